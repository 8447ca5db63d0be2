"""Line deduplication that can be taken back: exact reference counts of lines, and cuckoo filters of the frequent ones.

An exact table holds in how many documents each line's key occurs. The keys that reach the threshold are also in cuckoo
filters, one for each shard of the keys. Inserting documents adds to the counts, deleting takes off; keys that cross
the threshold enter or leave their shard's filter, which a Bloom filter could not do. A document's lines meet the
filters, some bytes a frequent key, and only what the filters let pass is looked up in the exact table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, materialize, mix64

THRESHOLD, LEAST_CHARS = 10, 1
#: Frequent keys of a shard when it is laid out; with more than twice as many on average, shards are laid out anew.
PER_SHARD = 1 << 16
#: (document, line) pairs that one task holds against a filter.
PER_TASK = 1 << 18
#: Documents of one key that travel in one row.
PER_ROW = 1 << 12
SLOTS, KICKS, LOAD = 4, 500, 0.85
_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; each key has two buckets. Keys are pairs of 64-bit hashes, shape (n, 2)."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = len(slots) - 1

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 1) -> CuckooFilter:
        """A filter of the keys, as large as they need."""
        buckets = max(2, room)
        while buckets * SLOTS * LOAD < len(keys):
            buckets *= 2
        while not (made := cls(np.zeros((buckets, SLOTS), np.uint16))).insert(keys):
            buckets *= 2
        return made

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, first and second bucket of each key."""
        print_ = np.maximum(keys[:, 0] >> np.uint64(48), np.uint64(1))
        one = keys[:, 1] & np.uint64(self.mask)
        return print_.astype(np.uint16), one.astype(np.int64), (one ^ (mix64(print_) & np.uint64(self.mask))).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are not in; true for one of some 8,000 others."""
        print_, one, two = self.places(keys)
        return (self.slots[one] == print_[:, None]).any(axis=1) | (self.slots[two] == print_[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds the keys; False if there is no room, which leaves the filter unusable."""
        slots, turn = self.slots, 0
        for print_, one, two in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (one, two):
                free = np.flatnonzero(slots[bucket] == 0)
                if len(free):
                    slots[bucket, free[0]] = print_
                    break
            else:
                bucket = two
                for _ in range(KICKS):
                    turn = (turn + 1) % SLOTS
                    print_, slots[bucket, turn] = int(slots[bucket, turn]), print_
                    bucket = int(bucket ^ (int(mix64(np.array([print_], np.uint64))[0]) & self.mask))
                    free = np.flatnonzero(slots[bucket] == 0)
                    if len(free):
                        slots[bucket, free[0]] = print_
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that are in."""
        for print_, one, two in zip(*(x.tolist() for x in self.places(keys))):
            bucket = one if (self.slots[one] == print_).any() else two
            self.slots[bucket, np.flatnonzero(self.slots[bucket] == print_)[0]] = 0


@dataclass
class LineIndex:
    """refs(key, refs): documents that each key occurs in; filters(shard, buckets, items, slots): the frequent ones."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    threshold: int = THRESHOLD
    least_chars: int = LEAST_CHARS


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).translate(_LOWER)


def key_pairs(column) -> np.ndarray:
    """An Arrow column of 16-byte digests as pairs of 64-bit numbers."""
    import pyarrow as pa

    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary(16))
    if not len(column):
        return np.zeros((0, 2), np.uint64)
    return np.frombuffer(column.buffers()[1], np.uint64, 2 * len(column), 16 * column.offset).reshape(-1, 2)


def row_key(id_col: str, text: Column) -> Column:
    """A row is known by a digest of its id and text; rows that share it are alike in all that matters."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text).cast("binary")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text).alias("row"), text.alias("text"))


def line_pairs(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, key) for each row of docs and each distinct key of its lines: the MD5 of the stripped, lower-cased line."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["row", "key"]
        for batch in batches:
            keys, owner = [], []
            for i, text in enumerate(batch.column(1)):
                found = {line_key(x) for x in text.as_py().encode().split(b"\n")}
                found = [hashlib.md5(x).digest() for x in found if len(x) >= least_chars and (least_chars <= 1 or len(x.decode()) >= least_chars)]
                keys += found
                owner += [i] * len(found)
                if len(keys) > 200_000:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(keys, pa.binary())], names)
                    keys, owner = [], []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(keys, pa.binary())], names)

    return materialize(keyed(docs, id_col, text_col).select("row", "text").mapInArrow(run, "row binary, key binary"))


def count_keys(pairs: DataFrame) -> DataFrame:
    """key, refs; a key of very many documents is combined before the shuffle."""
    return pairs.groupBy("key").agg(F.count("*").alias("refs"))


def _sharded(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))


_FILTER = "shard int, buckets int, items int, slots binary"


def _as_table(shard: int, items: int, made: CuckooFilter):
    import pyarrow as pa

    columns = [pa.array([shard], pa.int32()), pa.array([len(made.slots)], pa.int32()), pa.array([items], pa.int32()), pa.array([made.slots.tobytes()], pa.binary())]
    return pa.Table.from_arrays(columns, ["shard", "buckets", "items", "slots"])


def _slots(filters) -> np.ndarray:
    return np.frombuffer(filters.column("slots")[0].as_py(), np.uint16).reshape(-1, SLOTS)


def _filters(frequent: DataFrame, shards: int) -> DataFrame:
    """A filter for each shard that has one of the keys of frequent(key)."""

    def build(keys):
        found = key_pairs(keys.column("key"))
        return _as_table(keys.column("shard")[0].as_py(), len(found), CuckooFilter.of(found))

    return _sharded(frequent, shards).groupBy("shard").applyInArrow(build, _FILTER)


def build_index(docs: DataFrame | None = None, pairs: DataFrame | None = None, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, **kw) -> LineIndex:
    """The index of docs, or of their line_pairs()."""
    refs = materialize(count_keys(line_pairs(docs, least_chars, **kw) if pairs is None else pairs))
    return _laid_out(refs, threshold, least_chars)


def _laid_out(refs: DataFrame, threshold: int, least_chars: int) -> LineIndex:
    frequent = refs.where(F.col("refs") >= threshold).select("key")
    shards = -(-frequent.count() // PER_SHARD) or 1
    return LineIndex(refs, materialize(_filters(frequent, shards)), shards, threshold, least_chars)


def insert(index: LineIndex, docs: DataFrame, **kw) -> LineIndex:
    """The index with docs added; the old one stays as it is."""
    return _changed(index, line_pairs(docs, index.least_chars, **kw), 1)


def delete(index: LineIndex, docs: DataFrame, **kw) -> LineIndex:
    """The index without docs, rows that it has counted, with the texts that they had; insert() and delete() undo each other."""
    return _changed(index, line_pairs(docs, index.least_chars, **kw), -1)


def _changed(index: LineIndex, pairs: DataFrame, sign: int) -> LineIndex:
    delta = count_keys(pairs).select("key", (F.col("refs") * sign).alias("change"))
    both = index.refs.join(delta, "key", "full").select("key", F.coalesce("refs", F.lit(0)).alias("was"), (F.coalesce("refs", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("refs"))
    both = materialize(both)
    refs = both.where("refs > 0").select("key", "refs")
    over = lambda c: F.col(c) >= index.threshold
    if both.where(over("refs")).count() > 2 * PER_SHARD * index.shards:
        return _laid_out(refs, index.threshold, index.least_chars)
    crossed = _sharded(both.where(over("was") != over("refs")).select("key", over("refs").alias("enters")), index.shards)

    def update(filters, changes):
        found = key_pairs(changes.column("key"))
        enters = np.array(changes.column("enters").to_pylist(), bool)
        if not len(found):
            return filters.append_column("full", _flags(False))
        shard = changes.column("shard")[0].as_py()
        if not len(filters):
            return _as_table(shard, len(found), CuckooFilter.of(found)).append_column("full", _flags(False))
        made, items = CuckooFilter(_slots(filters).copy()), filters.column("items")[0].as_py() + int(enters.sum()) - int((~enters).sum())
        made.delete(found[~enters])
        full = items > SLOTS * len(made.slots) * LOAD or not made.insert(found[enters])
        return _as_table(shard, items, made).append_column("full", _flags(full))

    def _flags(x: bool):
        import pyarrow as pa

        return pa.array([x], pa.bool_())

    updated = materialize(index.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(update, _FILTER + ", full boolean"))
    kept = updated.where("not full and items > 0").drop("full")
    full = _sharded(refs.where(F.col("refs") >= index.threshold).select("key"), index.shards).join(updated.where("full").select("shard"), "shard", "left_semi")
    return LineIndex(refs, materialize(kept.unionByName(_filters(full.select("key"), index.shards))), index.shards, index.threshold, index.least_chars)


def frequent_pairs(pairs: DataFrame, index: LineIndex) -> DataFrame:
    """(row, keys) for each row of pairs(row, key) that has keys of at least the threshold's documents.

    Each shard's pairs are dealt to as many tasks as their counted number needs, so that neither a line of a third of all
    documents nor any other set of pairs meets in one task. What a filter lets pass travels in rows of one key and many
    documents, and is confirmed against the exact counts.
    """
    spark, shards = pairs.sparkSession, index.shards
    load = _sharded(pairs, shards).groupBy("shard").agg((F.floor(F.count("*") / PER_TASK) + 1).cast("int").alias("parts"))
    load = materialize(load.join(index.filters.select("shard"), "shard", "left_semi"))
    # one number a shard, in the shards' order, 0 where there is nothing to look for
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(load, "shard", "left").na.fill(0)
    parts = F.get(every.agg(F.array_sort(F.collect_list(F.struct("shard", "parts"))).alias("x")).select(F.col("x.parts")).scalar(), F.col("shard"))
    dealt = _sharded(pairs, shards).withColumn("parts", parts).where("parts > 0").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts")
    filters = index.filters.join(load, "shard").select("shard", "slots", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def probe(left, right):
        import pyarrow as pa

        names, kinds = ["key", "rows"], [pa.binary(), pa.list_(pa.binary())]
        keys = key_pairs(left.column("key"))
        hit = np.flatnonzero(CuckooFilter(_slots(right)).contains(keys)) if len(keys) and len(right) else np.zeros(0, np.int64)
        if not len(hit):
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        order = hit[np.lexsort((keys[hit, 1], keys[hit, 0]))]
        new = np.flatnonzero((np.diff(keys[order], axis=0, prepend=~keys[order[:1]]) != 0).any(axis=1))
        cuts = np.unique(np.concatenate([np.arange(a, b, PER_ROW) for a, b in zip(new, [*new[1:], len(order)])]))
        rows = left.column("row").combine_chunks().cast(pa.binary()).take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array([*cuts, len(order)], pa.int32()), rows)
        return pa.Table.from_arrays([left.column("key").combine_chunks().cast(pa.binary()).take(pa.array(order[cuts])), lists], names)

    passed = dealt.groupBy("shard", "part").cogroup(filters.groupBy("shard", "part")).applyInArrow(probe, "key binary, rows array<binary>")
    exact = passed.join(index.refs.where(F.col("refs") >= index.threshold).select("key"), "key", "left_semi")
    return exact.select("key", F.explode("rows").alias("row")).groupBy("row").agg(F.collect_set("key").alias("keys"))


def drop_lines(docs: DataFrame, index: LineIndex, pairs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (with keep_text also kept_text) for each row of docs.

    A text is cut at LF; a line's key is the line without the white space (space, tab, LF, VT, FF, CR) at its ends, A-Z
    lower-cased. Lines whose key has at least the index's least_chars code points and at least its threshold of documents
    go; the others stay as they are, joined by LF. `pairs` are line_pairs() of docs, where they are at hand.

    A document is a row: repeated rows count each, whatever their ids, and rows with a null id count like others. Null and
    empty text is one empty line, which stays. An empty table gives an empty result; other columns are ignored.
    """
    texts = keyed(docs, id_col, text_col)
    gone = frequent_pairs(line_pairs(docs, index.least_chars, id_col, text_col) if pairs is None else pairs, index)
    least = index.least_chars

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(4)]
            for text, drop in zip(batch.column(1), batch.column(2)):
                lines, drop = text.as_py().encode().split(b"\n"), set(drop.as_py() or ())
                kept = lines
                if drop:
                    kept = [x for x in lines if not (len(k := line_key(x)) >= least and hashlib.md5(k).digest() in drop)]
                whole = b"\n".join(kept)
                for column, value in zip(out, (len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest(), whole)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()][: 3 + keep_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept_text"] * keep_text
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.join(gone, "row", "left").select("doc_id", "text", "keys").mapInArrow(run, f"doc_id {kind}, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept_text binary" * keep_text)
    return found.withColumn("kept_text", F.col("kept_text").cast("string")) if keep_text else found


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, **kw) -> DataFrame:
    """drop_lines() of docs by an index of themselves: lines of at least `threshold` documents go from all of them."""
    own = {k: v for k, v in kw.items() if k in ("id_col", "text_col")}
    pairs = line_pairs(docs, least_chars, **own)
    return drop_lines(docs, build_index(pairs=pairs, threshold=threshold, least_chars=least_chars), pairs, **kw)
