"""Drawing documents that look like a target text: importance weights from hashed n-grams, Gumbel keys, exact selection.

Every run of one to three words falls into a bucket by its CRC-32. The buckets' gains, log ratios of target to raw
frequency as whole thousandths, are one array of fixed size; a document's weight is the sum over its features. The
cut of the draw is found by weighted medians of medians over the partitions of the keys, and only winners are sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, lower_bytes, materialize, runs_of_docs, text_bytes

BUCKETS, MOST_WORDS, SCALE = 10_000, 3, 1000
PERCENT, LEAST_WORDS, SEED = 5, 20, "42"
#: Winners that one task sorts.
PER_SORT = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    """The remainders of all bytes by the reflected CRC-32 polynomial."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def _shifts() -> np.ndarray:
    """shift[n, k, b]: what byte k = b of a checksum becomes when n more bytes follow; the checksum is linear in its bits."""
    out = np.empty((LONG + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG + 1):
        out[n] = _CRC[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shifts()
_ONES = np.uint32(0xFFFFFFFF)


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (letters, digits and all beyond ASCII) of lower-cased bytes; each document's first word."""
    word = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.concatenate(([False], word)), np.concatenate((word, [False]))
    starts, ends = np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: byte by byte over all words at once, those of over LONG bytes one by one."""
    size = ends - starts
    state = np.full(len(starts), _ONES)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    order = order[np.count_nonzero(size > LONG) :]
    left = size[order]
    for k in range(LONG):
        n = int(np.searchsorted(-left, -k, "left"))
        if not n:
            break
        at = order[:n]
        s = state[at]
        state[at] = _CRC[(s ^ data[starts[at] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out = state ^ _ONES
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def append_word(crc: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with checksum `crc` and a space and a word after them; words are of at most LONG bytes."""
    state = crc ^ _ONES
    crc = _CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)) ^ _ONES
    out = word.copy()
    for k in range(4):
        out ^= _SHIFT[size, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the documents, the document of each feature, and the number of words of each document."""
    data = lower_bytes(data)
    starts, ends, first = words_in(data, offsets)
    doc, size = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), ends - starts
    single = word_crcs(data, starts, ends)
    crcs, docs = [single], [doc]
    long_ = size > LONG
    for n in range(2, MOST_WORDS + 1):
        m = max(0, len(single) - n + 1)
        last = slice(n - 1, n - 1 + m)
        crc = append_word(crcs[-1][:m], single[last], np.minimum(size[last], LONG))
        for i in np.flatnonzero(long_[last]):
            crc[i] = zlib.crc32(b" " + data[starts[i + n - 1] : ends[i + n - 1]].tobytes(), int(crcs[-1][i]))
        crcs.append(crc)
        docs.append(doc[:m])
    kept = [np.ones(len(single), bool)] + [doc[: len(c)] == doc[n : n + len(c)] for n, c in enumerate(crcs[1:], 1)]
    return np.concatenate([c[k] for c, k in zip(crcs, kept)]) % np.uint32(buckets), np.concatenate([d[k] for d, k in zip(docs, kept)]), np.diff(first)


def count_buckets(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts; each task adds up its own, at most `buckets` rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in runs_of_docs(offsets):
                a, b = offsets[i], offsets[j]
                total += np.bincount(feature_buckets(data[a:b], offsets[i : j + 1] - a, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return texts.select(F.col(text_col)).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of each bucket, floor(1000 ln(((t + 1) (S + buckets)) / ((s + 1) (T + buckets)))): an array of fixed size."""
    counts = count_buckets(docs, text_col, buckets).withColumnRenamed("n", "s").join(count_buckets(target, target_col, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["s", "t"])
    row = every.agg(F.array_sort(F.collect_list(F.struct("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t")))).alias("c"), F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    ratio = lambda x: (x["t"] + 1.0) * (F.col("s") + float(buckets)) / ((x["s"] + 1.0) * (F.col("t") + float(buckets)))
    return np.array(row.select(F.transform("c", lambda x: F.floor(F.lit(float(SCALE)) * F.log(ratio(x)))).alias("g")).first()["g"], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs: the sum of its features' gains."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for i, j in runs_of_docs(offsets):
                a, b = offsets[i], offsets[j]
                bucket, doc, words = feature_buckets(data[a:b], offsets[i : j + 1] - a, len(gains))
                out[0][i:j], out[1][i:j] = words, np.bincount(doc, minlength=j - i)
                out[2][i:j] = np.bincount(doc, gains[bucket], j - i)  # whole numbers, far below 2**53
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel_score(weight: Column, id_col: str, seed: str = SEED) -> Column:
    """weight + floor(-1000 ln(-ln u)) with u from a SHA-256 of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    u = (h + 0.5) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))).cast("bigint")


#: The order of the draw: (least first) negative score, id (null last), place in the table.
KEY = ("k1", "k2", "k3", "k4")


def with_key(df: DataFrame) -> DataFrame:
    """df(score, doc_id, row) with the parts of its key, all of them whole numbers; keys are distinct, since rows are."""
    return df.withColumns({"k1": -F.col("score"), "k2": F.col("doc_id").isNull().cast("bigint"), "k3": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "k4": F.col("row")})


def at_most(key: tuple[int, ...]) -> Column:
    """Whether a row's key is not beyond the given one."""
    out = F.col(KEY[-1]) <= key[-1]
    for c, x in list(zip(KEY, key))[-2::-1]:
        out = (F.col(c) < x) | ((F.col(c) == x) & out)
    return out


def medians(keys: DataFrame) -> list[tuple]:
    """(key, n) of each partition that has rows: its median key and its number of rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else []
        if columns and len(columns[0]):
            at = np.lexsort(columns[::-1])[(len(columns[0]) - 1) // 2]
            yield pa.RecordBatch.from_arrays([pa.array([c[at]], pa.int64()) for c in columns] + [pa.array([len(columns[0])], pa.int64())], [*KEY, "n"])

    found = keys.select(*KEY).mapInArrow(run, ", ".join(f"{k} bigint" for k in KEY) + ", n bigint").collect()
    return sorted((tuple(r[k] for k in KEY), r["n"]) for r in found)


def cutoff(keys: DataFrame, k: int) -> tuple[int, ...] | None:
    """The k-th least key of a written table of distinct keys, None for k = 0; k is at most the number of rows.

    Each round takes the median of what is left in each partition, one row each, and the median of those weighted by
    the partitions' rows left: at least a quarter of the rows lies on either side of it. The side that cannot hold the
    k-th is discarded, in every partition, until the pivot is the k-th itself. What is left is written anew when it is
    less than a quarter of the last table, so that all rounds together read a few times the first.
    """
    if k < 1:
        return None
    base, above, below, size, own = keys.select(*KEY), None, None, None, False
    while True:
        left = base if above is None else base.where(~at_most(above))
        left = left if below is None else left.where(at_most(below) & ~_same(below))
        found = medians(left)
        total, seen = sum(n for _, n in found), 0
        for pivot, n in found:
            seen += n
            if 2 * seen >= total:
                break
        upto = left.where(at_most(pivot)).count()
        if upto == k:
            break
        if upto > k:
            below, rest, left = pivot, upto - 1, left.where(at_most(pivot) & ~_same(pivot))
        else:
            above, k, rest, left = pivot, k - upto, total - upto, left.where(~at_most(pivot))
        size = size or total
        if 4 * rest < size:
            fewer = materialize(left)
            if own:
                discard(base)
            base, above, below, size, own = fewer, None, None, rest, True
    if own:
        discard(base)
    return pivot


def _same(key: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for c, x in zip(KEY, key):
        out = out & (F.col(c) == x)
    return out


def ranked(winners: DataFrame, n: int) -> DataFrame:
    """row, rank of n rows in the order of their keys: sorted in ranges, with the number of rows in the ranges before."""
    parts = -(-n // PER_SORT) or 1
    dealt = materialize(winners.select(*KEY).repartitionByRange(parts, *KEY).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*KEY))
    return dealt.withColumn("inside", inside).join(before, "range").select(F.col("k4").alias("row"), (F.col("inside") + F.col("before")).cast("bigint").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs; rank is null for what is not drawn.

    Of the documents with at least `least_words` words, `percent` of 100 are drawn, rounded down: those of the highest scores, of
    equal scores those of the smaller ids (null last), of repeated rows the first in the table. A document is a row. Null
    and empty text has no words, no features and the weight 0. Features of one text never reach into another. An empty
    target gives each bucket the gain of its raw count alone; an empty table gives an empty result; other columns are ignored.
    """
    gains = bucket_gains(docs, target, buckets, text_col, target_col)
    scored = weigh(docs, gains, id_col, text_col).withColumn("score", gumbel_score(F.col("weight"), "doc_id", seed))
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()))
    keys = with_key(scored.where(F.col("n_words") >= least_words))
    k = percent * keys.count() // 100
    cut = cutoff(keys, k)
    winners = keys.where(at_most(cut) if cut else F.lit(False))
    return scored.join(ranked(winners, k), "row", "left").drop("row")
