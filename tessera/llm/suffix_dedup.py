"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as the threshold, by passes over digits from the most significant on; a suffix
alone in its group leaves, and groups that hold to the full depth are the repeated windows. Passes over all suffixes
would shuffle many times the text, so the first digits are taken where they decide most:

1. Each window's first digit is its anchor, the 44 bytes of the least hash in it. Equal windows have equal anchors
   at equal places; neighbouring windows share one, and form a segment: one row for some 30 windows.
2. Segments whose anchor no other has are alone. The second digit is the whole segment: all windows of an equal,
   later segment are repeats.
3. Of anchors with unlike segments (the edges of passages, or an anchor that recurs by chance) the first segment of
   each kind goes on. A window has its anchor in one of four quarters: the bytes around the anchor that all windows
   of the quarter hold (86 of the 100) are the next digit, and keep the quarter's windows alive.
4. What is left is opened into windows, whose two halves are the last digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import RangeHash, discard, list_fields, materialize, mix64, runs_of_docs, text_bytes

LENGTH, ANCHOR = 100, 44
#: Texts are worked on in pieces of at most so many window starts; the places fit into 21 bits.
PIECE = 1 << 20
_OTHER = 0xD1342543DE82EF95


def pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of bytes with the documents in them: bytes, document numbers, starts and ends, place of the start in its document.

    A long document is cut so that each window lies in one stretch.
    """
    long_enough = np.flatnonzero(np.diff(offsets) >= length)
    k = 0
    while k < len(long_enough):
        a = offsets[long_enough[k]]
        m = k + 1
        while m < len(long_enough) and offsets[long_enough[m] + 1] - a <= PIECE:
            m += 1
        docs = long_enough[k:m]
        if m == k + 1 and offsets[docs[0] + 1] - a > PIECE:
            stop = offsets[docs[0] + 1]
            for p in range(a, stop - length + 1, PIECE):
                q = min(p + PIECE + length - 1, stop)
                yield data[p:q], docs, np.array([0]), np.array([q - p]), np.array([p - a])
        else:
            yield data[a : offsets[docs[-1] + 1]], docs, offsets[docs] - a, offsets[docs + 1] - a, np.zeros(len(docs), np.int64)
        k = m


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(2**64 - 1))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each segment: anchor hash, first window, number of windows, place of the anchor in the stretch."""
    h = RangeHash(data).every(ANCHOR)
    key = (h & np.uint64(2**64 - 2**21)) | np.arange(len(h), dtype=np.uint64)
    anchor = (least_in_window(key, length - ANCHOR + 1) & np.uint64(2**21 - 1)).view(np.int64)
    # A segment begins where the anchor changes or a document's windows begin; windows that reach into the next document go.
    turn = np.empty(len(anchor), bool)
    turn[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=turn[1:])
    turn[starts] = True
    gap = ends[:-1] - length + 1
    turn[gap] = True
    first = np.flatnonzero(turn)
    count = np.diff(first, append=len(anchor))
    inside = first < ends[np.searchsorted(starts, first, "right") - 1] - length + 1
    first, count = first[inside], count[inside]
    anchor = anchor[first]
    return h[anchor].view(np.int64), first, count, anchor


def segments(data: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each segment: anchor hash, content hash, document number, first window's place; number of windows * 256 + anchor's place in it."""
    h, first, count, anchor = anchored(data, starts, ends, length)
    content = RangeHash(data, _OTHER)(first, first + count + length - 1)
    g = mix64(content ^ (count.astype(np.uint64) << np.uint64(32)) ^ (anchor - first).astype(np.uint64))
    doc = np.searchsorted(starts, first, "right") - 1
    return h, g.view(np.int64), docs[doc], first - starts[doc] + place[doc], (count << 8) | (anchor - first)


def find_segments(df: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for piece in pieces(data, offsets, length):
                h, g, doc, pos, shape = segments(*piece, length)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), batch.column(0).take(pa.array(doc)), pa.array(pos, pa.int32()), pa.array(shape, pa.int32())], ["h", "g", "doc_id", "pos", "shape"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(run, f"h bigint, g bigint, doc_id {kind}, pos int, shape int")


def find_anchors(df: DataFrame, length: int) -> DataFrame:
    """Only the anchor hashes of find_segments()."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for piece, _, starts, ends, _ in pieces(data, offsets, length):
                yield pa.RecordBatch.from_arrays([pa.array(anchored(piece, starts, ends, length)[0])], ["h"])

    return df.select("text").mapInArrow(run, "h bigint")


def quarters(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each quarter of a window's possible anchor places: least and greatest place, and the bytes before and after the anchor that all its windows hold."""
    room = length - ANCHOR
    part, k = max(1, room // 4), np.arange(4)
    most = np.where(k < 3, np.minimum((k + 1) * part - 1, room), room)
    return k * part, most, k * part, np.maximum(0, room - most)


def sides(texts: DataFrame, length: int) -> DataFrame:
    """For each of the runs of texts(doc_id, text, runs) and each quarter its windows lie in: hash of the bytes that the quarter's windows have in common."""
    least, most, before, after = quarters(length)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            items, fields = list_fields(batch.column(2), ("pos", "n", "at"))
            for i, j in runs_of_docs(offsets, PIECE):
                pos, n, at = (x[items[i] : items[j]] for x in fields)
                doc = np.repeat(np.arange(i, j), np.diff(items[i : j + 1]))
                row, part = np.nonzero((at[:, None] >= least) & ((at - n + 1)[:, None] <= most))
                doc, pos, n, at = doc[row], pos[row], n[row], at[row]
                a = offsets[doc] - offsets[i] + pos + at
                digit = RangeHash(data[offsets[i] : offsets[j]])(a - before[part], a + ANCHOR + after[part]).view(np.int64)
                columns = [pa.array(x.astype(np.int32)) for x in (pos, n, at, part)] + [pa.array(digit)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *columns], ["doc_id", "pos", "n", "at", "part", "digit"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "runs").mapInArrow(run, f"doc_id {kind}, pos int, n int, at int, part int, digit bigint")


def open_windows(texts: DataFrame, length: int) -> DataFrame:
    """The windows in the live quarters of the runs of texts(doc_id, text, runs): hashes of their two halves, and place."""
    least, most, _, _ = quarters(length)
    half = length // 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            items, fields = list_fields(batch.column(2), ("pos", "n", "at", "part"))
            for i, j in runs_of_docs(offsets, PIECE):
                text = data[offsets[i] : offsets[j]]
                one, two = RangeHash(text), RangeHash(text, _OTHER)
                docs = np.repeat(np.arange(i, j), np.diff(items[i : j + 1]))
                for k in range(0, len(docs), 20_000):
                    doc = docs[k : k + 20_000]
                    pos, n, at, part = (x[items[i] : items[j]][k : k + 20_000] for x in fields)
                    first = pos + np.maximum(0, at - most[part])
                    count = pos + np.minimum(n - 1, at - least[part]) - first + 1
                    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    doc = np.repeat(doc, count)
                    start = offsets[doc] - offsets[i] + place
                    d1, d2 = one(start, start + half), two(start + half, start + length)
                    yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array(place.astype(np.int32))], ["d1", "d2", "doc_id", "pos"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "runs").mapInArrow(run, f"d1 bigint, d2 bigint, doc_id {kind}, pos int")


def cut_spans(texts: DataFrame, keep_text: bool) -> DataFrame:
    """texts(doc_id, text, spans) without the spans' bytes: n_bytes, n_removed, n_spans, kept_sha256[, kept_text, removed]."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            items, fields = list_fields(batch.column(2), ("a", "b"))
            out = [[] for _ in range(6)]
            for i, j in runs_of_docs(offsets, PIECE):
                text, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                doc = np.repeat(np.arange(j - i), np.diff(items[i : j + 1]))
                a, b = (np.minimum(own[doc] + x[items[i] : items[j]], own[doc + 1]) for x in fields)
                gone = np.cumsum(np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1))[:-1] > 0
                kept, left = text[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[own]
                # Runs end at their document's end.
                edge = np.concatenate((gone[:1], gone[1:] & ~gone[:-1], [False]))
                edge[own[:-1]] |= np.append(gone, False)[own[:-1]]
                heads = np.flatnonzero(edge)
                edge = np.concatenate(([False], gone[:-1] & ~gone[1:], gone[-1:]))
                edge[own[1:]] |= np.append(False, gone)[own[1:]]
                tails = np.flatnonzero(edge)
                turns = np.searchsorted(heads, own)
                for k in range(j - i):
                    rest, at = kept[left[k] : left[k + 1]], slice(turns[k], turns[k + 1])
                    values = own[k + 1] - own[k], own[k + 1] - own[k] - len(rest), turns[k + 1] - turns[k], hashlib.sha256(rest).hexdigest()
                    if keep_text:
                        values += rest, (np.stack((heads[at], tails[at]), 1) - own[k]).tolist()
                    for column, value in zip(out, values):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int32()))]
            n = 6 if keep_text else 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out[:n], types))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text", "removed"] * keep_text
    kind = texts.schema["doc_id"].dataType.simpleString()
    extra = ", kept_text binary, removed array<array<int>>" if keep_text else ""
    return texts.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Lists of spans (doc_id, spans) of repeated windows of docs(doc_id, text). Tables between are dropped once they are used."""
    found = find_segments(docs, length)
    again = find_anchors(docs, length).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    alive = materialize(found.join(again, "h"))
    here = F.struct("doc_id", "pos")
    equal = materialize(alive.groupBy("h", "g").agg(F.min(F.struct("doc_id", "pos", "shape")).alias("first")))
    later = alive.join(equal, ["h", "g"]).where(here != F.struct("first.doc_id", "first.pos")).select("doc_id", F.col("pos").alias("a"), (F.col("pos") + F.shiftright("shape", 8) + (length - 1)).alias("b"))
    later = materialize(later.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    discard(alive)
    unlike = equal.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    edges = equal.join(unlike, "h").select("first.*").groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.shiftright("shape", 8).alias("n"), F.expr("shape & 255").alias("at"))).alias("runs"))
    runs = materialize(sides(docs.join(edges, "doc_id"), length))
    discard(equal)
    shared = runs.groupBy("part", "digit").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    live = runs.join(shared, ["part", "digit"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n", "at", "part")).alias("runs"))
    windows = materialize(open_windows(docs.join(live, "doc_id"), length))
    discard(runs)
    whole = windows.groupBy("d1", "d2").agg(F.min(here).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    repeats = windows.join(whole, ["d1", "d2"]).where(here != F.col("first")).select("doc_id", F.col("pos").alias("a"), (F.col("pos") + length).alias("b"))
    repeats = materialize(repeats.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    discard(windows)
    return later.unionByName(repeats)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with keep_text also kept_text, removed) for each row of df.

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a smaller id, or earlier
    in the same document. Texts are taken whole, as UTF-8 bytes; null is empty. Rows with one id are one document:
    repeated rows get the same result and don't count as copies of each other. Rows with a null id are kept whole.
    Texts shorter than `length` lose nothing. An empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = docs.where("doc_id is not null")
    per_doc = repeated_spans(texts, length).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = cut_spans(texts.join(per_doc, "doc_id"), keep_text)
    cut = cut.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in cut.columns if c not in ("doc_id", "n_bytes")))
    rest = [F.col("text").cast("binary").alias("text")] * keep_text
    whole = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *rest)
    more = [F.coalesce("kept_text", "text").alias("kept_text"), "removed"] * keep_text
    return whole.join(cut, "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *more)
