"""Near-duplicates by SetSketch registers: bands of registers, a joint likelihood estimate, then the full sets.

A register holds floor(1 - log_b x), cut to 0..q+1, of the smallest of exponential values that the set's elements
draw for it: mergeable by maximum, and equal in two sets about as often as the sets are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import RangeHash, lower_bytes, materialize, mix64, runs_of_docs, shared_dir, text_bytes, word_spans

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
REGISTERS, MISS = 120, 1e-6
BASE, RATE, LIMIT = 1.02, 20.0, 2000
#: Candidates whose estimated similarity is lower than the threshold by so much (over five standard errors) are not verified.
#: A pair at the threshold is so lost with 1.1e-8 at 85 percent, 3.1e-7 at 80; with the bands' miss it stays below MISS.
SLACK = 0.2
#: Pairs whose share of equal registers is lower than the threshold by so much are not estimated.
FAR = 0.35
#: A block holds about so many documents or shingles at most.
BLOCK, SHINGLES = 512, 1 << 22

_rng = np.random.default_rng(777)
_FLIP = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**62, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_layout(percent: int) -> tuple[int, int]:
    """Bands and rows a band: as many rows as leave a pair at the threshold without a common band with less than MISS.

    Equal registers are reckoned as often as the sets are alike; in sets of one size they are a little more often.
    """
    for rows in (6, 5, 4, 3, 2, 1):
        if (1 - (percent / 100) ** rows) ** (REGISTERS // rows) < MISS:
            return REGISTERS // rows, rows
    raise ValueError(f"{REGISTERS} registers cannot find pairs at {percent} percent")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    starts, ends, first = word_spans(data, offsets)
    h = RangeHash(lower_bytes(data))(starts, ends)
    n = max(0, len(h) - words + 1)
    full = np.zeros(n, np.uint64)
    for k in range(words):
        full += h[k : k + n] * _PLACE[k]
    full = mix64(full)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            short = (h[a:b] * _PLACE[words : words + b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (sets by REGISTERS, int16) of non-empty sets."""
    every, heads = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((REGISTERS, len(sets)), np.uint64)
    for i in range(REGISTERS):
        x = every ^ _FLIP[i]
        x *= _TIMES[i]
        x ^= x >> np.uint64(32)
        x *= _TIMES[i - 1]
        least[i] = np.minimum.reduceat(x, heads)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64 + 1e-17) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1).astype(np.int16)


def band_keys(regs: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A 64-bit key for each band of each row of registers, laid out for the threshold; the band is part of the key."""
    bands, rows = band_layout(percent)
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    return mix64((parts * _PLACE[:rows]).sum(axis=2, dtype=np.uint64) * _PLACE[20] + mix64(np.arange(bands, dtype=np.uint64) + np.uint64(99))).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 101) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from their registers jointly (greater, smaller, equal) and set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for k in range(steps):
        j = top * k / (steps - 1)
        up, down = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(more > 0, more * np.log(up), 0) + np.where(less > 0, less * np.log(down), 0) + np.where(same > 0, same * np.log(np.maximum(1 - up - down, 1e-300)), 0)
        better = value > best
        best, at = np.where(better, value, best), np.where(better, j, at)
    return at


def sketch(df: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set_id (32 bytes of set hash as two longs), regs, keys for each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in runs_of_docs(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full = [k for k, s in enumerate(sets) if len(s)]
                regs = np.zeros((len(sets), REGISTERS), np.int16)
                if full:
                    regs[full] = registers([sets[k] for k in full])
                own = np.array([[s.sum(dtype=np.uint64), mix64(s).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
                keys = band_keys(regs, percent)
                none = np.array([len(s) == 0 for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(own[:, 0], mask=none), pa.array(own[:, 1], mask=none), pa.array([r.tobytes() for r in regs], pa.binary()), lists], ["doc_id", "n", "s1", "s2", "regs", "keys"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n bigint, s1 bigint, s2 bigint, regs binary, keys array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep, items: the sorted shingle hashes of docs(rep, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in runs_of_docs(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "items"])

    return docs.select("rep", "text").mapInArrow(run, f"rep {docs.schema['rep'].dataType.simpleString()}, items binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are linked, on the full sets."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_pairs(table, percent: int) -> np.ndarray:
    """Rows i, j and likelihood estimate of the pairs of a task that may be linked, the likeliest first.

    Pairs are of block lo with block hi, of unlike labels, without a common band before the task's own (there they meet
    as well), and with registers near enough.
    """
    lo, hi, block, band = (table.column(c).to_numpy() for c in ("lo", "hi", "block", "band"))
    label = np.unique(table.column("label").to_pylist(), return_inverse=True)[1]
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.int16).reshape(len(block), -1)
    n = table.column("n").to_numpy().astype(float)
    left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
    rows, found = band_layout(percent)[1], []
    for i in left:
        js = right[right > i] if lo[0] == hi[0] else right
        js = js[(label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
        same = regs[js] == regs[i]
        js = js[(same.mean(axis=1) >= percent / 100 - FAR) & ~same[:, : band[0] * rows].reshape(len(js), band[0], rows).all(axis=2).any(axis=1)]
        if len(js):
            found.append(np.stack([np.full(len(js), i), js]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    likely = np.zeros(len(i))
    for k in range(0, len(i), 50_000):
        x, y = i[k : k + 50_000], j[k : k + 50_000]
        likely[k : k + 50_000] = estimate(regs[x], regs[y], n[x], n[y])
    order = np.argsort(-likely, kind="stable")
    return np.stack([i, j])[:, order[likely[order] >= percent / 100 - SLACK]]


def candidates_within(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of dealt(key, lo, hi, rep, block, label, band, n, regs) that have a near pair in their task, without registers."""
    columns = ["key", "lo", "hi", "rep", "block", "label", "band"]

    def run(table):
        return table.select(columns).take(np.unique(near_pairs(table, percent)))

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, dealt.select(columns).schema)


def links_within(dealt: DataFrame, percent: int) -> DataFrame:
    """Ties (a, b) of what verified links join in each task of dealt(key, lo, hi, rep, block, label, band, n, regs, items).

    Near pairs are verified on the full sets, the likeliest first, unless earlier links already join their labels.
    Each label that is joined is tied to the smallest that it is joined with, so that ties form no long chains.
    """
    kind = dealt.schema["label"].dataType.simpleString()

    def run(table):
        import pyarrow as pa

        names, label = np.unique(table.column("label").to_pylist(), return_inverse=True)
        parent = list(range(len(names)))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        for i, j in near_pairs(table, percent).T:
            u, v = root(label[i]), root(label[j])
            if u != v and alike(sets[i], sets[j], percent):
                parent[max(u, v)] = min(u, v)
        joined = [v for v in range(len(names)) if root(v) != v]
        own = table.schema.field("label").type
        return pa.table({"a": pa.array([names[root(v)] for v in joined], own), "b": pa.array([names[v] for v in joined], own)})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """v, component (the smallest id reachable) for every end of edges(a, b), by contraction.

    In each round each vertex goes up two steps to its least neighbour's least neighbour, and the edges are rewritten
    to where their ends went: what is not a local minimum vanishes, so that half the vertices or fewer are left. The
    rounds' steps, one after the other, give the components. Lineage is cut by checkpoint() in the shared folder.
    """
    shared_dir(edges.sparkSession)
    left, steps = edges.select("a", "b").where("a <> b").distinct().checkpoint(), []
    while left.limit(1).count():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("w")))
        near = both.groupBy("v").agg(F.least("v", F.min("w")).alias("p"))
        step = near.join(near.select(F.col("v").alias("p"), F.col("p").alias("up")), "p").select("v", "up").checkpoint()
        steps.append(step)
        for end in ("a", "b"):
            left = left.join(step.withColumnRenamed("v", end), end).withColumn(end, F.col("up")).drop("up")
        left = left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    if not steps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("component"))
    label = steps[0].withColumnRenamed("up", "component")
    for step in steps[1:]:
        label = label.join(step.withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("up", "component").alias("component"))
    return label


def stars(ties: DataFrame) -> DataFrame:
    """Each document of ties(rep, key, band, hub, n) with the hub that it shares most bands with: key, lo, hi, rep, block, label, band.

    A hub's documents are dealt into parts of bounded weight, and the hub goes to each part.
    """
    best = ties.where("rep <> hub").groupBy("rep", "hub").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    best = best.groupBy("rep").agg(F.min(F.struct((-F.col("c")).alias("c"), "hub", "n")).alias("best")).select("rep", F.col("best.hub").alias("key"), "best.n")
    parts = best.groupBy("key").agg(_blocks("n").alias("parts"))
    members = best.join(parts, "key").select("key", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("lo"), "rep")
    hubs = parts.select("key", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("lo"), F.col("key").alias("rep"))
    return members.unionByName(hubs).select("key", "lo", F.col("lo").alias("hi"), "rep", F.col("lo").alias("block"), F.col("rep").alias("label"), F.lit(0).alias("band"))


def _blocks(n: str) -> Column:
    """How many blocks hold a group's documents, a document weighing its set, but at least its share of a block."""
    return F.ceil(F.sum(F.greatest(F.lit(SHINGLES // BLOCK), F.col(n))) / SHINGLES)


def mixed_buckets(ties: DataFrame) -> DataFrame:
    """The buckets of ties(rep, key, band, label, n) that hold more than one label, in tasks of two blocks: key, lo, hi, rep, block, label, band.

    A label that fills more than a block has blocks of its own, which never meet each other; all other pairs of blocks do.
    """
    many = ties.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    sizes = ties.join(many, "key", "left_semi").groupBy("key", "label").agg(_blocks("n").alias("own"), F.sum(F.greatest(F.lit(SHINGLES // BLOCK), F.col("n"))).alias("weight"))
    sizes = materialize(sizes)
    shared = F.ceil(F.sum(F.when(F.col("own") == 1, F.col("weight"))) / SHINGLES)
    totals = sizes.groupBy("key").agg(F.coalesce(shared, F.lit(0)).alias("shared"), F.coalesce(F.sum(F.when(F.col("own") > 1, F.col("own"))), F.lit(0)).alias("apart"))
    large = sizes.where("own > 1").withColumn("first", F.sum("own").over(Window.partitionBy("key").orderBy("label")) - F.col("own")).select("key", "label", "own", "first")
    placed = ties.join(totals, "key").join(large, ["key", "label"], "left").withColumn("first", F.col("shared") + F.col("first"))
    block = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("rep"), "shared")).otherwise(F.col("first") + F.pmod(F.xxhash64("rep"), "own"))
    others = F.filter(F.sequence(F.lit(0), (F.col("shared") + F.col("apart") - 1).cast("int")), lambda o: F.col("own").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("own")))
    dealt = placed.withColumn("block", block.cast("int")).select("key", "rep", "label", "band", "block", F.explode(others).alias("other"))
    return dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "block", "label", "band")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df.

    1. Equal sets form a class; its smallest id stands for it, so that copies cost no pairs.
    2. Classes that share a band key form a bucket. Each class goes to the smallest id of the bucket that it shares
       most bands with, and is compared there with those that went with it: groups of like texts join in one pass, at
       a cost in proportion to their size.
    3. Buckets that still hold classes not joined are compared in full: pairs of blocks of bounded weight by their
       registers, then, where registers come near the threshold, on full sets. What a pass joined meets no more.
       Tasks return no more links than join their members; the links' components are the result.

    Null, empty or blank text has the empty set, linked with nothing. Rows with one id are taken as one document:
    a repeated row gets the same component. Null ids are never linked. An empty table gives an empty result; other
    columns are ignored.
    """
    rows = materialize(sketch(df, id_col, text_col, percent))
    classes = materialize(rows.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min("regs").alias("regs"), F.min("keys").alias("keys")))
    member = classes.select("rep", "n", F.posexplode("keys").alias("band", "key"))
    buckets = materialize(member.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1").select("key", "hub"))
    ties = materialize(member.join(buckets, "key"))
    reps = materialize(ties.select("rep").distinct())
    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(reps, "rep", "left_semi")
    sets = full_sets(texts).groupBy("rep").agg(F.min("items").alias("items"))
    full = materialize(classes.select("rep", "n", "regs").join(reps, "rep", "left_semi").join(sets, "rep"))
    label = components(materialize(links_within(stars(ties).join(full, "rep"), percent))).select(F.col("v").alias("rep"), F.col("component").alias("label"))
    ties = materialize(ties.drop("hub").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    near = candidates_within(mixed_buckets(ties).join(full.select("rep", "n", "regs"), "rep"), percent)
    later = components(materialize(links_within(near.join(full, "rep"), percent))).select(F.col("v").alias("label"), "component")
    final = classes.select("s1", "s2", "n", "rep").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    final = final.join(later, "label", "left").select("s1", "s2", "n", F.coalesce("component", "label").alias("component_id"))
    out = rows.select("doc_id", "n", "s1", "s2").join(final, ["s1", "s2", "n"], "left").withColumn("component_id", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
