"""Clusterings that Spark ML lacks: bottom-up merging over micro-clusters, and density clusters over cells."""

from __future__ import annotations

from itertools import product
from math import sqrt

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.shared import cut_lineage
from tessera.operators.graph import components
from tessera.operators.order import exact_quantiles

#: Rows are merged from at most so many micro-clusters on; so many merges stand in a dendrogram.
MICRO = 256
#: Points of a cell that are held at a time against those of another.
PART = 4_096


def standard_point(df: DataFrame, cols: list[str], scale: bool = True) -> Column:
    """The columns as one array: nulls and NaN are the exact median, and with `scale` each is standardised by the population deviation."""
    middle = {r["column_name"]: (r["q"] or [0.0])[0] for r in exact_quantiles(df, cols, [0.5]).collect()}
    filled = {c: F.coalesce(C.value(df, c).cast("double"), F.lit(float(middle[c]))) for c in cols}
    if not scale:
        return F.array(*filled.values())
    row = df.agg(*(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(c) for c, x in filled.items())).first()
    return F.array(*((x - F.lit(row[c]["m"] or 0.0)) / F.lit(row[c]["s"] or 1.0) for c, x in filled.items()))


def ward_merges(sizes: list[float], centres: list[list[float]]) -> list[tuple[int, int, float, float]]:
    """(left, right, height, size) of each merge, from the lowest: ids below len(sizes) are the given clusters, then merges in order.

    A chain of nearest neighbours: it ends in two clusters that are each other's nearest, which merge. Ward distances never fall
    by merging, so that the rest of the chain stays one. Height is that of the root of twice the rise of the sum of squares.
    """
    import numpy as np

    n, c = np.array(sizes, float), np.array(centres, float).reshape(len(sizes), len(centres[0]) if centres else 0)
    live, made, chain = np.ones(len(n), bool), [], []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            at = chain[-1]
            d = 2 * n * n[at] / (n + n[at]) * ((c - c[at]) ** 2).sum(axis=1)
            d[~live], d[at] = np.inf, np.inf
            near = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        made.append((at, near, sqrt(d[near]), n[at] + n[near]))
        c[at] = (n[at] * c[at] + n[near] * c[near]) / (n[at] + n[near])
        n[at] += n[near]
        live[near] = False
    order, name, out = sorted(range(len(made)), key=lambda i: made[i][2]), {}, []
    # a merge keeps its first cluster's slot: names follow the slots in the order of heights
    of = list(range(len(n)))
    for i in order:
        a, b, height, size = made[i]
        x, y = name.get(a, of[a]), name.get(b, of[b])
        out.append((min(x, y), max(x, y), height, size))
        name[a] = len(n) + len(out) - 1
    return out


def micro_clusters(df: DataFrame, cols: list[str], micro: int = MICRO, scale: bool = True) -> tuple[DataFrame, list[tuple[float, list[float]]]]:
    """df with __micro, and (size, centre) of the micro-clusters: the distinct points, or k-means cells where there are more than `micro`."""
    pointed = df.withColumn("__point", standard_point(df, cols, scale))
    counts = pointed.groupBy("__point").agg(F.count("*").alias("n"))
    few = counts.limit(micro + 1).collect()
    if len(few) <= micro:
        few = sorted((tuple(r[0]), r[1]) for r in few)
        table = df.sparkSession.createDataFrame([(list(p), i) for i, (p, _) in enumerate(few)], "__point array<double>, __micro int")
        return pointed.join(F.broadcast(table), "__point").drop("__point"), [(float(n), list(p)) for p, n in few]
    model = KMeans(k=micro, seed=42, featuresCol="__vector", predictionCol="__micro").fit(pointed.select(array_to_vector("__point").alias("__vector")))
    placed = model.transform(pointed.withColumn("__vector", array_to_vector("__point"))).drop("__vector")
    d = len(cols)
    found = placed.groupBy("__micro").agg(F.count("*").alias("n"), F.array(*(F.avg(F.col("__point")[i]) for i in range(d))).alias("c")).collect()
    row = {r["__micro"]: r for r in found}
    ids = {m: i for i, m in enumerate(sorted(row))}
    dense = F.array(*(F.lit(ids.get(m)).cast("int") for m in range(max(row) + 1)))
    return placed.withColumn("__micro", F.get(dense, F.col("__micro"))).drop("__point"), [(float(row[m]["n"]), list(row[m]["c"])) for m in ids]


def dendrogram(df: DataFrame, cols: list[str], micro: int = MICRO, scale: bool = True) -> DataFrame:
    """merge, left, right, height, size: the merges of hierarchical(), from the lowest; ids below the number of micro-clusters are those."""
    found = micro_clusters(df, cols, micro, scale)[1]
    made = ward_merges([n for n, _ in found], [c for _, c in found])
    return df.sparkSession.createDataFrame([(len(found) + i, a, b, float(h), int(s)) for i, (a, b, h, s) in enumerate(made)], "merge int, left int, right int, height double, size bigint")


def hierarchical(df: DataFrame, cols: list[str], k: int = 3, micro: int = MICRO, scale: bool = True) -> DataFrame:
    """df with cluster (0 .. k-1): Ward's bottom-up merging, cut at k clusters.

    Up to `micro` distinct points are merged themselves, and the result is exactly Ward's; more are first gathered into `micro`
    k-means cells, each merged with its size and centre. The driver sees those, never rows; no pairs of rows are made. Clusters
    are numbered by the least of their micro-clusters. Nulls are the median; fewer distinct points than k give as many clusters.
    """
    placed, found = micro_clusters(df, cols, micro, scale)
    made = ward_merges([n for n, _ in found], [c for _, c in found])
    root = list(range(len(found) + len(made)))
    for i, (a, b, _, _) in enumerate(made[: max(0, len(found) - k)]):
        root[a] = root[b] = len(found) + i

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    tops = [top(i) for i in range(len(found))]
    number = {t: i for i, t in enumerate(dict.fromkeys(tops))}
    cluster = F.get(F.lit([number[t] for t in tops] or [0]), F.col("__micro"))
    return placed.withColumn("cluster", cluster.cast("int")).drop("__micro")


# --- density ---------------------------------------------------------------------------------------------------


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _gap(side: float) -> Column:
    """Squared distance between the nearest corners of cells c and o."""
    apart = lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double") * side
    return F.aggregate(F.zip_with("c", "o", apart), F.lit(0.0), lambda s, x: s + x * x)


def dbscan(df: DataFrame, key: str, cols: list[str], eps: float, min_samples: int = 5) -> DataFrame:
    """id, cluster for each row of df: the least id of a core point of its cluster, -1 for noise.

    A point with at least min_samples points within eps, itself included, is a core point; core points within eps of each
    other share a cluster; other points go to the least cluster with a core point within eps. Rows with a null are noise.

    Points lie in cells whose diagonal is eps. In a cell of min_samples points all are core points of one cluster, and none
    are compared with each other; only the few points of other cells are held against their neighbours. Cells are then linked
    if they hold core points within eps: first the two nearest each other's middle, and only where those are too far
    apart all points that lie within eps of the other cell, in parts of bounded size. Clusters are components of the cells.
    """
    d, side = len(cols), eps / sqrt(len(cols)) * (1 - 1e-12)
    reach, lead = int(eps / side) + 1, min(d, 3)
    vector = F.array(*(C.value(df, c).cast("double") for c in cols))
    rows = df.select(F.col(key).alias("id"), vector.alias("v"))
    whole = ~F.exists("v", lambda x: x.isNull())
    points = cut_lineage(rows.where(whole).withColumn("c", F.transform("v", lambda x: F.floor(x / F.lit(side)))))
    cells = cut_lineage(points.groupBy("c").agg(F.count("*").alias("n")))

    # neighbouring cells: candidates by the first columns, confirmed over all
    steps = F.array(*(F.array(*map(F.lit, s)) for s in product(range(-reach, reach + 1), repeat=lead)))
    at = cells.select("c", F.slice("c", 1, lead).alias("lead"))
    moved = at.select("c", F.explode(steps).alias("s")).select("c", F.zip_with(F.slice("c", 1, lead), "s", lambda x, y: x + y).alias("lead"))
    near = moved.join(at.withColumnRenamed("c", "o"), "lead").where((F.col("c") != F.col("o")) & (_gap(side) <= eps * eps)).select("c", "o")
    near = cut_lineage(near)

    # core points: all of a dense cell, and of the others those with enough neighbours
    dense = cells.where(F.col("n") >= min_samples).select("c")
    few = points.join(dense, "c", "left_anti")
    own = few.join(cells, "c").select("id", "v", "c", F.col("n").alias("around"))
    around = few.join(near, "c").select("id", "v", "o").join(points.select(F.col("c").alias("o"), F.col("v").alias("w")), "o")
    around = around.where(_squared(F.col("v"), F.col("w")) <= eps * eps).groupBy("id").agg(F.count("*").alias("more"))
    some = own.join(around, "id", "left").where(F.col("around") + F.coalesce("more", F.lit(0)) >= min_samples).select("id", "v", "c")
    core = cut_lineage(points.join(dense, "c", "left_semi").select("id", "v", "c").unionByName(some))
    alive = core.select("c").distinct()
    pairs = near.where(F.col("c") < F.col("o")).join(alive, "c", "left_semi").join(alive.withColumnRenamed("c", "o"), "o", "left_semi")

    # links of cells by the points nearest the other cell's middle, the rest by a comparison that ends with the first hit
    middle = lambda c: F.transform(c, lambda x: (x + 0.5) * side)
    towards = pairs.select("c", "o").unionByName(pairs.select(F.col("o").alias("c"), F.col("c").alias("o")))
    best = towards.join(core, "c").groupBy("c", "o").agg(F.min_by("v", _squared(F.col("v"), middle(F.col("o")))).alias("v"))
    tested = pairs.join(best, ["c", "o"]).join(best.select(F.col("o").alias("c"), F.col("c").alias("o"), F.col("v").alias("w")), ["c", "o"])
    tested = cut_lineage(tested.select("c", "o", (_squared(F.col("v"), F.col("w")) <= eps * eps).alias("linked")))
    open_ = tested.where("not linked").select("c", "o")
    box = F.aggregate(F.zip_with("v", "to", lambda x, y: F.greatest(y * side - x, x - (y + 1) * side, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)

    def facing(a: str, b: str) -> DataFrame:
        """The core points of cell a within eps of cell b, dealt into parts."""
        found = open_.join(core.withColumnRenamed("c", a), a).withColumn("to", F.col(b)).where(box <= eps * eps * (1 + 1e-9))
        sizes = found.groupBy("c", "o").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        return found.join(sizes, ["c", "o"]).select("c", "o", "v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts")

    left, right = cut_lineage(facing("c", "o")), cut_lineage(facing("o", "c"))
    sizes = left.select("c", "o", F.col("parts").alias("lp")).distinct().join(right.select("c", "o", F.col("parts").alias("rp")).distinct(), ["c", "o"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(sizes, ["c", "o"]).select("c", "o", "v", F.col("part").alias("i"), every("rp").alias("j"))
    right = right.join(sizes, ["c", "o"]).select("c", "o", "v", F.col("part").alias("j"), every("lp").alias("i"))

    def closest(a, b):
        import numpy as np
        import pandas as pd

        out = pd.DataFrame({"c": a["c"].iloc[:1], "o": a["o"].iloc[:1]})
        if len(a) and len(b):
            x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
            for v in x:
                if (((y - v) ** 2).sum(axis=1) <= eps * eps).any():
                    return out
        return out.iloc[:0]

    deal = ["c", "o", "i", "j"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, though both come from one table
    hits = left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInPandas(closest, "c array<bigint>, o array<bigint>")
    links = tested.where("linked").select("c", "o").unionByName(hits).distinct()

    # clusters of cells, named by their least core point
    first = core.groupBy("c").agg(F.min("id").alias("name"))
    named = links.join(first.withColumnRenamed("name", "a"), "c").join(first.select(F.col("c").alias("o"), F.col("name").alias("b")), "o").select("a", "b")
    named = cut_lineage(named.unionByName(first.select(F.col("name").alias("a"), F.col("name").alias("b"))))
    cluster = first.join(components(named), F.col("name") == F.col("id")).select("c", F.col("root").alias("cluster"))
    inner = core.select("id", "v", "c").join(cluster, "c")
    inner = cut_lineage(inner)
    edge = few.join(core.select("id"), "id", "left_anti").join(near, "c").select("id", "v", "o").unionByName(few.join(core.select("id"), "id", "left_anti").select("id", "v", F.col("c").alias("o")))
    edge = edge.join(inner.select(F.col("c").alias("o"), F.col("v").alias("w"), "cluster"), "o").where(_squared(F.col("v"), F.col("w")) <= eps * eps)
    placed = inner.select("id", "cluster").unionByName(edge.groupBy("id").agg(F.min("cluster").alias("cluster")))
    return rows.select("id").join(placed, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
