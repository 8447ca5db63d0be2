"""Exact nearest rows over k-means cells: a cell that cannot hold one of the k nearest is not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import cut_lineage

#: Training rows a cell is laid out for, the most cells, and the rows that their centres are fitted on. Every row is in a cell.
PER_CELL, MOST_CELLS, FIT_ROWS = 4_096, 1_024, 100_000
#: Query rows and training rows of a cell that one task measures at a time.
BLOCKS = (2_048, 32_768)


@dataclass
class Cells:
    """rows(id, v, label, cell), and for each cell its centre, the largest distance of a row from it and its number of rows."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray


def vector(df: DataFrame, cols: list[str]) -> Column:
    """Columns of numbers or of arrays of numbers as one array."""
    return F.concat(*(F.col(c).cast("array<double>") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("double")) for c in cols))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all of y, a row of x at a time: differences, no cancelling products."""
    return np.stack([((y - v) ** 2).sum(axis=1) for v in x]) if len(x) else np.zeros((0, len(y)))


def build_cells(train: DataFrame, cols: list[str], label: str, key: str, per_cell: int = PER_CELL) -> Cells:
    """The cells of the rows without nulls; the centres come from a hash sample of FIT_ROWS rows."""
    rows = train.select(F.col(key).alias("id"), vector(train, cols).alias("v"), F.col(label).cast("double").alias("label"))
    rows = cut_lineage(rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & F.col("label").isNotNull()))
    n = rows.count()
    k = min(MOST_CELLS, -(-n // per_cell)) or 1
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < int(1e6 * min(1.0, FIT_ROWS / max(n, 1))) + 1)
    if k > 1:
        centres = np.array(KMeans(k=k, seed=42, maxIter=10, featuresCol="x").fit(sample.select(array_to_vector("v").alias("x"))).clusterCenters())
    else:
        centres = np.array([r[0] for r in rows.select("v").limit(1).collect()] or [[0.0]])

    def place(batches: Iterator) -> Iterator:
        for pdf in batches:
            d = distances(np.stack(pdf["v"].to_numpy()), centres) if len(pdf) else np.zeros((0, len(centres)))
            yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), away=np.sqrt(d.min(axis=1)))

    kind = rows.schema["id"].dataType.simpleString()
    placed = cut_lineage(rows.mapInPandas(place, f"id {kind}, v array<double>, label double, cell int, away double"))
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect():
        radius[r["cell"]], count[r["cell"]] = r["r"], r["n"]
    return Cells(placed.drop("away"), centres, radius, count)


def _measured(cells: Cells, probes: DataFrame, k: int, blocks: tuple[int, int]) -> DataFrame:
    """id, other, d, label: for each of probes(id, v, home, cell) the k nearest of that cell, own id left out."""
    kind = probes.schema["id"].dataType.simpleString()
    parts = F.get(F.lit([int(-(-n // blocks[1])) or 1 for n in cells.count]), F.col("cell"))
    right = cells.rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), parts).cast("int"))
    sizes = probes.groupBy("home", "cell").agg(F.ceil(F.count("*") / blocks[0]).cast("int").alias("deals"))
    left = probes.join(sizes, ["home", "cell"]).withColumn("deal", F.pmod(F.xxhash64("id", F.lit(5)), F.col("deals")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = right.join(sizes, "cell").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    left = left.select("id", "v", "home", "cell", "deal", "part").toDF("id", "v", "home", "cell", "deal", "part")
    right = right.select("id", "v", "label", "home", "cell", "deal", "part").toDF("id", "v", "label", "home", "cell", "deal", "part")

    def nearest(a, b):
        import pandas as pd

        out = []
        if len(a) and len(b):
            vectors, ids, labels = np.stack(b["v"].to_numpy()), b["id"].to_numpy(), b["label"].to_numpy()
            for i, v in zip(a["id"], a["v"]):
                d = ((vectors - v) ** 2).sum(axis=1)
                d[ids == i] = np.inf
                at = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                at = at[np.isfinite(d[at])]
                at = at[np.lexsort((ids[at], d[at]))][:k]
                out.append(pd.DataFrame({"id": i, "other": ids[at], "d": d[at], "label": labels[at]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "d": [], "label": []})

    deal = ["home", "cell", "deal", "part"]
    return left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInPandas(nearest, f"id {kind}, other {kind}, d double, label double")


def _best(near: DataFrame, k: int) -> DataFrame:
    return near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).where(F.col("r") <= k).drop("r")


def probes_of(cells: Cells, queries: DataFrame, k: int, rest: bool) -> DataFrame:
    """(id, v, home, cell) for the cells that a query is held against: the nearest ones with over k rows, and with `rest`
    of queries(id, v, kth) those others whose rows may be as near as the k-th found there, by the triangle inequality."""
    centres, radius, count = cells.centres, cells.radius, cells.count
    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            away = np.sqrt(distances(np.stack(pdf["v"].to_numpy()), centres)) if len(pdf) else np.zeros((0, len(centres)))
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            first = np.zeros(away.shape, bool)
            np.put_along_axis(first, order, before <= k, axis=1)
            chosen = first
            if rest:
                least = np.maximum(away - radius, 0) * (1 - 1e-9) - 1e-12
                chosen = ~first & (least <= np.sqrt(pdf["kth"].to_numpy(float))[:, None])
            row, cell = np.nonzero(chosen & (count > 0))
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "v": pdf["v"].to_numpy()[row], "home": order[row, 0].astype("int32"), "cell": cell.astype("int32")})

    return queries.mapInPandas(run, f"id {kind}, v array<double>, home int, cell int")


def nearest_rows(cells: Cells, queries: DataFrame, k: int = 5, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """id, other, d, label: the k nearest rows of the cells for each of queries(id, v), by squared distance, of equally near ones
    those of the smaller ids; a row is no neighbour of its own id. Exact: what is not read is proven to be farther."""
    found = cut_lineage(_best(_measured(cells, probes_of(cells, queries, k, False), k, blocks), k))
    kth = found.groupBy("id").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("kth"))
    more = queries.join(kth, "id", "left").select("id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    return _best(found.unionByName(_measured(cells, probes_of(cells, more, k, True), k, blocks)), k)


def knn_predict(train: DataFrame, test: DataFrame, cols: list[str], label: str, key: str, k: int = 5, blocks: tuple[int, int] = BLOCKS, method: str = "mean", weights: str = "uniform", per_cell: int = PER_CELL) -> DataFrame:
    """id, prediction of each test row from its k nearest training rows: their mean label, or with method "vote" the commonest.

    With weights "distance" a neighbour counts by one over its distance; where some are at distance 0 only those count. Of labels
    with equal votes the smallest wins. Columns are numbers or arrays of numbers; rows with a null are left out.
    """
    if method not in ("mean", "vote") or weights not in ("uniform", "distance"):
        raise ValueError("method is mean or vote, weights are uniform or distance")
    cells = build_cells(train, cols, label, key, per_cell)
    queries = test.select(F.col(key).alias("id"), vector(test, cols).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    near = nearest_rows(cells, cut_lineage(queries), k, blocks)
    if weights == "distance":
        exact = F.min("d").over(Window.partitionBy("id")) == 0
        w = F.when(exact, (F.col("d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.sqrt("d")))
    else:
        w = F.lit(1.0)
    near = near.withColumn("w", w)
    if method == "mean":
        return near.groupBy("id").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))
    votes = near.groupBy("id", "label").agg(F.sum("w").alias("votes"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("prediction"))
