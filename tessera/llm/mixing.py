"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, hash_unit, materialize

WEIGHTS = (5, 2, 1)
BUDGET, MOST, SEED = 1.5, 2.0, "mix"
#: Beyond so many sources their rates are joined, not looked up.
LOOKUP = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, target, rate for each source of sizes(source, size).

    The sources in code-point order, null last, weigh `weights` in turn and share `budget` times all sizes. No
    target exceeds `most` times its source's size; what is over goes to the rest by weight. In the order of
    cap / weight, a source is capped if its share of what the earlier ones leave reaches its cap. The windows see
    one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = total.select("source", "source_size", weight.alias("w"), F.sum("source_size").over(every).alias("all_size"))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("w"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rest = F.col("all_size") * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("capped", F.col("level") <= rest / rest_w)
    open_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    water = (F.col("all_size") * budget - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)) / open_w
    t = t.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(water * F.col("w")))
    return t.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("rate"))


def copies(rate: Column, id_col: str, seed: str = SEED) -> Column:
    """floor(rate), and one more with the fraction's probability, decided by a hash of the id."""
    return (F.floor(rate) + (hash_unit(id_col, seed) < rate - F.floor(rate)).cast("int")).cast("bigint")


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of df; only ids, sources and sizes are shuffled.

    size is the number of words (null text: 0); taken is size times copies. A null source is a source of its own,
    the last. Repeated ids are decided alike. An empty table gives an empty plan; other columns are ignored. The
    targets have one row per source; Spark broadcasts them only when their measured size allows, else it joins by
    source and splits a hot one.
    """
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    targets = source_targets(sized, **kw).withColumnRenamed("source", "target_source")
    n = copies(F.col("rate"), "doc_id", seed)
    return sized.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, lookup: int = LOOKUP, **kw) -> DataFrame:
    """The rows of df, each as many times as the mix takes it.

    Up to `lookup` sources, a counted bound, the rates are looked up in a map, which keeps the texts where they are;
    beyond it they are joined by source.
    """
    sizes = df.select(F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    rates = materialize(source_targets(sizes, **kw).select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate")))
    if rates.count() <= lookup:
        table = rates.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.concat(F.lit("="), "__mix_source"), F.lit("null")), "__mix_rate"))).alias("m")).scalar()
        rated = df.withColumn("__mix_rate", F.element_at(table, F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))))
    else:
        rated = df.join(rates, F.col(source_col).eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    n = copies(F.col("__mix_rate"), id_col, seed).cast("int")
    return rated.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), n))).drop("__mix_rate", "__mix_copy")
