"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, materialize

PREFIX_CHARS = 64


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space has become one space. A row's length
    class is refined by a hash of its first characters and, where that is shared too, by SHA-256. Groups are
    formed by counts with map-side combine, on narrow digests; no text is shuffled. All digests are read off the text
    in one scan: the result has every row's SHA-256, so that the refinement narrows the groups, not what is read.

    Null text counts as empty. Of equal texts the smallest id stays (a null id only if all are null); of repeated
    rows with that id, one stays. An empty table gives an empty result; other columns are ignored.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = materialize(
        df.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
            "doc_id", F.octet_length("t").alias("len"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("head"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
        )
    )
    keys = ["len", "head", "text_sha256"]
    # equal digests are counted first, combined before the shuffle, so that a large group of copies is one row below
    left = rows.groupBy(keys).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    for depth in (1, 2):  # what is alone in its class can have no copy
        shared = left.groupBy(keys[:depth]).agg(F.sum("n").alias("in_class")).where("in_class > 1").select(keys[:depth])
        left = left.join(shared, keys[:depth], "left_semi")
    groups = left.where("n > 1")
    out = rows.join(groups, keys, "left")
    repeat = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("len"))
    return (
        out.withColumn("repeat", repeat)
        .withColumn("keep_id", F.coalesce("first_id", "doc_id"))
        .select(
            "doc_id", "keep_id", F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"), "text_sha256"
        )
    )
