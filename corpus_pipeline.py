"""From raw documents to token digests: language, exact copies, near copies, source mix, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, language_crf, minhash_dedup, mixing
from tessera.llm.common import discard, materialize

#: Documents whose language has less than this share of their words' probability are rejected, as are those without a letter.
LEAST_SCORE = 0.3
#: Near copies share at least so many of 100 word shingles; op5_minhash_dedup alone goes by its own 85.
NEAR_PERCENT = 80
#: No SQL expresses the language model, the sketches or the encoding.
ORACLE_SQL = None


#: Copies of the documents that a stage has written for itself; run() deletes them once the stage's result is written.
_written: list[DataFrame] = []


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __row, a key of each row; written, so that every reader sees the same keys."""
    _written.append(materialize(docs.withColumn("__row", F.monotonically_increasing_id())))
    return _written[-1]


def _one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs(__row, doc_id, ...) for each group of groups(__row, group): the smallest id, null last, then the first row.

    What goes is joined, not what stays: few rows, which Spark may broadcast where their measured size allows.
    """
    groups = materialize(groups)
    ids = docs.select("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row").alias("order"))
    first = groups.join(ids, "__row").groupBy("group").agg(F.min("order").alias("first")).select("first.__row")
    gone = materialize(groups.select("__row").join(first, "__row", "left_anti"))
    return docs.join(gone, "__row", "left_anti").drop("__row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language, with that language as their lang; each row is judged by its own text.

    Null text, and text without a letter, has no language and goes. Repeated rows and null ids are rows like others.
    Without a row to learn from every text goes. An empty table stays empty; other columns stay as they are.
    """
    model = language_crf.fit_language_model(docs)
    found = language_crf.label(docs, model, names=("__lang", "__score"))
    found = found.where((F.col("__lang") != language_crf.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, whether their ids differ, repeat or are null.

    The smallest id stays, a null id only where all are null; of rows with that id, the first in the table. Null text
    counts as empty and equals empty text. An empty table stays empty; other columns stay as they are.
    """
    docs = _keyed(docs)
    found = exact_dedup.exact_dedup(docs, "__row").where("group_size > 1")
    return _one_of_each(docs, found.select(F.col("doc_id").alias("__row"), F.col("keep_id").alias("group")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near-duplicates at NEAR_PERCENT; rows are linked by their texts alone.

    Ties, null and repeated ids go as in exact_copies. Null, empty and blank texts are linked with nothing and all
    stay. An empty table stays empty; other columns stay as they are.
    """
    docs = _keyed(docs)
    found = minhash_dedup.near_components(docs, "__row", percent=NEAR_PERCENT)
    return _one_of_each(docs, found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("group")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice.

    Rows with one id, or a null one, are decided alike. A null source is one of its own. Null text has no words. An
    empty table stays empty; other columns stay as they are.
    """
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each copy; null text counts as empty, and each row is encoded for itself."""
    return bpe.encode_decode(docs, keep_ids=False)


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of sf_dir, each written and reread; what is read no more is deleted."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        for used in [*_written, *([] if written is None else [written])]:
            discard(used)
        _written.clear()
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
