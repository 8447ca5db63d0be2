"""Hashed n-gram models of target and raw text: quality rules by likelihood ratio, and importance resampling.

Words and word pairs fall into a fixed number of buckets. Two multinomials, of the trusted target texts and of the
whole raw corpus, give each bucket a log ratio; that table is bounded by the number of buckets, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, hash_unit, materialize

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Documents are kept from the ratio on that all but this share of the trusted ones reach, to STEP nats per n-gram.
TRUSTED_LOSS, STEP = 0.01, 0.001
#: Bits of the filter that trusted ids pass through before the exact join (1 MiB), and its hash functions.
FILTER_BITS, FILTER_HASHES = 1 << 23, 3


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda variable, which no rewrite copies into inner loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucket_ids(words: Column, buckets: int = BUCKETS) -> Column:
    """A bucket for each word and each pair of neighbours."""
    bucket = lambda *w: F.pmod(F.xxhash64(*w), F.lit(buckets))
    return F.flatten(let(words, lambda ws: F.transform(ws, lambda w, i: F.array(bucket(w), F.when(i > 0, bucket(F.get(ws, i - 1), w))))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that any row labels as of good quality, each once."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def trusted_docs(docs: DataFrame, labels: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text of the documents with a trusted label.

    Ids first meet a Bloom filter of the trusted ones, one array of fixed size, so that the texts of most other
    documents are never shuffled; what passes is joined with the ids themselves, by sorted keys at every size.
    """
    ids = trusted_ids(labels)
    slots = lambda c: [F.pmod(F.xxhash64(c, F.lit(j)), F.lit(bits)) for j in range(FILTER_HASHES)]
    words = ids.select(F.explode(F.array(*slots(F.col("doc_id")))).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    every = docs.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    table = materialize(every.agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w")).select(F.col("w.bits").alias("bits"))).scalar()
    hit = F.lit(True)
    for slot in slots(F.col("doc_id")):
        hit = hit & (F.get(table, F.shiftright(slot, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & hit).join(ids.hint("merge"), "doc_id", "left_semi")


def count_grams(docs: DataFrame, name: str, buckets: int) -> DataFrame:
    """b, `name`: the number of n-grams in each bucket; combined before the shuffle, at most `buckets` rows per task."""
    grams = docs.select(F.explode(bucket_ids(words_of(F.col("text")), buckets)).alias("b")).where("b is not null")
    return grams.groupBy("b").agg(F.count("*").alias(name))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with `ratios`: for each bucket log P(bucket | target) - log P(bucket | raw).

    Every word of every document counts as raw, in a scan without a join; those of documents with a trusted label
    count as target too. The table is bounded by the number of buckets, whatever the input.
    """
    raw, target = count_grams(docs, "raw", buckets), count_grams(trusted_docs(docs, labels), "target", buckets)
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "b").join(raw, "b", "left").join(target, "b", "left").na.fill(0)
    row = every.agg(F.sum("raw").alias("r"), F.sum("target").alias("t"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    p = lambda n, total: F.log((n + F.lit(smoothing)) / (total + F.lit(smoothing * buckets)))
    return materialize(row.select(F.transform("c", lambda x: p(x["target"], F.col("t")) - p(x["raw"], F.col("r"))).alias("ratios")))


def log_weight(words: Column, ratios: DataFrame, buckets: int = BUCKETS) -> Column:
    """The sum of the log ratios over a document's n-grams, 0 if it has none.

    The table has a fixed size, one number per bucket. Spark takes no subquery in a lambda's function, so that it goes
    into the plan as one text literal, folded to an array.
    """
    table = F.split(F.lit(",".join(map(repr, ratios.first()["ratios"]))), ",").cast("array<double>")
    value = lambda h: F.get(table, F.pmod(h, F.lit(buckets)).cast("int"))
    pair = lambda ws, w, i: F.when(i > 0, value(F.xxhash64(F.get(ws, i - 1), w))).otherwise(0.0)
    values = let(words, lambda ws: F.transform(ws, lambda w, i: value(F.xxhash64(w)) + pair(ws, w, i)))
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def repeat_words(words: Column) -> Column:
    """The number of words in 3-word windows that occur twice or more, from hashes of the windows.

    Sorting (hash, place) pairs brings equal windows together; the places of those that have an equal neighbour,
    in order again, add up to the words that they cover. That takes n log n steps. A document without a repeated
    window, which distinct hashes show, is not sorted.
    """
    window = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def covered(pairs: Column) -> Column:
        same = lambda x, j: x["h"].eqNullSafe(F.get(pairs, j)["h"])
        places = F.array_sort(F.transform(F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        add = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"), i.alias("at"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), add, lambda acc: acc["n"])

    def repeats(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, covered))

    return let(let(words, window), repeats).cast("bigint")


def loss_cut(judged: DataFrame, labels: DataFrame, loss: float = TRUSTED_LOSS, step: float = STEP) -> DataFrame:
    """One row with `cut`: the ratio, in whole steps, that all but the share `loss` of the trusted documents reach.

    Trusted documents are counted per step, a table bounded by the range of the ratios; without any, the cut is null.
    """
    trusted = judged.where("llr is not null").select("doc_id", "llr").join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi")
    counts = trusted.groupBy(F.floor(F.col("llr") / step).cast("bigint").alias("at")).agg(F.count("*").alias("n"))
    below = Window.orderBy("at")
    ranked = counts.select("at", F.sum("n").over(below).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return ranked.where(F.col("upto") > F.col("all") * loss).agg((F.min("at") * step).alias("cut"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, loss: float = TRUSTED_LOSS, max_repeat_percent: int = 50, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr for each row of docs.

    Every document gets the length-normalised log-likelihood ratio of its words and word pairs, trusted target
    against raw corpus. It is kept if it passes the base rules (enough words, not mostly repeated windows) and its
    ratio is not below loss_cut(): the same in every run. Null text has no words, fails the base rules and has a
    null ratio. Repeated rows are judged each; labels of a document are merged first. Without trusted documents all
    ratios are alike and only the base rules tell. Empty tables give an empty result; other columns are ignored.
    """
    ratios = log_ratios(docs, labels, buckets)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    judged = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("ws")).select(
        "doc_id",
        F.size("ws").cast("bigint").alias("n_words"),
        F.coalesce(F.length(F.regexp_replace("text", SPACE, "")), F.lit(0)).cast("bigint").alias("word_chars"),
        F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("ws")).alias("n_repeat_words"),
        F.when(F.size("ws") > 0, log_weight(F.col("ws"), ratios, buckets) / (2 * F.size("ws") - 1)).alias("llr"),
    )
    judged = materialize(judged)
    cut = loss_cut(judged, labels, loss).scalar()
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    good = (F.col("llr") >= cut) | (cut.isNull() & F.col("llr").isNotNull())
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(good, F.lit(False)))


def kth_largest(df: DataFrame, col: str, k: int, small: int = 10_000) -> float | None:
    """The k-th largest value of a column, by counting in ever narrower ranges; collects 1024 counts at a time."""
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while n > small and lo < hi:
        width = (hi - lo) / 1024
        inside = df.where(F.col(col).between(lo, hi))
        slot = F.least(F.floor((F.col(col) - lo) / width), F.lit(1023)).alias("slot")
        found = sorted(inside.groupBy(slot).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), reverse=True)
        for r in found:
            if k <= r["n"]:
                break
            k -= r["n"]
        if (lo, hi) == (r["lo"], r["hi"]):
            break
        lo, hi, n = r["lo"], r["hi"], r["n"]
    if lo == hi:
        return lo
    return df.where(F.col(col).between(lo, hi)).select(col).orderBy(F.col(col).desc()).limit(k).agg(F.min(col)).first()[0]


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS, seed: str = "gumbel") -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept for each row of docs: k rows drawn without replacement by importance.

    The log weight is the sum of log P(target) - log P(raw) over the document's words and word pairs; a Gumbel
    variable from a hash of the id is added, and the k largest keys are kept: exactly k rows, or all. Rows that tie
    at the last key, those of one id and text, are taken by their place in the table. k is by default the share of trusted documents among the labelled ones, of all rows.
    Null or empty text has the weight of no evidence, 0. Without labels every row is kept. Empty tables give an
    empty result; other columns are ignored.
    """
    ratios = log_ratios(docs, labels, buckets)
    u = hash_unit("doc_id", seed) + F.lit(2.0**-54)
    keyed = docs.select("doc_id", words_of(F.col("text")).alias("ws")).select("doc_id", F.when(F.size("ws") > 0, log_weight(F.col("ws"), ratios, buckets)).otherwise(0.0).alias("log_weight"))
    keyed = materialize(keyed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))).withColumn("row", F.monotonically_increasing_id()))
    if k is None:
        share = labels.where("quality is not null").agg(F.avg("quality")).first()[0]
        k = round(keyed.count() * (1.0 if share is None else share))
    cut = kth_largest(keyed, "gumbel_key", k)
    if cut is None:
        return keyed.drop("row").withColumn("kept", F.lit(False))
    over, tied = keyed.agg(F.count_if(F.col("gumbel_key") > cut), F.count_if(F.col("gumbel_key") == cut)).first()
    last = kth_largest(keyed.where(F.col("gumbel_key") == cut), "row", k - over) if k - over < tied else -1
    tie = (F.col("gumbel_key") == cut) & (F.col("row") >= last)
    return keyed.withColumn("kept", (F.col("gumbel_key") > cut) | tie).drop("row")
