"""How quality filters act together: removals of all coalitions of filters, step counts of all orders, exact Shapley shares.

A document's row of failed filters is a bit mask; a coalition of filters removes the documents whose mask meets it.
Removals of all 2**n coalitions come from counts by mask, and everything else from those: a step's removals are the
difference of two coalitions, and Shapley shares solve a least-squares problem over the coalitions, in rationals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import UPPER
from tessera.llm.ngram_model import words_of

#: Masks, coalitions and orders of so many filters still fit into one plan (720 orders).
MOST_FILTERS = 6


def shapley_rows(n: int) -> list[list[Fraction]]:
    """For each of n players, the coefficient of each of the 2**n coalition values in its Shapley value.

    The shares fit the values of all coalitions but the empty and the full one best, by squares weighted with the Shapley
    kernel, and add up to the full one's value. The normal equations with the multiplier of that constraint are solved in
    rationals by elimination, for all coalition values at once: the right-hand side of a value is a column.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    has = lambda s, i: s >> i & 1
    rows = []
    for i in range(n):
        normal = [sum((w for s, w in weight.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)]
        rows.append([*normal, Fraction(1), *(weight.get(s, Fraction(0)) * has(s, i) for s in range(full + 1))])
    rows.append([*[Fraction(1)] * n, Fraction(0), *(Fraction(int(s == full)) for s in range(full + 1))])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[n + 1 :] for row in rows[:n]]


def fail_counts(docs: DataFrame, labels: DataFrame, failed: list[Column | None], part: Column, id_col: str, text_col: str) -> DataFrame:
    """part, mask, good, toxic, n: documents by the filters that they fail; None in `failed` is the filter of later copies.

    Rows are narrow: a mask and a digest in the place of the text. Copies are counted by digest, combined before the
    shuffle, so that a large group of them is a few rows; all but the rows of the group's smallest id fail.
    """
    n = len(failed)
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed) if f is not None), F.lit(0))
    copies = sum(1 << i for i, f in enumerate(failed) if f is None)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)) if copies else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), part.alias("part"), mask.cast("int").alias("mask"), digest.alias("digest"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    kind = ["part", "mask", "good", "toxic"]
    rows = rows.join(known, "doc_id", "left").na.fill(False, ["good", "toxic"])
    if not copies:
        return rows.groupBy(kind).agg(F.count("*").alias("n"))
    of_id = rows.groupBy("doc_id", "digest", *kind).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = of_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    alike = alike.withColumn("first", F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.array(F.struct("mask", F.col("first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    split = alike.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return split.groupBy(kind).agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None], part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part, order and step.

    `filters` maps names to conditions on docs under which a document fails; None stands for the filter of copies: a text
    identical to that of a smaller id anywhere in the table. The filters are applied in every order; a step's filter
    is the one at its place. Counts are of documents within the part: left after the step, removed by it, failing its filter
    but removed before, failing no other filter, removed by it with a label quality = 1 or toxic = 1; shapley is what its
    filter removes, summed over all orders, the number of orders times its Shapley value.

    A condition that is null counts as passed. Repeated rows are documents each; rows of one id and text are no copies of
    each other, and rows with a null id neither are copies nor have labels. Repeated labels of an id are merged. An
    empty table gives an empty result; other columns are ignored.
    """
    names, n = list(filters), len(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited, not {n}")
    counts = fail_counts(docs, labels, list(filters.values()), part, id_col, text_col)
    meets = lambda s: F.col("mask").bitwiseAND(F.lit(s)) != 0
    removals = lambda also: F.array(*(F.sum(F.when(meets(s) & also, F.col("n")).otherwise(0)) for s in range(1 << n)))
    table = counts.groupBy("part").agg(F.sum("n").alias("all"), removals(F.lit(True)).alias("v"), removals(F.col("good")).alias("g"), removals(F.col("toxic")).alias("t"))
    if n == 1:
        shares = [F.col("v")[1]]
    else:
        whole = [[x * factorial(n) for x in row] for row in shapley_rows(n)]
        assert all(x.denominator == 1 for row in whole for x in row)
        shares = [sum((F.lit(int(x)) * F.col("v")[s] for s, x in enumerate(row) if x), F.lit(0)) for row in whole]
    table = table.withColumn("shares", F.array(*(s.cast("bigint") for s in shares)))
    orders = F.lit([list(p) for p in permutations(range(n))])
    steps = table.withColumn("p", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.withColumns({"i": F.element_at("p", F.col("step")), "before": F.aggregate(F.slice("p", F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, i: acc + F.element_at(F.lit([1 << k for k in range(n)]), i + 1))})
    steps = steps.withColumns({"own": F.element_at(F.lit([1 << k for k in range(n)]), F.col("i") + 1)})
    steps = steps.withColumns({"after": F.col("before") + F.col("own")})
    gain = lambda c: F.get(c, F.col("after")) - F.get(c, F.col("before"))
    return steps.select(
        "part",
        F.array_join(F.transform("p", lambda i: F.element_at(F.lit(names), i + 1)), "").alias("filter_order"),
        "step",
        (F.col("all") - F.get("v", F.col("after"))).alias("kept"),
        gain("v").alias("removed"),
        (F.get("v", F.col("own")) - gain("v")).alias("redundant"),
        (F.get("v", F.lit((1 << n) - 1)) - F.get("v", F.lit((1 << n) - 1) - F.col("own"))).alias("unique_fails"),
        gain("g").alias("good_lost"),
        gain("t").alias("toxic_lost"),
        F.get("shares", F.col("i")).alias("shapley"),
    )


def audit_text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit_filters by language for five filters: A few words, B few distinct words, C many capitals, D symbols, E copies."""
    texts = docs.select("doc_id", F.col("lang").alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("ws", words_of(F.col("text")))
    n = F.size("ws")
    capitals = F.length("text") - F.length(F.translate("text", UPPER, ""))
    filters = {"A": n < 100, "B": 100 * F.size(F.array_distinct("ws")) < 80 * n, "C": 100 * capitals > 10 * F.length("text"), "D": F.col("text").rlike(r"[#$%&*|]"), "E": None}
    return audit_filters(texts, labels, filters, F.coalesce("part", F.lit("")))
