"""Filter audit, reversible line deduplication and the target draw against brute force on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from tessera.llm import filter_audit, line_filters, target_draw
from tessera.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank long, part string, mask int, row string, shard int, keys string, key string"


def documents(spark, texts, ids=None, langs=("en", "de", None, "")):
    """Documents with extra columns whose names clash with inner ones and with outputs."""
    rows = [(ids[i] if ids else i, t, langs[i % len(langs)], "s", 0, 0.5, 1, "p", 3, "r", 2, "k", "q") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- filter audit ----------------------------------------------------------------------------------------------


def audit_texts():
    r = random.Random(7)
    vocabulary = ["alpha", "Beta", "GAMMA", "é", "d$d", "tail", *(f"w{i}" for i in range(150))]
    out = [" ".join(r.choice(vocabulary[: r.choice([6, 40, 156])]) for _ in range(r.choice([5, 99, 100, 140]))) for _ in range(60)]
    return [*out, *out[:9], out[0], None, "", " \n", "A" * 3000, "x " * 40_000, "|"]


def failures(texts, ids):
    for i, t in enumerate(texts):
        t, ws = t or "", words_of(t)
        earlier = any((texts[j] or "") == t and ids[i] is not None and ids[j] is not None and ids[j] < ids[i] for j in range(len(texts)))
        yield "".join(
            f
            for f, fails in zip("ABCDE", (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), earlier))
            if fails
        )


@pytest.mark.parametrize("awkward_ids", [False, True])
def test_audit_equals_applying_the_filters_in_every_order(spark, awkward_ids):
    texts = audit_texts()
    ids = [None if i % 11 == 3 else i // 2 for i in range(len(texts))] if awkward_ids else list(range(len(texts)))
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "x") for i in range(0, 70, 2)] + [(4, 1, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    good, toxic = {i for i in range(0, 70, 2) if i % 2} | {4}, {i for i in range(0, 70, 2) if i % 3 == 0}
    langs = ("en", "de", None, "")
    got = {(x["part"], x["filter_order"], x["step"]): x for x in filter_audit.audit_text_filters(documents(spark, texts, ids), labels).collect()}
    fails = list(failures(texts, ids))
    parts = {p: [i for i in range(len(texts)) if (langs[i % 4] or "") == p] for p in ("en", "de", "")}
    assert len(got) == 3 * 120 * 5
    for p, rows in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in fails[i]]
                want = (
                    len(left) - len(gone),
                    len(gone),
                    sum(f in fails[i] for i in rows) - len(gone),
                    sum(fails[i] == f for i in rows),
                    sum(ids[i] in good for i in gone),
                    sum(ids[i] in toxic for i in gone),
                )
                x = got[p, "".join(order), step]
                assert (x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"]) == want
                removed_by[f] += len(gone)
                left = [i for i in left if f not in fails[i]]
        assert all(x["shapley"] == removed_by[x["filter_order"][x["step"] - 1]] for (q, _, _), x in got.items() if q == p)


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_least_squares_give_shapley_values(n):
    rows = filter_audit.shapley_rows(n)
    r = random.Random(n)
    v = [0, *(r.randrange(1000) for _ in range(2**n - 1))]
    want = [Fraction(0)] * n
    for order in permutations(range(n)):
        s = 0
        for i in order:
            want[i] += Fraction(v[s | 1 << i] - v[s], math.factorial(n))
            s |= 1 << i
    assert [sum(x * y for x, y in zip(row, v)) for row in rows] == want


def test_audit_of_other_filters(spark):
    from pyspark.sql import functions as F

    docs, labels = documents(spark, ["ab", "abc", None, "b"]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs, labels, {"short": F.length("text") < 3, "b": F.col("text").contains("b")}, F.lit("all")).collect()
    assert {(x["filter_order"], x["step"]): (x["kept"], x["removed"], x["shapley"]) for x in got} == {("shortb", 1): (2, 2, 2), ("shortb", 2): (1, 1, 4), ("bshort", 1): (1, 3, 4), ("bshort", 2): (1, 0, 2)}
    assert [x["removed"] for x in filter_audit.audit_filters(docs, labels, {"E": None}, F.lit("all")).collect()] == [0]
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit_filters(docs, labels, {}, F.lit("all"))


# --- lines -----------------------------------------------------------------------------------------------------


def line_texts(n=80):
    r = random.Random(5)
    shared = [f"Shared line {i}" for i in range(12)]
    out = []
    for i in range(n):
        own = [f"own {i} {j}" for j in range(r.randint(0, 4))]
        some = [r.choice(("", " ", "\t", "\x0b")) + r.choice((str, str.upper))(x) + r.choice(("", "\r", "  ")) for k, x in enumerate(shared) if r.random() < (k + 1) / 14]
        both = own + some + [""] * r.randint(0, 2)
        r.shuffle(both)
        out.append("\n".join(both))
    return [*out, *[out[3]] * 4, None, "", "\n\n", "É only", "shared line 11 ", "long " * 60_000, "\n".join(["Shared line 11"] * 3000)]


def clean_lines(texts, least, threshold=10):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()  # noqa: E731  bytes: A-Z alone
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").encode().split(b"\n")})
    for t in texts:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not (seen[key(x)] >= threshold and len(key(x).decode()) >= least)]
        yield len(lines), len(lines) - len(kept), b"\n".join(kept)


@pytest.mark.parametrize("tasks", [1 << 20, 7])
@pytest.mark.parametrize("least", [1, 15])
def test_line_dedup(spark, monkeypatch, tasks, least):
    monkeypatch.setattr(line_filters, "PER_TASK", tasks)
    monkeypatch.setattr(line_filters, "PER_SHARD", max(3, tasks // 1000))
    monkeypatch.setattr(line_filters, "PER_ROW", 5)
    texts = line_texts()
    for ids in (None, [None if i % 5 == 0 else i // 3 for i in range(len(texts))]):
        got = line_filters.line_dedup(documents(spark, texts, ids), least_chars=least, keep_text=True).collect()
        want = [(n, gone, hashlib.sha256(kept).hexdigest(), kept.decode()) for n, gone, kept in clean_lines(texts, least)]
        pairs = sorted(((-1 if i is None else i), *w) for i, w in zip(ids or range(len(texts)), want))
        assert sorted((-1 if x[0] is None else x[0], *x[1:]) for x in map(tuple, got)) == pairs


def membership(index):
    """The keys that filters and exact counts let through, and the number of items in the filters."""
    refs = {bytes(x["key"]): x["refs"] for x in index.refs.collect()}
    items = {x["shard"]: x["items"] for x in index.filters.collect()}
    pairs = index.refs.selectExpr("key", "key as row")
    return refs, sum(items.values()), {bytes(k) for x in line_filters.frequent_pairs(pairs, index).collect() for k in x["keys"]}


@pytest.mark.parametrize("per_shard", [1 << 16, 4])
def test_inserting_and_deleting_documents_undo_each_other(spark, monkeypatch, per_shard):
    monkeypatch.setattr(line_filters, "PER_SHARD", per_shard)
    texts = line_texts()
    first, second = documents(spark, texts[:30]), documents(spark, texts[30:])
    index = line_filters.build_index(first)
    both = line_filters.insert(index, second)
    whole = line_filters.build_index(documents(spark, texts))
    assert membership(both) == membership(whole) and membership(both) != membership(index)
    back = line_filters.delete(both, second)
    assert membership(back) == membership(index)
    assert membership(line_filters.delete(back, first)) == ({}, 0, set())
    frequent = {k for k, n in membership(whole)[0].items() if n >= 10}
    assert membership(whole)[1:] == (len(frequent), frequent)
    by_old = {x["doc_id"]: x["kept_sha256"] for x in line_filters.drop_lines(first, both).collect()}
    assert by_old == {i: hashlib.sha256(kept).hexdigest() for i, (_, _, kept) in zip(range(30), clean_lines(texts, 1))}


def test_cuckoo_filter_takes_out_what_was_put_in():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**64, (20_000, 2), dtype=np.uint64)
    made = line_filters.CuckooFilter.of(keys[200:])
    assert made.contains(keys[200:]).all() and made.contains(r.integers(0, 2**64, (50_000, 2), dtype=np.uint64)).mean() < 1e-3
    made.delete(keys[200:10_000])
    assert made.contains(keys[10_000:]).all() and made.contains(keys[200:10_000]).mean() < 1e-3
    assert np.count_nonzero(made.slots) == 10_000
    assert not line_filters.CuckooFilter(np.zeros((2, 4), np.uint16)).insert(keys[200:220])


# --- target draw -----------------------------------------------------------------------------------------------


def draw_texts(n=150):
    r = random.Random(9)
    words = ["".join(r.choice("abcXYZ09éß漢") for _ in range(r.randint(1, 8))) for _ in range(60)]
    out = [r.choice(" \n.-").join(r.choice(words) for _ in range(r.choice([3, 19, 20, 21, 60]))) for _ in range(n)]
    return [*out, out[0], out[0], None, "", "..", "q" * 63 + " " + "r" * 64 + " " + "s" * 65 + " t " + "u" * 4000 + " v", "big word " * 30_000]


def features(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    return len(ws), [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute_draw(ids, texts, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for x in texts for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for place, (i, x) in enumerate(zip(ids, texts)):
        n, fs = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, place) for place, r in enumerate(rows) if r[1] >= 20)
    drawn = {place: k for k, (*_, place) in enumerate(able[: percent * len(able) // 100], 1)}
    return [(*r, drawn.get(place)) for place, r in enumerate(rows)]


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_draw(spark, monkeypatch, percent):
    monkeypatch.setattr(target_draw, "PER_SORT", 7)
    texts, target = draw_texts(), [x for x in draw_texts(40)[:20]] + [None, ""]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    null_last = lambda r: tuple((x is None, x or 0) for x in r)
    for ids in (list(range(len(texts))), [None if i % 9 == 0 else i // 4 for i in range(len(texts))]):
        got = target_draw.draw(documents(spark, texts, ids), goal, percent=percent).collect()
        want = brute_draw(ids, texts, target, percent)
        assert sorted((tuple(x)[:5] for x in got), key=null_last) == sorted((x[:5] for x in want), key=null_last)
        # of rows that tie in id and score any may come first
        assert sorted((x["rank"], x["score"], x["doc_id"] or -1) for x in got if x["rank"]) == sorted((x[5], x[4], x[0] or -1) for x in want if x[5])


def test_checksums_of_runs_of_words():
    texts = draw_texts()
    raw = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    bucket, doc, words = target_draw.feature_buckets(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        n, fs = features(t)
        assert words[i] == n and Counter(bucket[doc == i].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in fs)


@pytest.mark.parametrize("parts", [1, 5])
def test_cutoff_is_the_kth_key(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice([1, 2, 3, 50]) if i % 3 else i, None if i % 7 == 0 else r.randrange(9), i) for i in range(500)]
    keys = target_draw.with_key(spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(parts)).cache()
    order = sorted((-s, int(d is None), d or 0, i) for s, d, i in rows)
    for k in (1, 2, 250, 499, 500):
        assert target_draw.cutoff(keys, k) == order[k - 1]
    assert target_draw.cutoff(keys, 0) is None


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_dedup", "op13_target_draw"])
def test_empty_tables(spark, tmp_path, name):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries()[name](spark, str(tmp_path)).collect() == []


def test_draw_without_a_target(spark):
    got = target_draw.draw(documents(spark, ["a b"] * 3), spark.createDataFrame([], "item_id long, text string"), least_words=1, percent=50).collect()
    assert sorted(x["rank"] or 9 for x in got) == [1, 9, 9] and len({x["weight"] for x in got}) == 1
