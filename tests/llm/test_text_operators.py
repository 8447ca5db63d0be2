"""Each text operator against a brute-force version on small, awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from tessera.llm import bpe, exact_dedup, language_crf, lattice_lm, minhash_dedup, mixing, ngram_model, suffix_dedup, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h long"


def table(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    rows = [(ids[i] if ids else i, t, "en" if i % 2 else "de", (sources or ["s"])[i % len(sources or ["s"])], 0, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    out = [" ".join(r.choice(words) for _ in range(r.randint(30, 90))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " tail", "x " + out[2], out[3][:150] + out[4][:140], None, "", "  \n ", "one", "a b c", "is " * 300, "z" * 5000, "a\x0b b\x1c c\x85d", out[5].upper()]
    return out


def words_of(t):
    return (t or "").encode().lower().split()


def test_exact_dedup(spark):
    texts = awkward() + ["a  b\tc"]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(table(spark, texts)).collect()}
    import re

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (norm.index(t), norm.count(t), norm.index(t) == i)
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    repeated = exact_dedup.exact_dedup(table(spark, ["q", "q", "r"], ids=[4, 4, None])).collect()
    assert sorted(r["kept"] for r in repeated) == [False, True, True]


def test_suffix_dedup(spark):
    texts = awkward()
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, texts), keep_text=True).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False] + gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        assert bytes(got[i]["kept_text"]) == kept


def test_suffix_dedup_cuts_long_texts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    whole = list(suffix_dedup.pieces(data, np.array([0, 5000]), 100))
    windows = [p[4][0] + s for p in whole for s in range(p[3][0] - 99)]
    assert windows == list(range(4901))


@pytest.mark.parametrize("block", [512, 3])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "SHINGLES", block * 100)
    r = random.Random(2)
    base = [f"w{r.randint(0, 999)}" for _ in range(200)]
    near = []
    for k in range(40):
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(200)] = f"v{r.randint(0, 999)}"
        near.append(" ".join(w))
    for _ in range(60):  # a chain: each text is edited from the one before, so that few are like the first
        w[r.randrange(200)] = f"u{r.randint(0, 999)}"
        if r.random() < 0.5:
            w[r.randrange(200)] = f"u{r.randint(0, 999)}"
        near.append(" ".join(w))
    texts = awkward() + near
    r.shuffle(texts)
    got = {x["doc_id"]: x for x in minhash_dedup.near_components(table(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(sets[i]), root(i), root(i) == i) for i in range(len(texts))]


def test_likelihood_estimate():
    import numpy as np

    r = random.Random(4)
    both, a, b = (np.array([r.getrandbits(64) for _ in range(n)], np.uint64) for n in (800, 100, 100))
    regs = minhash_dedup.registers([np.concatenate([both, a]), np.concatenate([both, b])])
    assert abs(minhash_dedup.estimate(regs[:1], regs[1:], np.array([900.0]), np.array([900.0]))[0] - 0.8) < 0.12


def test_suffix_steps_take_documents_together(spark):
    """A batch gives few batches, not one a document, and what documents give alone."""
    import numpy as np
    import pyarrow as pa

    class Captured:
        schema = spark.createDataFrame([], "doc_id long").schema

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    r = random.Random(9)
    texts = ["".join(r.choice("abcdé") for _ in range(r.choice([0, 100, 130, 260]))) for _ in range(200)] + [None]
    sizes = [len((t or "").encode()) for t in texts]
    spans = [[{"a": a, "b": a + r.choice([1, 30, 100, 500])} for a in r.sample(range(n + 1), min(n, r.randint(0, 4)))] + [{"a": 0, "b": 7}, {"a": max(0, n - 5), "b": n}] * (k % 2) for k, n in enumerate(sizes)]
    runs = [[{"pos": p, "n": 1 + p % 3, "at": 20 + p % 30, "part": (20 + p % 30) // 14} for p in r.sample(range(n - 101), min(3, n - 101))] if n > 101 else [] for n in sizes]
    for step, lists in ((lambda: suffix_dedup.cut_spans(Captured(), True), spans), (lambda: suffix_dedup.sides(Captured(), 100), runs), (lambda: suffix_dedup.open_windows(Captured(), 100), runs)):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(lists)], ["doc_id", "text", "list"])
        together = list(step()(iter([batch])))
        alone = [x for k in range(len(texts)) if lists is spans or lists[k] for x in step()(iter([batch.slice(k, 1)]))]
        assert len(together) < 5 and pa.Table.from_batches(together).to_pylist() == pa.Table.from_batches(alone).to_pylist()
    for row, t, own in zip(pa.Table.from_batches(suffix_dedup.cut_spans(Captured(), True)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array(spans)], ["doc_id", "text", "list"])]))).to_pylist(), texts, spans):
        data = (t or "").encode()
        gone = [any(s["a"] <= i < s["b"] for s in own) for i in range(len(data))]
        kept = bytes(x for x, g in zip(data, gone) if not g)
        edges = [i for i in range(len(data) + 1) if (gone[i] if i < len(data) else False) != (gone[i - 1] if i else False)]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_text"], row["kept_sha256"]) == (len(data), sum(gone), len(edges) // 2, kept, hashlib.sha256(kept).hexdigest())
        assert row["removed"] == [edges[i : i + 2] for i in range(0, len(edges), 2)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    h = [x for b in suffix_dedup.find_segments(Captured(), 100)(iter([docs])) for x in b.column(0).to_pylist()]
    assert h and h == [x for b in suffix_dedup.find_anchors(Captured(), 100)(iter([docs.select(["text"])])) for x in b.column(0).to_pylist()]
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    at = np.arange(len(data) - 43)
    assert (suffix_dedup.RangeHash(data).every(44) == suffix_dedup.RangeHash(data)(at, at + 44)).all()


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.default_ranks())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = awkward() + ["don't  stop\n\n it's 42!? 漢字 😀 <|endoftext|>", " lead", "trail ", "x" * 3000]
    r = random.Random(11)
    texts += ["".join(r.choice(["a", "bc ", " ", " ", "\n", "\t", "\u00a0", "\x1c", "it's ", "9!", "é"]) for _ in range(r.randint(1, 40))) for _ in range(400)] * 2
    for row in bpe.encode_decode(table(spark, texts)).collect():
        t = texts[row["doc_id"]] or ""
        assert row["ids"] == library.encode_ordinary(t) and row["n_tokens"] == len(row["ids"])
        assert row["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_encodes_different_pieces_together(monkeypatch):
    """A block's unknown pieces take a few passes over arrays; one by one they took most of the time."""
    import public_tokenizers
    import pyarrow as pa

    ranks = bpe.read_ranks(bpe.default_ranks())
    r = random.Random(7)
    texts = [" ".join("".join(r.choice(["th", "ing", "é", "ction", "x", "漢", "ß", "qu", "\n"]) for _ in range(r.randint(1, 9))) for _ in range(60)) for _ in range(40)] + [None, ""]
    texts += [x.replace(" ", r.choice(["  ", " \n", " ", "\u00a0 "])) + " " for x in texts[:8]]
    alone = bpe.PrefixEncoder.encode_piece
    calls = []
    monkeypatch.setattr(bpe.PrefixEncoder, "encode_piece", lambda self, piece: calls.append(piece) or alone(self, piece))
    expected = []
    for t in texts:
        pieces = bpe._splitter(public_tokenizers.PATTERN).findall(t or "")
        expected.append(([i for p in pieces for i in bpe.PrefixEncoder.merge(bpe._encoder(bpe.default_ranks()), p.encode())], (t or "").encode()))
    for memory, block in ((200_000, 4 << 20), (50, 500), (1, 1)):
        monkeypatch.setattr(bpe, "MEMORY", memory)
        monkeypatch.setattr(bpe, "BLOCK", block)
        encoder = bpe.TextEncoder(bpe.default_ranks(), public_tokenizers.PATTERN)
        calls.clear()
        assert [(list(map(int, ids.split())), plain) for ids, plain in encoder.encode(pa.array(texts))] == expected
        assert block < 1000 or len(calls) < 300
    pieces = list({t[i : i + n] for t in list(ranks)[:9000:30] for i in range(3) for n in range(1, 9) if t[i : i + n]}) + [bytes(r.choices(b"abein t=", k=n)) for n in range(1, 80)]
    encoder = bpe.PrefixEncoder(ranks)
    assert encoder.encode_many(pieces) == [encoder.merge(p) for p in pieces]


def test_bpe_append_and_edit():
    e = bpe.PrefixEncoder(bpe.read_ranks(bpe.default_ranks()))
    r = random.Random(5)
    for _ in range(200):
        s = "".join(r.choice(["a", "b", "ing", "the", "ction", " ", "==", "é"]) for _ in range(r.randint(1, 60))).encode()
        last = e.last_tokens(s)
        assert e.tokens(last) == e.merge(s) and e.append(s, last, b"xing") == e.last_tokens(s + b"xing")
        i, j = sorted((r.randint(0, len(s)), r.randint(0, len(s))))
        assert e.replace(s, last, i, j, b"zen") == (s[:i] + b"zen" + s[j:], e.last_tokens(s[:i] + b"zen" + s[j:]))


def test_mix(spark):
    texts = awkward(n=150)
    docs = table(spark, texts, ["a", "b", None, "c", "d"])
    rows = mixing.mix_plan(docs).collect()
    total = sum(r["size"] for r in rows)
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts))) and all(r["size"] == len(words_of(texts[r["doc_id"]])) for r in rows)
    targets = {r["doc_id"] % 5: (r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets.values())
    for k, (_, t) in targets.items():
        assert abs(sum(r["taken"] for r in rows if r["doc_id"] % 5 == k) - t) <= 0.35 * t
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix_plan(docs.repartition(1)).collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    joined = mixing.mix(docs, lookup=2)
    assert joined.columns == docs.columns and sorted(r["doc_id"] for r in joined.collect()) == sorted(r["doc_id"] for r in out.collect())


def test_url_filter(spark):
    urls = ["http://a.NET/x", "http://b.example.net/en/1?q", "https://example.com/de/", "http://x.org/fr/a#b", "http://casino-win.example.org/", "http://a.net", None, "nothing", "ftp://x.net?y"]
    docs = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    got = [tuple(r)[1:] for r in url_filter.filter_urls(docs, url_filter.hosts_named(docs)).orderBy("page_id").collect()]
    assert got == [("a.net", "/x", "net/", "block"), ("b.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("x.org", "/fr/a", "org/fr/", "allow"), ("casino-win.example.org", "/", None, "block"), ("a.net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.net", "", None, "allow")]
    listed = spark.createDataFrame([("a.net",), (None,), ("unseen.org",), ("x.org",), ("",), ("x.net",), ("x.net",)], "key string")
    verdicts = [r["verdict"] for r in url_filter.filter_urls(docs, listed).orderBy("page_id").collect()]
    assert verdicts == ["block", "allow", "block", "allow", "allow", "block", "block", "block", "block"]


def test_cascade_is_exact(spark):
    u = spark.range(5000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    c = url_filter.BloomCascade(u, chunk=10)
    assert len(c.levels) > 1 and u.where(c.contains(u["key"]) != u["listed"]).count() == 0


def test_quality_rules(spark):
    texts = awkward() + ["a b c a b c d a b c " * 20, "l1 x\nl1 x\n\n#*|\nl1 x"]
    labels = spark.createDataFrame([(i, 1 if i < 30 else 0, 0) for i in range(40)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ngram_model.quality_rules(table(spark, texts), labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(win)
        cover = {k + d for k, x in enumerate(win) if often[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert (r["word_chars"], r["n_symbols"]) == (sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def likelihood_ratios(spark, texts, trusted, buckets):
    """log weight and number of n-grams of each text, counted one by one; the hash is Spark's."""
    grams = [[(x,) for x in w] + list(zip(w, w[1:])) for w in (list(map(bytes.decode, (t or "").encode().split())) for t in texts)]
    from pyspark.sql import functions as F

    every = sorted({g for x in grams for g in x})
    df = spark.createDataFrame([(i, g[0], g[-1], len(g)) for i, g in enumerate(every)], "i long, a string, b string, n int")
    slot = {every[r[0]]: r[1] for r in df.select("i", F.pmod(F.when(F.col("n") == 1, F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(buckets))).collect()}
    raw, target = Counter(slot[g] for x in grams for g in x), Counter(slot[g] for i in trusted for g in grams[i])
    p = lambda c, b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * buckets))
    ratio = [p(target, b) - p(raw, b) for b in range(buckets)]
    return [(sum(ratio[slot[g]] for g in x), len(x)) for x in grams]


def test_quality_ratios(spark):
    texts = awkward() + ["word " * 30_000 + "end"]
    labels = spark.createDataFrame([(i, int(i < 30 or i == 66), 0) for i in range(0, 70, 2)] + [(2, 0, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = [i for i in range(len(texts)) if i % 2 == 0 and (i < 30 or i == 66)]
    got = {r["doc_id"]: r for r in ngram_model.quality_rules(table(spark, texts), labels, buckets=64).collect()}
    brute = [w / n if n else None for w, n in likelihood_ratios(spark, texts, trusted, 64)]
    assert all((got[i]["llr"] is None and x is None) or abs(got[i]["llr"] - x) < 1e-9 for i, x in enumerate(brute))
    steps = sorted(math.floor(brute[i] / 0.001) for i in trusted if brute[i] is not None)
    cut = next(x for k, x in enumerate(steps) if sum(y <= x for y in steps) > 0.01 * len(steps)) * 0.001
    for i, x in enumerate(brute):
        assert got[i]["kept"] == (not got[i]["base_failed"] and x is not None and x >= cut)


def test_importance_resampling(spark):
    texts = awkward()
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = ngram_model.importance_resample(table(spark, texts), labels, k=25, buckets=64).collect()
    brute = likelihood_ratios(spark, texts, range(30), 64)
    for r in rows:
        u = int(hashlib.md5(f"gumbel:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 16**13 + 2.0**-54
        weight = brute[r["doc_id"]][0]
        assert abs(r["log_weight"] - weight) < 1e-9 and abs(r["gumbel_key"] - (weight - math.log(-math.log(u)))) < 1e-9
    ranked = sorted(rows, key=lambda r: -r["gumbel_key"])
    assert [r["kept"] for r in ranked] == [True] * 25 + [False] * (len(rows) - 25) and len(rows) == len(texts)


def test_importance_resampling_keeps_exactly_k_of_ties(spark):
    texts = ["same text here"] * 30 + [None] * 10 + ["other words"]
    docs = table(spark, texts, ids=[7] * 30 + [None] * 10 + [8])
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    for k in (0, 1, 13, 35, 41, 99):
        rows = ngram_model.importance_resample(docs, labels, k=k).collect()
        assert len(rows) == 41 and sum(r["kept"] for r in rows) == min(k, 41)
        assert min([r["gumbel_key"] for r in rows if r["kept"]], default=0) >= max([r["gumbel_key"] for r in rows if not r["kept"]], default=-1e9) or k == 0


def test_language_id(spark):
    r = random.Random(6)
    vocab = {"de": ["der", "und", "nicht", "schön", "über", "haus"], "en": ["the", "and", "with", "house", "thing", "what"]}
    texts = [" ".join(r.choice(vocab["en" if i % 2 else "de"]) for _ in range(40)) for i in range(120)] + [None, "12 34", ""]
    got = {x["doc_id"]: x for x in language_crf.identify_languages(table(spark, texts)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(120)) and [got[i]["lang_pred"] for i in (120, 121, 122)] == ["und"] * 3
    assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= x["score"] <= 1 for i, x in got.items())


def test_forward_backward_in_blocks():
    import numpy as np

    rng = np.random.default_rng(7)
    first, moves = np.array([0, 3, 3, 80, 81]), rng.normal(size=(3, 3))
    score = rng.normal(size=(81, 3))
    blocks, one = language_crf.marginals(score, first, moves, 8), language_crf.marginals(score, first, moves, 100)
    assert np.allclose(blocks[0], one[0]) and np.allclose(blocks[1], one[1])
    paths = np.array([[a, b, c] for a in range(3) for b in range(3) for c in range(3)])
    w = np.exp(score[0, paths[:, 0]] + score[1, paths[:, 1]] + score[2, paths[:, 2]] + moves[paths[:, 0], paths[:, 1]] + moves[paths[:, 1], paths[:, 2]]) * np.exp(moves).sum(axis=0)[paths[:, 0]]
    assert np.allclose(one[0][1], [w[paths[:, 1] == k].sum() / w.sum() for k in range(3)])


def test_lattice_scores(spark):
    path = lattice_lm.default_vocabulary()
    pieces, log_p = lattice_lm.vocabulary(path)
    p = dict(zip(pieces, log_p))

    def brute(w):
        w = lattice_lm.MARK + w
        a = [0.0] + [-math.inf] * len(w)
        for j in range(1, len(w) + 1):
            v = [a[i] + p[w[i:j]] for i in range(j) if w[i:j] in p]
            a[j] = max(v) + math.log(sum(math.exp(x - max(v)) for x in v))
        return a[-1]

    words = [b"the", "é".encode(), b"x" * 300, b"hello", b"thtionwh"]
    lattice = lattice_lm.Lattice(path)
    assert max(abs(lattice.scores(words) - [brute(w) for w in words])) < 1e-8
    uses = lattice.expected(words, [1.0, 2.0, 1.0, 1.0, 1.0] * __import__("numpy").ones(5))
    assert abs(sum(uses[i] * len(x) for i, x in enumerate(pieces)) - (6 + 2 * 5 + 303 + 8 + 11)) < 1e-6


def test_long_texts_are_labelled_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessera.llm.common import text_bytes

    r = random.Random(9)
    model = language_crf.LanguageModel(["de", "en"])
    model.fit([" ".join(r.choice(["der", "und", "nicht"]) for _ in range(60)), " ".join(r.choice(["the", "and", "with"]) for _ in range(60))], ["de", "en"])
    for words in (["der", "und", "the"], ["and", "with", "nicht"]):
        data, offsets = text_bytes(pa.array([" ".join(r.choice(words) for _ in range(5000)) + " " + "und" * 3000], pa.string()))
        whole = model.predict(data, offsets)
        with monkeypatch.context() as m:
            m.setattr(language_crf, "PART_BYTES", 700)
            m.setattr(language_crf, "PART_WORDS", 333)
            parts = model.predict(data, offsets)
        assert whole[0] == parts[0] and np.allclose(whole[1], parts[1], rtol=0, atol=1e-9)


def test_a_long_word_scores_as_a_short_one_would(monkeypatch):
    import numpy as np

    weights = np.random.default_rng(1).normal(size=(1 << 17, 3)).astype(np.float32) / 100
    for word in (b"q" * 701, bytes(random.Random(6).choices(range(97, 123), k=5000))):
        data = np.frombuffer(word, np.uint8)
        whole = language_crf.emissions(language_crf.features(data, np.array([0]), np.array([len(data)])), weights, 1)[0]
        with monkeypatch.context() as m:
            m.setattr(language_crf, "PART_BYTES", 700)
            assert np.allclose(language_crf.long_word(data, weights), whole, rtol=0, atol=1e-9)


def test_held_out_languages_and_code_switching(spark):
    """Whole held-out texts, and texts whose halves are of two languages: the words' labels follow the switch."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.common import text_bytes, word_spans

    r = random.Random(12)
    own = {"de": ["der", "und", "nicht", "schön", "über"], "en": ["the", "and", "with", "house", "thing"], "es": ["el", "los", "niño", "qué", "casa"]}
    names = list(own)
    rows = [(i, " ".join(r.choice(own[names[i % 3]]) for _ in range(30)), names[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [x for x in language_crf.identify_languages(docs).collect() if x["held_out"]]
    assert len(got) > 40 and all(x["lang_pred"] == names[x["doc_id"] % 3] and x["score"] > 0.8 for x in got)
    model = language_crf.fit_language_model(docs)
    text = " ".join(r.choice(own["de"]) for _ in range(40)) + " " + " ".join(r.choice(own["es"]) for _ in range(20))
    data, offsets = text_bytes(pa.array([text], pa.string()))
    starts, ends, first = word_spans(data, offsets)
    score = language_crf.word_scores(language_crf.lower_bytes(data), starts, ends, model.weights)
    labels = language_crf.marginals(score, first, model.moves)[0].argmax(axis=1)
    assert [model.labels[k] for k in labels] == ["de"] * 40 + ["es"] * 20
    assert model.predict(data, offsets)[0] == ["de"] and abs(model.predict(data, offsets)[1][0] - 2 / 3) < 0.05 and np.isfinite(score).all()


def test_language_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(i, "the and" if i % 2 else "der und", "en" if i % 2 else "de", 1, "x") for i in range(40)], "doc_id long, text string, lang string, score int, lang_pred string")
    assert {(x["doc_id"] % 2, x["lang_pred"]) for x in language_crf.identify_languages(docs).collect()} == {(0, "de"), (1, "en")}
    with pytest.raises(ValueError, match="score"):
        language_crf.label(docs, language_crf.fit_language_model(docs))


def test_language_sample_does_not_depend_on_partitions(spark):
    r = random.Random(10)
    rows = [(i, " ".join(r.choice(["der", "und", "nicht"] if i % 9 else ["the", "and"]) for _ in range(8)), "de" if i % 9 else "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_crf.fit_language_model(d, rows=30) for d in (docs.repartition(1), docs.repartition(7)))
    assert one.labels == ["de", "en"] and (one.weights == two.weights).all()


def test_lm_rounds_raise_the_held_out_likelihood(spark):
    r = random.Random(12)
    stems, ends = ["walk", "talk", "inter", "form", "play", "comput"], ["ing", "ed", "er", "ation", "s", ""]
    texts = [" ".join(r.choice(stems) + r.choice(ends) for _ in range(40)) for _ in range(150)]
    sums = {}
    for rounds in (0, 1, 4):
        rows = lattice_lm.score_documents(table(spark, texts), rounds=rounds).where("held_out").collect()
        sums[rounds] = sum(x["score"] for x in rows)
    assert sums[0] < sums[1] < sums[4]


@pytest.mark.parametrize("frequent", [5, 1000])
def test_lm_base(spark, frequent):
    texts = awkward() + ["q" * 100 + " " + "r" * 70, "q" * 100 + " a b"] * 3
    got = {r["doc_id"]: r for r in lattice_lm.score_documents(table(spark, texts), frequent=frequent).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    c = Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            c.update([*words_of(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        tokens = [*words_of(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)) < 1e-6 and r["score"] < 0


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, suffix_dedup.remove_repeats, minhash_dedup.near_components, bpe.encode_decode, mixing.mix_plan, mixing.mix, language_crf.identify_languages, lattice_lm.score_documents])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_empty_tables_with_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (ngram_model.quality_rules, ngram_model.importance_resample):
        assert f(spark.createDataFrame([], SCHEMA), labels).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages, url_filter.hosts_named(pages)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    table(spark, awkward()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, size long, rate double, copies long, n_tokens long, group string, row int, kept boolean, component_id long, keep_id long, order int, first int, t string, len int, head int"


def test_pipeline_stages_with_clashing_names_long_texts_and_empty_tables(spark):
    import corpus_pipeline

    texts = [*awkward(n=20), "und der " * 20_000, "long" * 30_000]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", 0, 0.5, "x", 1, 2.0, 3, 4, "g", 5, True, 6, 7, 8, 9, "t", 1, 2) for i, t in enumerate(texts)], CLASHES).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        given = {(x["doc_id"], x["text"], x["score"], x["row"]) for x in docs.collect()}
        kept = {(x["doc_id"], x["text"], x["score"], x["row"]) for x in out.collect()}
        assert kept <= given and len(kept) > 10, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {(x["doc_id"], x["decoded_sha256"]) for x in last.collect()} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}
    empty = spark.createDataFrame([], CLASHES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name


def test_pipeline_leaves_only_its_last_tables(spark, tmp_path):
    import os

    import corpus_pipeline
    from tessera.llm.common import shared_dir

    table(spark, awkward(n=20)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{shared_dir(spark).removeprefix('file://')}/tables"
    texts = lambda: {x for x in os.listdir(folder) if "text" in spark.read.parquet(f"file://{folder}/{x}").columns and "source" in spark.read.parquet(f"file://{folder}/{x}").columns}
    before = texts()
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(texts() - before) == 1  # what the last stage reads


def test_pipeline_drops_near_copies_from_80_percent(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(204)]
    pairs = {4: "80 to 85", 5: "below"}
    rows = []
    for n, (edits, _) in enumerate(pairs.items()):
        text = [f"{n}{w}" for w in base]
        near = [f"v{i}" if i in range(20, 20 * edits + 1, 20) else w for i, w in enumerate(text)]
        a, b = ({tuple(t[i : i + 5]) for i in range(200)} for t in (text, near))
        assert (0.8 <= len(a & b) / len(a | b) < 0.85) == (edits == 4)
        rows += [" ".join(text), " ".join(near)]
    kept = corpus_pipeline.near_copies(spark, table(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3]
    assert minhash_dedup.near_components(table(spark, rows)).where("kept").count() == 4


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_are_laid_out_for_the_threshold(percent):
    bands, rows = minhash_dedup.band_layout(percent)
    assert bands * rows <= minhash_dedup.REGISTERS and (1 - (percent / 100) ** rows) ** bands < 1e-6
    assert percent != 85 or (bands, rows) == (24, 5)


@pytest.mark.parametrize("percent", [80, 85])
def test_bands_and_slack_together_miss_less_than_one_in_a_million(percent):
    p, n = percent / 100, minhash_dedup.REGISTERS
    bands, rows = minhash_dedup.band_layout(percent)
    dropped = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n) if k / n < p - minhash_dedup.SLACK)
    assert (1 - p**rows) ** bands + dropped < 1e-6


def test_pipeline_with_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    vocab = {"de": ["der", "und", "nicht", "schön", "über", "haus"], "en": ["the", "and", "with", "house", "thing", "what"]}
    fresh = lambda lang: " ".join(r.choice(vocab[lang]) for _ in range(60))
    a, b, c, d, e = (fresh("en") for _ in range(5))
    rows = [(i, fresh("en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(60)]
    rows += [(900, a, "en")] * 3 + [(901, a, "en"), (None, a, "en"), (None, b, "en"), (None, b, "en"), (None, "12 34", "en")]
    rows += [(902, c, "en"), (902, fresh("de"), "en"), (902, "56 78", "en"), (902, c + " tail", "en"), (None, d, "en"), (903, d + " tail", "en"), (None, e, "en"), (None, e + " tail", "en")]
    docs = spark.createDataFrame([(*x, "s", 0) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    state = lambda df: Counter((x["doc_id"], x["text"]) for x in df.collect())

    lettered = [(i, t) for i, t, _ in rows if any(ch.isalpha() for ch in t)]
    out = corpus_pipeline.language_id(spark, docs, "")
    assert state(out) == Counter(lettered)
    assert all(x["lang"] == ("de" if set(x["text"].split()) & set(vocab["de"]) else "en") for x in out.collect())

    first = lambda group: min(group, key=lambda x: (x[0] is None, x[0] or 0))
    exact = Counter(first([x for x in lettered if x[1] == t]) for t in {t for _, t in lettered})
    assert state(corpus_pipeline.exact_copies(spark, out, "")) == exact

    parts = [{t, f"{t} tail"} for t in (c, d, e)]
    near = Counter()
    for group in [g for t in exact for g in [[x for x in exact if any({x[1], t[1]} <= p for p in parts) or x == t]]]:
        near[first(sorted(group, key=str))] = 1
    got = state(corpus_pipeline.near_copies(spark, corpus_pipeline.exact_copies(spark, out, ""), ""))
    # of rows with the same id, either may stay
    assert Counter((i, t.removesuffix(" tail")) for i, t in got.elements()) == Counter((i, t.removesuffix(" tail")) for i, t in near.elements())
    got = state(corpus_pipeline.near_copies(spark, out, ""))
    assert Counter((i, t.removesuffix(" tail")) for i, t in got.elements()) == Counter((i, t.removesuffix(" tail")) for i, t in near.elements())

    mixed = Counter({x["doc_id"]: 0 for x in docs.collect()})
    for i, _ in near:
        u = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        mixed[i] += 1 + (u < 0.5)  # one source: its rate is the budget, 1.5
    run = Counter(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert run == +mixed
