"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed byte n-grams, affixes and the word itself (the lexicon); transitions are learned. The
forward-backward recursion labels the words of code-switched text; a document's language is the one with the largest
share of its words' probability, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import _BASE, RangeHash, crc_mod, lower_bytes, mix64, runs_of_docs, text_bytes, word_spans

UNKNOWN = "und"
SLOTS = 1 << 17
GRAMS, AFFIXES = (1, 2, 3), (1, 2, 3)
#: The classifier is fitted on at most so many rows of each language, drawn by a hash of id and text; of a longer text, on a
#: stretch of so many characters at a place drawn by the hash. More languages are refused, not left out.
TRAIN_ROWS, TRAIN_CHARS, MOST_LANGUAGES = 120, 50_000, 100
#: Words are scored so many bytes at a time, and sequences of words are run in parts of so many.
PART_BYTES, PART_WORDS = 1 << 19, 1 << 17
EPOCHS, RATE, SPAN = 25, 0.3, 48


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, number for each word), kind by kind; the slots follow the words' order."""
    ranges, n = RangeHash(data), ends - starts
    out = []
    slot = lambda a, b, kind: ((ranges(a, b) * np.uint64(2 * kind + 1)) >> np.uint64(64 - 17)).astype(np.int32)
    for g in GRAMS:
        count = np.maximum(n - g + 1, 0)
        at = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())
        out.append((slot(at, at + g, g), count))
    for g in AFFIXES:
        has = n >= g
        out.append((slot(starts[has], starts[has] + g, 10 + g), has.astype(np.int64)))
        out.append((slot(ends[has] - g, ends[has], 20 + g), has.astype(np.int64)))
    out.append((slot(starts, ends, 31), np.ones(len(n), np.int64)))
    return out


def emissions(feats: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_words: int) -> np.ndarray:
    out = np.zeros((n_words, weights.shape[1]))
    for slots, count in feats:
        sums = np.concatenate((np.zeros((1, weights.shape[1])), np.cumsum(weights[slots], axis=0, dtype=np.float64)))
        stop = np.cumsum(count)
        out += sums[stop] - sums[stop - count]
    return np.clip(out, -40, 40)


def long_word(data: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The emission of one word of more than PART_BYTES: the sums of features(), taken part by part."""
    slot = lambda h, kind: ((h * np.uint64(2 * kind + 1)) >> np.uint64(64 - 17)).astype(np.int32)
    whole = lambda x: RangeHash(x)(np.array([0]), np.array([len(x)]))
    out, total = np.zeros(weights.shape[1]), np.zeros(1, np.uint64)
    for at in range(0, len(data), PART_BYTES):
        part = data[at : at + PART_BYTES + max(GRAMS) - 1]
        ranges = RangeHash(part)
        for g in GRAMS:
            n = min(PART_BYTES, len(part) - g + 1)
            if n > 0:
                out += weights[slot(ranges(np.arange(n), np.arange(n) + g), g)].sum(axis=0, dtype=np.float64)
        end = min(PART_BYTES, len(part))
        total += ranges.sums[end : end + 1] * np.uint64(pow(_BASE, at, 2**64))
    for g in AFFIXES:
        out += weights[slot(whole(data[:g]), 10 + g)[0]].astype(np.float64) + weights[slot(whole(data[-g:]), 20 + g)[0]]
    out += weights[slot(mix64(total + np.uint64(len(data))), 31)[0]]
    return np.clip(out, -40, 40)


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Emissions of the words, some PART_BYTES of text at a time."""
    out, i = np.zeros((len(starts), weights.shape[1])), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART_BYTES, "right")))
        a, b = starts[i], ends[j - 1]
        out[i:j] = long_word(data[a:b], weights) if b - a > PART_BYTES else emissions(features(data[a:b], starts[i:j] - a, ends[i:j] - a), weights, j - i)
        i = j
    return out


def transfer(score: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The product of all steps of one sequence, up to a factor: what any state before it becomes."""
    steps = np.exp(moves)[None] * np.exp(score - score.max(axis=1, keepdims=True))[:, None, :]
    while len(steps) > 1:
        steps = np.concatenate((steps[:-1:2] @ steps[1::2], steps[len(steps) - len(steps) % 2 :]))
        steps /= steps.sum(axis=(1, 2), keepdims=True)
    return steps[0]


def marginals(score: np.ndarray, first: np.ndarray, moves: np.ndarray, width: int = 32, head: np.ndarray | None = None, tail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of the words by forward-backward, and the expected transitions.

    head and tail are what comes in from words before and after; uniform by default.

    Sequences lie one after the other (first: where each starts, with the end). They are cut into blocks of `width`:
    the blocks' transfer matrices give what comes in at both sides, and all blocks then run at once.
    """
    k = score.shape[1]
    lengths = np.diff(first)
    per = -(-lengths // width)
    n = int(per.sum())
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    seq = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(n) - np.repeat(np.cumsum(per) - per, per)
    begin = first[:-1][seq] + rank * width
    size = np.minimum(width, first[1:][seq] - begin)
    e, a = np.exp(score - score.max(axis=1, keepdims=True)), np.exp(moves)
    at = np.minimum(begin[:, None] + np.arange(width), len(score) - 1)
    live = np.arange(width) < size[:, None]
    grid = e[at]
    norm = lambda x: x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
    through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(width):
        go = live[:, t]
        through[go] = norm((through[go] @ a) * grid[go, t][:, None, :])
    into, out = np.tile(np.full(k, 1.0 / k) if head is None else head, (n, 1)), np.tile(np.full(k, 1.0 / k) if tail is None else tail, (n, 1))
    for r in range(1, int(per.max())):
        now = np.flatnonzero(rank == r) if r == 1 else now[now + 1 < n] + 1
        now = now[rank[now] == r]
        into[now] = norm((into[now - 1][:, None, :] @ through[now - 1])[:, 0])
    last = np.cumsum(per[per > 0]) - 1
    now = last[rank[last] > 0] - 1
    while len(now):
        out[now] = norm((through[now + 1] @ out[now + 1][:, :, None])[:, :, 0])
        now = now[rank[now] > 0] - 1
    alpha, state = np.empty((width, n, k)), into
    before = np.empty((width, n, k))
    for t in range(width):
        before[t] = state
        state = np.where(live[:, t, None], norm((state @ a) * grid[:, t]), state)
        alpha[t] = state
    gamma, pairs, state = np.empty((n, width, k)), np.zeros((k, k)), out
    for t in range(width - 1, -1, -1):
        gamma[:, t] = norm(alpha[t] * state)
        go = live[:, t] & ((rank > 0) | (t > 0))
        after = grid[go, t] * state[go]
        both = before[t][go][:, :, None] * a * after[:, None, :]
        pairs += norm(both).sum(axis=0)
        state = np.where(live[:, t, None], norm((grid[:, t] * state) @ a.T), state)
    return gamma[live], pairs


class LanguageModel:
    """labels, feature weights and transitions; fit() and predict()."""

    def __init__(self, labels: list[str]):
        self.labels, k = labels, len(labels)
        self.weights, self.moves = np.zeros((SLOTS, k), np.float32), np.zeros((k, k))

    def fit(self, texts: list[str], langs: list[str], seed: int = 5) -> LanguageModel:
        """Maximum likelihood by AdaGrad; stretches of different texts are joined, so that switches occur."""
        import pyarrow as pa

        data, offsets = text_bytes(pa.array(texts, pa.string()))
        data, k = lower_bytes(data), len(self.labels)
        starts, ends, first = word_spans(data, offsets)
        truth = np.repeat([self.labels.index(x) for x in langs], np.diff(first))
        rng = np.random.default_rng(seed)
        cuts = np.unique(np.concatenate([np.arange(a + rng.integers(1, SPAN), b, SPAN) for a, b in zip(first[:-1], first[1:])] + [first]))
        order = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in rng.permutation(len(cuts) - 1)]) if len(cuts) > 1 else np.zeros(0, np.int64)
        starts, ends, truth = starts[order], ends[order], truth[order]
        if not len(order) or k < 2:
            return self
        bounds = np.append(np.arange(0, len(order), 4 * SPAN), len(order))
        feats, want = features(data, starts, ends), np.eye(k)[truth]
        inner = np.ones(len(order), bool)
        inner[bounds[:-1]] = False
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
        g_w, g_m = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6)
        words = [np.repeat(np.arange(len(order), dtype=np.int32), count) for _, count in feats]
        for _ in range(EPOCHS):
            p, pairs = marginals(emissions(feats, self.weights, len(order)), bounds, self.moves)
            miss, step = (want - p) / len(order), np.zeros((SLOTS, k))
            for (slots, _), word in zip(feats, words):
                for label in range(k):
                    step[:, label] += np.bincount(slots, miss[word, label], SLOTS)
            step -= 1e-7 * self.weights
            g_w += step**2
            self.weights += (RATE * step / np.sqrt(g_w)).astype(np.float32)
            move = (seen - pairs) / len(order) - 1e-4 * self.moves
            g_m += move**2
            self.moves += RATE * move / np.sqrt(g_m)
        return self

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each document."""
        data = lower_bytes(data)
        starts, ends, first = word_spans(data, offsets)
        if len(offsets) == 2 and len(starts) > PART_WORDS:
            share = self.long_share(data, starts, ends)[None]
        else:
            p, _ = marginals(word_scores(data, starts, ends, self.weights), first, self.moves)
            sums = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(p * (ends - starts)[:, None], axis=0)))
            share = sums[first[1:]] - sums[first[:-1]]
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        best = share.argmax(axis=1)
        return [self.labels[i] for i in best], share[np.arange(len(best)), best].clip(0, 1)

    def long_share(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each language's weight in one long text, in parts: their transfers first, then each with what comes in."""
        parts = [slice(i, i + PART_WORDS) for i in range(0, len(starts), PART_WORDS)]
        score = lambda part: word_scores(data, starts[part], ends[part], self.weights)
        through = [transfer(score(part), self.moves) for part in parts]
        heads = [np.full(len(self.labels), 1.0 / len(self.labels))]
        tails = [heads[0]]
        for step in through[:-1]:
            heads.append(heads[-1] @ step / (heads[-1] @ step).sum())
        for step in through[:0:-1]:
            tails.append(step @ tails[-1] / (step @ tails[-1]).sum())
        total = np.zeros(len(self.labels))
        for part, head, tail in zip(parts, heads, reversed(tails)):
            p, _ = marginals(score(part), np.array([0, len(starts[part])]), self.moves, 32, head, tail)
            total += (p * (ends[part] - starts[part])[:, None]).sum(axis=0)
        return total


def fit_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, rows: int = TRAIN_ROWS) -> LanguageModel:
    """The model of df's rows with a language, without those whose crc32(id) mod `folds` is 0.

    Languages are counted over all these rows; the fit sees at most `rows` of each (the bound): those with the smallest
    hashes of id and text, whatever the partitioning. A first draw of about twice as many keeps the sort small.
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, folds) != 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return LanguageModel([])
    share = F.element_at(F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * rows + 100) / n))))), F.col(lang_col))
    h = F.xxhash64(F.lit("lang"), id_col, text_col)
    place = (F.pmod(F.col("h"), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))) + 1).cast("int")
    drawn = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"), share.alias("share")).where((F.col("h") / 2.0**64 + 0.5) < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = sorted((r[0], r[1]) for r in drawn.select("lang", F.substring("text", place, F.lit(TRAIN_CHARS)).alias("text"), "h").withColumn("rank", rank).where(F.col("rank") <= rows).select("lang", "text").collect())
    return LanguageModel(sorted(counts)).fit([t for _, t in sample], [x for x, _ in sample])


def label(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (all) of df with lang_pred and score of each row: `und` with score 0 for null text or text without a letter.

    `names` are those of the two new columns; a kept column of that name is refused.
    """
    keep = df.columns if keep is None else keep
    if clash := {x.lower() for x in keep} & {x.lower() for x in names}:
        raise ValueError(f"the result would have two columns {', '.join(sorted(clash))}: choose other names")
    shared = df.sparkSession.sparkContext.broadcast(model)
    texts = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        letter, own = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(texts))
            lettered = np.array([bool(letter.search(x.as_py() or "")) for x in batch.column(texts)], bool)
            langs, scores = [], []
            for i, j in runs_of_docs(offsets, 1 << 19) if own.labels else ():
                found, score = own.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                langs += found
                scores.append(score)
            if not own.labels:
                langs, scores, lettered = [UNKNOWN] * len(lettered), [np.zeros(len(lettered))], np.zeros(len(lettered), bool)
            score = np.where(lettered, np.concatenate(scores) if scores else np.zeros(0), 0.0)
            out = [*batch.columns[: len(keep)], pa.array([x if ok else UNKNOWN for x, ok in zip(langs, lettered)], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[: len(keep)], *names])

    given = df.select(*keep, *([] if text_col in keep else [text_col]))
    return given.mapInArrow(run, StructType([*given.schema.fields[: len(keep)], StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    return label(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), model, "__text", ["doc_id"])


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of df; learned from rows that are not held out.

    Null text and text without letters is `und`. Repeated rows are judged each. Without training rows every text is
    `und`. An empty table gives an empty result; other columns are ignored, and language and id never predict.
    """
    found = identify(df, fit_language_model(df, id_col, text_col, lang_col, folds), id_col, text_col)
    return found.select("doc_id", (crc_mod("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
