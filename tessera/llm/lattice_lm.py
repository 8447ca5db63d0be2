"""Language-model scoring: a unigram model over subword pieces, summed over all segmentations of a text.

The pieces and their scores come from an existing vocabulary file. The scores, as ranks of a Zipf law, weight the
segmentations of the training words; the expected piece counts, smoothed by the same law, weight the next pass, and
after a few such rounds are the model. A document's probability is the product of its words' marginals and of the end's: pieces never cross words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, materialize

#: Words looked up in each task without a shuffle: the most frequent ones, at most so many. Longer words go by a digest.
FREQUENT, LONG = 65_536, 64
#: Rounds of expected piece counts.
ROUNDS = 4
#: Weight of the vocabulary's own law against the corpus counts, in pieces.
PRIOR = 1000.0
FLUSH = 300_000
MARK = "▁".encode()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces' bytes and prior log probabilities. Byte pieces rank after all others; the mark only begins."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    weight: dict[bytes, float] = {bytes([b]): 1.0 / (n + 1) for b in range(256)}
    for i in range(n):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).encode()
            if MARK not in piece[1:]:
                weight[piece] = weight.get(piece, 0.0) + 1.0 / (1.0 - model.get_score(i))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, np.log(p / p.sum())


class Lattice:
    """Marginal log probabilities of words over all their segmentations, many words at a time."""

    BLOCK = 400_000

    def __init__(self, path: str, log_p: np.ndarray | None = None):
        pieces, prior = vocabulary(path)
        self.n, self.log_p = len(pieces), prior if log_p is None else log_p
        self.child, self.piece = _trie(path)

    def blocks(self, words: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of words of bounded size: bytes, each word with the mark before it, and offsets."""
        ends = np.cumsum([len(w) + len(MARK) for w in words])
        i = 0
        while i < len(words):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + self.BLOCK, "right")))
            offsets = np.concatenate(([0], ends[i:j] - (ends[i - 1] if i else 0)))
            yield slice(i, j), np.frombuffer(MARK + MARK.join(words[i:j]), np.uint8), offsets
            i = j

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces found in the words: source and target node, piece, and each node's place in its word.

        A word of n bytes has n + 1 nodes; the trie is walked from every byte at once.
        """
        lengths = np.diff(offsets)
        word = np.repeat(np.arange(len(lengths)), lengths)
        stop = offsets[1:][word]
        start, at, found = np.arange(len(data)), np.zeros(len(data), np.int32), []
        for l in range(len(data)):
            live = start + l < stop[start]
            start, at = start[live], at[live]
            at = self.child[at, data[start + l]]
            start, at = start[at > 0], at[at > 0]
            if not len(start):
                break
            hit = self.piece[at] >= 0
            source = start[hit] + word[start[hit]]
            found.append((source, source + l + 1, self.piece[at[hit]]))
        place = np.arange(len(data) + len(lengths)) - np.repeat(offsets[:-1] + np.arange(len(lengths)), lengths + 1)
        return *(np.concatenate(x) for x in zip(*found)), place

    def walk(self, near: np.ndarray, far: np.ndarray, score: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-space recursion: value[far] = log sum exp(value[near] + score), by growing place; 0 at `first`."""
        value = np.full(len(place), -np.inf)
        value[first] = 0
        order = np.lexsort((far, place[far]))
        near, far, score = near[order], far[order], score[order]
        heads = np.flatnonzero(np.diff(far, prepend=-1))
        steps = np.flatnonzero(np.diff(place[far[heads]], prepend=-1))
        for a, b in zip(steps, np.append(steps[1:], len(heads))):
            i, j = heads[a], heads[b] if b < len(heads) else len(far)
            value[far[heads[a:b]]] = np.logaddexp.reduceat(value[near[i:j]] + score[i:j], heads[a:b] - i)
        return value

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for part, data, offsets in self.blocks(words):
            source, target, piece, place = self.edges(data, offsets)
            nodes = offsets + np.arange(len(offsets))
            out[part] = self.walk(source, target, self.log_p[piece], place, nodes[:-1])[nodes[1:] - 1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in the words, each taken `counts` times."""
        total = np.zeros(self.n)
        for part, data, offsets in self.blocks(words):
            source, target, piece, place = self.edges(data, offsets)
            nodes, score = offsets + np.arange(len(offsets)), self.log_p[piece]
            first, last = nodes[:-1], nodes[1:] - 1
            alpha = self.walk(source, target, score, place, first)
            beta = self.walk(target, source, score, np.repeat(place[last], np.diff(nodes)) - place, last)
            word = np.repeat(np.arange(len(first)), np.diff(nodes))[source]
            total += np.bincount(piece, np.exp(alpha[source] + score + beta[target] - alpha[last][word]) * counts[part][word], self.n)
        return total


@lru_cache(2)
def _trie(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Children by node and byte (0: none; 0 is the root), and the piece that ends at each node or -1."""
    nodes: dict[bytes, int] = {b"": 0}
    for piece in vocabulary(path)[0]:
        for n in range(1, len(piece) + 1):
            nodes.setdefault(piece[:n], len(nodes))
    child, ends = np.zeros((len(nodes), 256), np.int32), np.full(len(nodes), -1, np.int32)
    for prefix, node in nodes.items():
        if prefix:
            child[nodes[prefix[:-1]], prefix[-1]] = node
    for i, piece in enumerate(vocabulary(path)[0]):
        ends[nodes[piece]] = i
    return child, ends


def word_key(word: bytes) -> bytes:
    """The word, or 65 bytes with the SHA-256 of a longer one."""
    return word if len(word) <= LONG else hashlib.sha256(word).hexdigest().encode() + b"#"


def count_words(df: DataFrame, text_col: str, train: str) -> DataFrame:
    """word (bytes, A-Z lower-cased), train, total: how often in the rows where the flag `train` holds, and in all."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows():
            words = list(total)
            out = [pa.array(words, pa.binary()), pa.array([inside.get(x, 0) for x in words], pa.int64()), pa.array(list(total.values()), pa.int64())]
            total.clear(), inside.clear()
            return pa.RecordBatch.from_arrays(out, ["word", "train", "total"])

        inside, total = Counter(), Counter()
        for batch in batches:
            for text, flag in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    words = text.as_py().encode().lower().split()
                    total.update(words)
                    if flag.as_py():
                        inside.update(words)
                if len(total) > FLUSH:
                    yield rows()
        if total:
            yield rows()

    parts = df.select(F.col(text_col), F.col(train)).mapInArrow(count, "word binary, train bigint, total bigint")
    return parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total"))


def score_documents(df: DataFrame, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df.

    Rows whose crc32(id) mod `folds` is not `held` are learned from. base_score is the add-one word unigram; score is
    the log10 probability of the text by the lattice model. The word table grows with the corpus and stays in
    Spark: each task looks up the most frequent words (at most `frequent`; from which count on, a histogram of the
    counts tells), and all other words of a document meet the table in a join by hash and word. Model parameters that travel are one number per vocabulary piece.

    Null or empty text is just an end. Repeated rows are scored each. A table without training rows scores with the
    vocabulary's law alone. An empty table gives an empty result; other columns are ignored.
    """
    spark, path = df.sparkSession, vocabulary_path or default_vocabulary()
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(id_col, folds) == held).alias("held_out"))
    counted = materialize(count_words(docs.withColumn("train", ~F.col("held_out")), "text", "train"))
    n_docs = docs.where("not held_out").count()
    n_words, v = counted.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    big_n, big_v = n_words + n_docs, v + (n_docs > 0)

    pieces, prior = vocabulary(path)
    ends, weight = n_docs + 1.0, PRIOR * np.exp(prior)
    own = np.log(weight / (weight.sum() + ends))
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(own)

        def expect(batches: Iterator, now=now) -> Iterator:
            import pyarrow as pa

            lattice, total = Lattice(path, now.value), 0.0
            for batch in batches:
                total = total + lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            if np.ndim(total):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

        weight = PRIOR * np.exp(prior)
        for r in counted.where("train > 0").select("word", "train").mapInArrow(expect, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            weight[r["piece"]] += r["uses"]
        own = np.log(weight / (weight.sum() + ends))
    log_p, log_end = spark.sparkContext.broadcast(own), float(np.log(ends / (weight.sum() + ends)))

    def marginal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lattice = Lattice(path, log_p.value)
        for batch in batches:
            given = batch.column(0).to_pylist()
            scores = lattice.scores(given) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(map(word_key, given), pa.binary()), *batch.columns[1:], pa.array(scores)], ["word", "train", "total", "lm"])

    words = materialize(counted.mapInArrow(marginal, "word binary, train bigint, total bigint, lm double").select(F.xxhash64("word").alias("wh"), "word", "train", "total", "lm"))
    level = F.floor(F.log2("total") * 8)
    room, least = frequent, None
    for r in sorted(words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= r["n"]
        if room < 0:
            break
        least = r["level"]
    top = words.where(level >= least).select("word", "train", "lm").collect() if least is not None else []
    table = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([r["train"] for r in top], np.int64), np.array([r["lm"] for r in top])))
    floor = big_n + 1 * (big_v + 1)

    def look_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, train, lm = table.value
        base = np.log10((train + 1) / floor)
        for batch in batches:
            rare: list[bytes] = []
            rare_of, tf, n, known, bases, lms = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                found = (text.as_py() or "").encode().lower().split()
                at = [index.get(x, -1) for x in found]
                n.append(len(at) + 1)
                at = np.array(at, np.int64)
                if (at < 0).any():
                    again = []
                    for word, times in Counter(word_key(found[i]) for i in np.flatnonzero(at < 0)).items():
                        if word in index:
                            again += [index[word]] * times
                        else:
                            rare.append(word), rare_of.append(k), tf.append(times)
                    at = np.concatenate((at, np.array(again, np.int64)))
                at = at[at >= 0]
                known.append(int((train[at] > 0).sum()) + (n_docs > 0))
                bases.append(base[at].sum() + np.log10((n_docs + 1) / floor))
                lms.append(lm[at].sum() + log_end / np.log(10))
            rare_of = np.array(rare_of, np.int64)
            both = lambda c: pa.concat_arrays([c, c.take(pa.array(rare_of))])
            add = lambda own, kind, other=0: pa.array(list(own) + [other] * len(rare), kind)
            yield pa.RecordBatch.from_arrays(
                [both(batch.column(0)), both(batch.column(2)), both(batch.column(3)), pa.array([None] * len(n) + rare, pa.binary()), pa.array([0] * len(n) + tf, pa.int64()), add(n, pa.int64()), add(known, pa.int64()), add(bases, pa.float64(), 0.0), add(lms, pa.float64(), 0.0)],
                ["doc_id", "held_out", "rid", "word", "tf", "n", "known", "base", "lm"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    parts = docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("rid")).mapInArrow(look_up, f"doc_id {kind}, held_out boolean, rid bigint, word binary, tf bigint, n bigint, known bigint, base double, lm double")
    # a document's own row has no word: its key is spread by the row, and meets nothing in the table
    parts = parts.select("doc_id", "held_out", "rid", F.coalesce(F.xxhash64("word"), F.lit(0)).alias("h"), "word", "tf", "n", "known", "base", "lm").withColumn("wh", F.when(F.col("word").isNull(), F.xxhash64("rid")).otherwise(F.col("h"))).drop("h")
    joined = parts.join(words.select("wh", "word", "train", F.col("lm").alias("word_lm")), ["wh", "word"], "left")
    times = F.when(F.col("tf") > 0, F.col("tf")).otherwise(0)
    c = F.coalesce("train", F.lit(0))
    return (
        joined.groupBy("rid", "doc_id", "held_out")
        .agg(
            F.sum("n").alias("n_tokens"),
            F.sum(F.col("known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + times * F.log10((c + 1) / F.lit(float(floor)))).alias("base_score"),
            F.sum(F.col("lm") + times * F.coalesce("word_lm", F.lit(0.0))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(big_n)).cast("bigint").alias("train_tokens"), "base_score", "score")
    )
