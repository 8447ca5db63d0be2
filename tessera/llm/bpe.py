"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece there is one last token with which its encoding can end; storing just that token per
byte gives the encoding by walking back, lets bytes be appended, and confines an edit to the bytes near it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import runs_of_docs, text_bytes

#: Encoded stretches, and pieces, that a task remembers in each of two generations; what is forgotten is encoded anew.
MEMORY = 200_000
#: Texts are encoded in blocks of about so many bytes.
BLOCK = 1 << 20
#: So many last bytes narrow down the tokens that can end there.
TAIL = 4


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes byte strings by merge ranks: last_tokens(), tokens(), append(), replace()."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.text = {i: f" {i}".encode() for i in self.token}
        self.longest = max(map(len, ranks), default=1)
        self.by_tail: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) >= TAIL:
                self.by_tail.setdefault(t[-TAIL:], set()).add(len(t))
        self.lengths: dict[bytes, list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.pairs = self.pair_fits = None

    def lengths_at(self, tail: bytes) -> list[int]:
        """Lengths, the longest first, that tokens ending in these last bytes can have."""
        found = self.lengths.get(tail)
        if found is None:
            short = {n for n in range(1, min(TAIL, len(tail) + 1)) if tail[-n:] in self.ranks}
            found = self.lengths[tail] = sorted(short | (self.by_tail.get(tail, set()) if len(tail) == TAIL else set()), reverse=True)
        return found

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: join the neighbours of the lowest rank, the leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    @cached_property
    def halves(self) -> dict[int, tuple[int, int]]:
        """Each token's last merge: the two tokens left when only lower ranks have merged; (t, t) for one byte."""
        out = {}
        for t, i in self.ranks.items():
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out[i] = (self.ranks[parts[0]], self.ranks[parts[-1]]) if len(t) > 1 else (i, i)
        return out

    def can_follow(self, left: int, token: int) -> bool:
        """Whether merging leaves left and token as they are; left is -1 at the start.

        Undoing the later of the two tokens' last merges, step by step, shows every pair of neighbours that meets at
        the seam; the seam holds if none of them would have merged before what was undone.
        """
        if len(self.fits) > 4 * MEMORY:
            self.fits.clear()
        if left < 0:
            found = self.merge(self.token[token]) == [token]
        else:
            a, b, before, found = left, token, 1 << 60, True
            while self.ranks.get(self.token[a] + self.token[b], 1 << 60) >= before:
                can_a, can_b = len(self.token[a]) > 1, len(self.token[b]) > 1
                if not (can_a or can_b):
                    break
                if can_a and (a > b or not can_b):
                    before, a = a, self.halves[a][1]
                else:
                    before, b = b + 1, self.halves[b][0]
            else:
                found = False
        self.fits[(left << 32) + token] = found
        return found

    def last_tokens(self, data: bytes) -> list[int]:
        return self.append(b"", [-1], data)

    def append(self, data: bytes, last: list[int], more: bytes) -> list[int]:
        """The last tokens of data + more, from those of data."""
        return self._extend(data + more, list(last))

    def _extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        ranks, fits, lengths = self.ranks, self.fits, self.lengths
        for end in range(len(last), (len(data) if stop is None else stop) + 1):
            tail = data[end - TAIL if end > TAIL else 0 : end]
            for n in lengths.get(tail) or self.lengths_at(tail):
                start = end - n
                if start < 0 or (t := ranks.get(data[start:end])) is None:
                    continue
                fit = fits.get((last[start] << 32) + t)
                if self.can_follow(last[start], t) if fit is None else fit:
                    last.append(t)
                    break
            else:
                raise ValueError("the ranks are not those of merges")
        return last

    def replace(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """data with data[start:stop] replaced, and its last tokens.

        What precedes the edit stays; after it, once as many entries as the longest token has bytes agree with the
        old ones, all that follow do.
        """
        whole, shift = data[:start] + new + data[stop:], len(new) - (stop - start)
        out, alike = list(last[: start + 1]), 0
        for end in range(start + 1, len(whole) + 1):
            self._extend(whole, out, end)
            old = end - shift
            alike = alike + 1 if old > stop and out[-1] == last[old] else 0
            if alike >= self.longest:
                return whole, out + last[old + 1 :]
        return whole, out

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.token[last[end]])
        return out[::-1]

    @cached_property
    def trie(self) -> tuple:
        """Beginnings of tokens as nodes, 0 the empty one: an index of node * 256 + next byte, whose place k leads to node k + 1, and each node's token or -1."""
        import pandas as pd

        edges: dict[int, int] = {}
        ends = []
        for t, i in self.ranks.items():
            node = 0
            for byte in t:
                node = edges.setdefault(node * 256 + byte, len(edges) + 1)
            ends.append((node, i))
        token = np.full(len(edges) + 1, -1)
        nodes, ids = np.array(ends).T
        token[nodes] = ids
        return pd.Index(np.fromiter(edges, np.int64, len(edges))), token

    @cached_property
    def sizes(self) -> np.ndarray:
        out = np.zeros(max(self.token, default=0) + 1, np.int64)
        out[list(self.token)] = list(map(len, self.token.values()))
        return out

    def follows(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """can_follow() of many pairs."""
        import pandas as pd

        if self.pairs is None or len(self.fits) > 1.1 * len(self.pairs) + 1000:
            self.pairs = pd.Index(np.fromiter(self.fits, np.int64, len(self.fits)))
            self.pair_fits = np.fromiter(self.fits.values(), bool, len(self.fits))
        keys = (left << 32) + token
        at = self.pairs.get_indexer(keys)
        out = self.pair_fits[at] if len(self.pair_fits) else np.zeros(len(keys), bool)
        new = np.flatnonzero(at < 0)
        if len(new):
            different, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            found = [self.fits.get(k) for k in different.tolist()]
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.can_follow(int(left[new[first[i]]]), int(token[new[first[i]]]))
            out[new] = np.array(found)[which]
        return out

    def encode_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The encodings of many pieces, not empty: last tokens of all prefixes of one length at a time."""
        index, token = self.trie
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        size = np.array([len(pieces[i]) for i in order])
        data = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8)
        # A piece of n bytes has n + 1 places, before and after each byte.
        base = np.cumsum(size + 1) - size - 1
        at = np.arange(len(data))
        shift = np.repeat(np.arange(len(size)), size)
        start, room, node = at + shift, np.repeat(np.cumsum(size), size), np.zeros(len(data), np.int64)
        # Tokens by the place where they end; each points to the next shorter one there.
        longest = np.full(len(data) + len(size), -1)
        tokens, begins, shorter, count, n = [], [], [], 0, 0
        while len(at):
            node = index.get_indexer(node * 256 + data[at + n]) + 1
            n += 1
            hit = np.flatnonzero(node)
            at, start, room, node = at[hit], start[hit], room[hit], node[hit]
            whole = np.flatnonzero(token[node] >= 0)
            ends = start[whole] + n
            tokens.append(token[node[whole]])
            begins.append(start[whole])
            shorter.append(longest[ends])
            longest[ends] = np.arange(count, count + len(whole))
            count += len(whole)
            more = np.flatnonzero(at + n < room)
            at, start, room, node = at[more], start[more], room[more], node[more]
        tokens, begins, shorter = map(np.concatenate, (tokens, begins, shorter))
        last = np.full(len(longest), -1)
        for n in range(1, size[0] + 1):
            ends = base[: np.searchsorted(-size, -n, "right")] + n
            tried = longest[ends]
            while len(ends):
                if tried.min() < 0:
                    raise ValueError("the ranks are not those of merges")
                t = tokens[tried]
                fit = self.follows(last[begins[tried]], t)
                last[ends[fit]] = t[fit]
                ends, tried = ends[~fit], shorter[tried[~fit]]
        out: list[list[int]] = [[] for _ in pieces]
        which, place = np.array(order), base + size
        while len(which):
            t = last[place]
            for i, x in zip(which.tolist(), t.tolist()):
                out[i].append(x)
            place = place - self.sizes[t]
            open_ = np.flatnonzero(last[place] >= 0)
            which, place = which[open_], place[open_]
        for ids in out:
            ids.reverse()
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """A piece that is a token is that token; others are encoded by prefixes."""
        whole = self.ranks.get(piece)
        return (whole,) if whole is not None else tuple(self.tokens(self.last_tokens(piece)))


@lru_cache(2)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path))


@lru_cache(2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class TextEncoder:
    """Whole texts: each match of the pattern is encoded and decoded for itself, and remembered.

    A space after or before a character that is no white space can start a match, so that a text can be cut there. The
    stretches between recur far more than they differ: each block of texts looks up its different stretches once, and
    Arrow puts their ids (each after a space) and decoded bytes together. Stretches and pieces are remembered in two
    generations, so that a full memory forgets only what was not seen since the last time.
    """

    def __init__(self, path: str, pattern: str):
        self.bpe, self.pieces = _encoder(path), _splitter(pattern).findall
        self.stretches, self.old_stretches = {}, {}
        self.parts, self.old_parts = {}, {}

    def encode(self, texts) -> Iterator[tuple[bytes, bytes]]:
        """Of each text of an Arrow array: the decimal ids, each after a space, and the bytes that they decode to."""
        import pyarrow as pa

        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets = text_bytes(texts)
        for i, j in runs_of_docs(offsets, BLOCK):
            heads, rest, first = cut(texts.slice(i, j - i))
            coded = rest.dictionary_encode()
            known = self.look_up(coded.dictionary.to_pylist())
            ids, plain = (pa.array([x[k] for x in known], pa.large_binary()).take(coded.indices) for k in (0, 1))
            for head, a, b in zip(heads, first[:-1], first[1:]):
                start = self.encode_whole(head)
                yield start[0] + joined(ids, a, b), start[1] + joined(plain, a, b)

    def look_up(self, keys: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of stretches, each with the space before it."""
        found = list(map(self.stretches.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.old_stretches.get(keys[i])
        new = [i for i in missing if found[i] is None]
        for i, x in zip(new, self.encode_stretches([keys[i] for i in new])):
            found[i] = x
        for i in missing:
            if len(keys[i]) <= 64:
                if len(self.stretches) >= MEMORY:
                    self.old_stretches, self.stretches = self.stretches, {}
                self.stretches[keys[i]] = found[i]
        return found

    def encode_stretches(self, keys: list[str]) -> list[tuple[bytes, bytes]]:
        """One pass of the pattern over stretches without a space or leading white space: their first pieces start with a space."""
        plain = [x for x in keys if x and " " not in x and not x[0].isspace()]
        pieces = self.pieces(" " + " ".join(plain)) if plain else []
        parts = self.encode_pieces(pieces)
        first = [i for i, x in enumerate(pieces) if x[0] == " "]
        out = iter([parts[a] if b - a == 1 else together(parts[a:b]) for a, b in zip(first, first[1:] + [len(parts)])])
        return [next(out) if x and " " not in x and not x[0].isspace() else self.encode_whole(" " + x) for x in keys]

    def encode_pieces(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        out = list(map(self.parts.get, pieces))
        missing = {x: self.old_parts.get(x) for x, known in zip(pieces, out) if known is None}
        if missing:
            new = [x for x, known in missing.items() if known is None]
            missing.update(zip(new, self.encode_new([x.encode() for x in new])))
            for i, x in enumerate(out):
                if x is None:
                    out[i] = missing[pieces[i]]
            for x, known in missing.items():
                if len(x) <= 64:
                    if len(self.parts) >= MEMORY:
                        self.old_parts, self.parts = self.parts, {}
                    self.parts[x] = known
        return out

    def encode_new(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Short pieces that are no tokens are encoded together, if they are more than a few."""
        ids = list(map(self.bpe.ranks.get, pieces))
        many = [i for i, x in enumerate(ids) if x is None and len(pieces[i]) <= 64]
        if len(many) >= 100:
            for i, x in zip(many, self.bpe.encode_many([pieces[i] for i in many])):
                ids[i] = x
        text, token = self.bpe.text.__getitem__, self.bpe.token.__getitem__
        out = []
        for piece, x in zip(pieces, ids):
            if isinstance(x, int):
                out.append((text(x), token(x)))
            else:
                x = x or self.bpe.encode_piece(piece)
                out.append((b"".join(map(text, x)), b"".join(map(token, x))))
        return out

    def encode_whole(self, text: str) -> tuple[bytes, bytes]:
        return together(self.encode_pieces(self.pieces(text)))


def together(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    return b"".join([x[0] for x in parts]), b"".join([x[1] for x in parts])


def joined(values, a: int, b: int) -> bytes:
    """The values a to b of an Arrow large_binary array, one after the other."""
    _, offsets, data = values.buffers()
    if a == b or data is None:
        return b""
    x, y = np.frombuffer(offsets, np.int64, b - a + 1, 8 * (values.offset + a))[[0, -1]].tolist()
    return data[x:y].to_pybytes()


def cut(texts) -> tuple[list[str], object, list[int]]:
    """Texts cut at spaces: heads, an Arrow array of all stretches after a space, and where each text's begin and end in it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pc.any(pc.match_substring_regex(texts, r" ([\t-\r\x{85}\p{Z}]|\z)")).as_py():
        lists = [stretches(x) for x in texts.to_pylist()]
        first = np.cumsum([0] + [len(x) - 1 for x in lists]).tolist()
        return [x[0] for x in lists], pa.array(list(chain.from_iterable(x[1:] for x in lists)), pa.large_string()), first
    lists = pc.split_pattern(texts, " ")
    values, starts = lists.values, lists.offsets.to_numpy()
    after = np.ones(len(values), bool)
    after[starts[:-1]] = False
    return values.take(pa.array(starts[:-1])).to_pylist(), values.filter(pa.array(after)), (starts - np.arange(len(starts))).tolist()


def stretches(text: str) -> list[str]:
    """text cut at spaces, but not where white space comes before the space and white space or the end after it."""
    first, *rest = text.split(" ")
    out, open_end = [[first]], first[-1:].isspace()
    for x in rest:
        if open_end and (not x or x[0].isspace()):
            out[-1].append(x)
        else:
            out.append([x])
        open_end = not x or x[-1].isspace()
    return [" ".join(x) for x in out]


def encode_decode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids array<int>, for each row of df.

    Whole texts are encoded without special tokens and the ids are decoded again. Null text counts as empty: no
    token, hashes of nothing. No row depends on another, so repeated rows, null ids and empty tables need no rule.
    The rank file is opened on each executor, where the tokenizer package is installed; its path is a parameter.
    """
    import public_tokenizers

    path, pattern = ranks_path or default_ranks(), pattern or public_tokenizers.PATTERN

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = TextEncoder(path, pattern)
        for batch in batches:
            columns = ([], [], [], [])
            for ids, plain in encoder.encode(batch.column(1)):
                columns[0].append(ids.count(b" "))
                columns[1].append(hashlib.sha256(ids[1:]).hexdigest())
                columns[2].append(hashlib.sha256(plain).hexdigest())
                if keep_ids:
                    columns[3].append(list(map(int, ids.split())))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())] + [pa.array(columns[3], pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.select(id_col, text_col).mapInArrow(digest, schema)
