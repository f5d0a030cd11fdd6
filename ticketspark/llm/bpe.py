"""Byte-level BPE encoding and decoding by merge replay over blocks of documents.

The distinct pre-tokens of a block are laid out once as one array of byte tokens. Words of
up to ``Replay.SHORT`` bytes, which are nearly all, go through rounds without an index: each
word undergoes its own merge of the lowest rank in each. Only for longer words an inverted
index leads from adjacent token pairs to the positions where they stand, and merges are
applied in rank order to all of them, where only the neighbours that a merge touched enter
the index anew. Both give the ids of merging one word after the other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ticketspark.llm.common import distinct, field, map_text

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Encoded pre-tokens that a worker remembers between blocks (speed only).
CACHE_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Replay:
    """Encodes lists of pre-tokens by replaying the vocabulary's merges over all of them."""

    #: Bytes of a word up to which it takes part in the rounds over all words.
    SHORT = 48
    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.byte, np.int64)
        pairs = {}
        for t, i in ranks.items():
            for k in range(1, len(t)):
                x, y = ranks.get(t[:k]), ranks.get(t[k:])
                if x is not None and y is not None:
                    pairs[(x << 20) | y] = i
        # last: a key that no pair has, so that a search never ends beyond the array
        self.pair_keys = np.array([*sorted(pairs), np.iinfo(np.int64).max], np.int64)
        self.pair_ids = np.array([*(pairs[k] for k in sorted(pairs)), -1], np.int64)
        self.rank_of: dict[tuple[int, int], int | None] = {}

    def merges(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, which is its rank too; NONE without."""
        key = (x << 20) | y
        k = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[k] == key, self.pair_ids[k], self.NONE)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. A word that is a token itself is that token."""
        out: list = [None if (i := self.ranks.get(w)) is None else [i] for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for some, how in (([k for k in rest if len(words[k]) <= self.SHORT], self.in_rounds),
                          ([k for k in rest if len(words[k]) > self.SHORT], self.by_heap)):
            for k, ids in zip(some, how([words[k] for k in some])):
                out[k] = ids
        return out

    def in_rounds(self, words: list[bytes]) -> list[list[int]]:
        """Merges of short words. In each round every word undergoes the leftmost merge of
        its lowest rank, which is the order in which one word after the other would."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(len(ids), self.NONE)
        pair = np.flatnonzero(word[1:] == word[:-1])
        rank[pair] = self.merges(ids[pair], ids[pair + 1])
        out: list = [None] * len(words)
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, first)
            n = np.diff(np.append(first, len(ids)))
            over = lowest == self.NONE
            if over.any():
                done = ids.tolist()
                for w, a, k in zip(word[first[over]].tolist(), first[over].tolist(), n[over].tolist()):
                    out[w] = done[a:a + k]
                live = np.repeat(~over, n)
                ids, word, rank = ids[live], word[live], rank[live]
                lowest, n = lowest[~over], n[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, n))
            hit = hit[np.flatnonzero(np.diff(word[hit], prepend=-1))]
            ids[hit] = rank[hit]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            hit -= np.arange(len(hit))  # one token before each hit has gone for each hit
            for at in (hit, hit[hit > 0] - 1):  # the neighbours that the merge touched
                last = np.append(word, -1)[at + 1] != word[at]
                rank[at] = np.where(last, self.NONE, self.merges(ids[at], np.append(ids, 0)[at + 1]))
        return out

    def merged(self, a: int, b: int) -> int | None:
        """The token that the pair merges into, or None."""
        pair = (a, b)
        if pair not in self.rank_of:
            if len(self.rank_of) > 4_000_000:
                self.rank_of.clear()
            self.rank_of[pair] = self.ranks.get(self.token[a] + self.token[b])
        return self.rank_of[pair]

    def by_heap(self, words: list[bytes]) -> list[list[int]]:
        """Merges of words of any length, from an inverted index and a heap of ranks."""
        ids: list[int] = []
        start = []
        for w in words:
            start.append(len(ids))
            ids.extend([self.byte[b] for b in w])
        n = len(ids)
        left = list(range(-1, n - 1))
        right = list(range(1, n + 1))
        for s in start:  # no pair crosses words
            left[s] = -1
            if s:
                right[s - 1] = -1
        if n:
            right[n - 1] = -1
        # inverted index: merge -> places of the left tokens of its pairs. Places that a
        # later merge has taken stay in and are passed over when their turn comes.
        index: dict[int, list[int]] = defaultdict(list)
        for p in range(n):
            if right[p] >= 0 and (m := self.merged(ids[p], ids[right[p]])) is not None:
                index[m].append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            m = heapq.heappop(heap)
            places = sorted(index.pop(m))
            for k, p in enumerate(places):
                q = right[p]
                if ids[p] < 0 or q < 0 or self.merged(ids[p], ids[q]) != m:
                    continue
                ids[p], ids[q] = m, -1
                right[p] = right[q]
                if right[q] >= 0:
                    left[right[q]] = p
                for t in (left[p], p):
                    if t >= 0 and right[t] >= 0:
                        new = self.merged(ids[t], ids[right[t]])
                        if new is not None:
                            if new not in index:
                                heapq.heappush(heap, new)
                            index[new].append(t)
                if heap and heap[0] < m and k + 1 < len(places):
                    # the merge made a pair of an earlier rank, which goes first
                    index[m].extend(places[k + 1:])
                    heapq.heappush(heap, m)
                    break
        out = []
        for s in start:
            got = []
            while s >= 0:
                got.append(ids[s])
                s = right[s]
            out.append(got)
        return out


def _members(prop: str) -> set[str]:
    """The code points that a property of tiktoken's own regular expressions has."""
    import tiktoken
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    enc = tiktoken.Encoding("points", pat_str=prop, special_tokens={},
                            mergeable_ranks={bytes([b]): b for b in range(256)})
    return set(bytes(enc.encode_ordinary(every)).decode())


def _ranges(points: set[str]) -> str:
    out, codes = [], sorted(map(ord, points))
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=1)
def pre_token_patterns() -> tuple[re.Pattern, re.Pattern]:
    """The public pattern with each property as the explicit ranges that the library's own
    engine gives it, as engines of other Unicode versions differ: for texts without and
    with code points beyond U+FFFF, whose many ranges are slow to search."""
    import public_tokenizers
    every = [_members(p) for p in (r"\s", r"\p{L}", r"\p{N}")]
    out = []
    for last in ("\uffff", "\U0010ffff"):
        space, letter, number = (_ranges({c for c in x if c <= last}) for x in every)
        pattern = public_tokenizers.PATTERN
        for shape, ranges in ((r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]"),
                              (r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"),
                              (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
            pattern = pattern.replace(shape, ranges)
        out.append(re.compile(pattern))
    return tuple(out)


def pre_tokens(text: str) -> list[str]:
    near, every = pre_token_patterns()
    beyond = not text.isascii() and len(text.encode("utf-16-le")) > 2 * len(text)
    return (every if beyond else near).findall(text)


class Codec:
    """A vocabulary loaded in a worker process: encodes blocks of texts and decodes ids."""

    def __init__(self, path: str):
        self.replay = Replay(read_ranks(path))
        self.known: dict[str, list[int]] = {}
        token = self.replay.token
        self.size = np.zeros(max(token) + 1, np.int64)
        self.size[list(token)] = [len(t) for t in token.values()]
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(len(self.size))), np.uint8)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        split = [pre_tokens(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        code, words = distinct(list(chain.from_iterable(split)))
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        known.update(zip(new, self.replay.encode([w.encode() for w in new])))
        ids = [known[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        table = np.array(list(chain.from_iterable(ids)), np.uint32)
        n = size[code]
        bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return _gather(table, (np.cumsum(size) - size)[code], n), np.diff(bounds)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes that the ids stand for as uint8, number of bytes of each id)."""
        if len(ids) and (ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        return _gather(self.bytes, self.first[ids], self.size[ids]), self.size[ids]


def _gather(table: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs table[first[k]:first[k] + n[k]], one after the other."""
    begin = np.cumsum(n) - n
    return table[np.arange(int(n.sum())) + np.repeat(first - begin, n)]


@lru_cache(maxsize=4)
def codec(name: str = TOKENIZER) -> Codec:
    import public_tokenizers
    return Codec(public_tokenizers.path(name))


FIELDS = [field("n_tokens", "long"), field("ids_sha256", "string"),
          field("decoded_sha256", "string")]


def encode(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
           tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns (default: all) plus ``ids`` (array of int), the token ids of each
    whole text. A null or empty text has no ids. Rows are encoded one by one, so
    repeated rows, null keys and an empty table need no care; an input column named
    ``ids`` gives way."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(texts: list) -> list:
        ids, n = codec(tokenizer).encode([t or "" for t in texts])
        return [pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
            pa.array(ids.astype(np.int32), pa.int32()))]
    return map_text(df, text_col, [field("ids", T.ArrayType(T.IntegerType()))], run, keep)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded",
           tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``out_col`` (binary), the bytes of an array column of ids (null: null).
    An id that the vocabulary lacks fails the query."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else codec(tokenizer).decode(x)[0].tobytes())
    return df.withColumn(out_col, run(F.col(ids_col)))


def _digests(tokenizer: str):
    def run(texts: list) -> list:
        own = codec(tokenizer)
        ids, n = own.encode([t or "" for t in texts])
        back, size = own.decode(ids)
        at = np.concatenate([[0], np.cumsum(n)])
        byte_at = np.concatenate([[0], np.cumsum(size)])[at]
        ids = ids.astype("<u4")
        return [n, [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(at, at[1:])],
                [hashlib.sha256(back[a:b].tobytes()).hexdigest() for a, b in zip(byte_at, byte_at[1:])]]
    return run


def round_trip(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
               tokenizer: str = TOKENIZER) -> DataFrame:
    """``keep`` columns plus ``n_tokens``, ``ids_sha256`` (of the ids as little-endian
    unsigned 32-bit integers) and ``decoded_sha256`` (of the bytes decoded from those
    ids): :func:`encode` and :func:`decode` in one pass, for tables whose ids needn't be
    kept. A null text counts as empty: no ids, the digests of no bytes."""
    return map_text(df, text_col, FIELDS, _digests(tokenizer), keep)
