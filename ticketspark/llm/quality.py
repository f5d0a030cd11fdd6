"""Quality rules by repetition coverage.

Rolling hashes over word codes find, for several n-gram lengths, the n-grams that occur
more than once in a text; the share of the text's characters inside them, and inside
lines that repeat, decides whether the text is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketspark.llm.common import distinct, field, map_text

_B = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word characters inside duplicated n-grams, by n-gram
    length, and largest share of its line characters inside repeated lines."""
    ngram_chars: tuple[tuple[int, float], ...] = ((5, 0.40), (7, 0.36), (10, 0.33))
    line_chars: float = 0.30
    min_words: int = 50
    repeat_words_pct: int = 50


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each word: is it inside an n-gram that its document holds twice or more?
    ``code``: scrambled word codes of consecutive documents; ``doc``: their document."""
    m = len(code) - n + 1
    if m <= 1:
        return np.zeros(len(code), bool)
    h = np.zeros(m, np.uint64)
    for k in range(n):  # Horner form of the rolling hash of n codes
        h = h * _B + code[k:k + m]
    inside = doc[:m] == doc[n - 1:]
    h = mix(h) + mix(doc[:m].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(inside)
    twice = at[pd.Series(h[at]).duplicated(keep=False).to_numpy()]
    edge = np.bincount(twice, minlength=len(code) + 1) - np.bincount(
        twice + n, minlength=len(code) + 1)
    return np.cumsum(edge[:-1]) > 0


def _measure(limits: Limits):
    def run(texts: list) -> list:
        docs = [t or b"" for t in texts]
        nd = len(docs)
        words = [d.split() for d in docs]
        n_words = np.fromiter(map(len, words), np.int64, nd)
        doc = np.repeat(np.arange(nd), n_words)
        flat = distinct(list(chain.from_iterable(words)), pa.binary())[0]
        code = mix(flat.astype(np.uint64) + np.uint64(1))

        # a separator after each document, so that no word runs into the next one
        raw = np.frombuffer(b"\n".join([*docs, b""]), np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, docs), np.int64, nd) + 1)])
        space = _SPACE[raw]
        # code points of the words: bytes that are neither white space nor continuations
        points = np.concatenate([[0], np.cumsum(((raw & 0xC0) != 0x80) & ~space)])
        edge = np.flatnonzero(np.diff(np.concatenate([[1], space, [1]]).astype(np.int8)))
        chars = points[edge[1::2]] - points[edge[::2]]
        word_chars = np.diff(points[at])
        n_symbols = np.diff(np.concatenate([[0], np.cumsum(_SYMBOLS[raw])])[at])

        def words_in(mask: np.ndarray, weight=None) -> np.ndarray:
            return np.bincount(doc[mask], None if weight is None else weight[mask], nd)

        n_repeat = words_in(covered(code, doc, 3)).astype(np.int64)
        verdict = np.ones(nd, bool)
        shares = []
        for n, most in limits.ngram_chars:
            share = words_in(covered(code, doc, n), chars) / np.maximum(word_chars, 1)
            shares.append(share)
            verdict &= share <= most
        n_dup = np.zeros(nd, np.int64)
        line_share = np.zeros(nd)
        for i, d in enumerate(docs):
            if b"\n" not in d:
                continue
            seen, dup, every = set(), 0, 0
            for line in d.split(b"\n"):
                if line.strip():
                    every += len(line)
                    if line in seen:
                        n_dup[i] += 1
                        dup += len(line)
                    seen.add(line)
            line_share[i] = dup / max(every, 1)
        verdict &= line_share <= limits.line_chars
        failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_words_pct * n_words)
        return [n_words, word_chars, n_symbols, n_dup, n_repeat, failed, verdict & ~failed,
                np.max(shares, axis=0), line_share]
    return run


FIELDS = [field("n_words", "long"), field("word_chars", "long"), field("n_symbols", "long"),
          field("n_dup_lines", "long"), field("n_repeat_words", "long"),
          field("base_failed", "boolean"), field("kept", "boolean"),
          field("dup_ngram_chars", "double"), field("dup_line_chars", "double")]


def quality(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
            limits: Limits = Limits()) -> DataFrame:
    """``keep`` columns (default: all) plus the measures of each text and ``kept``.

    Words are runs of anything but ASCII white space. ``kept`` is false when
    ``base_failed`` (fewer than 50 words, or over half of them inside repeated 3-word
    windows), when the characters inside duplicated 5-, 7- or 10-grams exceed their
    share of the text, or when repeated lines hold over 30 % of its line bytes. A null
    or empty text has no words: all counts 0, not kept. Each row is judged on its own
    whole text, so ties, repeated rows and null keys are ordinary rows; input columns
    named like an output give way to it; an empty table stays empty.
    """
    return map_text(df, text_col, FIELDS, _measure(limits), keep, binary=True)
