"""Fill-in-the-middle: each document cut into prefix, middle and suffix, the middle moved last.

Cut points count code points, and their bytes are found by SWAR words: the UTF-8 of a batch
is viewed as uint64; arithmetic on whole words marks each byte that ends a code point,
``bitwise_count`` counts the marks of a word, a search in their running sums finds the word
that holds a wanted mark, and a multiplication resolves it inside the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketspark.llm.common import CHUNK_BYTES, field, plain, slices

# The marks of the three parts, and the forms of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Hundredths of all documents from which on one stays plain, and of the others below which
# the suffix comes first.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"

_ONES = np.uint64(0x0101010101010101)


class Units:
    """The code points of UTF-8 bytes: how many end within so many bytes, and where the
    k-th ends. The bytes may be many texts, one after the other."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        wide = np.zeros((n // 8 + 2) * 8, np.uint8)
        wide[:n] = data
        word = wide.view("<u8")
        # a byte 10xxxxxx goes on with a code point, any other begins one; zeros beyond the
        # end begin one each, so that the last code point has an end too
        begins = (word >> np.uint64(7)) & ~(word >> np.uint64(6)) & _ONES ^ _ONES
        after = np.append(begins[1:], _ONES)
        self.ends = begins >> np.uint64(8) | after << np.uint64(56)
        self.ends[n // 8] &= (np.uint64(1) << np.uint64(n % 8 * 8)) - np.uint64(1)
        self.ends[n // 8 + 1:] = 0
        self.count = np.bitwise_count(self.ends).astype(np.int64)
        self.total = np.cumsum(self.count)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end within the first ``at`` bytes."""
        word, rest = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << rest * np.uint64(8)) - np.uint64(1)
        return self.total[word] - self.count[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Bytes up to the end of the k-th code point (none for k = 0)."""
        word = np.searchsorted(self.total, k)
        nth = k - self.total[word] + self.count[word]
        # each byte of the product holds the marks up to there
        upto = (self.ends[word] * _ONES).reshape(-1, 1).view(np.uint8)
        return np.where(k > 0, word * 8 + (upto < nth[:, None]).sum(axis=1) + 1, 0)


def _draws(ids: list, seed: str) -> np.ndarray:
    """Four pseudo-random 32-bit integers for each id."""
    got = b"".join(sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(got, ">u4").reshape(-1, 4).astype(np.int64)


def _rearranged(texts: pa.Array, ids: list, seed: str, plain_from: int, spm_below: int) -> list:
    """(code points, form, prefix's and middle's code points, output) as arrays."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] \
        else np.zeros(0, np.uint8)
    at = at - at[0]
    units = Units(data)
    first = units.rank(at[:-1])
    n = units.rank(at[1:]) - first
    h = _draws(ids, seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    a = np.maximum(units.select(first + cuts[:, 0]), at[:-1])
    b = np.maximum(units.select(first + cuts[:, 1]), at[:-1])
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    forms, outputs = [], []
    raw = data.tobytes()
    for start, x, y, end, whole, order in zip(at[:-1].tolist(), a.tolist(), b.tolist(), at[1:].tolist(),
                                              (h[:, 2] % 100).tolist(), (h[:, 3] % 100).tolist()):
        text = raw[start:end]
        if whole >= plain_from or not text or any(k in text for k in marks):
            forms.append(PLAIN)
            outputs.append(text)
        elif order < spm_below:
            forms.append(SPM)
            outputs.append(b"".join((s, raw[y:end], p, raw[start:x], m, raw[x:y])))
        else:
            forms.append(PSM)
            outputs.append(b"".join((p, raw[start:x], s, raw[y:end], m, raw[x:y])))
    cut = np.array([f == PLAIN for f in forms], bool)
    return [pa.array(n), pa.array(forms, pa.string()), pa.array(cuts[:, 0], mask=cut),
            pa.array(cuts[:, 1] - cuts[:, 0], mask=cut), pa.array(outputs, pa.binary()).view(pa.string())]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None, seed: str = SEED, plain_from: int = PLAIN_FROM,
                   spm_below: int = SPM_BELOW) -> DataFrame:
    """``keep`` columns (default: all) plus ``n`` (code points of the text), ``form``,
    ``prefix_chars``, ``middle_chars`` (code points; null where plain) and ``output``.

    The cuts, the form and the order come from the SHA-256 of the seed and the row's id, so
    reruns agree whatever the partitions; rows of equal ids are cut alike where their texts
    are as long, and a null id counts as an empty one. A text stays plain, which is whole
    and unmarked, if it is null (then it is empty) or empty, or holds one of the marks,
    or if its draw says so. Every row gives one row and none is moved; working memory is a
    chunk of texts (one text at least). Input columns named like an output give way; an
    empty table stays empty.
    """
    fields = [field("n", "long"), field("form", "string"), field("prefix_chars", "long"),
              field("middle_chars", "long"), field("output", "string")]
    names = [f.name for f in fields]
    kept = [c for c in (plain(df).columns if keep is None else keep) if c.lower() not in names]
    src = df.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("_text"),
                    F.col(f"`{id_col}`").cast("string").alias("_id"), *[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, CHUNK_BYTES):
                out = _rearranged(part.column(0), part.column(1).to_pylist(), seed, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *out], names=[*kept, *names])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[2:], *fields]))


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` rearranged. No part holds a mark, nor can a mark
    arise where a part meets one, so the first of each is the one that was set."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(second: str) -> tuple[Column, Column, Column]:
        return (F.substring_index(rest, second, 1),
                F.substring_index(F.substring_index(rest, second, -1), MIDDLE, 1),
                F.substring_index(rest, MIDDLE, -1))

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(
        form == SPM, F.concat(prefix2, middle2, suffix2)).otherwise(output)
