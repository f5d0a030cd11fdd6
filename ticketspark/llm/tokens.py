"""Token counts of a SentencePiece BPE vocabulary by the whole-token shortcut.

No piece of the vocabulary has a space after another character, so no merge crosses the
place where a space follows one: a text is a row of independent pre-tokens (a run of
spaces and the characters up to the next). The vocabulary strings that encode alone as one
token are found beforehand; pre-tokens among them count one, and only the rest is merged.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from ticketspark.llm.common import distinct, field, map_text

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
# Merged pre-tokens that a worker remembers between blocks (speed only).
CACHE_WORDS = 300_000
_SPACE = "▁"  # the vocabulary's sign for a space


class Counter:
    """A loaded vocabulary with its proven whole tokens."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character")
        if [*self.model.encode("", out_type=str), *self.model.encode(" a", out_type=str)] != [
                *self.model.encode("", out_type=str), *self.model.encode(_SPACE + "a", out_type=str)]:
            raise ValueError("the vocabulary doesn't write spaces as expected")
        words = [p[1:] for p in pieces if p[0] == _SPACE and p[1:] and _SPACE not in p[1:]]
        alone = self.model.encode(words, num_threads=1)
        self.whole = frozenset(f" {w}" for w, ids in zip(words, alone) if len(ids) == 1)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        split = [re.findall(" +[^ ]*", f" {t}".replace(_SPACE, " ")) if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        code, words = distinct(list(chain.from_iterable(split)))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        rest = [w for w in words if w not in self.whole and w not in self.known]
        # the model puts a space of its own before what it encodes; a single space that
        # ends a text is a token which it wouldn't give for no text
        merged = self.model.encode([w[1:] for w in rest], num_threads=1) if rest else []
        self.known.update((w, len(ids) if w != " " else 1) for w, ids in zip(rest, merged))
        cost = np.fromiter((1 if w in self.whole else self.known[w] for w in words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(cost[code])])
        return np.diff(total[np.concatenate([[0], np.cumsum(n)])])


@lru_cache(maxsize=4)
def counter(name: str = TOKENIZER) -> Counter:
    import public_tokenizers
    return Counter(public_tokenizers.path(name))


FIELDS = [field("n_bytes", "long"), field("n_tokens", "long"), field("over_limit", "boolean")]


def count_tokens(df: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                 tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``keep`` columns (default: all) plus ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens) of each whole text.

    Counts equal the library's own without begin and end tokens. A null or empty text has
    no bytes and no tokens. Rows are counted one by one: repeated rows, null keys and an
    empty table need no care; input columns named like an output give way to it.
    """
    def run(texts: list) -> list:
        texts = [t or "" for t in texts]
        n = counter(tokenizer).count(texts)
        return [[len(t.encode()) for t in texts], n, n > limit]
    return map_text(df, text_col, FIELDS, run, keep)
