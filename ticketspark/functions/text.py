"""Text column expressions (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The ASCII whitespace set, the \s class of Java regex (space, tab,
# newline, carriage return, form feed, vertical tab).
WS_CHARS = " \t\n\r\f\u000b"


def strip_ws(col: Column | str) -> Column:
    """Remove leading and trailing whitespace (``str.strip()`` on ASCII space)."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def tokens(col: Column | str, lowercase: bool = True) -> Column:
    """Whitespace tokens of the whole text (none empty; [] for blank text).

    The text is stripped first, so splitting on runs of whitespace yields an empty
    token only for blank text; ``array_remove`` (a built-in, no lambda) drops it.
    """
    c = strip_ws(_c(col))
    if lowercase:
        c = F.lower(c)
    return F.array_remove(F.split(c, r"\s+"), F.lit(""))


def word_count(col: Column | str) -> Column:
    """Number of whitespace-separated tokens (0 for blank or null text).

    Counts maximal runs of non-whitespace with a regex scan, without building the
    token strings.
    """
    return F.coalesce(F.regexp_count(_c(col), F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


def truncate_words(col: Column | str, n: int) -> Column:
    """First ``n`` whitespace tokens joined by one space (sequence-length cut)."""
    return F.array_join(F.slice(tokens(col, lowercase=False), 1, n), " ")
