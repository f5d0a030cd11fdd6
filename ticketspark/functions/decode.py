"""Free-text model output -> label (G4-G6), as column expressions over a label array.

``labels`` is an array column of labels in ascending order (see
``operators.vocab.label_array``); precedence is by that order, never by position in
the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketspark.functions.text import strip_ws

# The label given to outputs that match no label, and the characters
# stripped from both ends of a lower-cased output.
UNPARSEABLE = "UNPARSEABLE"
DECODE_STRIP_CHARS = ".\"'"


def lenient_clean(raw: Column) -> Column:
    """strip whitespace -> lower -> strip . " ' at both ends (whitespace is not re-stripped)."""
    return F.btrim(F.lower(strip_ws(raw)), F.lit(DECODE_STRIP_CHARS))


def decode_lenient(raw: Column, labels: Column, lower_labels: Column | None = None) -> Column:
    """Exact (case-insensitive) match, else first label contained as a substring, else
    ``UNPARSEABLE``. A null output decodes to ``UNPARSEABLE``.

    The exact match is an ``array_position`` lookup in the lower-cased labels (pass
    ``lower_labels`` computed once, e.g. by ``vocab.lower_label_array``); the
    substring scan, a per-label lambda, runs only for outputs without an exact match. For
    row-wise use (streams) with few labels; ``operators.labelmatch.decode_outputs`` takes a
    table of labels of any size.
    """
    cleaned = lenient_clean(raw)
    low = lower_labels if lower_labels is not None else F.transform(labels, F.lower)
    idx = F.array_position(low, cleaned)
    contained = F.get(F.filter(labels, lambda _, i: F.contains(cleaned, F.get(low, i))), 0)
    return F.when(idx > 0, F.element_at(labels, idx.cast("int"))).otherwise(
        F.coalesce(contained, F.lit(UNPARSEABLE)))


def decode_strict(raw: Column, labels: Column) -> Column:
    """True when the stripped output is exactly a known label (case-sensitive)."""
    return F.coalesce(F.array_contains(labels, strip_ws(raw)), F.lit(False))


def decode_raw(raw: Column) -> Column:
    """The stripped output itself, which may be a non-label."""
    return strip_ws(raw)
