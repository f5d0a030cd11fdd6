"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 4 << 20


def plain(df: DataFrame) -> DataFrame:
    """``df`` without columns whose names begin with an underscore, which are the operators'
    own."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def slices(batch: pa.RecordBatch, index: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch holding about ``chunk_bytes`` of one column each
    (one row at least), so that working memory doesn't follow the batch's size."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // chunk_bytes
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def map_text(df: DataFrame, text_col: str, fields: list[T.StructField],
             fn: Callable[[list], list], keep: list[str] | None = None,
             binary: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields``, computed from a text column in Arrow
    batches.

    ``fn`` gets a list of texts (str, or bytes with ``binary``; None for null) and
    returns one sequence or Arrow array for each field. A kept column whose name a
    field has (in any case) gives way to the field. Rows are neither moved nor lost:
    the step is a narrow map, so a lost executor costs its own partitions only.
    """
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    kept = [c for c in (plain(df).columns if keep is None else keep) if c.lower() not in taken]
    text = F.col(f"`{text_col}`")
    src = df.select(text.cast("binary" if binary else "string").alias("_text"),
                    *[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*src.schema.fields[1:], *fields])
    types = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, chunk_bytes):
                out = fn(part.column(0).to_pylist())
                cols = [x if isinstance(x, pa.Array) else pa.array(x, type=t)
                        for x, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *cols], names=[*kept, *names])

    return src.mapInArrow(run, schema)


def distinct(items: list, kind: pa.DataType | None = None) -> tuple[np.ndarray, list]:
    """(code of each item, the distinct items in order of appearance). Exact for any
    string: pandas' factorize would end strings at U+0000."""
    d = pa.array(items, kind or pa.string()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "string": T.StringType(), "binary": T.BinaryType()}


def field(name: str, kind: str | T.DataType) -> T.StructField:
    return T.StructField(name, _KINDS[kind] if isinstance(kind, str) else kind)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
