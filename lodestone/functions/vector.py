"""Column functions over vectors, and their Arrow forms for whole columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .slabs import slabs


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; vectors of different lengths raise an error."""
    n = norm(a) * norm(b)
    value = F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimension: the index must be rebuilt")).cast("double"))


def normalize(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def _counts(texts: pa.Array, dim: int, blank: bool) -> np.ndarray:
    """[n, dim] counts of UTF-16 code units modulo `dim`, by one bincount; zeros for null and empty texts, and where `blank` for blank ones."""
    units = [(t if t and not (blank and t.isspace()) else "").encode("utf-16-le", "surrogatepass") for t in texts.to_pylist()]
    row = np.repeat(np.arange(len(units)) * dim, [len(u) // 2 for u in units])
    return np.bincount(row + np.frombuffer(b"".join(units), "<u2") % dim, minlength=len(units) * dim).reshape(-1, dim)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def histogram(text: Column, dim: int = 64) -> Column:
    """Counts of UTF-16 code units modulo `dim`; null and empty texts give zeros."""

    @arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (part for batch in batches for part in slabs(batch)):
            yield _lists(_counts(texts, dim, False).astype(np.int64))

    return run(text)


def unit_histogram(text: Column, dim: int = 64) -> Column:
    """The same of length 1; blank texts give zeros too."""

    @arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (part for batch in batches for part in slabs(batch)):
            rows = _counts(texts, dim, True).astype(np.float64)
            size = np.sqrt((rows * rows).sum(1, keepdims=True))
            yield _lists(np.divide(rows, size, out=rows, where=size > 0).astype(np.float32))

    return run(text)


def pack(vector: Column) -> Column:
    """Little-endian 32-bit floats, in the buffers that they come in."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            ends = v.offsets.to_numpy()
            values = v.values.cast(pa.float32()).to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype("<f4")
            packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(((ends - ends[0]) * 4).astype(np.int32)), pa.py_buffer(values)])
            yield pc.if_else(v.is_valid(), packed, None)

    return run(vector)


def unpack(blob: Column) -> Column:
    """The vector of a packed one; a length that is no multiple of 4 raises an error."""

    @arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b), 0).to_numpy(zero_copy_only=False)
            if (sizes % 4).any():
                raise ValueError("the size of a packed vector must be a multiple of 4")
            values = np.frombuffer(b"".join(b.drop_null().to_pylist()), "<f4")
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes // 4)]), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(values), mask=b.is_null())

    return run(blob)


def from_json(text: Column) -> Column:
    """The vector of an older index's JSON text; a text that is no list of numbers raises an error."""
    v = F.from_json(text, "array<float>")
    bad = text.isNotNull() & (v.isNull() | F.exists(v, lambda x: x.isNull()))
    return F.when(bad, F.raise_error(F.lit("not a vector in JSON: the index must be rebuilt")).cast("array<float>")).otherwise(v)
