"""Vectors of a table as integers, and blocks of them that one step of a Python operator holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), finite), F.lit(False))


def reach(dim: int) -> int:
    """The largest size of an integer component at which squared distances of `dim` components still fit 64 bits."""
    return 1 << ((61 - max(1, dim - 1).bit_length()) // 2)


def scaled(vector: Column, factor: int, dim: int) -> Column:
    """floor(factor * x) of every component, in double precision, kept within +-reach(dim)."""
    most = float(reach(dim))
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * factor, F.lit(most)), F.lit(-most))).cast("long"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists of a column as rows; shorter ones end with zeros."""
    n = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim)[None] < n[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of `most` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, most - n)
            held.append(piece)
            n, at = n + piece.num_rows, at + piece.num_rows
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the last axis, exact."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def width(vectors: DataFrame, id_col: str, vector_col: str) -> int | None:
    """The number of components of the usable vector with the smallest id; None without any."""
    return vectors.agg(F.min_by(F.size(vector_col), F.struct(F.col(id_col).isNull(), id_col, F.size(vector_col))).alias("n")).first()["n"]
