"""Vector arithmetic: Catalyst expressions for single columns, numpy over Arrow batches for scoring.

Scores are summed in double precision. ``metric`` is "cosine" (zero or
non-finite vectors score 0), "dot" or "euclidean" (the negated squared
distance), so greater is nearer for all three.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Unit length; a vector whose norm is tiny or not finite stays as it is."""

    def scaled(norm: Column) -> Column:
        return F.when((norm >= TINY) & (norm < F.lit(float("inf"))), F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)

    # The norm is a lambda's argument, so it is computed once and not for each element.
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), scaled), F.lit(0))


def matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x dimension doubles, which rows have a vector) of an Arrow list column; rows without get zeros. Vectors of several lengths are an error."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    known = col.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.unique(col.value_lengths().drop_null().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} dimensions")
    flat = col.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    dim = int(sizes[0]) if len(sizes) else 0
    out = np.zeros((len(known), dim))
    if dim:
        out[known] = flat.reshape(-1, dim)
    return out, known


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    good = (norm >= TINY) & np.isfinite(norm)
    return np.where(good, m / np.where(good, norm, 1.0), m)


def scores(m: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries."""
    if metric == "cosine":
        return unit(m) @ unit(queries).T
    if metric == "dot":
        return m @ queries.T
    out = np.empty((len(m), len(queries)))
    for j, q in enumerate(queries):  # one at a time, so that memory is that of the rows
        d = m - q
        np.einsum("ij,ij->i", d, d, out=out[:, j])
    return -out


def score(vector: Column, query: list[float], metric: str) -> Column:
    """Score of a vector column against one query; NULL for a NULL vector."""
    q = np.array([query], np.float64)

    @F.arrow_udf("double")
    def of(col: pa.Array) -> pa.Array:
        m, known = matrix(col)
        s = scores(m, q, metric)[:, 0] if m.shape[1] else np.zeros(len(m))
        return pa.array(s, mask=~known)

    return of(vector)


# --- quantised codes ---------------------------------------------------------------------------------------------


def _rows(col: pa.Array, metric: str) -> tuple[np.ndarray, np.ndarray]:
    m, known = matrix(col)
    return (unit(m) if metric == "cosine" else m), known


def peak(v: Column, metric: str) -> Column:
    """The greatest magnitude of a vector's elements, of the unit vector for cosine."""

    @F.arrow_udf("double")
    def of(col: pa.Array) -> pa.Array:
        m, known = _rows(col, metric)
        return pa.array(np.abs(m).max(axis=1, initial=0.0), mask=~known)

    return of(v)


def quantize(m: np.ndarray, scale: float) -> np.ndarray:
    """round(x / scale), halves away from zero, within 127 of zero."""
    return np.clip(np.sign(m) * np.floor(np.abs(np.nan_to_num(m)) / scale + 0.5), -127, 127)


def int8_codes(v: Column, scale: float, metric: str) -> Column:
    """Symmetric int8 codes of a vector, of the unit vector for cosine."""

    @F.arrow_udf("array<tinyint>")
    def of(col: pa.Array) -> pa.Array:
        m, known = _rows(col, metric)
        made = quantize(m, scale).astype(np.int8)
        return pa.array([row if k else None for row, k in zip(made, known, strict=True)], pa.list_(pa.int8()))

    return of(v)


def sign_words(v: Column, dim: int) -> Column:
    """Bits x >= 0 of a vector, 64 to a long."""
    words = []
    for at in range(0, dim, 64):
        bits = [F.when(F.get(v, F.lit(i)) >= 0, F.shiftleft(F.lit(1).cast("long"), i - at)).otherwise(F.lit(0).cast("long")) for i in range(at, min(dim, at + 64))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
