"""Pairs of vectors whose score reaches a threshold, exactly, by products of blocks that bounds cut short.

Vectors are turned so that their first elements hold the most. The product of
two vectors is at most that of their first elements plus that of the lengths of
the rest, which is one product of short rows; what it leaves is decided by the
whole vectors in double precision. Boxes around vectors that lie together rule
blocks out before that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V

#: First elements of the bound of a pair, and of a box; rows and columns of a block; pairs that are decided at a time.
HEAD, BOX, ROWS, COLUMNS, EXACT = 24, 2, 256, 512, 16384
#: Sides of rows that stay, from which they are merged.
MERGE = 6


def packed(vector: Column) -> Column:
    """A vector column as bytes of single-precision numbers, which move at a fraction of an array's cost."""

    @F.arrow_udf("binary")
    def of(col: pa.Array) -> pa.Array:
        m = np.ascontiguousarray(V.matrix(col)[0], np.float32)
        ends = np.arange(len(m) + 1, dtype=np.int32) * np.int32(4 * m.shape[1])
        return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(m)])

    return of(vector)


def unpacked(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of ``packed``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.binary())
    if not len(col):
        return np.zeros((0, 0), np.float32)
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    sizes = np.unique(np.diff(ends))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0] // 4} and of {sizes[-1] // 4} dimensions")
    if not sizes[0]:
        return np.zeros((len(col), 0), np.float32)
    return np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(col), -1)


def turn(m: np.ndarray) -> np.ndarray:
    """A rotation to the axes along which ``m`` is longest, longest first. Results don't depend on it, the work does."""
    m = V.unit(m.astype(np.float64))
    m = m[np.isfinite(m).all(axis=1)]
    return np.linalg.eigh(m.T @ m)[1][:, ::-1].copy() if len(m) else np.eye(m.shape[1])


class Side:
    """Rows of one side of a comparison, turned and with their bounds. ``right`` sides differ for the metric euclidean only."""

    def __init__(self, m: np.ndarray, axes: np.ndarray, metric: str, right: bool = False):
        self.metric, self.m = metric, m
        kind = np.float32 if metric == "cosine" else np.float64
        x = m.astype(np.float64)
        x = V.unit(x) if metric == "cosine" else x
        self.ok = np.isfinite(x).all(axis=1)
        x = np.where(self.ok[:, None], x, 0.0) @ axes
        length = (x * x).sum(axis=1)
        self.scale = float(length.max(initial=0.0))

        def short(k: int) -> np.ndarray:
            return np.concatenate([x[:, :k], np.sqrt((x[:, k:] ** 2).sum(axis=1, keepdims=True))], axis=1)

        self.box = short(BOX)
        whole, head = x, short(HEAD)
        if metric == "euclidean":  # 2xy - xx - yy as a product
            ends = [np.ones_like(length), -length] if right else [-length, np.ones_like(length)]
            whole, head = (np.column_stack([p if right else 2 * p, *ends]) for p in (whole, head))
        self.whole, self.head = whole.astype(kind), head.astype(kind)

    def __len__(self) -> int:
        return len(self.m)

    def take(self, rows: np.ndarray) -> Side:
        other = object.__new__(Side)
        other.metric, other.scale = self.metric, self.scale
        for name in ("m", "ok", "box", "whole", "head"):
            setattr(other, name, getattr(self, name)[rows])
        return other

    def exact(self, rows: np.ndarray) -> np.ndarray:
        x = self.m[rows].astype(np.float64)
        return V.unit(x) if self.metric == "cosine" else x


def together(side: Side, leaf: int = ROWS) -> np.ndarray:
    """An order of the rows in which those that lie together stand together: halves, of halves, by the widest element of the box."""
    out, todo = [], [np.arange(len(side))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        x = side.box[at]
        half = len(at) // 2 // leaf * leaf or leaf
        at = at[np.argpartition(x[:, np.argmax(x.var(axis=0))], half)]
        todo += [at[half:], at[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _boxes(side: Side, step: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(side), step)
    return np.minimum.reduceat(side.box, at), np.maximum.reduceat(side.box, at)


def scores(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> np.ndarray:
    """Scores of pairs of rows in double precision, whichever side they are on."""
    x, y = left.exact(i), right.exact(j)
    return -((x - y) ** 2).sum(axis=1) if left.metric == "euclidean" else (x * y).sum(axis=1)


def pairs(left: Side, right: Side, threshold: float):
    """Yields (rows of ``left``, rows of ``right``, scores) of all pairs at ``threshold`` or more, some at a time."""
    if not len(left) or not len(right):
        return
    metric = left.metric
    slack = 1e-4 if metric == "cosine" else 1e-9 * (1 + left.scale + right.scale)
    least = threshold - slack
    reach = {"cosine": 2 - 2 * threshold, "euclidean": -threshold}.get(metric, np.inf) + 10 * slack
    (low, high), (low2, high2) = _boxes(left, ROWS), _boxes(right, ROWS)
    for n in range(len(low)):
        gap = np.maximum(0, np.maximum(low[n] - high2, low2 - high[n]))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
        a = n * ROWS
        rows = slice(a, a + ROWS)
        k = 0
        while k < len(near):
            last = k
            while last + 1 < len(near) and near[last + 1] == near[last] + 1 and (near[last + 1] - near[k] + 1) * ROWS <= COLUMNS:
                last += 1
            b = near[k] * ROWS
            cols = slice(b, (near[last] + 1) * ROWS)
            k = last + 1
            bound = left.head[rows] @ right.head[cols].T >= least
            some = np.count_nonzero(bound)
            if not some:
                continue
            whole = some * 64 > bound.size
            if whole:
                bound = left.whole[rows] @ right.whole[cols].T >= least
            i, j = np.divmod(np.flatnonzero(bound), bound.shape[1])
            if not whole:
                good = np.einsum("ij,ij->i", left.whole[a + i], right.whole[b + j]) >= least
                i, j = i[good], j[good]
            for at in range(0, len(i), EXACT):
                p, q = a + i[at : at + EXACT], b + j[at : at + EXACT]
                good = left.ok[p] & right.ok[q]
                p, q = p[good], q[good]
                score = scores(left, p, right, q)
                good = score >= threshold
                if good.any():
                    yield p[good], q[good], score[good]


class Best:
    """The best partner of each of ``n`` rows so far: of the highest score, of those the one of least rank."""

    def __init__(self, n: int):
        self.score, self.rank = np.full(n, -np.inf), np.zeros(n, np.int64)

    def see(self, row: np.ndarray, rank: np.ndarray, score: np.ndarray) -> None:
        by = np.lexsort((rank, -score, row))
        row, rank, score = row[by], rank[by], score[by]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        row, rank, score = row[first], rank[first], score[first]
        new = (score > self.score[row]) | ((score == self.score[row]) & (rank < self.rank[row]))
        self.score[row[new]], self.rank[row[new]] = score[new], rank[new]

    @property
    def found(self) -> np.ndarray:
        return self.score > -np.inf


def first_of(side: Side, right: Side, names: np.ndarray, best: Best, out: np.ndarray, threshold: float, step: int = 1024) -> np.ndarray:
    """Which rows stay: in their order, those like none that stayed before. ``best`` holds the nearest such of each row.

    ``best`` comes with what rows are like from outside and is continued with the
    names of rows of ``side``; ``right`` is ``side`` as a right one. Rows that are
    ``out`` take no part. Rows are held against those that stay only, so a dense
    group costs its size times those.
    """
    stays = np.zeros(len(side), bool)
    held: list[tuple[np.ndarray, Side]] = []
    for a in range(0, len(side), step):
        rows = a + np.flatnonzero(~out[a : a + step])
        if not len(rows):
            continue
        if len(held) > MERGE:  # many small sides as one, in which what lies together stands together
            at = np.concatenate([x for x, _ in held])
            at = at[together(side.take(at))]
            held = [(at, right.take(at))]
        lain = rows[together(side.take(rows))]
        chunk = side.take(lain)
        for at, kept in held:
            for i, j, score in pairs(chunk, kept, threshold):
                best.see(lain[i], names[at[j]], score)
        if not (free := rows[~best.found[rows]]).size:
            continue
        free_side, own = side.take(free), right.take(free)
        found = [(i[j < i], j[j < i]) for i, j, _ in pairs(free_side, own, threshold)] or [(np.zeros(0, np.int64),) * 2]
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(i, kind="stable")
        before, ends = j[by], np.searchsorted(i[by], np.arange(len(free) + 1))
        keep = np.ones(len(free), bool)
        for n in np.unique(i):
            keep[n] = not keep[before[ends[n] : ends[n + 1]]].any()
        new = free[keep]
        stays[new] = True
        held.append((new, right.take(new)))
        for i, j, score in pairs(chunk, held[-1][1], threshold):
            later = new[j] < lain[i]
            if later.any():
                best.see(lain[i][later], names[new[j]][later], score[later])
    return stays
