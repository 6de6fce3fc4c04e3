"""Embedding whitening by hierarchical merging of singular value decompositions.

A task keeps, for the rows it has read, their number, their exact sums and the full-rank product of singular values and
right singular vectors of the centred rows. Two such states merge losslessly: their products are stacked, a row that corrects for the
difference of their means is appended, and the stack is decomposed again. States merge in a tree of bounded fan-in, so neither the
driver nor a task ever holds more than a few of them; the last one, whose size depends on the dimensions alone, is the model.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows per decomposition, states per merge, dimensions at most (a state is 8 * dimensions^2 bytes).
ROWS, FAN, MOST_DIMENSIONS = 4096, 16, 8192
#: Entries lie within this bound, so that block sums and centred entries are exact.
BOUND = 1 << 50

State = tuple[int, list[int], np.ndarray]


def grid(vectors: DataFrame, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, x array<long>) with x = floor(scale * c) + shift for every entry c, taken as double. Vectors that are null or hold
    null, NaN or infinite entries are dropped, and so are those with an entry whose x would lie beyond 2^50."""
    v = F.col("v")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * abs(scale) + abs(shift) < F.lit(float(BOUND)))
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    # a filter may be moved behind this: no entry overflows
    whole = F.transform(v, lambda c: F.when(fits(c), F.floor(c * F.lit(float(scale)))) + F.lit(shift).cast("long"))
    return rows.where(v.isNotNull() & F.forall(v, fits)).select(F.col("i").alias(id_col), whole.alias("x"))


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors: rows' own full-rank stand-in, with the same inner products."""
    if len(rows) <= 1:
        return rows
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def block_state(x: np.ndarray) -> State:
    """The state of whole-number rows, before any decomposition: the centred rows themselves."""
    n = len(x)
    total = x.sum(axis=0)
    near = x - total // n  # exact; its mean lies in [0, 1)
    rows = near.astype(np.float64)
    return n, total.tolist(), rows - near.sum(axis=0) / n


def merged(a: State, b: State) -> State:
    """The state of both states' rows: stacked, with the mean-correction row, and decomposed again."""
    (n, s, x), (m, t, y) = a, b
    # (mean of a - mean of b), from exact integers and rounded once
    gap = np.array([(p * m - q * n) / (n * m) for p, q in zip(s, t, strict=True)])
    return n + m, [p + q for p, q in zip(s, t, strict=True)], decomposed(np.concatenate([x, y, np.sqrt(n / (n + m) * m) * gap[None]]))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(part: int, state: State) -> pa.RecordBatch:
    n, s, x = state
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(v) for v in s]], pa.list_(pa.string())), pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())],
        ["part", "n", "sums", "rows"],
    )


def _unpack(row: dict, dim: int) -> State:
    return row["n"], [int(v) for v in row["sums"]], np.frombuffer(row["rows"], "<f8").reshape(-1, dim)


STATE = "part long, n long, sums array<string>, rows binary"


def _tree(states: DataFrame, dim: int, merge: Callable[[State, State], State]) -> State | None:
    """One state out of those of all tasks, FAN at a time; groups of a level are tasks of their own."""
    states = written(states)
    last = states.agg(F.max("part")).first()[0]
    if last is None:
        return None

    def level(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part").to_pylist()
        state = _unpack(rows[0], dim)
        for row in rows[1:]:
            state = merge(state, _unpack(row, dim))
        return pa.Table.from_batches([_pack(rows[0]["part"] // FAN, state)])

    while last > 0:
        states = states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(level, STATE)
        last //= FAN
    return _unpack(states.first().asDict(), dim)


def fitted(points: DataFrame, dim: int, vector_col: str = "x") -> State | None:
    """The state of all rows of points (vector_col: array<long> of `dim` entries)."""

    def run(batches):
        state = None
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), ROWS):
                block = block_state(x[at : at + ROWS])
                state = merged(state, block) if state else (block[0], block[1], decomposed(block[2]))
        if state:
            yield _pack(TaskContext.get().partitionId(), state)

    return _tree(points.select(vector_col).mapInArrow(run, STATE), dim, merged)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; null beyond a long."""
    middle = [s // n for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, middle, strict=True)], object)
    near = x - np.array(middle, np.int64)
    most = (int(np.abs(near).max()) + 1) * n
    if most * most * x.shape[1] < 1 << 63:
        gap = near * n - rest.astype(np.int64)
        return (gap * gap).sum(axis=1).tolist()
    gap = near.astype(object) * n - rest
    return [v if v < 1 << 63 else None for v in (gap * gap).sum(axis=1).tolist()]


def whiten(points: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): a row for each row of points and each of its first
    `components` principal components, numbered from 1 by falling variance.

    points: vector_col is array<long>, entries within 2^50 (see `grid`). n: rows of the fit, all rows. deviation: the exact sum of (n * x - S)^2, S
    being the sums; null beyond a long. whitened: the centred row, projected on the component, over its standard deviation. explained: the component's share of all variance.
    identity_error: the largest absolute entry of the whitened rows' covariance minus the identity, one value for all rows, measured on the rows by a second pass.
    Components without variance (rounding apart) have whitened 0 and explained 0 and no part in identity_error; so it is for one row, or for
    equal rows. Null vectors and those of another length than the most common one (ties: the shorter) take no part. Null and repeated ids are carried, a result for each row. Fewer
    dimensions than `components` give fewer rows; an empty table gives none. Other columns are not read, so their names cannot clash.
    The model, of at most MOST_DIMENSIONS^2 numbers, is the only thing that the driver holds."""
    # written once: three passes read it
    rows = written(points.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("x")).where("x is not null"))
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = size["d"] if size else 0
    if not dim:
        return points.sparkSession.createDataFrame([], schema)
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dim} dimensions: a state of {dim}^2 numbers is more than a task should hold (at most {MOST_DIMENSIONS})")
    rows = rows.where(F.size("x") == dim)
    n, sums, product = fitted(rows, dim)
    _, s, vt = np.linalg.svd(product, full_matrices=False)
    s, vt = np.r_[s, np.zeros(dim - len(s))][:dim], np.concatenate([vt, np.zeros((dim - len(vt), dim))])
    k = min(components, dim)
    live = s[:k] > s[0] * dim * 8 * np.finfo(float).eps
    variance = s**2 / n
    explained = np.where(live, variance[:k] / (variance.sum() or 1.0), 0.0)
    # one matrix centres, projects and scales; components without variance project to 0
    to = vt[:k].T * np.where(live, 1 / np.sqrt(np.where(live, variance[:k], 1.0)), 0.0)
    middle = np.array([c // n for c in sums], np.int64)
    rest = np.array([(c % n) / n for c in sums])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - middle).astype(np.float64) - rest) @ to

    def spread(batches):
        state = None
        for batch in batches:
            w = project(_matrix(batch.column(0), dim))
            if len(w):
                gap = w - w.mean(axis=0)
                block = (len(w), w.mean(axis=0), gap.T @ gap)
                state = joined(state, block) if state else block
        if state:
            yield _pack(TaskContext.get().partitionId(), (state[0], [], np.concatenate([state[1][None], state[2]])))

    def joined(a, b):
        (p, m, x), (q, t, y) = a, b
        gap = m - t
        return p + q, (p * m + q * t) / (p + q), x + y + np.outer(gap, gap) * (p / (p + q) * q)

    def whole(a: State, b: State) -> State:
        p, m, x = joined((a[0], a[2][0], a[2][1:]), (b[0], b[2][0], b[2][1:]))
        return p, [], np.concatenate([m[None], x])

    _, _, found = _tree(rows.select("x").mapInArrow(spread, STATE), k, whole)
    error = np.abs(found[1:] / n - np.eye(k))[np.ix_(live, live)]
    identity_error = float(error.max()) if error.size else 0.0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, x = batch.column(0).slice(at, ROWS), _matrix(batch.column(1).slice(at, ROWS), dim)
                each = np.repeat(np.arange(len(x)), k)
                full = lambda v, kind: pa.array(np.full(len(each), v), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), full(n, pa.int64()), pa.array(_deviation(x, n, sums), pa.int64()).take(pa.array(each)),
                        pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))), full(identity_error, pa.float64()),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
