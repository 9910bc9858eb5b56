"""Least squares by a tree of triangular factors.

Each task reduces its rows [X | y] to the triangular factor of their QR decomposition, which
has the size of the column list whatever the number of rows.  Factors stacked on each other
have a factor again, so they are merged task by task and then key by key.  Rows and factors
alike are merged in pairs of equal weight, so that rounding grows with the depth of the tree
and not with the number of rows: the rank of a singular design can be read at any size.
Nothing is squared: a factor is as well conditioned as the design itself, where a Gram matrix
has the square of its condition.
"""
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

REALS = T.ArrayType(T.DoubleType())
ROUNDING = 16 * np.finfo(float).eps
HELD = 4096  # keys whose factors a task holds at a time


@dataclass(frozen=True)
class Factor:
    """Rows seen and left out, column sums, and the triangular factor of the rows."""
    n: int
    left_out: int
    sums: np.ndarray
    r: np.ndarray

    @staticmethod
    def empty(size: int) -> "Factor":
        return Factor(0, 0, np.zeros(size), np.zeros((0, size)))

    @staticmethod
    def of_rows(x: np.ndarray, left_out: int = 0) -> "Factor":
        return Factor(len(x), left_out, x.sum(axis=0), triangle(x))

    def merged(self, other: "Factor") -> "Factor":
        return Factor(self.n + other.n, self.left_out + other.left_out, self.sums + other.sums,
                      triangle(np.vstack([self.r, other.r])))

    @property
    def gram(self) -> np.ndarray:
        return self.r.T @ self.r


class Tree:
    """Factors merged as they come, always two of equally many: at most one is kept for each
    power of two."""

    def __init__(self, size: int):
        self.empty, self.levels = Factor.empty(size), {}

    def add(self, factor: Factor) -> None:
        level = 0
        while level in self.levels:
            factor, level = self.levels.pop(level).merged(factor), level + 1
        self.levels[level] = factor

    @property
    def factor(self) -> Factor:
        out = self.empty
        for level in sorted(self.levels):
            out = out.merged(self.levels[level])
        return out


def triangle(x: np.ndarray) -> np.ndarray:
    """The triangular factor of ``x``, by short pieces merged in pairs; fewer rows than
    columns are a factor already."""
    n = x.shape[1]
    if len(x) <= n:
        return x
    piece = max(4 * n, 64)
    while len(x) > piece:
        pieces = -(-len(x) // piece)
        full = np.zeros((pieces * piece, n))  # rows of zeros change no factor
        full[:len(x)] = x
        x, piece = np.linalg.qr(full.reshape(pieces, piece, n), mode="r").reshape(-1, n), 2 * n
    return np.linalg.qr(x, mode="r")


def pivoted(a: np.ndarray) -> tuple[np.ndarray, int]:
    """The order in which a pivoted factor takes the columns of ``a``, by descending rest,
    and the rank: how many have a rest above rounding of the first."""
    r, order = a.astype(float).copy(), np.arange(a.shape[1])
    top, rank = 0.0, 0
    for k in range(min(r.shape)):
        rest = np.linalg.norm(r[k:, k:], axis=0)
        j = k + int(rest.argmax())
        r[:, [k, j]], order[[k, j]] = r[:, [j, k]], order[[j, k]]
        v, size = r[k:, k].copy(), float(rest.max())
        top = max(top, size)
        if size <= max(a.shape) * ROUNDING * top or size == 0:
            break
        v[0] += np.copysign(size, v[0])  # a reflection on the axis
        r[k:, k:] -= np.outer(2 * v / (v @ v), v @ r[k:, k:])
        rank += 1
    return order, rank


def solved(r: np.ndarray, targets: int = 1, ridge: float = 0.0) -> tuple[np.ndarray, int]:
    """Coefficients (columns, targets) from the factor of [X | Y] whose last ``targets``
    columns are Y, and the rank of X.  Of all solutions of a singular design it is the one
    of least norm; a ridge adds its rows below the factor.  The rank is read with all
    columns at one length, so it does not depend on their units."""
    size = r.shape[1] - targets
    x, y = r[:, :size], r[:, size:]
    if ridge > 0:
        x, y = np.vstack([x, np.sqrt(ridge) * np.eye(size)]), np.vstack([y, np.zeros((size, targets))])
    length = np.linalg.norm(x, axis=0)
    scale = np.where(length > 0, length, 1.0)
    order, rank = pivoted(x / scale)
    q, both = np.linalg.qr((x / scale)[:, order])
    both = np.hstack([both, q.T @ y])
    head, rest, z = both[:rank, :rank], both[:rank, rank:size], both[:rank, size:]
    out = np.zeros((size, targets))
    out[order[:rank]] = np.linalg.solve(head, z) if rank else z
    out /= scale[:, None]
    if rank < size:  # what can be added without a change of X b
        free = np.zeros((size, size - rank))
        free[order[:rank]] = -np.linalg.solve(head, rest) if rank else rest
        free[order[rank:], range(size - rank)] = 1.0
        free[np.abs(free) <= max(x.shape) * ROUNDING] = 0.0  # what the rank takes for zero
        free /= scale[:, None]
        out -= free @ np.linalg.lstsq(free, out, rcond=None)[0]
    return out, rank


def _batch(found: dict[tuple, Tree], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    rows = [(*key, f.n, f.left_out, f.sums.tolist(), f.r.reshape(-1).tolist()) for key, f in ((key, tree.factor) for key, tree in found.items())]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def factors(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: ``n`` rows, ``left_out`` rows with a missing value, column ``sums``
    and the factor ``r`` (row by row) of the ``columns``.

    A task passes on one factor per key; factors that fall into one partition are merged
    there, and what is left, a factor per key and partition, is merged by key.  An empty
    table without keys gives no row."""
    from pyspark.sql.pandas.types import to_arrow_type

    size, keys = len(columns), list(keys)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType(fields + [T.StructField("n", T.LongType()), T.StructField("left_out", T.LongType()),
                                    T.StructField("sums", REALS), T.StructField("r", REALS)])
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def reduced(batches):
        found: dict[tuple, Tree] = {}
        for batch in batches:
            x = np.column_stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(size)])
            whole = ~np.isnan(x).any(axis=1)
            for key, rows in _grouped(batch, len(keys)):
                own = whole[rows]
                found.setdefault(key, Tree(size)).add(Factor.of_rows(x[rows][own], int((~own).sum())))
            if len(found) > HELD:
                yield _batch(found, arrow)
                found.clear()
        yield _batch(found, arrow)

    def merged(batches):
        found: dict[tuple, Tree] = {}
        for batch in batches:
            for *key, n, left_out, sums, r in zip(*[c.to_pylist() for c in batch.columns[:len(arrow)]]):
                own = Factor(n, left_out, np.array(sums, float), np.array(r, float).reshape(-1, size))
                found.setdefault(tuple(key), Tree(size)).add(own)
        yield _batch(found, arrow)

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(merged(table.select([n for n, _ in arrow]).to_batches()))

    def parted(batches):
        for batch in reduced(batches):
            part = pa.array(np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*schema.names, "_part"])

    parts = T.StructType(schema.fields + [T.StructField("_part", T.IntegerType())])
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    level = rows.mapInArrow(parted, parts).repartition(*keys, "_part").mapInArrow(merged, schema)
    if not keys:
        level, keys = level.withColumn("_all", F.lit(0)), ["_all"]
    return level.groupBy(*keys).applyInArrow(one, schema)


def _grouped(batch: pa.RecordBatch, keys: int):
    """Key values and row numbers of a batch's groups."""
    if not keys:
        return [((), np.arange(batch.num_rows))] if batch.num_rows else []
    codes = np.zeros(batch.num_rows, np.int64)
    for i in range(keys):
        own = batch.column(i).dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * (len(own.dictionary) + 1) + own.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return [(tuple(batch.column(i)[int(rows[0])].as_py() for i in range(keys)), rows) for rows in np.split(order, cuts[1:]) if len(rows)]


def factor(df: DataFrame, columns: Sequence[str]) -> Factor:
    """The factor of all rows.  Rows with a missing value are left out with a warning."""
    row = factors(df, columns).first()
    if row is None:
        return Factor.empty(len(columns))
    if row["left_out"]:
        warnings.warn(f"{row['left_out']} of {row['n'] + row['left_out']} rows have missing values and are left out", stacklevel=3)
    return Factor(row["n"], row["left_out"], np.array(row["sums"]), np.array(row["r"], float).reshape(-1, len(columns)))


def fit(df: DataFrame, xs: Sequence[str], ys: Sequence[str], ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (xs, ys) without intercept, each target's residual variance, and the rank."""
    f = factor(df, [*xs, *ys])
    if not f.n:
        return np.zeros((len(xs), len(ys))), np.zeros(len(ys)), 0
    b, rank = solved(f.r, len(ys), ridge)
    full = np.vstack([-b, np.eye(len(ys))])
    return b, ((f.r @ full) ** 2).sum(axis=0) / f.n - (f.sums @ full / f.n) ** 2, rank
