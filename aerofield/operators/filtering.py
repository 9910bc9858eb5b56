"""Recursive filters along lines, as a scan of affine maps over blocks.

What a block of rows does to the filter's state is a fixed power of a small matrix and a
vector.  Such maps compose, so each block is filtered from rest on its own, the states
between blocks follow from a scan over one small row per block, and each row is corrected
by its block's opening states.  No block carries rows of its neighbours, however long the
filter remembers.

A line that fits one block needs no scan.  Such lines are filtered in one piece, as many at a
time as an Arrow batch holds, those of equal length together.
"""
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from aerofield.functions.filters import Sections, butterworth
from aerofield.operators.sequence import LINE, block_rows, number_rows, with_group_stats
from aerofield.session import materialized, small

REALS = T.ArrayType(T.DoubleType())
FAN = 4096  # blocks that one task scans


class Kernel:
    """A filter as s' = A s + B x, y = C s + D x, and its tables for up to ``m`` samples."""

    def __init__(self, sections: Sections, m: int):
        size = 2 * len(sections.rows)
        unit = np.eye(size)
        steps = [sections.recurse([0.0], unit[j].reshape(-1, 2).tolist()) for j in range(size)]
        self.a = np.array([np.ravel(closing) for _, closing in steps]).T
        self.c = np.array([y[0] for y, _ in steps])
        y, closing = sections.recurse([1.0])
        self.b, self.d, self.m = np.ravel(closing), float(y[0]), m
        self.echo = self._powers(self.c[None, :], lambda rows, p: rows @ p)  # y after i samples, of an opening state
        self.taps = self._powers(self.b[None, :], lambda rows, p: rows @ p.T)  # state i samples after an impulse
        self.h = np.append(self.d, self.echo[:m - 1] @ self.b)
        self.steady = np.linalg.solve(np.eye(size) - self.a, self.b)  # of the constant 1

    def _powers(self, first: np.ndarray, on) -> np.ndarray:
        out, power = first, self.a
        while len(out) < self.m:
            out, power = np.vstack([out, on(out, power)]), power @ power
        return out[:self.m]

    def rest(self, x: np.ndarray) -> np.ndarray:
        """Output from rest, along the first axis."""
        return self.rest_rows(x.T).T

    def rest_rows(self, x: np.ndarray) -> np.ndarray:
        """Output from rest, along the last axis."""
        m = x.shape[-1]
        size = 1 << (2 * m - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(self.h[:m], size), size)[..., :m]

    def closing(self, x: np.ndarray) -> np.ndarray:
        """State after ``x``, from rest, along the last axis."""
        return x[..., ::-1] @ self.taps[:x.shape[-1]]


@functools.lru_cache(maxsize=4)
def kernel(sections: Sections, m: int) -> Kernel:
    return Kernel(sections, m)


@functools.lru_cache(maxsize=8)
def there_and_back(sections: Sections, size: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block of ``m`` rows: what an opening state of the forward pass adds to the
    backward pass's output, and to its closing state."""
    k = kernel(sections, size)
    return k.rest(k.echo[:m][::-1])[::-1], (k.echo[:m].T @ k.taps[:m]).T


@functools.lru_cache(maxsize=64)
def power(sections: Sections, size: int, m: int) -> np.ndarray:
    return np.linalg.matrix_power(kernel(sections, size).a, m)


def turned_block(sections: Sections, size: int, m: int, state, opened) -> tuple[np.ndarray, np.ndarray]:
    """What the backward pass adds in a block of ``m`` rows, and the last forward values, from
    its states from rest (forward, backward, last value for each column) and the opening ones."""
    q = 2 * len(sections.rows)
    s, o = np.array(state, float).reshape(-1, 2 * q + 1), np.array(opened, float).reshape(-1, q)
    add = s[:, q:2 * q] + o @ there_and_back(sections, size, m)[1].T
    return add.reshape(-1), s[:, 2 * q] + o @ kernel(sections, size).echo[m - 1]


def both_ways(held: DataFrame, keys: Sequence[str], sections: Sections, size: int, n: int) -> DataFrame:
    """``_s`` and ``_back``, the states of both passes at each block's ends, from the stored
    states from rest of ``n`` columns."""
    keys, q = list(keys), 2 * len(sections.rows)
    blocks = held.where("_state IS NOT NULL").select(*keys, "_blk", "_m", "_state")
    most = blocks.agg(F.max("_blk")).first()[0]
    steady = kernel(sections, size).steady
    if most is None or most < FAN:  # a line's blocks in one task
        schema = T.StructType([held.schema[k] for k in keys] + [T.StructField("_blk", T.LongType()), T.StructField("_s", REALS), T.StructField("_back", REALS)])

        def line(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_blk", ignore_index=True)
            opened, adds, state = [], [], np.zeros((n, q))
            for m, own in zip(pdf["_m"], pdf["_state"]):
                opened.append(state.reshape(-1).tolist())
                add, last = turned_block(sections, size, int(m), own, state)
                adds.append(add.reshape(n, q))
                state = state @ power(sections, size, int(m)).T + np.array(own, float).reshape(n, -1)[:, :q]
            state, back = np.outer(last, steady), []
            for m, add in zip(pdf["_m"][::-1], adds[::-1]):
                back.append(state.reshape(-1).tolist())
                state = state @ power(sections, size, int(m)).T + add
            return pdf.assign(_s=opened, _back=back[::-1])[schema.names]
        return blocks.groupBy(*keys).applyInPandas(line, schema)
    width = 2 * q + 1
    first = F.concat(*[F.slice("_state", width * i + 1, q) for i in range(n)])
    forward = materialized(scanned(blocks.select("*", first.alias("_add"), F.array_repeat(F.lit(0.0), q * n).alias("_init")), keys, sections, size), "forward")

    @F.pandas_udf(T.StructType([T.StructField("add", REALS), T.StructField("last", REALS)]))
    def turned(m: pd.Series, state: pd.Series, opened: pd.Series) -> pd.DataFrame:
        found = [turned_block(sections, size, int(a), b, c) for a, b, c in zip(m, state, opened)]
        return pd.DataFrame([(a.tolist(), b.tolist()) for a, b in found], columns=["add", "last"])

    turn = materialized(forward.withColumn("_t", turned("_m", "_state", "_s")).select(
        *keys, "_blk", "_m", "_s", F.col("_t.add").alias("_add"), F.col("_t.last").alias("_w")), "turned")
    ends = turn.groupBy(*keys).agg(F.max_by("_w", "_blk").alias("_w"))
    start = F.flatten(F.transform("_w", lambda w: F.transform(F.array(*map(F.lit, steady.tolist())), lambda s: w * s)))
    back = scanned(turn.drop("_w", "_s").join(ends.select(*keys, start.alias("_init")), keys), keys, sections, size, reverse=True)
    return turn.select(*keys, "_blk", "_s").join(back.select(*keys, "_blk", F.col("_s").alias("_back")), [*keys, "_blk"])


def scanned(blocks: DataFrame, keys: Sequence[str], sections: Sections, size: int, reverse: bool = False) -> DataFrame:
    """``blocks`` (keys, _blk, _m, _add, _init) with ``_s``, the state before each block, or
    after it if ``reverse``: a block takes a state s to A^m s + add; ``_init`` is the state
    at the line's end where the pass begins.  States lie one after the other for each
    column.  More than FAN blocks in a line are scanned in groups, and the groups likewise."""
    keys, q = list(keys), 2 * len(sections.rows)
    schema = T.StructType(blocks.schema.fields + [T.StructField("_s", REALS)])

    def step(state: np.ndarray, m: int, add) -> np.ndarray:
        return (state.reshape(-1, q) @ power(sections, size, m).T).reshape(-1) + np.asarray(add)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ascending=not reverse)
        state, out = np.asarray(pdf["_init"].iloc[0], float), []
        for m, add in zip(pdf["_m"], pdf["_add"]):
            out.append(state.tolist())
            state = step(state, m, add)
        return pdf.assign(_s=out)

    most = blocks.agg(F.max("_blk")).first()[0]
    if most is None or most < FAN:
        return blocks.groupBy(*keys).applyInPandas(run, schema)

    def compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ascending=not reverse)
        state = np.zeros(len(pdf["_init"].iloc[0]))
        for m, add in zip(pdf["_m"], pdf["_add"]):
            state = step(state, m, add)
        return pd.DataFrame([(*key, int(pdf["_m"].sum()), state.tolist(), pdf["_init"].iloc[0])], columns=grouped.names)
    grouped = T.StructType([blocks.schema[k] for k in keys] + [blocks.schema[c] for c in ("_blk", "_m", "_add", "_init")])
    group = F.floor(F.col("_blk") / FAN)
    upper = scanned(materialized(blocks.withColumn("_g", group).groupBy(*keys, "_g").applyInPandas(compose, grouped), "blocks"), keys, sections, size, reverse)
    opened = blocks.drop("_init").withColumn("_g", group).join(upper.select(*keys, F.col("_blk").alias("_g"), F.col("_s").alias("_init")), [*keys, "_g"])
    return opened.groupBy(*keys, "_g").applyInPandas(lambda pdf: run(pdf)[schema.names], schema)


def _missing(column: str) -> Column:
    x = F.col(column).cast("double")
    return x.isNull() | F.isnan(x)


def _by_block(rows: DataFrame, keep: list[str], columns: list[str], keys, sections: Sections, size: int, both: bool) -> DataFrame:
    """Stored rows (``_blk``, ``_i`` in it, ``_m``) filtered from rest, forward or forward and
    back.  A block's first row holds ``_state``: for each column the forward closing state
    and, for both passes, the backward one and the last forward value."""
    schema = T.StructType([rows.schema[k] for k in keep] + [T.StructField(c, T.DoubleType()) for c in columns] + [
        T.StructField("_blk", T.LongType()), T.StructField("_i", T.IntegerType()), T.StructField("_m", T.IntegerType()),
        T.StructField("_core", T.BooleanType()), T.StructField("_state", REALS)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", ignore_index=True)
        m, k, state = len(pdf), kernel(sections, size), []
        out = pdf[[*keep, "_blk", "_core"]].copy()
        for c in columns:
            x = np.nan_to_num(pdf[c].to_numpy(dtype=float))
            y = k.rest(x)
            state.append(k.closing(x))
            if both:
                state += [k.closing(y[::-1]), y[-1:]]
                y = k.rest(y[::-1])[::-1]
            out[c] = y
        first = np.concatenate(state).tolist()
        return out.assign(_i=np.arange(m), _m=m, _state=[first, *[None] * (m - 1)])[schema.names]
    return materialized(rows.groupBy(*keys, "_blk").applyInPandas(run, schema), "filtered")


def _corrected(held: DataFrame, states: DataFrame, keys, columns: list[str], sections: Sections, size: int, both: bool) -> DataFrame:
    """Stored rows with what their block's opening states add.  One small row per block is
    joined to the rows."""
    q, n = 2 * len(sections.rows), len(columns)
    joined = held.drop("_state").join(small(states), [*keys, "_blk"])
    schema = T.StructType([f for f in joined.schema.fields if f.name not in ("_s", "_back")])

    def run(batches):
        k = kernel(sections, size)
        for pdf in batches:
            parts = []
            for m, part in pdf.groupby("_m", sort=False):
                at = part["_i"].to_numpy()
                opened = np.array(part["_s"].tolist(), float).reshape(len(part), n, q)
                weights = there_and_back(sections, size, int(m))[0][at] if both else k.echo[at]
                add = np.einsum("rnq,rq->rn", opened, weights)
                if both:
                    back = np.array(part["_back"].tolist(), float).reshape(len(part), n, q)
                    add += np.einsum("rnq,rq->rn", back, k.echo[m - 1 - at])
                parts.append(part.assign(**{c: part[c] + add[:, j] for j, c in enumerate(columns)}))
            if parts:
                yield pd.concat(parts)[schema.names]
    return joined.mapInPandas(run, schema)


Run = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]


def _begins(table: pa.Table, keys: int) -> np.ndarray:
    """Where the keys, the first columns, differ from the row before."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for column in table.columns[:keys]:
        codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of their keys, cut where a group ends, and the groups' first rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.Table.from_batches([b.slice(b.num_rows - 1) for b in held[-1:]] + [batch])
        last = int(_begins(ends, keys)[-1]) - len(held[-1:])  # where the batch's last group begins
        if last < 0 or not held and last == 0:  # nothing has ended
            held.append(batch)
            continue
        done = pa.Table.from_batches([*held, batch.slice(0, last)])
        yield done, _begins(done, keys)
        held = [batch.slice(last)]
    if held:
        done = pa.Table.from_batches(held)
        yield done, _begins(done, keys)


def _in_lines(df: DataFrame, keys: Sequence[str], run: Run, schema: T.StructType) -> DataFrame:
    """``run`` on whole lines in the order of ``pos``, many at a time: it gets a table, whose
    first columns are the keys, and the lines' first rows and lengths in it."""
    def lines(batches):
        for table, starts in _whole_groups(batches, len(keys)):
            yield from run(table, starts, np.diff(starts, append=table.num_rows)).to_batches()
    rows = df.select(*keys, *[c for c in df.columns if c not in keys])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInArrow(lines, schema)


def _doubles(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Columns one below the other, missing values as NaN."""
    return np.stack([table.column(c).to_numpy().astype(float) for c in columns])


def _by_length(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the row numbers of the lines that have it."""
    for m in np.unique(sizes):
        yield int(m), starts[sizes == m][:, None] + np.arange(m)


def _longer(rows: DataFrame, room: int) -> bool:
    """Whether any line has more than ``room`` rows."""
    return (rows.agg(F.max("n_line")).first()[0] or 0) > room


def _zero_phase_lines(slim: DataFrame, keep: list[str], columns: list[str], keys, sections: Sections, size: int) -> DataFrame:
    """``zero_phase`` for lines that, with their extensions, fit one block."""
    n, pad, level = len(columns), sections.pad, sections.gain * sections.gain
    schema = T.StructType([slim.schema[k] for k in keep] + [T.StructField(c, T.DoubleType()) for c in columns])

    def run(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.Table:
        k = kernel(sections, size)
        x = _doubles(table, [f"_x{i}" for i in range(n)])
        out, filtered = x.copy(), np.zeros(x.shape[1], bool)
        for m, at in _by_length(starts, sizes):
            if m <= sections.shortest:
                continue
            filtered[at] = True
            v = x[:, at]
            first, last = v[..., :1], v[..., -1:]
            e = np.concatenate([2 * first - v[..., pad:0:-1], v, 2 * last - v[..., -2:-pad - 2:-1]], axis=-1)
            base = e[..., :1]
            y = k.rest_rows(np.nan_to_num(e - base))
            y = k.rest_rows(y[..., ::-1]) + y[..., -1:] * (k.echo[:e.shape[-1]] @ k.steady)
            y = y[..., ::-1][..., pad:-pad] + level * base
            y = np.where(v.min(axis=-1, keepdims=True) == v.max(axis=-1, keepdims=True), v, y)
            out[:, at] = np.where(np.isnan(v).any(axis=-1, keepdims=True), np.nan, y)
        done = [pa.array(y, mask=table.column(f"_x{i}").is_null().to_numpy() & ~filtered) for i, y in enumerate(out)]
        return pa.Table.from_arrays([*[table.column(c) for c in keep], *done], names=schema.names)
    return _in_lines(slim, keys, run, schema)


def _block_size(df: DataFrame, sections: Sections) -> int:
    return max(block_rows(df.sparkSession), 2 * len(sections.rows))


def zero_phase(df: DataFrame, columns: list[str], sections: Sections | None = None,
               keep: list[str] | None = None, keys=LINE, **design) -> DataFrame:
    """Zero-phase filter of each column along each line, which is continued by an odd
    extension at both ends.  Constant columns and lines too short for the filter stay as
    they are.  Both passes remember every sample, so a line with a missing value has no
    filtered values at all.  Returns ``keep`` and the filtered columns."""
    f = sections or butterworth(**design)
    rows = number_rows(df, keys)
    keep = [c for c in (keep or [c for c in rows.columns if c not in columns])]
    keep += [c for c in (*keys, "pos", "n_line") if c not in keep]
    pad, size, n = f.pad, _block_size(df, f), len(columns)
    pos, last = F.col("pos"), F.col("n_line") - 1
    long = F.col("n_line") > f.shortest
    slim = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    room = size - 2 * pad
    whole = _zero_phase_lines(slim.where(F.col("n_line") <= room), keep, columns, keys, f, size)
    if not _longer(rows, room):
        return whole
    slim = slim.where(F.col("n_line") > room)
    stats = {}
    for i in range(n):
        x = F.col(f"_x{i}")
        stats |= {f"_flat{i}": F.min(x) == F.max(x), f"_gap{i}": F.max(_missing(f"_x{i}")), f"_f{i}": F.max(F.when(pos == 0, x)),
                  f"_l{i}": F.max(F.when(pos == last, x)), f"_e{i}": 2 * F.max(F.when(pos == 0, x)) - F.max(F.when(pos == pad, x))}
    told = with_group_stats(slim, stats, keys)
    none = F.array().cast("array<bigint>")
    places = F.concat(F.array(pos), F.when(long & pos.between(1, pad), F.array(-pos)).otherwise(none),
                      F.when(long & pos.between(last - pad, last - 1), F.array(2 * last - pos)).otherwise(none))
    at = F.col("_at")
    value = lambda i: (F.when(at < 0, 2 * F.col(f"_f{i}") - F.col(f"_x{i}")).when(at > last, 2 * F.col(f"_l{i}") - F.col(f"_x{i}"))
                       .otherwise(F.col(f"_x{i}")) - F.col(f"_e{i}"))
    marks = [f"_{m}{i}" for m in ("x", "flat", "gap", "e") for i in range(n)]
    spread = told.withColumn("_at", F.explode(places)).select(
        *keep, *marks, "_at", F.floor((at + F.lit(pad)) / size).alias("_blk"), (at == pos).alias("_core"), *[value(i).alias(f"_y{i}") for i in range(n)])
    ys = [f"_y{i}" for i in range(n)]
    held = _by_block(spread, [*keep, *marks], ys, keys, f, size, True)
    states = both_ways(held, keys, f, size, n)
    done = _corrected(held.where("_core"), states, keys, ys, f, size, True)
    level = f.gain * f.gain
    final = lambda i: (F.when(~long, F.col(f"_x{i}")).when(F.col(f"_gap{i}"), F.lit(float("nan"))).when(F.col(f"_flat{i}"), F.col(f"_x{i}"))
                       .otherwise(F.col(f"_y{i}") + level * F.col(f"_e{i}")))
    return whole.unionByName(done.select(*keep, *[final(i).alias(c) for i, c in enumerate(columns)]))


def _forward(df: DataFrame, columns: list[str], sections: Sections, keep: list[str], state, keys):
    """Stored rows filtered from rest, and a row per block with its opening state."""
    size, n, q = _block_size(df, sections), len(columns), 2 * len(sections.rows)
    rows = df.withColumns({"_at": F.col("pos"), "_blk": F.floor(F.col("pos") / size), "_core": F.lit(True)})
    held = _by_block(rows, keep, columns, keys, sections, size, False)
    opening = np.ravel(state).tolist() if state is not None else [0.0] * q
    blocks = held.where("_state IS NOT NULL").select(
        *keys, "_blk", "_m", F.col("_state").alias("_add"), F.array(*map(F.lit, [float(v) for v in opening] * n)).alias("_init"))
    return held, scanned(blocks, keys, sections, size), size


def _causal_lines(slim: DataFrame, keep: list[str], columns: list[str], keys, sections: Sections, size: int, state) -> DataFrame:
    """``causal`` for lines that fit one block."""
    schema = T.StructType([slim.schema[k] for k in keep] + [T.StructField(c, T.DoubleType()) for c in columns])
    opening = np.ravel(state) if state is not None else None

    def run(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.Table:
        k = kernel(sections, size)
        out = _doubles(table, columns)
        for m, at in _by_length(starts, sizes):
            v = out[:, at]
            gone = np.logical_or.accumulate(np.isnan(v), axis=-1)
            y = k.rest_rows(np.nan_to_num(v)) + (k.echo[:m] @ opening if opening is not None else 0.0)
            out[:, at] = np.where(gone, np.nan, y)
        return pa.Table.from_arrays([*[table.column(c) for c in keep], *map(pa.array, out)], names=schema.names)
    return _in_lines(slim, keys, run, schema)


def causal(df: DataFrame, columns: list[str], sections: Sections, keep: list[str] | None = None,
           state=None, keys=LINE) -> DataFrame:
    """One forward pass from rest, or from a state per section.  From a line's first
    missing value on there is no output."""
    rows = number_rows(df, keys)
    keep = [c for c in (keep or [c for c in rows.columns if c not in columns])]
    keep += [c for c in (*keys, "pos", "n_line") if c not in keep]
    slim = rows.select(*keep, *[F.col(c).cast("double") for c in columns])
    size = _block_size(df, sections)
    whole = _causal_lines(slim.where(F.col("n_line") <= size), keep, columns, keys, sections, size, state)
    if not _longer(rows, size):
        return whole
    stops = {f"_end{i}": F.min(F.when(_missing(c), F.col("pos"))) for i, c in enumerate(columns)}
    slim = with_group_stats(slim.where(F.col("n_line") > size), stops, keys)
    held, blocks, size = _forward(slim, columns, sections, [*keep, *stops], state, keys)
    done = _corrected(held, blocks.select(*keys, "_blk", "_s"), keys, columns, sections, size, False)
    return whole.unionByName(done.select(*keep, *[
        F.when(F.col("pos") >= F.col(f"_end{i}"), F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)]))


def closing_state(df: DataFrame, column: str, sections: Sections, keys=LINE) -> DataFrame:
    """The filter's state after each line's last row, from rest."""
    rows = number_rows(df, keys).select(*keys, "pos", "n_line", F.col(column).cast("double").alias("_x"))
    size = _block_size(df, sections)
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("state", REALS)])

    def run(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> pa.Table:
        k = kernel(sections, size)
        x, out = np.nan_to_num(_doubles(table, ["_x"])[0]), np.zeros((len(starts), 2 * len(sections.rows)))
        for m, at in _by_length(starts, sizes):
            out[sizes == m] = k.closing(x[at])
        ends = table.take(pa.array(starts))
        return pa.Table.from_arrays([*[ends.column(c) for c in keys], pa.array(out.tolist(), pa.list_(pa.float64()))], names=schema.names)
    whole = _in_lines(rows.where(F.col("n_line") <= size), keys, run, schema)
    if not _longer(rows, size):
        return whole
    _, blocks, size = _forward(rows.where(F.col("n_line") > size), ["_x"], sections, list(keys), None, keys)

    @F.pandas_udf(REALS)
    def after(m: pd.Series, add: pd.Series, opened: pd.Series) -> pd.Series:
        return pd.Series([(power(sections, size, int(n)) @ np.array(s) + np.array(c)).tolist() for n, c, s in zip(m, add, opened)])
    return whole.unionByName(blocks.withColumn("state", after("_m", "_add", "_s")).groupBy(*keys).agg(F.max_by("state", "_blk").alias("state")))


def low_pass_currents(df: DataFrame, sensors: list[str], fs: float, keep: list[str]) -> DataFrame:
    """Low-passed (0.2 Hz) current sensors as features ``lpf_<sensor>``."""
    named = df.withColumns({f"lpf_{s}": F.col(s) for s in sensors})
    return zero_phase(named, [f"lpf_{s}" for s in sensors], butterworth(0.0, 0.2, fs), keep=keep)
