"""Continuation of maps that fit a task: their cells travel packed in pieces of arrays, meet once
by map, and are padded, transformed and inverted many maps at a time, without a row per cell.

The sums are those of ``mapspectra``'s passes over grid rows and columns, cell by cell, also where
cells are missing or come twice; the passes remain for maps too large for this.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from aerofield.session import small

#: Cells of a padded map that a task may hold, and about as many of all maps it works on at a time.
WHOLE = 1 << 17
PIECE = 128
_LISTS = {"iy": "long", "ix": "long", "xx": "double", "yy": "double", "_v": "double", "_live": "boolean", "mask": "boolean"}
_CELL = pa.struct([("iy", pa.int64()), ("ix", pa.int64()), ("xx", pa.float64()), ("yy", pa.float64()), ("val", pa.float64()), ("mask", pa.bool_())])


def padded_size(pad: int, cells, nx, ny):
    """Cells of a padded map, its own and the ring's, of Columns or arrays."""
    return cells + 2 * pad * (nx + ny + 2 * pad)


def unfit(cells: DataFrame, pad: int) -> DataFrame:
    """``map_id``, its lowest altitude ``_alt`` and ``_odd``: too large, of several levels, or
    with a missing index or coordinate."""
    known = F.lit(True)
    for c in ("iz", "iy", "ix"):
        known = known & F.col(c).isNotNull()
    for c in ("xx", "yy", "alt"):
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    wide = lambda i: F.max(i).cast("double") - F.min(i).cast("double") + 1
    got = cells.groupBy("map_id").agg(
        F.count("*").alias("_cells"), F.count_if(~known).alias("_missing"), F.min("alt").alias("_alt"),
        (F.min("iz") != F.max("iz")).alias("_deep"), wide("ix").alias("_nx"), wide("iy").alias("_ny"))
    size = padded_size(pad, F.col("_cells"), F.col("_nx"), F.col("_ny"))
    return got.select("map_id", "_alt", ((F.col("_missing") > 0) | F.col("_deep") | (F.greatest("_nx", "_ny", size) > WHOLE)).alias("_odd"))


def continued(cells: DataFrame, altitudes: list[float], alpha: float, steps: DataFrame | None, value: str, pad: int,
              live: Column) -> DataFrame:
    """Maps of one level, none of them ``unfit``, continued to every altitude; ``live`` tells
    the cells that do not count as 0."""
    mask = F.col("mask") if "mask" in cells.columns else F.lit(True)
    flat = cells.select("map_id", F.col("alt").cast("double").alias("alt"), *[
        {"_v": F.col(value), "_live": live, "mask": mask}.get(c, F.col(c)).cast(kind).alias(c) for c, kind in _LISTS.items()])
    key = flat.schema["map_id"].dataType.simpleString()
    pieces = flat.mapInArrow(_packed, f"map_id {key}, alt double, " + ", ".join(f"{c} array<{k}>" for c, k in _LISTS.items()))
    if steps is not None:
        pieces = pieces.join(small(steps.select("map_id", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"))), "map_id")
    met = pieces.repartition("map_id").sortWithinPartitions("map_id")
    levels = sorted({float(a) for a in altitudes})
    rows = met.mapInArrow(_worker(levels, float(alpha), pad),
                          f"map_id {key}, iz long, alt double, _cells array<struct<iy:long,ix:long,xx:double,yy:double,val:double,mask:boolean>>")
    of = lambda c: F.col(f"_c.{c}").cast(cells.schema[c].dataType).alias(c)
    return rows.select("map_id", "iz", "alt", F.explode("_cells").alias("_c")).select(
        "map_id", "iz", "_c.iy", of("ix"), of("xx"), of("yy"), "alt", F.col("_c.val").alias(value), "_c.mask")


def _begins(ids: pa.Array) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(ids), bool)
    if len(ids) > 1:
        out[1:] = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    return out


def _lists(at: np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring cells of a map as a row of arrays."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = _begins(b.column("map_id"))
        runs = np.flatnonzero(new)
        first = np.flatnonzero((np.arange(n) - runs[np.cumsum(new) - 1]) % PIECE == 0)
        alt = np.minimum.reduceat(b.column("alt").to_numpy(zero_copy_only=False), first)
        lists = [_lists(np.append(first, n), b.column(c)) for c in _LISTS]
        yield pa.RecordBatch.from_arrays([b.column("map_id").take(pa.array(first)), pa.array(alt), *lists], names=["map_id", "alt", *_LISTS])


def _worker(altitudes: list[float], alpha: float, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (b.slice(at, WHOLE // PIECE) for b in batches for at in range(0, b.num_rows, WHOLE // PIECE)):
            cut = int(np.flatnonzero(_begins(b.column("map_id")))[-1])
            if cut == 0 and held and held[-1].column("map_id")[-1] == b.column("map_id")[0]:
                held.append(b)
                continue
            yield from _blocks([*held, b.slice(0, cut)], altitudes, alpha, pad)
            held = [b.slice(cut)]
        yield from _blocks(held, altitudes, alpha, pad)
    return run


def _blocks(held: list[pa.RecordBatch], altitudes: list[float], alpha: float, pad: int) -> Iterator[pa.RecordBatch]:
    """Whole maps in blocks of about WHOLE padded cells."""
    if not sum(b.num_rows for b in held):
        return
    whole = pa.Table.from_batches(held).combine_chunks()
    col = lambda c: whole.column(c).chunk(0)
    ids, firsts = col("map_id"), np.flatnonzero(_begins(col("map_id")))
    at = np.append(0, np.cumsum(pc.list_value_length(col("ix")).to_numpy(zero_copy_only=False)))  # cells before a piece
    starts = at[firsts]
    flat = {c: col(c).flatten() for c in _LISTS}
    plain = lambda c: flat[c].to_numpy(zero_copy_only=False)
    v = np.where(plain("_live"), pc.fill_null(flat["_v"], 0.0).to_numpy(zero_copy_only=False), 0.0)
    a = {"iy": plain("iy"), "ix": plain("ix"), "xx": plain("xx"), "yy": plain("yy"), "v": v}
    lows = {c: np.minimum.reduceat(a[c], starts) for c in ("iy", "ix")}
    wide = {c: np.maximum.reduceat(a[c], starts) - lows[c] + 1 for c in ("iy", "ix")}
    bounds = np.append(starts, at[-1])
    size = np.cumsum(padded_size(pad, np.diff(bounds), wide["ix"], wide["iy"]))
    cuts = [*np.flatnonzero(np.diff(size // WHOLE, prepend=-1)), len(starts)]
    source = np.minimum.reduceat(col("alt").to_numpy(zero_copy_only=False), firsts)
    steps = [col(c).to_numpy(zero_copy_only=False)[firsts] for c in ("dx", "dy")] if "dx" in whole.column_names else None
    for m0, m1 in zip(cuts, cuts[1:]):
        lo, hi = int(bounds[m0]), int(bounds[m1])
        part = {c: x[lo:hi] for c, x in a.items()}
        counts = np.diff(bounds[m0:m1 + 1])
        g = np.repeat(np.arange(m1 - m0), counts)
        for c in ("iy", "ix"):
            part[c] = part[c] - lows[c][m0:m1][g]
        solved = _solved(g, part, pad, steps and [s[m0:m1] for s in steps], source[m0:m1], altitudes, alpha)
        for iz, (alt, (there, vals, known)) in enumerate(zip(altitudes, solved)):
            kept = pa.array(np.flatnonzero(there) + lo)
            cells = pa.StructArray.from_arrays([*(flat[c].take(kept) for c in ("iy", "ix", "xx", "yy")),
                                                pa.array(vals[there], mask=~known[there]), flat["mask"].take(kept)], fields=list(_CELL))
            ends = np.append(0, np.cumsum(np.bincount(g[there], minlength=m1 - m0)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(firsts[m0:m1])), pa.array(np.full(m1 - m0, iz, np.int64)),
                                              pa.array(np.full(m1 - m0, alt)), _lists(ends, cells)], names=["map_id", "iz", "alt", "_cells"])


def _ringed(g, line, along, fixed, moving, v, pad: int) -> list[np.ndarray]:
    """The cells and, beyond each line's ends, ``pad`` more that lead around the ring."""
    span = along.max() - along.min() + 1
    key = (g * (line.max() - line.min() + 1) + line - line.min()) * span
    order = np.lexsort((v, key + along - along.min()))
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(first[1:], len(key)) - 1
    low = lambda x: np.minimum.reduceat(x[order], first)[:, None]
    high = lambda x: np.maximum.reduceat(x[order], first)[:, None]
    start, stop = v[order[first]][:, None], v[order[last]][:, None]
    lo, hi, c0, c1 = low(along), high(along), low(moving), high(moving)
    step = np.where(hi > lo, (c1 - c0) / np.maximum(hi - lo, 1), 1.0)
    r = np.arange(1, 2 * pad + 1)[None, :]
    after, back = r <= pad, 2 * pad + 1 - r
    wide = lambda x: np.repeat(x[order[first]], 2 * pad)
    return [np.append(x, more) for x, more in (
        (g, wide(g)), (line, wide(line)), (along, np.where(after, hi + r, lo - back).ravel()), (fixed, np.repeat(low(fixed), 2 * pad)),
        (moving, np.where(after, c1 + r * step, c0 - back * step).ravel()), (v, (stop + (start - stop) * r / (2 * pad + 1)).ravel()))]


def _distinct(g: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((x, g))
    g, x = g[order], x[order]
    new = np.append(True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]))
    return g[new], x[new]


def _median_steps(g: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Median step between the distinct values of each map; 0 for a single value."""
    g, x = _distinct(g, x)
    same = g[1:] == g[:-1]
    g, d = g[1:][same], np.abs(np.diff(x)[same])
    d = d[np.lexsort((d, g))]
    n = np.bincount(g, minlength=m)
    begin, out, some = np.cumsum(n) - n, np.zeros(m), n > 0
    out[some] = (d[(begin + (n - 1) // 2)[some]] + d[(begin + n // 2)[some]]) / 2
    return out


def _wave(i: np.ndarray, n: np.ndarray, step: np.ndarray) -> np.ndarray:
    size = n * step
    return np.where(size == 0, 0.0, np.where(i <= (n - 1) // 2, i, i - n) * (2 * np.pi) / np.where(size == 0, 1.0, size))


class _Lines:
    """Elements sorted into lines (``key``), each by ``along``; the lines are transformed in
    groups of one length."""

    def __init__(self, key: np.ndarray, along: np.ndarray, ties: np.ndarray | None = None):
        span = int(along.max()) + 1
        self.order = np.argsort(key * span + along, kind="stable") if ties is None else np.lexsort((ties, key * span + along))
        key = key[self.order]
        self.first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.key, self.size = key[self.first], np.diff(np.append(self.first, len(key)))
        self.place = np.arange(len(key)) - np.repeat(self.first, self.size)

    def each(self, z: np.ndarray, transform) -> np.ndarray:
        out = np.empty(len(z), complex)
        for n in np.unique(self.size):
            at = self.first[self.size == n][:, None] + np.arange(n)
            out[at] = transform(z[at], axis=1)
        return out


def _solved(g, cells: dict, pad: int, steps, source: np.ndarray, altitudes: list[float], alpha: float):
    """For each altitude: which cells have a grid row, their values, and which of these there are.
    Indices begin at 0 in each map."""
    m = len(source)
    iy, ix, yy, xx, v = (cells[c] for c in ("iy", "ix", "yy", "xx", "v"))
    pg, py, px, pyy, pxx, pv = g, iy, ix, yy, xx, v
    with np.errstate(all="ignore"):
        if pad:
            pg, py, px, pyy, pxx, pv = _ringed(pg, py, px, pyy, pxx, pv, pad)
            pg, px, py, pxx, pyy, pv = _ringed(pg, px, py, pxx, pyy, pv, pad)
            pv = np.where(np.isnan(pv), 0.0, pv)
        nx, ny = (np.bincount(_distinct(pg, i)[0], minlength=m) for i in (px, py))
        dx, dy = steps if steps is not None else (_median_steps(pg, x, m) for x in (pxx, pyy))
        py, px = py - py.min(), px - px.min()
        rows = _Lines(pg * (py.max() + 1) + py, px, pv)
        spec = rows.each(pv[rows.order], np.fft.fft)
        pg, py, jx = pg[rows.order], py[rows.order], rows.place
        wide = jx.max() + 1
        columns = _Lines(pg * wide + jx, py)
        spec, pg, jx, jy = columns.each(spec[columns.order], np.fft.fft), pg[columns.order], jx[columns.order], columns.place
        kx, ky = _wave(jx, nx[pg], dx[pg]), _wave(jy, ny[pg], dy[pg])
        k = np.sqrt(kx * kx + ky * ky)
        tall = jy.max() + 1
        back = _Lines(pg * tall + jy, jx)
        # the grid row of each cell, and its place there
        y, x = iy + pad, ix + pad
        line = np.minimum(np.searchsorted(back.key, g * tall + y), len(back.key) - 1)
        there = (y < tall) & (back.key[line] == g * tall + y)
        known = x < back.size[line]
        at = np.where(known, back.first[line] + x, 0)
        for alt in altitudes:
            dz = (alt - source)[pg]
            up = np.exp(-k * dz)
            z = columns.each(spec * (up / (1.0 + np.where(dz >= 0, 0.0, alpha) * k * k * up)), np.fft.ifft)
            yield there, back.each(z[back.order], np.fft.ifft).real[at], known
