"""Embedding near-duplicates: Euclidean p-stable hashing and exact cosine checks."""
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aerofield.llm import blocks
from aerofield.llm.common import runs
from aerofield.llm.components import components
from aerofield.session import materialized

WIDTH = 1.5  # of a quantised projection, for vectors of length 1
MISSED = 0.02  # share of the links right at the threshold that no table may show
CROWD = 256  # unrelated vectors that a bucket may hold on average
BLOCK = 1024


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that a quantised Gaussian projection is equal for two vectors."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float) -> tuple[int, int]:
    """(projections per table, tables) for n vectors: so many projections that unrelated
    (orthogonal) vectors crowd no bucket, and so many tables that a pair at the
    threshold shares a bucket with probability 1 - MISSED or more."""
    near, far = same_cell(math.sqrt(max(2 - 2 * cosine, 0.0))), same_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n / CROWD, 1.0)) / -math.log(far)))
    hit = near ** k
    return k, 1 if hit >= 1 else max(1, math.ceil(math.log(MISSED) / math.log(1 - hit)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hasher(k: int, tables: int, kind: str):
    """Rows (node, weight, vec) to their bucket in each table, as 32-bit mixes of the k
    cells.  Projections depend on the dimension alone."""
    known: dict[int, tuple] = {}

    def plan(dim: int):
        if dim not in known:
            draw = np.random.default_rng([dim, k, tables])
            known[dim] = (draw.standard_normal((dim, tables * k)), draw.uniform(0, WIDTH, tables * k),
                          draw.integers(1, 1 << 63, (tables, k), dtype=np.uint64) | np.uint64(1))
        return known[dim]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.asarray(vecs.offsets)
            dims = np.diff(ends)
            flat, ends = np.ascontiguousarray(flat, kind), ends - ends[0]
            keys = np.zeros((len(dims), tables), np.int32)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                a, b, odd = plan(int(dim))
                x = unit(np.stack([flat[ends[i]:ends[i + 1]] for i in own]))
                cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(own), tables, k)
                mixed = (cells * odd).sum(axis=2, dtype=np.uint64)
                keys[own] = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims.astype(np.int32)),
                 pa.array([flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary()),
                 pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int32()))],
                names=["node", "weight", "dim", "vec", "sig", "buckets"])
    return hashed


def linker(cosine: float, kind: str):
    """Links of each block group: for every linked node the rows it is linked to there,
    and a node that stands for its connected part of the group.  A pair counts only in
    the first table that its two vectors share."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in runs(batches, ["dim", "tbl", "bucket", "lo", "hi"]):
            out: list[tuple] = []
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                dim, t, lo, hi = (int(cols[c][a]) for c in ("dim", "tbl", "lo", "hi"))
                x = unit(np.frombuffer(b"".join(cols["vec"][a:b]), kind).reshape(-1, dim))
                sig = np.frombuffer(b"".join(cols["sig"][a:b]), np.int32).reshape(b - a, -1)
                part = cols["part"][a:b]
                left, right = (np.flatnonzero(part == lo), np.flatnonzero(part == hi))
                on = x[left] @ x[right].T >= cosine
                if lo == hi:
                    np.fill_diagonal(on, False)
                i, j = np.nonzero(on)
                if t:
                    new = ~(sig[left[i], :t] == sig[right[j], :t]).any(axis=1)
                    i, j = i[new], j[new]
                if not len(i):
                    continue
                i, j = left[i], right[j]
                if lo != hi:
                    i, j = np.concatenate([i, j]), np.concatenate([j, i])
                node, weight = cols["node"][a:b], cols["weight"][a:b]
                count = np.bincount(i, weight[j], b - a).astype(np.int64)
                label = np.arange(b - a)
                while True:
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                hit = np.flatnonzero(count)
                out.append((node[hit], count[hit], node[label[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "links", "root"])
    return link


def linked(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    Equal vectors are one class, so copies cost one index entry.  Candidates are pairs
    that share a bucket in some table (at the threshold all but MISSED of them, above it
    nearly all); a pair links if its cosine in double precision is at least ``cosine``.
    Buckets of any size are met in blocks, and a block returns counts and a star for
    each connected part, never its pairs.

    Null, empty and zero vectors and those with null or non-finite components link with
    nothing; vectors of different dimension are not compared.  Repeated rows are copies
    of each other.  Rows with a null vec_id link and count, but name no component."""
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"
    cast = "array<float>" if kind == "<f4" else "array<double>"
    ok = F.expr("size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vec, x -> x <> 0)")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(cast).alias("vec")).withColumn(
        "ok", F.coalesce(ok, F.lit(False)))
    classes = materialized(
        rows.where("ok").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    k, tables = shape(classes.count(), cosine)
    hashed = materialized(classes.select("node", "weight", "vec").mapInArrow(
        hasher(k, tables, kind), "node long, weight long, dim int, vec binary, sig binary, buckets array<int>"), "hashed")
    members = hashed.select("node", "dim", F.posexplode("buckets").alias("tbl", "bucket"))
    groups = blocks.met(members, ["dim", "tbl", "bucket"], "node", BLOCK, hashed.select("node", "weight", "vec", "sig"))
    found = materialized(groups.select("dim", "tbl", "bucket", "lo", "hi", "part", "node", "weight", "vec", "sig").mapInArrow(
        linker(cosine, kind), "node long, links long, root long"), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
    labelled = materialized(
        classes.join(roots, "node", "left").join(counts, F.col("node") == F.col("counted"), "left")
        .select("vec", "first", F.coalesce("root", "node").alias("root"),
                (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "labelled")
    names = materialized(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    told = materialized(labelled.join(names, "root").select("vec", "n_links", "component_id"), "told")
    same = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.where("ok").select("vec_id", "vec").join(told, "vec").select("vec_id", "n_links", "component_id", same).unionByName(
        rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
