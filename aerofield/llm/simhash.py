"""SimHash near-duplicates, candidates filtered by the pigeonring principle."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from aerofield.llm import blocks
from aerofield.llm.common import fresh, runs, whole_texts, word_blocks
from aerofield.llm.components import components
from aerofield.session import materialized

BITS, SEED = 64, 42


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    ones, total, carry = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in word_blocks(data or b""):
        words = carry + words
        if len(words) >= width:
            text = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[:len(words) - width + 1].tolist()
            hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], "<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            carry = words[len(words) - width + 1:]
        else:
            carry = words
    if not total:
        if not carry:
            return 0
        hashes = np.array([digest(b" ".join(carry), SEED)], "<u8")
        return int(hashes.view("<i8")[0])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprint_of(text: Column) -> Column:
    return _fingerprints(text.cast("binary"))


def segments(distance: int) -> list[tuple[int, int]]:
    """distance + 1 segments (shift, width) around the fingerprint's ring."""
    m = distance + 1
    edges = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cut(x: np.ndarray, seg: tuple[int, int]) -> np.ndarray:
    return (x >> np.uint64(seg[0])) & np.uint64((1 << seg[1]) - 1)


def chain_keys(distance: int):
    """Index keys of a fingerprint.  With m = distance + 1 segments, two fingerprints
    within ``distance`` have a start i on the ring from which any chain of l segments
    differs in at most floor(l * distance / m) = l - 1 bits.  So the start segment is
    equal and the next one differs in one bit at most: a key holds both, once as they
    are and once with each set bit of the second cleared.  Of two fingerprints that
    differ in that bit, the one that has it meets the other under the other's key."""
    segs = segments(distance)
    m = len(segs)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            start, key, own = [], [], []
            for i in range(m):
                a, nxt = _cut(fps, segs[i]), segs[(i + 1) % m]
                b = _cut(fps, nxt)
                base = a << np.uint64(nxt[1])
                forms = [(np.arange(len(fps)), b)]
                for p in range(nxt[1] if m > 1 else 0):
                    has = np.flatnonzero((b >> np.uint64(p)) & np.uint64(1))
                    forms.append((has, b[has] ^ np.uint64(1 << p)))
                for at, second in forms:
                    start.append(np.full(len(at), i, np.int32))
                    key.append((base[at] | second).view(np.int64))
                    own.append(fps[at].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(start)), pa.array(np.concatenate(key)), pa.array(np.concatenate(own))],
                names=["start", "key", "fp"])
    return keys


def within(x: np.ndarray, start: int, segs: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the differences ``x`` that keep every prefix of the chain from
    ``start`` within its budget; the last prefix is the whole Hamming distance."""
    alive, spent = np.arange(len(x)), np.zeros(len(x), np.int64)
    for step in range(len(segs)):
        spent = spent + np.bitwise_count(_cut(x[alive], segs[(start + step) % len(segs)]))
        ok = spent <= step
        alive, spent = alive[ok], spent[ok]
        if not len(alive):
            break
    return alive


def chain_edges(distance: int):
    """A spanning forest of the links in each block group: a linked fingerprint is
    absorbed once and then only asks those not absorbed yet."""
    segs = segments(distance)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in runs(batches, ["start", "key", "lo", "hi"]):
            left, right = [], []
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                fps, start = cols["fp"][a:b].view(np.uint64), int(cols["start"][a])
                rest, queue = np.arange(b - a), []
                while len(rest):
                    if queue:
                        pivot = queue.pop()
                    else:
                        pivot, rest = rest[0], rest[1:]
                    hit = within(fps[rest] ^ fps[pivot], start, segs)
                    if len(hit):
                        near = rest[hit]
                        left.append(np.full(len(near), fps[pivot]))
                        right.append(fps[near])
                        queue.extend(near.tolist())
                        rest = np.delete(rest, hit)
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(right).view(np.int64))], names=["a", "b"])
    return edges


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect whatever is
    connected by Hamming distances up to ``distance``."""
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    rows = fps.select("fp").mapInArrow(chain_keys(distance), "start int, key long, fp long")
    return blocks.met(rows, ["start", "key"], "fp").select("start", "key", "lo", "hi", "fp").mapInArrow(
        chain_edges(distance), "a long, b long")


def grouped(docs: DataFrame, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id (smallest doc_id
    reachable over links of fingerprints at ``distance`` bits or fewer) and first (the
    row that stands for its group).

    Equal fingerprints are one class, so exact copies cost one index entry however
    many there are.  Null and wordless texts have fingerprint 0 and link like any
    other.  A null doc_id joins its group but names it only if the group has no
    other (component_id is then null).  Of equal rows one is first."""
    rows = materialized(whole_texts(docs).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
        fingerprint_of(F.col(text)).alias("fp")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = materialized(rows.groupBy("fp").agg(F.min(order).alias("first")), "classes")
    roots = components(links(classes, distance))
    labelled = materialized(classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "labelled")
    named = materialized(labelled.groupBy("root").agg(F.min("first").alias("head")), "heads")
    heads = materialized(labelled.join(named, "root").select("fp", "head"), "members")
    return rows.join(heads, "fp").select(
        "doc_id", "text_hash", "fp", F.col("head.doc_id").alias("component_id"),
        (order == F.col("head")).alias("first"))


def deduplicated(docs: DataFrame, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest doc_id, and of
    rows that agree in id and text the first by a hash of all columns."""
    names = {n: fresh(docs.columns, f"kept_{n}") for n in ("id", "hash", "n", "rank")}
    keep = materialized(grouped(docs, distance, doc_id, text).where("first").groupBy(
        F.col("doc_id").alias(names["id"]), F.col("text_hash").alias(names["hash"])).agg(F.count("*").alias(names["n"])), "keep")
    rank = F.row_number().over(Window.partitionBy(F.col(doc_id), F.xxhash64(F.col(text))).orderBy(
        F.xxhash64(*[F.col(c) for c in docs.columns])))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(names["id"])) & (F.xxhash64(F.col(text)) == F.col(names["hash"]))

    def met(kept: DataFrame) -> DataFrame:  # the narrow side is hashed, so the texts are not sorted
        return docs.join(kept.hint("shuffle_hash"), same, "left_semi")

    rare = met(keep.where(F.col(names["n"]) > 1))
    return met(keep.where(F.col(names["n"]) == 1)).unionByName(
        rare.withColumn(names["rank"], rank).where(F.col(names["rank"]) == 1).drop(names["rank"]))


def query(docs: DataFrame) -> DataFrame:
    out = grouped(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
