"""LM scoring: deleted interpolation of n-gram estimates by context frequency.

Texts are tokenised once into chunks of some million tokens.  A chunk asks for its
distinct n-grams, in as many ranges of their hash as the input needs; each range adds
up the counts of all chunks and answers each chunk in the order it asked.  So an n-gram
that is everywhere is one entry per chunk, and what is shuffled grows with the distinct
n-grams of chunks instead of with tokens."""
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from aerofield.llm.common import crc_mod, pack, unpack, whole_texts, word_blocks
from aerofield.llm.quality import joined
from aerofield.session import materialized

ORDER = 2
CHUNK = 1 << 19  # tokens of a chunk, about; a task holds the arrays of one chunk
RANGE = 1 << 21  # tokens behind a range of n-gram hashes, about
FOLD = 8  # one in so many training documents is deleted to learn the weights
STEPS, SHIFT, TOP = 4, 120, 510  # ratio bins: 1 / STEPS of a doubling, around SHIFT
_END = xxhash.xxh64_intdigest(b"")  # no word is empty


# ---- chunks ----

class Builder:
    """Pieces of documents as local word numbers; word 0 is the end mark."""

    def __init__(self, deleted: bool, order: int):
        self.deleted, self.order = deleted, order
        self.clear()

    def clear(self):
        self.known, self.hashes = {b"": 0}, [_END]
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.pieces: list[list] = []  # [row, doc_id, held, size, lead]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        for w in dict.fromkeys(words):
            if w not in known:
                known[w] = len(known)
                self.hashes.append(xxhash.xxh64_intdigest(w))
        return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))

    def open(self, row: int, doc_id, held: bool, lead: list[bytes]):
        self.pieces.append([row, doc_id, held, 0, self.numbers(lead).tolist()])

    def add(self, words: list[bytes]):
        self.parts.append(self.numbers(words))
        self.n += len(words)
        self.pieces[-1][3] += len(words)

    def row(self, chunk: int) -> tuple:
        rows, ids, held, sizes, leads = zip(*self.pieces)
        return (chunk, self.deleted, list(rows), list(ids), list(held), list(sizes), [x for lead in leads for x in lead],
                np.array(self.hashes, "<u8").tobytes(), pack(np.concatenate(self.parts)))


_CHUNK = "chunk long, deleted boolean, rows array<long>, ids array<{}>, held array<boolean>, sizes array<int>, leads array<int>, words binary, tokens binary"


def chunker(order: int, kind: pa.DataType, size: int):
    types = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.binary(), pa.binary())
    names = [c.split()[0] for c in _CHUNK.split(", ")]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        builders = [Builder(False, order), Builder(True, order)]
        row, done = first, 0

        def told(b: Builder):
            nonlocal done
            done += 1
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(b.row(first + done), types)], names=names)
            b.clear()
            return out

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for doc_id, held, deleted, data in zip(*cols):
                b = builders[deleted]
                lead = [b""] * (order - 1)
                b.open(row, doc_id, held, lead)
                for words in word_blocks(data or b""):
                    if b.n > size:
                        yield told(b)
                        b.open(row, doc_id, held, lead)
                    b.add(words)
                    lead = (lead + words)[len(words):] if len(words) < order - 1 else words[len(words) - order + 1:]
                b.add([b""])
                row += 1
                if b.n > size:
                    yield told(b)
        for b in builders:
            if b.pieces:
                yield told(b)
    return chunks


@dataclass
class Grams:
    """The n-grams of a chunk: for each order its distinct keys in hash order, and the
    place of the n-gram that ends at each position (-1: cut off by the piece's start)."""
    keys: list[np.ndarray]
    at: list[np.ndarray]
    real: np.ndarray  # positions that are tokens of a piece and not its lead
    piece: np.ndarray  # piece of each token
    starts: np.ndarray  # first token of each piece


def grams(order: int, sizes: list[int], leads: list[int], words: bytes, tokens: bytes) -> Grams:
    size, ids = np.array(sizes, np.int64), unpack(tokens, "<u4")
    lead = np.array(leads, np.int64).reshape(len(size), order - 1)
    ends = np.cumsum(size + order - 1)
    inside = np.arange(ends[-1]) - np.repeat(ends - size - order + 1, size + order - 1)
    real = inside >= order - 1
    ext = np.empty(len(inside), np.int64)
    ext[real] = ids
    ext[~real] = lead.reshape(-1)
    h = np.frombuffer(words, "<u8")[ext]
    keys, at = [], []
    for o in range(1, order + 1):
        key = np.zeros(len(h), np.uint64)
        key[o - 1:] = joined(*[h[i:len(h) - o + 1 + i] for i in range(o)]) if o > 1 else h
        ok = inside >= o - 1
        distinct, place = np.unique(key[ok], return_inverse=True)
        where = np.full(len(h), -1, np.int64)
        where[ok] = place
        keys.append(distinct)
        at.append(where)
    return Grams(keys, at, real, np.repeat(np.arange(len(size)), size), np.cumsum(size) - size)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, as each holds a chunk."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def asker(order: int, ranges: int):
    """Requests (bucket, kind, chunk, keys, n): the chunk's distinct n-grams in a range of
    the hash, with its training counts (0 for documents held out)."""
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                g = grams(order, r["sizes"], r["leads"], r["words"], r["tokens"])
                train = ~np.array(r["held"], bool)[g.piece]
                out = []
                for o, (keys, at) in enumerate(zip(g.keys, g.at), 1):
                    n = np.bincount(at[g.real][train], minlength=len(keys)).astype("<u4")
                    bucket = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(ranges))), len(keys))
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                        out.append((int(bucket[a]), o, r["chunk"], r["deleted"], pack(gaps), pack(n[a:b])))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)],
                                                 names=["bucket", "kind", "chunk", "deleted", "keys", "n"])
    return asked


def _tally(rows: list[tuple]) -> Iterator[tuple]:
    """Answers to the requests of one range and order, and the range's sums."""
    keys = [np.cumsum(unpack(r[4], "<u8"), dtype=np.uint64) for r in rows]
    n = np.concatenate([unpack(r[5], "<u4") for r in rows]).astype(np.float64)
    lost = np.repeat([bool(r[3]) for r in rows], [len(k) for k in keys])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    whole, fold = np.bincount(place, n), np.bincount(place, n * lost)
    at = 0
    bucket, kind = rows[0][:2]
    yield (bucket, kind, -1, False, b"", b"",
           [int(x) for x in (whole.sum(), (whole > 0).sum(), (whole - fold).sum(), (whole > fold).sum())])
    for r, k in zip(rows, keys):
        own = place[at:at + len(k)]
        at += len(k)
        yield (bucket, kind, r[2], r[3], pack(whole[own].astype("<u4")), pack(fold[own].astype("<u4")), None)


_ANSWER = "bucket int, kind int, chunk long, deleted boolean, whole binary, fold binary, sums array<long>"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    names = [c.split()[0] for c in _ANSWER.split(", ")]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*_tally(rows)), kinds)], names=names)

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][:2] != row[:2]:
                yield told(held)
                held = []
            held.append(row)
    if held:
        yield told(held)


# ---- the model ----

@dataclass(frozen=True)
class Weights:
    """``mix[b, o]``: weight of order o (0: uniform) where the context was seen between
    2^(b - 1) and 2^b - 1 times (b = 0: never)."""
    mix: np.ndarray
    tokens: int
    words: int


def estimates(g: Grams, counts: list[np.ndarray], tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (order, token) and the class of the context's count.
    A context occurs as often as its own n-gram: every word is followed by another or by
    the end, and the end mark stands before each first word."""
    here = np.flatnonzero(g.real)
    p = np.zeros((len(counts), len(here)))
    p[0] = counts[0][g.at[0][here]] / max(tokens, 1)
    seen = np.full(len(here), tokens)
    for o in range(1, len(counts)):
        place = g.at[o - 1][here - 1]
        seen = np.where(place >= 0, counts[o - 1][place], 0)
        np.divide(counts[o][g.at[o][here]], seen, out=p[o], where=seen > 0)
    return p, np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))) + 1, 0).astype(np.int64)


def answers(order: int, parts: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A chunk's counts by order, whole and of the deleted fold, in the order of its keys."""
    out = []
    for name in ("whole", "fold"):
        out.append([np.concatenate([unpack(p[name], "<u4") for p in sorted((x for x in parts if x["kind"] == o), key=lambda x: x["bucket"])])
                    .astype(np.float64) for o in range(1, order + 1)])
    return out[0], out[1]


def ratios(order: int, tokens: int, words: int):
    """Counts of cells: context class, and each order's estimate over the uniform one in
    bins, for the deleted documents under the counts of all others."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                g = grams(order, r["sizes"], r["leads"], r["words"], r["tokens"])
                whole, fold = answers(order, r["parts"])
                p, cell = estimates(g, [a - b for a, b in zip(whole, fold)], tokens)
                for q in p:
                    with np.errstate(divide="ignore"):
                        bins = np.floor(STEPS * np.log2(q * (words + 1))) + SHIFT
                    cell = cell * (TOP + 1) + np.where(q > 0, np.clip(bins, 1, TOP), 0).astype(np.int64)
                cell, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])
    return cells


def learn(cells: np.ndarray, n: np.ndarray, order: int, classes: int = 64, rounds: int = 100) -> np.ndarray:
    """Mixture weights of each context class by expectation-maximisation on the cells.  A
    class without cells takes the next lower one's; all weights stay above zero."""
    r = np.ones((order + 1, len(cells)))
    rest = cells.copy()
    for o in range(order, 0, -1):
        rest, b = np.divmod(rest, TOP + 1)
        r[o] = np.where(b > 0, 2.0 ** ((b - SHIFT + 0.5) / STEPS), 0.0)
    mix = np.full((classes, order + 1), 1.0 / (order + 1))
    for c in range(classes):
        own = rest == c
        if own.any():
            w, x, m = np.full(order + 1, 1.0 / (order + 1)), r[:, own], n[own]
            for _ in range(rounds):
                part = w[:, None] * x
                w = (part / part.sum(axis=0) * m).sum(axis=1) + 1e-3
                w /= w.sum()
            mix[c] = w
        elif c:
            mix[c] = mix[c - 1]
    return mix


def scorer(order: int, weights: Weights, kind: pa.DataType):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                g = grams(order, r["sizes"], r["leads"], r["words"], r["tokens"])
                whole, _ = answers(order, r["parts"])
                p, cls = estimates(g, whole, weights.tokens)
                mix = weights.mix[cls]
                prob = mix[:, 0] / (weights.words + 1)
                for o, q in enumerate(p, 1):
                    prob += mix[:, o] * q
                if order > 1:  # a context never seen leaves its order's weight to the others
                    lost = (cls == 0) * mix[:, order]
                    prob /= 1 - np.minimum(lost, 1 - 1e-9)
                c = whole[0][g.at[0][g.real]]
                base = np.log10((c + 1) / (weights.tokens + weights.words + 1))
                add = lambda x: np.add.reduceat(x, g.starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["rows"]), pa.array(r["ids"], kind), pa.array(r["held"]), pa.array(r["sizes"], pa.int64()),
                     pa.array(add((c > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(np.log10(prob)))],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return scored


def scored(docs: DataFrame, held_out, deleted, order: int = ORDER, doc_id: str = "doc_id", text: str = "text",
           chunk: int = CHUNK, span: int = RANGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    ``held_out`` (a Column) marks documents that teach nothing; of the others ``deleted``
    marks those whose text the mixture weights are learned on, under the counts of the
    rest.  Scores use the counts of all training documents.  Null and empty texts are
    their end token alone; equal rows count each; without training tokens every token is
    unknown.  A text longer than a chunk goes on in the next one, context included."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    arrow, ddl = to_arrow_type(kind), kind.simpleString()
    flags = whole_texts(docs).select(F.col(doc_id).alias("doc_id"), held_out.alias("held"), (~held_out & deleted).alias("deleted"),
                        F.col(text).cast("binary").alias("text"))
    chunks = materialized(flags.mapInArrow(chunker(order, arrow, chunk), _CHUNK.format(ddl)), "chunks")
    tokens = chunks.select(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    ranges = max(1, math.ceil(tokens / span))
    asked = chunks.select("chunk", "deleted", "held", "sizes", "leads", "words", "tokens").mapInArrow(
        asker(order, ranges), "bucket int, kind int, chunk long, deleted boolean, keys binary, n binary")
    told = materialized(asked.repartition(ranges, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(counted, _ANSWER), "answers")
    n, v, rest = told.where("chunk < 0 AND kind = 1").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in (0, 1, 2)]).first()
    parts = told.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "whole", "fold")).alias("parts"))
    lost = chunks.where("deleted").select("chunk", "sizes", "leads", "words", "tokens").join(
        told.where("chunk >= 0 AND deleted").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "whole", "fold")).alias("parts")), "chunk")
    cells = lost.select("sizes", "leads", "words", "tokens", "parts").mapInArrow(ratios(order, rest, v), "cell long, n long").groupBy(
        "cell").agg(F.sum("n").alias("n")).toArrow()  # at most 64 * (TOP + 1) ** order cells
    mix = learn(cells["cell"].to_numpy(), cells["n"].to_numpy().astype(np.float64), order)
    weights = Weights(mix, n, v)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    pieces = chunks.join(parts, "chunk").select("rows", "ids", "held", "sizes", "leads", "words", "tokens", "parts").mapInArrow(
        scorer(order, weights, arrow), schema)
    return pieces.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def query(docs: DataFrame) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    deleted = crc_mod(F.concat(F.lit("fold:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), FOLD) == 0
    return scored(docs, held_out, deleted)
