"""Tokens of two vocabularies aligned by the bytes they cover.

A text falls into units at blanks and line ends where both vocabularies begin a token; a
unit is aligned once and kept.  Both encode the new units; the ends of the tokens, in
bytes, go into one dictionary for each side, from end to index; the ends that both have,
sorted, cut both lists into groups.  Inside a group tokens are linked where their bytes
overlap.

How often two ids are linked in the whole corpus is asked for by chunks of documents: a
chunk holds each of its pairs once, so a pair that is in every document is one row a chunk."""
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from aerofield.llm import pieces
from aerofield.llm.common import pack, unpack, whole_texts
from aerofield.llm.tokens import _spread
from aerofield.session import materialized

BYTES = "byte_bpe_50k.json"
CHUNK = 1 << 19  # pairs of documents in a chunk, about, but for a longer document
_UNIT = re.compile(r"[ \n]+[^ \n]*|[^ \n]+")
_OTHER = re.compile(r"[^\S \n]")  # white space that a run of blanks may go on from
_CUT = re.compile(r"(?<=[!-~])(?=[ \n])")


def printable() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that is printable
    and no blank, the others in turn as the characters from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteVocabulary:
    """A byte-level BPE vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        names, byte = self.coder.get_vocab(), printable()
        self.spelled = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.spelled[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()

    def encode(self, texts: list[str]) -> np.ndarray:
        """Ids of the texts in turn."""
        return np.concatenate([np.array(g.ids, "<u4") for g in self.coder.encode_batch_fast(texts, add_special_tokens=False)])


@functools.cache
def numerals(n: int) -> list[str]:
    """Decimal ids with what may follow them; id i followed by the k-th mark is at 3 i + k."""
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


def units(text: str) -> Iterator[list[str]]:
    """Units of a text with its leading blank, a block at a time.  A blank or line end after
    a character that is no white space begins a token for both vocabularies: the one ends
    its words there, the other has blanks in front of pieces only and no line end in a
    longer one."""
    if _OTHER.search(text):
        yield _CUT.split(text)
    elif len(text) <= pieces.BLOCK:
        yield _UNIT.findall(text)
    else:
        found = _UNIT.finditer(text)
        while some := [m.group() for m in itertools.islice(found, pieces.BLOCK >> 3)]:
            yield some


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each side up to the end of each group."""
    at_a, at_b = ({end: i for i, end in enumerate(ends.tolist(), 1)} for ends in (ends_a, ends_b))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.array(list(map(at.__getitem__, common)), np.int64) for at in (at_a, at_b))


def links(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked tokens, group by group.  In a group with one token on a side
    this is linked with all of the other; else each stretch between two neighbouring ends
    of either side links the two tokens around it."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    plain = (n_a == 1) | (n_b == 1)
    times = np.where(plain, np.maximum(n_a, n_b), 0)
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    one_a, one_b = np.repeat(n_a == 1, times), np.repeat(n_b == 1, times)
    a = np.repeat(cut_a - n_a, times) + np.where(one_a, 0, inside)
    b = np.repeat(cut_b - n_b, times) + np.where(one_b, 0, inside)
    if not plain.all():
        in_a, in_b = np.repeat(~plain, n_a), np.repeat(~plain, n_b)
        ends = np.sort(np.concatenate([ends_a[in_a], ends_b[in_b]]), kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]
        a = np.append(a, np.searchsorted(ends_a, ends))
        b = np.append(b, np.searchsorted(ends_b, ends))
    return a, b


def marked(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``numerals`` that write the groups as ``a1,a2|b1;a3|b2,b3;``, and how many
    places they take up to the end of each group."""
    n_a, n_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    out = np.empty(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + np.repeat(cut_b - n_b, n_a)
    place_b = np.arange(len(b)) + np.repeat(cut_a, n_b)
    out[place_a], out[place_b] = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
    out[place_a[cut_a - 1]] += 1
    out[place_b[cut_b - 1]] += 2
    return out, cut_a + cut_b


class Aligner:
    """Aligned units of a Python worker, emptied when full; that changes no result."""

    def __init__(self, byte_path: str, piece_path: str, most: int = 300_000):
        self.a, self.b, self.most = ByteVocabulary(byte_path), pieces.Vocabulary(piece_path), most
        if self.b.pattern.findall("a\na") != ["a", "\n", "a"]:
            raise ValueError("a line end must be in no longer piece")
        self.lengths = [np.array([len(x) for x in v.spelled], np.int64) for v in (self.a, self.b)]
        self.names = numerals(max(map(len, self.lengths)))
        self._empty()

    def _empty(self):
        self.known: dict[str, int] = {}
        self.said: list[str] = []  # the written groups of a unit
        self.counts = [np.zeros((0, 5), np.int64)]  # n_a, n_b, n_groups, n_links, and whether ids fail to spell it
        self.pairs = [np.zeros(0, np.int64)]
        self.ready = None

    def numbers(self, some: list[str]) -> np.ndarray:
        """Places of units in the store; those of an earlier call hold no more."""
        at = np.fromiter(map(self.known.get, some, itertools.repeat(-1)), np.int64, len(some))
        lost = np.flatnonzero(at < 0)
        if len(lost):
            if len(self.known) > self.most:
                self._empty()
                lost = np.arange(len(some))
            missing = list(map(some.__getitem__, lost.tolist()))
            new = list(dict.fromkeys(missing))
            self._learn([u for u in new if not u[-1].isspace()])
            for unit in new:
                if unit[-1].isspace():
                    self._learn([unit])
            at[lost] = list(map(self.known.__getitem__, missing))
        return at

    def _learn(self, some: list[str]):
        """Align new units laid end to end.  Every unit begins with a blank or line end, so
        where one ends in no white space both sides end a token."""
        if not some:
            return
        packs = ["".join(some[i:i + 512]) for i in range(0, len(some), 512)]
        a = self.a.encode(packs)
        b, _ = self.b.encode(list(itertools.chain.from_iterable(map(self.b.pattern.findall, packs))))
        text = "".join(packs).encode("utf-8", "surrogatepass")
        if any(b"".join(map(v.spelled.__getitem__, ids.tolist())) != text for v, ids in ((self.a, a), (self.b, b))):
            if len(some) == 1:
                self._keep(some, [""], np.array([[0, 0, 0, 0, 1]]), np.zeros(0, np.int64))
            else:
                self._learn(some[:len(some) // 2])
                self._learn(some[len(some) // 2:])
            return
        ends_a, ends_b = (np.cumsum(length[ids]) for length, ids in zip(self.lengths, (a, b)))
        cut_a, cut_b = groups(ends_a, ends_b)
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)))
        last = np.searchsorted(ends_a[cut_a - 1], ends)  # the group that ends each unit
        i, j = links(ends_a, ends_b, cut_a, cut_b)
        unit = np.repeat(np.arange(len(some)), np.diff(cut_a[last], prepend=0))[i]
        order = np.argsort(unit, kind="stable")
        counts = np.zeros((len(some), 5), np.int64)
        for k, upto in enumerate((cut_a[last], cut_b[last], last + 1)):
            counts[:, k] = np.diff(upto, prepend=0)
        counts[:, 3] = np.bincount(unit, minlength=len(some))
        codes, upto = marked(a, b, cut_a, cut_b)
        texts, stops = list(map(self.names.__getitem__, codes.tolist())), upto[last].tolist()
        self._keep(some, ["".join(texts[x:y])[:-1] for x, y in zip([0, *stops], stops)], counts, (b[j].astype(np.int64) << 32 | a[i])[order])

    def _keep(self, some: list[str], said: list[str], counts: np.ndarray, pairs: np.ndarray):
        self.known.update(zip(some, range(len(self.said), len(self.said) + len(some))))
        self.said += said
        self.counts.append(counts)
        self.pairs.append(pairs)
        self.ready = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the units, the links of all, and where each unit's begin."""
        if self.ready is None:
            self.counts, self.pairs = ([np.concatenate(x)] for x in (self.counts, self.pairs))
            self.ready = (self.counts[0], self.pairs[0], np.cumsum(self.counts[0][:, 3]) - self.counts[0][:, 3])
        return self.ready

    def part(self, at: np.ndarray) -> tuple:
        """Counts, written groups and linked pairs with their numbers of units of one text."""
        counts, pairs, starts = self.tables()
        own, times = np.unique(at, return_counts=True)
        size = counts[own, 3]
        return (times @ counts[own], ";".join(map(self.said.__getitem__, at.tolist())),
                pairs[_spread(starts[own], size)], np.repeat(times, size))

    def texts(self, texts: list[str | None]) -> list[tuple]:
        """For each text n_a, n_b, n_groups, n_links, groups, and the distinct linked pairs (id
        of B, id of A in 64 bits) with how often each is linked."""
        fit = [" " + t if t and pieces.SPACE not in t else "" for t in texts]  # B writes a blank as that mark
        short = [next(units(t)) if t and len(t) <= pieces.BLOCK else [] for t in fit]
        at = self.numbers(list(itertools.chain.from_iterable(short)))  # of all texts at once
        ends = np.cumsum([0, *map(len, short)])
        out = [told([self.part(at[i:j])] if j > i else []) for i, j in zip(ends[:-1], ends[1:])]
        for k, text in enumerate(fit):
            if text and not short[k]:
                out[k] = told([self.part(self.numbers(some)) for some in units(text)])
        return out


def told(parts: list[tuple]) -> tuple:
    """The parts of one text as one."""
    if not parts or sum(p[0][4] for p in parts):
        return (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    n, said, pairs, times = zip(*parts)
    keys, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return (*sum(n)[:4].tolist(), ";".join(said), keys, np.bincount(place, np.concatenate(times), len(keys)).astype(np.int64))


@functools.cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each Python worker and pair of vocabularies."""
    return Aligner(byte_path, piece_path)


def aligned(docs: DataFrame, text: str = "text", byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """``docs`` without its texts, with n_a, n_b, n_groups, n_links, groups (the ids of A and
    B by group: ``a1,a2|b1;a3|b2,b3``), pairs (distinct linked ids, B's in the upper 32
    bits and A's in the lower) and times (how often each is linked in the text).

    A is the byte-level vocabulary with a blank in front of the text, B the SentencePiece
    vocabulary, which puts it there.  Null and empty texts, and those that either side's
    tokens do not spell, have no tokens: zeros, an empty ``groups`` and no pairs.  Equal
    rows stay; columns of these names in ``docs`` are an error.  A long text is aligned a
    block at a time; memory goes with its tokens."""
    run, schema = _alignment(docs, text, byte_path, piece_path)
    return whole_texts(docs).mapInArrow(run, schema)


def _alignment(docs: DataFrame, text: str, byte_path: str | None, piece_path: str | None):
    """What ``aligned`` does to the batches of a task, and its schema."""
    import public_tokenizers

    byte_path, piece_path = byte_path or public_tokenizers.path(BYTES), piece_path or pieces.model_path()
    made = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    if set(made) & set(docs.columns):
        raise ValueError(f"{sorted(set(made) & set(docs.columns))} are columns already")
    where = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != where]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema.fields[i] for i in kept] + [T.StructField(m, T.LongType()) for m in made[:4]] + [
        T.StructField("groups", T.StringType()), T.StructField("pairs", longs), T.StructField("times", longs)])

    def lists(values) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path)
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, 256):  # the groups of many long texts at once would fill a worker
                part = batch.slice(lo, 256)
                found = list(zip(*both.texts(part.column(where).to_pylist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in kept] + [pa.array(f, pa.int64()) for f in found[:4]]
                    + [pa.array(found[4], pa.string()), lists(found[5]), lists(found[6])], names=schema.names)
    return run, schema


# ---- counts of the corpus ----

_CHUNK = "chunk long, ids array<{}>, counts binary, digests array<string>, keys binary, at binary, times binary"


def chunker(kind: pa.DataType, size: int):
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    kinds = [pa.int64(), pa.list_(kind), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        n = 0

        def told() -> pa.RecordBatch:
            cols = {name: [b.column(i) for b in held] for i, name in enumerate(held[0].schema.names)}
            flat = lambda name: np.concatenate([c.flatten().to_numpy() for c in cols[name]])
            keys, at = np.unique(flat("pairs"), return_inverse=True)
            counts = np.stack([np.concatenate([c.to_numpy() for c in cols[k]]) for k in ("n_a", "n_b", "n_groups", "n_links")]
                              + [np.concatenate([np.asarray(c.value_lengths()) for c in cols["pairs"]])], axis=1)
            values = [first + done, *[[x for c in cols[k] for x in c.to_pylist()] for k in ("doc_id", "digest")],
                      pack(counts.astype("<i8").reshape(-1)), pack(np.diff(keys, prepend=0)), pack(at.astype("<u4")), pack(flat("times"))]
            values = [values[i] for i in (0, 1, 3, 2, 4, 5, 6)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                held.append(part)
                n += len(part.column(part.schema.get_field_index("pairs")).flatten())
                if n > size:
                    yield told()
                    done, n = done + 1, 0
                    held.clear()
        if held:
            yield told()
    return chunks


def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's pairs and how often they are linked in it."""
    for batch in batches:
        for chunk, *rest in zip(*[c.to_pylist() for c in batch.columns]):
            keys, at, times = map(unpack, rest, ("<i8", "<u4", "<i8"))
            keys = np.cumsum(keys)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(keys), chunk)), pa.array(keys),
                pa.array(np.bincount(at, times, len(keys)).astype(np.int64))], names=["chunk", "pair", "n"])


def summed(schema: T.StructType, kind: pa.DataType):
    """Rows of a chunk's documents from the chunk and the corpus counts of its pairs."""
    def rows(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        counts = unpack(row["counts"], "<i8").reshape(-1, 5)
        at, times = unpack(row["at"], "<u4"), unpack(row["times"], "<i8")
        order = np.argsort(told.column("pair").to_numpy())
        best, count = (told.column(c).to_numpy()[order] for c in ("best", "count"))
        ends = np.cumsum(counts[:, 4])
        both = []
        for value in (times * best[at], times * count[at]) if len(at) else ():
            run = np.append(0, np.cumsum(value))
            both.append(run[ends] - run[ends - counts[:, 4]])
        both = both or [np.zeros(len(counts), np.int64)] * 2
        return pa.table([pa.array(row["ids"], kind), *[pa.array(counts[:, i]) for i in range(4)], *map(pa.array, both),
                         pa.array(row["digests"], pa.string())], names=schema.names)
    return rows


def linked(rows: DataFrame, doc_id: str = "doc_id", digest: str = "groups_sha256", chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``rows`` (of ``aligned``, with a short text ``digest`` that is
    kept): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest.

    A pair's count is how often it is linked in all rows.  ``n_best`` counts a row's links
    whose count is the highest of all pairs with their id of B, ``count_sum`` adds up the
    counts of its links.  A null doc_id stays one; rows without pairs have zeros; without
    rows there is none."""
    kind = rows.schema[doc_id].dataType
    chunks = rows.select(F.col(doc_id).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.col(digest).alias("digest"), "pairs", "times").mapInArrow(
        chunker(to_arrow_type(kind), chunk), _CHUNK.format(kind.simpleString()))
    return _counted(materialized(chunks, "chunks"), kind, digest)


def _counted(chunks: DataFrame, kind: T.DataType, digest: str) -> DataFrame:
    """``linked`` from stored chunks."""
    arrow = to_arrow_type(kind)
    asked = chunks.where("length(keys) > 0").select("chunk", "keys", "at", "times").mapInArrow(exploded, "chunk long, pair long, n long")
    counts = materialized(asked.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    by_b = F.shiftright("pair", 32)
    most = counts.groupBy(by_b.alias("b")).agg(F.max("count").alias("most"))  # as many rows as B has ids at most
    told = asked.select("chunk", "pair").join(
        counts.join(F.broadcast(most), by_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")), "pair")
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField(digest, T.StringType())])
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(summed(schema, arrow), schema)


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``aligned`` with the SHA-256 of their groups (none: empty) in their place."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("groups")).to_pylist()
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name != "groups"}
        cols["digest"] = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def query(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``linked`` of ``aligned``.  A task aligns and chunks its rows in one Python worker: were
    there one for each, workers would change places from task to task, and all of an
    executor's would come to hold vocabularies and units."""
    rows = docs.select("doc_id", "text")
    run, _ = _alignment(rows, "text", None, None)
    kind = rows.schema["doc_id"].dataType
    chunks = chunker(to_arrow_type(kind), chunk)
    held = whole_texts(rows).mapInArrow(lambda batches: chunks(digested(run(batches))), _CHUNK.format(kind.simpleString()))
    return _counted(materialized(held, "chunks"), kind, "groups_sha256")
