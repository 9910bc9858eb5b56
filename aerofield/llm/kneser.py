"""Modified Kneser-Ney scores under the n-grams of all good documents.

Texts are tokenised once into chunks.  For trigrams, then pairs, then words, a chunk asks
for its distinct n-grams in ranges of their hash, with what it adds to their sums; a range
adds up all chunks' and answers each in the order it asked.  One chunk owns each n-gram
of the model and passes it on to the pairs or words it counts for, so an n-gram that is
everywhere is one entry per chunk.

Requests of an order are as large as the texts.  The ranges are worked off in some passes,
each of which sends, answers and sweeps away its own requests, and the chunks are stored
in buckets, so that answers are dealt to them and they are never dealt themselves.

The documents are dealt to two sides, and a text is scored by the good documents of the
other side.  Texts that share two of their smallest shingle hashes are on one side, with
all that are linked to them in this way, so neither a text nor a near copy
of it is judged by a model that has seen it."""
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from aerofield.llm import quality
from aerofield.llm.common import pack, swept, unpack, whole_texts
from aerofield.llm.components import components
from aerofield.session import bucketed, materialized, passing, small

CHUNK = 1 << 20  # tokens of a chunk, about, but for a longer text
RANGE = 3 << 19  # tokens behind a range of n-gram hashes, at most about
TOGETHER = 4  # ranges of a task, which adds them up one after the other
KEY = 40  # bits of a key inside a range: of the range's n-grams, one in 2 ** 20 shares its key with another, about
WORD = 48  # bits of a word's hash that chunks keep: of 2 ** 28 distinct words, one in 2 ** 20 shares its hash with another, about
PASSES = {3: 2, 2: 4, 1: 3}  # passes over the ranges of an order, at most
SCORED = 4  # parts of the chunks that are scored one after the other
BITS = 16  # ways to deal the families to two sides, of which the evenest is taken
WIDE = {3: 1, 2: 5, 1: 5}  # sums of an n-gram: as context the total and the n-grams seen 1, 2 and more times; last its own count
NONE = np.iinfo(np.int64).max
_WORD = np.uint64((1 << WORD) - 1)


def batch_of(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as each holds a chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def packed(a: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(a).reshape(-1)) if a.size else b""


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return unpack(data, kind) if data else np.zeros(0, kind)


def narrow(a: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, which the first byte tells."""
    flat = np.ascontiguousarray(a).reshape(-1)
    kind = np.min_scalar_type(int(flat.max())) if flat.size else np.dtype("u1")
    return bytes([kind.itemsize]) + packed(flat.astype(kind))


def widened(data: bytes) -> np.ndarray:
    return unpacked(data[1:], f"<u{data[0]}")


def by_value(n: np.ndarray) -> np.ndarray:
    """The stable order of counts, quick where they are small."""
    return np.argsort(n.astype(np.min_scalar_type(int(n.max(initial=0)))), kind="stable")


def columns(sums: np.ndarray) -> bytes:
    """Sums of n-grams, one column after the other, the last one first.  What the n-grams
    seen 1, 2 and more times give at least is taken off the total, which leaves little of
    it, and all are in the order of the last column, which they go with: most are 0 with it."""
    cols = sums.T[::-1].copy()
    if len(cols) > 1:
        cols[4] -= cols[3] + 2 * cols[2] + 3 * cols[1]
        cols[1:] = cols[1:, by_value(cols[0])]
    return narrow(cols)


def sums_of(data: bytes, order: int) -> np.ndarray:
    """What ``columns`` packed, as a row per column."""
    cols = widened(data).astype(np.int64).reshape(WIDE[order], -1)
    if len(cols) > 1:
        back = np.empty_like(cols[1:])
        back[:, by_value(cols[0])] = cols[1:]
        cols[1:] = back
        cols[4] += cols[3] + 2 * cols[2] + 3 * cols[1]
    return cols[::-1]


def ranked(h: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct hashes, the commonest first, and each hash's place among them: places of
    common words are small numbers, which pack well.  Equally common ones are in order of
    the hash, so that their gaps pack."""
    words, at, n = np.unique(h >> np.uint64(64 - WORD), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return packed(np.diff(words[order], prepend=np.uint64(0)) & _WORD), narrow(place[at])


def hashes_of(words: bytes) -> np.ndarray:
    """The distinct hashes that ``ranked`` stored."""
    return np.cumsum(unpacked(words, "<u8"), dtype=np.uint64) & _WORD


def distinct(keys: np.ndarray) -> np.ndarray:
    """A position of each distinct key, in the order of the keys."""
    order = np.argsort(keys)
    rank = keys[order]
    return order[np.append(True, rank[1:] != rank[:-1])[:len(rank)]]


# ---- chunks ----

_CHUNK = "chunk long, ids array<{}>, langs array<string>, good array<boolean>, out array<boolean>, stats binary, marks binary, words binary, tokens binary"


def chunker(kind: pa.DataType, size: int):
    fields = list(zip([c.split()[0] for c in _CHUNK.split(", ")], [
        pa.int64(), pa.list_(kind), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), *[pa.binary()] * 4]))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, hashes = TaskContext.get().partitionId() << 32, 0, quality.Hashes()
        held: list[tuple] = []
        tokens = 0

        def told() -> pa.RecordBatch:
            ids, langs, good, out, stats, marks, texts = zip(*held)
            return batch_of([(first + done, list(ids), list(langs), list(good), list(out), packed(np.array(stats, "<i8")),
                              packed(np.concatenate(marks)), *ranked(np.concatenate(texts)))], fields)

        for batch in batches:
            for doc_id, lang, data, good, out in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                data = data or b""
                h = quality.word_hashes(data, hashes)
                marks = np.full(quality.SKETCH, NONE, "<i8")
                own = quality.sketch(h).view(np.int64)
                marks[:len(own)] = own
                counts = quality.base_counts(data, h)
                held.append((doc_id, lang, bool(good) and counts[0] >= quality.MIN_WORDS, out, counts, marks, h))
                tokens += len(h)
                if tokens > size:
                    yield told()
                    done, tokens = done + 1, 0
                    held.clear()
        if held:
            yield told()
    return chunks


# ---- sides ----

def nodes(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's sketches, and a number for each."""
    marks = unpacked(r["marks"], "<i8").reshape(-1, quality.SKETCH)
    return marks, quality.joined(*marks.view(np.uint64).T).view(np.int64)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct sketches and their hashes."""
    for r in each(batches):
        marks, node = nodes(r)
        node, first = np.unique(node, return_index=True)
        some = marks[first] != NONE
        own = np.repeat(node, some.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), r["chunk"], np.int64)), pa.array(own), pa.array(marks[first][some])],
                                         names=["chunk", "node", "mark"])


def families(marks: DataFrame, stored: Callable[[DataFrame, str], DataFrame] = materialized) -> DataFrame:
    """``node, label`` of the sketches that share two hashes with another: the smallest
    node of their connected component."""
    def shared(rows: DataFrame) -> DataFrame:
        both = rows.groupBy("mark").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
        return rows.join(small(both.select("mark")), "mark")

    pairs = shared(marks).groupBy("node").agg(F.array_sort(F.collect_set("mark")).alias("m")).select("node", F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x, y))))")).alias("mark"))
    edges = stored(shared(stored(pairs, "pairs")).select("node", F.xxhash64("mark").alias("mark")), "shared")
    least = small(edges.groupBy("mark").agg(F.min("node").alias("least")))
    tied = components(edges.join(least, "mark").select(F.col("node").alias("a"), F.col("least").alias("b")))
    return tied.select("node", F.col("root").alias("label"))


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The family of each text of a chunk as random bits, and the good words behind each bit."""
    for r in each(batches):
        _, node = nodes(r)
        keys, label = (np.array([x[k] for x in r["linked"] or []], np.int64) for k in ("node", "label"))
        order = np.argsort(keys)
        at = quality.find(keys[order], node)
        family = quality.mix(np.where(at >= 0, np.append(label[order], 0)[at], node).view(np.uint64))
        words = unpacked(r["stats"], "<i8").reshape(-1, 5)[:, 0]
        n = words * np.array(r["good"], bool)
        bits = (family[:, None] >> np.arange(8, 8 + BITS, dtype=np.uint64)) & np.uint64(1)
        yield batch_of([(r["chunk"], packed(family), (bits.astype(np.int64) * n[:, None]).sum(axis=0).tolist(), int(n.sum()), int(words.sum()))], [
            ("chunk", pa.int64()), ("families", pa.binary()), ("ones", pa.list_(pa.int64())), ("n_good", pa.int64()), ("n_all", pa.int64())])


def chosen(bit: int):
    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each(batches):
            side = (unpacked(r["families"], "<u8") >> np.uint64(8 + bit)) & np.uint64(1)
            yield batch_of([(r["chunk"], np.packbits(side.astype(bool)).tobytes())], [("chunk", pa.int64()), ("sides", pa.binary())])
    return sides


# ---- n-grams of a side of a chunk ----

class Chunk:
    """A chunk's tokens, unpacked once for both sides."""

    def __init__(self, r: dict):
        sizes = unpacked(r["stats"], "<i8").reshape(-1, 5)[:, 0]
        self.sides = np.unpackbits(np.frombuffer(r["sides"], np.uint8))[:len(sizes)]
        self.doc, self.starts = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.cumsum(sizes) - sizes
        self.table, self.place = hashes_of(r["words"]), widened(r["tokens"])
        self.good = np.array(r["good"], bool)


class Part:
    """The tokens of a chunk's documents on one side, their n-grams, and which teach."""

    def __init__(self, chunk: "Chunk", side: int, bits: int):
        """``bits``: as many bits of a hash tell its range."""
        self.cut, self.table = np.uint64(64 - KEY - bits), chunk.table
        here = np.flatnonzero(chunk.sides[chunk.doc] == side)
        self.docs, self.doc, self.place = np.flatnonzero(chunk.sides == side), chunk.doc[here], chunk.place[here]
        self.first = here == chunk.starts[self.doc]
        self.c = self.table[self.place]
        self.b, self.a = np.zeros_like(self.c), np.zeros_like(self.c)  # before the text: the start mark, hash 0
        self.b[1:] = self.c[:-1]
        self.b[self.first] = 0
        self.a[1:] = self.b[:-1]
        self.a[self.first] = 0
        self.good = chunk.good[self.doc]

    def keys(self, order: int) -> np.ndarray:
        return self.short(quality.joined(*(self.a, self.b, self.c)[3 - order:]))

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> self.cut

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct keys of words and of the start mark, and the places among them of
        the tokens before each token and of the tokens."""
        key, start = self.short(quality.joined(self.table)), self.short(quality.joined(np.zeros(1, np.uint64)))
        here = np.zeros(len(key), bool)
        here[self.place] = True
        keys = np.append(key[here], start)
        keys = keys[distinct(keys)]
        own = np.searchsorted(keys, key).astype(np.int32)[self.place]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.first] = np.searchsorted(keys, start)[0]
        return keys, before, own

    def asked(self, order: int, given: np.ndarray | None, ranges: range) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys in ``ranges`` and what the chunk adds to their sums; ``given`` are
        the model's counts of the next longer n-grams of all ranges, at those that this
        part owns."""
        low, high = (np.uint64(x << KEY) for x in (ranges.start, ranges.stop - 1))
        high |= np.uint64((1 << KEY) - 1)
        if order > 1:
            key = self.keys(order)
            ours = (key >= low) & (key <= high)
            keys, place = np.unique(key[ours], return_inverse=True)
            if order == 3:
                return keys, np.bincount(place[self.good[ours]], minlength=len(keys))[:, None]
            at = np.full(len(key), -1, np.int32)
            at[ours] = place
        teach = np.flatnonzero(given)
        first, n = distinct(self.keys(order + 1))[teach], given[teach]
        if order == 2:
            inner = ~self.first[first]  # the first word has no pair before it
            context, last, m = at[first[inner] - 1], at[first], n[inner]
        else:
            keys, before, own = self.words()
            cut = np.searchsorted(keys, low)
            keys = keys[cut:np.searchsorted(keys, high, "right")]
            context, last, m = before[first] - cut, own[first] - cut, n
        known = (context >= 0) & (context < len(keys))
        context, m, last = context[known], m[known], last[(last >= 0) & (last < len(keys))]
        size = len(keys)
        return keys, np.stack([np.bincount(context, m, size).astype(np.int64), *(np.bincount(context[k], minlength=size) for k in (m == 1, m == 2, m > 2)),
                               np.bincount(last, minlength=size)], axis=1)


def parts_of(answers: list[dict] | None, order: int, side: int) -> np.ndarray:
    own = sorted((x for x in answers or [] if x["kind"] == order and x["side"] == side), key=lambda x: x["bucket"])
    return np.concatenate([widened(x["own"]) for x in own] or [np.zeros(0, np.uint8)])


def others_of(answers: list[dict] | None, order: int, side: int) -> np.ndarray:
    other = sorted((x for x in answers or [] if x["kind"] == order and x["side"] == side), key=lambda x: x["bucket"])
    return np.concatenate([sums_of(x["other"], order) for x in other] or [np.zeros((WIDE[order], 0), np.int64)], axis=1)


_ASKED = [("bucket", pa.int32()), ("chunk", pa.int64()), ("side", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())]
_TOLD = [("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("side", pa.int32()), ("other", pa.binary()), ("own", pa.binary()), ("sums", pa.list_(pa.int64()))]
ASKED = "bucket int, chunk long, side int, keys binary, n binary"
TOLD = "bucket int, kind int, chunk long, side int, other binary, own binary, sums array<long>"


def asker(order: int, bits: int, ranges: range):
    """Requests: a part's distinct n-grams in each of ``ranges`` of the hash and their additions."""
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each(batches):
            chunk = Chunk(r)
            for side in (0, 1):
                part = Part(chunk, side, bits)
                if not len(part.c):
                    continue
                keys, n = part.asked(order, None if order == 3 else parts_of(r["parts"], order + 1, side), ranges)
                bucket, inside = keys >> np.uint64(KEY), keys & np.uint64((1 << KEY) - 1)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << bits))), len(keys))
                yield batch_of([(int(bucket[a]), r["chunk"], side, narrow(np.diff(inside[a:b], prepend=np.uint64(0))), columns(n[a:b]))
                                for a, b in zip(cuts[:-1], cuts[1:])], _ASKED)
    return asked


def _tally(order: int, rows: list[tuple]) -> Iterator[tuple]:
    """Answers to the requests of a range: the other side's sums, and the count of an own
    n-gram to the one part that owns it; and for each side how many n-grams were seen 1,
    2, 3, 4 and more than 0 times, and the sum of their counts."""
    keys = [np.cumsum(widened(r[3]), dtype=np.uint64) for r in rows]
    ends = np.cumsum([0, *map(len, keys)])
    place = np.unique(np.concatenate(keys), return_inverse=True)[1].astype(np.int32)
    size, width = int(place.max()) + 1, WIDE[order]
    del keys
    whole, sums, own = [], [], np.zeros(len(place), np.int64)
    for k in (0, 1):
        asked = [i for i, r in enumerate(rows) if r[2] == k]
        at = np.concatenate([place[ends[i]:ends[i + 1]] for i in asked] or [np.zeros(0, np.int32)])
        n = np.concatenate([sums_of(rows[i][4], order) for i in asked] or [np.zeros((width, 0), np.int64)], axis=1)
        total = [np.bincount(at, c, size).astype(np.int64) for c in n]
        count, teach = total[-1], n[-1] > 0
        total = [t.astype(np.min_scalar_type(int(t.max()))) for t in total]
        whole.append(total)
        sums += [int((count == c).sum()) for c in (1, 2, 3, 4)] + [int((count > 0).sum()), int(count.sum())]
        if order > 1:
            spot = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in asked] or [np.zeros(0, np.int64)])[teach]
            found, first = np.unique(at[teach], return_index=True)
            own[spot[first]] = count[found]
        del at, n, total, count, teach
    yield rows[0][0], order, -1, 0, b"", b"", sums
    for r, a, end in zip(rows, ends[:-1], ends[1:]):
        other = np.stack([t[place[a:end]] for t in whole[1 - r[2]]], axis=1).astype(np.int64)
        yield r[0], order, r[1], r[2], columns(other), narrow(own[a:end]) if order > 1 else b"", None


def teller(order: int):
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    yield batch_of(list(_tally(order, held)), _TOLD)
                    held = []
                held.append(row)
        if held:
            yield batch_of(list(_tally(order, held)), _TOLD)
    return told


# ---- scores ----

def log_probabilities(part: Part, answers: list[dict], side: int, sums: dict[int, list[int]]) -> np.ndarray:
    """Natural logs of the tokens' probabilities under the other side's model; ``sums`` are
    that model's, by order."""
    cut = {o: quality.discounts_of([0, *s[:4]]) for o, s in sums.items()}
    n3, n2, n1 = (others_of(answers, o, side) for o in (3, 2, 1))
    _, before, own = part.words()
    ones, twos, _, _, seen, total = sums[1]
    rest = (cut[1][1] * ones + cut[1][2] * twos + cut[1][3] * (seen - ones - twos)) / total / (seen + 1)
    p = ((n1[4] - cut[1][np.minimum(n1[4], 3)]) / total + rest)[own]

    def mixed(p: np.ndarray, context: np.ndarray, where: np.ndarray, n: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """``context``: the sums of contexts, of which each token's is at ``where``; ``n``:
        the counts of n-grams, of which each token's is at ``at``."""
        some, total = context[0] > 0, np.maximum(context[0], 1)
        share = np.where(some, 1.0 / total, 0.0)
        left = np.where(some, (own[1] * context[1] + own[2] * context[2] + own[3] * context[3]) / total, 1.0)
        return (n - own[np.minimum(n, 3)])[at] * share[where] + left[where] * p

    _, at = np.unique(part.keys(2), return_inverse=True)
    p = mixed(p, n1, before, n2[4], at, cut[2])
    context = np.append(n2, np.zeros((5, 1), np.int64), axis=1)  # the last: no pair before the first word
    where = np.append(-1, at[:-1])
    where[part.first] = -1
    _, at = np.unique(part.keys(3), return_inverse=True)
    return np.log(mixed(p, context, where, n3[0], at, cut[3]))


def scorer(sums: dict[int, list[list[int]]], kind: pa.DataType, bits: int):
    """``sums[order][side]``; without words on either side there is no perplexity."""
    ready = all(s[-1] for both in sums.values() for s in both)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each(batches):
            stats = unpacked(r["stats"], "<i8").reshape(-1, 5)
            value = np.full(len(stats), np.nan)
            chunk = Chunk(r) if ready else None
            for side in (0, 1) if ready else ():
                part = Part(chunk, side, bits)
                if len(part.c):
                    logs = log_probabilities(part, r["parts"], side, {o: s[1 - side] for o, s in sums.items()})
                    total = np.bincount(part.doc, logs, len(stats))
                    value[part.docs] = -total[part.docs] / np.where(stats[part.docs, 0] > 0, stats[part.docs, 0], np.nan)
            out = np.array(r["out"], bool)
            cols = [pa.array(stats[:, i]) for i in range(5)] + [pa.array(value, mask=np.isnan(value))]
            yield pa.RecordBatch.from_arrays([pa.array(r["ids"], kind), pa.array(r["langs"], pa.string()), *cols],
                                             names=["id", "lang", *quality.STATS.names]).filter(pa.array(out))
    return scored


def scores(texts: DataFrame, chunk: int = CHUNK, span: int = RANGE, passes: dict[int, int] = PASSES) -> DataFrame:
    """One row (id, lang, base counts, log_perplexity) per row of ``texts(id, lang, text,
    good, out)`` with ``out``.  The n-grams are those of all rows with ``good``."""
    kind, spark = texts.schema["id"].dataType, texts.sparkSession
    arrow, ddl = to_arrow_type(kind), kind.simpleString()
    chunks = bucketed(whole_texts(texts).mapInArrow(chunker(arrow, chunk), _CHUNK.format(ddl)), "chunks", "chunk")
    swept(spark)
    dealt_to = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = max(dealt_to // 4, 1)  # files of what is small
    with passing(spark) as stored:
        marks = stored(chunks.select("chunk", "marks").mapInArrow(marked, "chunk long, node long, mark long").coalesce(few), "marks")
        linked = marks.select("chunk", "node").distinct().join(families(marks, stored), "node").groupBy("chunk").agg(
            F.collect_list(F.struct("node", "label")).alias("linked"))
        sides = materialized(chunks.select("chunk", "good", "stats", "marks").join(linked, "chunk", "left").mapInArrow(
            dealt, "chunk long, families binary, ones array<long>, n_good long, n_all long").coalesce(few), "sides")
    row = sides.agg(*[F.sum(F.col("ones")[i]) for i in range(BITS)], F.sum("n_good"), F.sum("n_all")).first()
    *ones, good, tokens = [x or 0 for x in row]
    bit = min(range(BITS), key=lambda i: abs(2 * ones[i] - good))
    bits = min(max(math.ceil(math.log2(max(tokens, 1) / span)), 0), 64 - KEY)
    one = small(sides.select("chunk", "families").mapInArrow(chosen(bit), "chunk long, sides binary"), 1_000_000)  # a bit a document
    chunks = chunks.drop("marks").join(one, "chunk")
    tokens_of = ("chunk", "good", "stats", "words", "tokens", "sides")

    def by_chunk(told: DataFrame, *names: str) -> DataFrame:
        return told.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "side", *names)).alias("parts"))

    told: dict[int, DataFrame] = {}
    sums: dict[int, list[list[int]]] = {}
    swept(spark)
    for order in (3, 2, 1):
        width = math.ceil((1 << bits) / passes[order])
        tasks = math.ceil(width / TOGETHER)
        for low in range(0, 1 << bits, width):
            ranges = range(low, min(low + width, 1 << bits))
            source = chunks.select(*tokens_of)
            if order < 3:
                source = source.join(by_chunk(told[order + 1], "own"), "chunk", "left")
            asked = source.mapInArrow(asker(order, bits, ranges), ASKED)
            done = materialized(asked.repartitionById(tasks, F.floor((F.col("bucket") - low) / TOGETHER).cast("int")).sortWithinPartitions("bucket", "chunk", "side").mapInArrow(
                teller(order), TOLD), f"told{order}")
            told[order] = told[order].unionByName(done) if low else done
            del source, asked
            swept(spark)
        found = told[order].where("chunk < 0").agg(*[F.sum(F.col("sums")[i]) for i in range(12)]).first()
        found = [x or 0 for x in found]
        sums[order] = [found[:6], found[6:]]
    every = told[3].unionByName(told[2]).unionByName(told[1])
    fields = f"id {ddl}, lang string, " + ", ".join(f"{n} long" for n in quality.STATS.names[:5]) + ", log_perplexity double"
    out, times = [], min(SCORED, 1 << bits)
    for k in range(times):
        ours = F.pmod(F.xxhash64("chunk"), F.lit(times)) == k
        scored = chunks.where(ours).join(by_chunk(every.where(ours), "other"), "chunk", "left").mapInArrow(scorer(sums, arrow, bits), fields)
        out.append(materialized(scored.coalesce(max(dealt_to // 2, 1)), "scored"))
        del scored
        swept(spark)
    return reduce(DataFrame.unionByName, out)
