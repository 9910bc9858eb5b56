"""Ranked lexical search: documents of an item grouped by the mask of its terms they hold.

Documents are read once for their terms among those of the items; what is found is written
and gives the counts of the whole table.  Then each task takes its documents in blocks: a
term is a bitmap over the block, an item's bitmaps side by side are a mask for each
document.  Distinct masks are evaluated by descending highest score they can reach, until
no mask left can reach the item's last place so far."""
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from aerofield.llm.common import LOWER, whole_texts, word_blocks
from aerofield.session import materialized

K = 50
BLOCK = 1 << 13  # documents of a block
ITEMS, BYTES = 1024, 8 << 20  # items and bytes of their texts that are searched in one pass
GROUP = 1 << 20  # bytes of texts whose terms are looked up together
PARTS = 64  # ways in which tasks' best documents meet first
LAST = (1 << 63) - 1  # stands for a null doc_id
# What separates terms, and the scale of weights and scores.
TERM = bytes(c if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)).translate(LOWER)
SCALE, ONE, STEP, FLOOR, SLOPE = 1000, 1_000_000_000, 20, 50, 50


def terms(data: bytes | None) -> Iterator[list[bytes]]:
    """Terms of a text, a block of it at a time."""
    if data and len(data) <= GROUP:
        yield data.translate(TERM).split()
    elif data:
        for words in word_blocks(data, lower=False):
            yield b" ".join(words).translate(TERM).split()


def finder(known: dict[bytes, int]):
    """n, terms and tf of each text: its terms with repeats, and those of ``known`` in it."""
    size = max(len(known), 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, times = [], [], []
            held: list[bytes] = []
            ends: list[int] = []

            def told():
                at = np.fromiter(map(known.get, held, itertools.repeat(-1)), np.int64, len(held))
                row = np.repeat(np.arange(len(n) - len(ends), len(n)), np.diff(np.array(ends, np.int64), prepend=0))
                key, count = np.unique((row * size + at)[at >= 0], return_counts=True)
                keys.append(key)
                times.append(count)
                held.clear()
                ends.clear()

            for data in batch.column(1).to_pylist():
                if data and len(data) > GROUP:
                    told()
                    own = {}
                    n.append(0)
                    for words in terms(data):
                        n[-1] += len(words)
                        at = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
                        for t, c in zip(*map(np.ndarray.tolist, np.unique(at[at >= 0], return_counts=True))):
                            own[t] = own.get(t, 0) + c
                    keys.append((len(n) - 1) * size + np.array(sorted(own), np.int64))
                    times.append(np.array([own[t] for t in sorted(own)], np.int64))
                    continue
                for words in terms(data):
                    held += words
                ends.append(len(held))
                n.append(len(held) - (ends[-2] if len(ends) > 1 else 0))
                if len(held) > GROUP >> 3:
                    told()
            told()
            key, count = np.concatenate(keys), np.concatenate(times)
            at = np.searchsorted(key, np.arange(len(n) + 1) * size)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in ((key % size).astype(np.int32), count.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])
    return found


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(SCALE * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (ONE * tf) // (SCALE * tf + STEP * m)


class Best:
    """The k best documents of an item so far: highest score, then smallest doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score must reach to come in: the last place's, or 1."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray):
        good = score >= self.least
        score, doc = np.append(self.score, score[good]), np.append(self.doc, doc[good])
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]


class Block:
    """Documents with the terms they hold: bitmaps by term, and tf by (term, document)."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.doc, self.m, self.n = doc, m, len(doc)
        where = np.repeat(np.arange(self.n), sizes)
        order = np.argsort(term, kind="stable")
        self.term, self.tf = np.unique(term), tf[order]
        place = np.searchsorted(self.term, term)
        self.keys = (place * self.n + where)[order]
        wide = -(-self.n // 8)
        self.bitmaps = np.zeros((len(self.term), wide), np.uint8)
        at, bit = (place * wide + (where >> 3))[order], (128 >> (where & 7)).astype(np.uint8)[order]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        if len(new):
            self.bitmaps.reshape(-1)[at[new]] = np.bitwise_or.reduceat(bit, new)
        first = np.searchsorted(place[order], np.arange(len(self.term)))
        self.most = np.maximum.reduceat(self.tf, first) if len(first) else self.tf  # highest tf of each term

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold a term, dealt to groups of equal masks: the groups' masks as
        rows of bits, the documents group by group, and the bounds of the groups."""
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=self.n)
        some = np.flatnonzero(bits.any(axis=0))
        held = np.packbits(bits[:, some], axis=0)
        words = np.zeros((-(-len(held) // 8) * 8, len(some)), np.uint8)
        words[:len(held)] = held
        group = np.zeros(len(some), np.int64)
        for word in np.ascontiguousarray(words.T).view(np.uint64).T:  # 64 terms at a time
            distinct, at = np.unique(word, return_inverse=True)
            _, group = np.unique(group * len(distinct) + at, return_inverse=True)
        order = np.argsort(group, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(group)))
        return bits[:, some[order[bounds[:-1]]]].T, some[order], bounds

    def search(self, wanted: np.ndarray, w: np.ndarray, best: Best):
        """Bring the block's best documents for an item with terms ``wanted`` and weights ``w``."""
        rows = np.searchsorted(self.term, wanted)
        here = (rows < len(self.term)) & (self.term[np.minimum(rows, len(self.term) - 1)] == wanted) & (w > 0)
        rows, w = rows[here], w[here]
        if not len(rows):
            return
        masks, docs, bounds = self.masks(rows)
        top = w * gain(self.most[rows], self.m.min())  # no document has more of a term
        reach = masks.astype(np.float64) @ top  # whole numbers below 2 ** 53
        order = np.argsort(-reach, kind="stable")
        size, at, some = np.diff(bounds), 0, best.k
        while at < len(order) and reach[order[at]] >= best.least:
            take = order[at:at + some]
            take = take[reach[take] >= best.least]
            at, some = at + len(take), 2 * some
            own = docs[np.repeat(bounds[take] - (np.cumsum(size[take]) - size[take]), size[take]) + np.arange(size[take].sum())]
            score = np.zeros(len(own), np.int64)
            for row, weight in zip(rows.tolist(), w.tolist()):
                key = row * self.n + own
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                tf = np.where(self.keys[spot] == key, self.tf[spot], 0)
                score += weight * gain(tf, self.m[own])
            best.add(score, self.doc[own])


def searcher(items: list[np.ndarray], weight: np.ndarray, docs: int, tokens: int, k: int, block: int):
    """The k best documents of each item among those of the task."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        held: list[pa.RecordBatch] = []

        def told():
            n, sizes, term, tf = (np.concatenate([f(b) for b in held]) for f in (
                lambda b: b.column(1).to_numpy(), lambda b: np.asarray(b.column(2).value_lengths()),
                lambda b: b.column(2).flatten().to_numpy(), lambda b: b.column(3).flatten().to_numpy()))
            doc = np.concatenate([b.column(0).to_numpy() for b in held])
            if len(term):
                part = Block(doc, 100 - FLOOR + (SLOPE * n * docs) // tokens, sizes, term, tf)
                for wanted, b in zip(items, best):
                    part.search(wanted, weight[wanted], b)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                told()
        if held:
            told()
        item = np.repeat(np.arange(len(items)), [len(b.doc) for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(item), TaskContext.get().partitionId() % PARTS, np.int64)), pa.array(item.astype(np.int32)),
             *[pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in ([b.doc for b in best], [b.score for b in best])]],
            names=["part", "item", "doc_id", "score"])
    return found


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[DataFrame, list[bytes | None]]]:
    """Items in blocks of at most ITEMS and about BYTES: ``item, item_id`` and the texts by
    item.  A block is what comes to the driver; one long item can be a block alone."""
    rows = materialized(items.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text"))
                        .withColumn("row", F.monotonically_increasing_id()), "items")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / (ITEMS // 2)), math.ceil(size / (BYTES // 2)))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        found = own.select("row", "text").orderBy("row").collect()
        numbers = own.sparkSession.createDataFrame([(r["row"], i) for i, r in enumerate(found)], "row long, item int")
        yield own.select("row", "item_id").join(F.broadcast(numbers), "row").drop("row"), [r["text"] for r in found]


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """For each row of ``items`` its k best documents with a score above 0: item_id, rank
    (from 1), doc_id long, score; equal scores by ascending doc_id, a null doc_id last.

    Terms are runs of ASCII letters, digits and all characters from U+0080, A-Z lower-cased.
    Null and empty texts have none: such a document is not counted and found by nothing,
    such an item finds nothing, as does every item in an empty table.  Each row of ``docs`` is
    a document and each row of ``items`` an item, equal rows too; other columns are not
    read.  Items are searched in blocks (``_blocks``), each with one pass over all
    documents; long texts are read a block at a time."""
    rows = whole_texts(docs).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = None
    for numbers, texts in _blocks(items, item_id, item_text):
        own = [list(dict.fromkeys(itertools.chain.from_iterable(terms(t)))) for t in texts]
        known = {w: i for i, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(own)))}
        held = materialized(rows.mapInArrow(finder(known), "doc_id long, n long, terms array<int>, tf array<long>"), "postings")
        n, tokens = held.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)
        for t, c in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # terms of the block of items
            df[t] = c
        wanted = [np.array(sorted(known[w] for w in words), np.int64) for words in own]
        found = _merged(held, searcher(wanted, weights(df, n), n, max(tokens, 1), k, block), k)
        found = found.join(F.broadcast(numbers), "item").select(
            "item_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out


def _merged(held: DataFrame, run, k: int) -> DataFrame:
    """The k best of the tasks' best: among the tasks of a part, then by item."""
    found = materialized(held.mapInArrow(run, "part long, item int, doc_id long, score long"), "found")
    for keys in (["item", "part"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
 e AS (SELECT doc_id, d, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
 a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM e),
 i AS (SELECT item_id, i, unnest(list_distinct(ts)) AS t FROM (SELECT item_id, row_number() OVER () AS i,
        regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)),
 p AS (SELECT doc_id, d, n, t, count(*) AS tf FROM (SELECT doc_id, d, n, unnest(ts) AS t FROM e) GROUP BY ALL),
 w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY t),
 s AS (SELECT item_id, i, doc_id, d, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens)))) AS BIGINT) AS score
       FROM i JOIN p USING (t) JOIN w USING (t), a GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 50"""
