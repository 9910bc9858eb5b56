"""Packing into windows: order-preserving dynamic programming over cut points."""
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from aerofield.llm.common import crc32, whole_texts
from aerofield.llm.tokens import store

SENTENCE_COST, FORCED_COST = 8, 32  # in padded tokens: a cut after a sentence, and inside one
FORCED_STEP = 32  # cut points inside a sentence that is longer than this
HORIZON = 1 << 18  # ids that one run of the programme looks over


def cut_points(points: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Indices of the cheapest cuts of a stream, from the first point to the cheapest of
    those that leave less than a window: what is left then is no window yet and costs
    nothing (else its padding would be free for all windows before it to use up).

    cost(i, j) = window - (p_j - p_i) padding + cost of cutting at j, for windows of at
    most ``window`` ids.  With p_j taken out, the best i is the least best_i + p_i of the
    points in reach: a queue kept in rising order gives it in amortised constant time."""
    p, w = points.tolist(), costs.tolist()
    best, prior, queue, keys = [0] * len(p), [0] * len(p), deque([0]), [p[0]] + [0] * (len(p) - 1)
    for j in range(1, len(p)):
        pj = p[j]
        least = pj - window
        while p[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        prior[j] = i
        key = keys[i] + window + w[j]
        best[j] = key - pj
        keys[j] = key
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    open_ = next(j for j in range(len(p)) if p[-1] - p[j] < window)
    path = [min(range(open_, len(p)), key=best.__getitem__)]
    while path[-1]:
        path.append(prior[path[-1]])
    return path[::-1]


class Stream:
    """Documents of one task in their order, cut run by run.  What a run's windows leave
    begins the next run.  Pieces of a document wait for its
    end only as numbers, so a document of any length passes in bounded memory."""

    def __init__(self, number: int, window: int):
        self.first, self.window = number << 32, window
        self.done = 0  # sequences so far
        self.ids: list[np.ndarray] = []
        self.held = 0  # ids held
        self.cuts, self.costs = [0], [0]  # relative to the ids held
        self.docs: list[list] = []  # [doc_id, ids before, ids held, total or None]
        self.waiting: list[tuple] = []  # pieces whose document has not ended
        self.ready: list[tuple] = []

    def begin(self, doc_id):
        self.docs.append([doc_id, 0, 0, None])
        self.total = 0

    def add(self, ids: np.ndarray, sentences: np.ndarray):
        base = self.held
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.docs[-1][2] += len(ids)
        last = self.cuts[-1]
        for s in (sentences + base).tolist():
            self._point(last, s, SENTENCE_COST)
            last = self.cuts[-1]
        if self.held > HORIZON:
            self._run(False)

    def _point(self, last: int, at: int, cost: int):
        if at == last:
            self.costs[-1] = min(self.costs[-1], cost)
            return
        if at - last > FORCED_STEP:
            steps = list(range(last + FORCED_STEP, at, FORCED_STEP))
            self.cuts += steps
            self.costs += [FORCED_COST] * len(steps)
        self.cuts.append(at)
        self.costs.append(cost)

    def end(self, closing: int):
        self.add(np.array([closing], "<u4"), np.zeros(0, np.int64))
        self._point(self.cuts[-1], self.held, 0)
        self.docs[-1][3] = self.total
        self.ready += [(*x, self.total) for x in self.waiting]
        self.waiting.clear()
        if self.held > HORIZON:
            self._run(False)

    def _run(self, last: bool):
        """Cut what is held; at the end, the rest too, in powers of two that need no padding."""
        if not self.held:
            return
        points, costs = self.cuts, self.costs
        if points[-1] < self.held:  # inside a sentence that is still open
            self._point(points[-1], self.held, FORCED_COST)
        points, costs = np.array(self.cuts), np.array(self.costs)
        at = points[cut_points(points, costs, self.window)].tolist()
        if last:
            rest = self.held - at[-1]
            for k in range(rest.bit_length() - 1, -1, -1):
                if rest >> k & 1:
                    at.append(at[-1] + (1 << k))
        if len(at) < 2:
            return
        ids = np.concatenate(self.ids)
        queue = iter(self.docs)
        doc = next(queue)
        left, past = doc[2], 0
        for a, b in zip(at, at[1:]):
            seq, offset = self.first + self.done, 0
            self.done += 1
            while a < b:
                while not left:
                    doc = next(queue)
                    left, past = doc[2], past + 1
                n = min(left, b - a)
                piece = (doc[0], doc[1], n, crc32(ids[a:a + n].tobytes()), seq, offset)
                if doc[3] is None:
                    self.waiting.append(piece)
                else:
                    self.ready.append((*piece, doc[3]))
                doc[1] += n
                doc[2] -= n
                left -= n
                a += n
                offset += n
        cut = at[-1]
        self.ids, self.held = [ids[cut:].copy()], self.held - cut
        keep = points >= cut
        self.cuts, self.costs = (points[keep] - cut).tolist(), costs[keep].tolist()
        self.costs[0] = 0
        self.docs = [d for d in self.docs[past:] if d[2] or d[3] is None]

    def finish(self):
        self._run(True)

    def take(self) -> list[tuple]:
        out, self.ready = self.ready, []
        return out


def packed(docs: DataFrame, vocabulary: str | None = None, window: int = 4096, closing: int = 2,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32
    (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset.

    Each task packs its rows in the order it reads them, so nothing is shuffled and a
    hot source is only a part of many tasks' rows.  Sequences hold at most ``window``
    ids; the rest of a task's stream is cut into powers of two, which are not padded.
    A null or empty text is the closing id alone; equal rows are packed each.
    ``vocabulary`` is the path of a tokenizers file (default: the public word BPE)."""
    kind = docs.schema[doc_id].dataType
    names = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"]
    arrow = [to_arrow_type(kind)] + [pa.int64()] * 6

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        words, stream = store(path), Stream(TaskContext.get().partitionId(), window)

        def rows():
            cols = list(zip(*stream.take())) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, arrow)], names=names)

        for batch in batches:
            names_, last = batch.column(0).to_pylist(), -1
            for i, ids, sentences, done in words.texts(batch.column(1).to_pylist()):
                if i != last:
                    stream.begin(names_[i])
                    last = i
                stream.add(ids, sentences)
                if done:
                    stream.end(closing)
                    if len(stream.ready) > 10_000:
                        yield rows()
        stream.finish()
        yield rows()

    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in names[1:]])
    return whole_texts(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(pack, schema).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
