"""Secret scans: fixed patterns, and a linear-chain CRF that adds spans to them."""
import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from aerofield.llm.common import LOWER, fresh, uniform, whole_texts, word_blocks

# The base patterns, their least lengths, and the kinds in their order.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_MIN, ACCESS_MIN = 8, 16
KINDS = ("assign", "access", "hex", "crf")

_WORD = re.compile(rb"[^ \t-\r]+")
STATES = 3  # outside, begin, inside
OUT, BEGIN, INSIDE = range(STATES)
WIDTH = 1 << 13  # hashed feature weights
REACH = 24  # words on each side of a training window


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, leftmost and non-overlapping per kind.  A match that
    is too short is dropped but still consumes its text.  Runs of hex digits are
    maximal, so asking for 32 of them finds just the runs that are long enough."""
    found = []
    low = data.translate(LOWER)
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if b"AKIA" in data:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(data)]
    return sorted(found)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b, *_ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


# ---- features ----

_CLASS = bytearray(b"o" * 256)
for _chars, _c in ((b"abcdefghijklmnopqrstuvwxyz", b"a"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"A"), (b"0123456789", b"0"),
                   (b"=:", b"="), (b"\"'", b"q"), (bytes(range(128, 256)), b"u")):
    for _b in _chars:
        _CLASS[_b] = _c[0]
_CLASS = bytes(_CLASS)
_REPEAT = re.compile(rb"(.)\1+")


def _slot(template: str, value) -> int:
    return zlib.crc32(f"{template}={value}".encode()) % WIDTH


@functools.lru_cache(1 << 16)
def _shape(kinds: bytes, spread: int) -> tuple[int, ...]:
    n, outline = len(kinds), _REPEAT.sub(rb"\1", kinds)
    classes = bytes(sorted(set(outline)))
    size, digits = min(n, 48) // 4, round(8 * kinds.count(b"0") / n)
    return (_slot("size", size), _slot("classes", classes), _slot("digits", digits),
            _slot("turns", min(len(outline), 24) // 2), _slot("spread", spread), _slot("outline", outline[:6]),
            _slot("size-classes", (size, classes)), _slot("size-digits", (size, digits)))


@functools.lru_cache(1 << 16)
def _beside(kinds: bytes) -> tuple[int, ...]:
    classes = bytes(sorted(set(kinds)))
    return tuple(_slot(side, x) for side in ("before", "after") for x in (classes, kinds[-1:]))


def word_features(word: bytes) -> tuple[int, ...]:
    """Weights of a word: 8 for itself (length, classes of characters, share of digits,
    changes of class, variety of characters, outline of its classes), 3 as the word
    before and 3 as the word after another (its letters, its classes, its end)."""
    kinds = word.translate(_CLASS)
    plain = word.translate(LOWER).strip(b"\"'.,;:=()[]{}!?")[:24]
    before, end_before, after, end_after = _beside(kinds[-48:])
    return (*_shape(kinds, min(len(set(word)), 24) // 3), zlib.crc32(plain) % WIDTH, before, end_before,
            zlib.crc32(plain, 1) % WIDTH, after, end_after)


def file_features(n_words: int, n_digit_words: int) -> list[int]:
    share = 100 * n_digit_words // max(n_words, 1)
    return [_slot("file-size", n_words.bit_length()), _slot("file-digits", share.bit_length())]


_DIGIT = re.compile(rb"[0-9]")


def _has_digit(word: bytes) -> bool:
    return _DIGIT.search(word) is not None


# ---- the model ----

@dataclass(frozen=True)
class Crf:
    """Feature weights (slot, state), transitions (from, to) and the largest gain that
    transitions can give a path for leaving the outside state at one word."""
    weights: np.ndarray
    moves: np.ndarray

    @property
    def gain(self) -> float:
        a, best = self.moves, 0.0
        for y in (BEGIN, INSIDE):
            into, onto = a[:, y] - a[:, OUT], a[y, :] - a[OUT, :]
            best = max(best, into.max() + onto.max(), into.max(), onto.max())
        return float(best)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.1, decay: float = 1e-5) -> Crf:
    """Conditional likelihood by Adam over batches of similar lengths; a sequence is
    (features[n, k], states[n])."""
    w, a = np.zeros((WIDTH, STATES)), np.zeros((STATES, STATES))
    memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, a)]
    order = sorted(range(len(sequences)), key=lambda i: (len(sequences[i][1]), i))
    batches = [order[i:i + 128] for i in range(0, len(order), 128)]
    draw, step = np.random.default_rng(7), 0
    for _ in range(epochs):
        for b in draw.permutation(len(batches)):
            group = [sequences[i] for i in batches[b]]
            lens = np.array([len(y) for _, y in group])
            n, most = len(group), lens.max()
            k = group[0][0].shape[1]
            feats, gold = np.zeros((n, most, k), np.int64), np.zeros((n, most), np.int64)
            for i, (x, y) in enumerate(group):
                feats[i, :len(y)], gold[i, :len(y)] = x, y
            there = np.arange(most) < lens[:, None]
            e = w[feats].sum(axis=2)
            alpha = np.empty((n, most, STATES))
            alpha[:, 0] = e[:, 0]
            for t in range(1, most):
                new = _logsum(alpha[:, t - 1, :, None] + a, 1) + e[:, t]
                alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
            total = _logsum(alpha[:, -1], 1)
            beta = np.zeros((n, most, STATES))
            grad_a = np.zeros_like(a)
            for t in range(most - 2, -1, -1):
                onward = e[:, t + 1] + beta[:, t + 1]
                on = there[:, t + 1]
                beta[:, t] = np.where(on[:, None], _logsum(a + onward[:, None, :], 2), 0.0)
                pair = np.exp(alpha[:, t, :, None] + a + onward[:, None, :] - total[:, None, None])
                grad_a -= pair[on].sum(axis=0)
                np.add.at(grad_a, (gold[on, t], gold[on, t + 1]), 1.0)
            node = -np.exp(alpha + beta - total[:, None, None])
            np.put_along_axis(node, gold[:, :, None], np.take_along_axis(node, gold[:, :, None], 2) + 1.0, 2)
            node[~there] = 0.0
            grad_w = np.zeros_like(w)
            flat = feats[there]
            for j in range(k):
                for s in range(STATES):
                    grad_w[:, s] += np.bincount(flat[:, j], node[there][:, s], WIDTH)
            step += 1
            for value, grad, (m, v) in zip((w, a), (grad_w, grad_a), memory):
                g = grad / n - decay * value * len(sequences) / n
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Crf(w.astype(np.float32), a.astype(np.float32))


def viterbi(e: np.ndarray, moves: np.ndarray) -> list[int]:
    back, score = [], e[0]
    for row in e[1:]:
        step = score[:, None] + moves
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Tagger:
    """Words to states.  The emissions of a distinct word are kept; the store is emptied
    when full, which changes no result."""

    def __init__(self, model: Crf, most: int = 100_000):
        self.model, self.most, self.gain = model, most, model.gain
        self._empty()

    def _empty(self):
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((1024, 3 * STATES + 1), np.float32)

    def _add(self, words: list[bytes]):
        """Emissions of new words as themselves, before and after another."""
        at, w = len(self.known), self.model.weights
        while at + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        slots = np.array([word_features(x) for x in words])
        self.rows[at:at + len(words)] = np.concatenate([
            w[slots[:, :8]].sum(axis=1), w[slots[:, 8:11]].sum(axis=1), w[slots[:, 11:]].sum(axis=1),
            np.array([[_has_digit(x)] for x in words], np.float32)], axis=1)
        self.known.update(zip(words, range(at, at + len(words))))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self._empty()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self._add(new)
        return self.rows[list(map(self.known.__getitem__, words))]

    def tags(self, data: bytes) -> np.ndarray:
        """The best path's states of all words of the text.  A word whose outside score
        leads by more than all that transitions could give is outside on the best path,
        whatever stands around it; only the stretches between such words are decoded."""
        blocks = [self._rows(w) for w in word_blocks(data, lower=False) if w]
        if not blocks:
            return np.zeros(0, np.int64)
        rows = np.concatenate(blocks) if len(blocks) > 1 else blocks[0]
        e = rows[:, :3].copy()
        e[1:] += rows[:-1, 3:6]
        e[:-1] += rows[1:, 6:9]
        e += self.model.weights[file_features(len(rows), int(rows[:, 9].sum()))].sum(axis=0)
        out = np.zeros(len(e), np.int64)
        open_ = np.flatnonzero(np.maximum(e[:, BEGIN], e[:, INSIDE]) + self.gain >= e[:, OUT])
        if not len(open_):
            return out
        a = self.model.moves
        for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            lo, hi = int(part[0]), int(part[-1])
            own = e[lo:hi + 1].copy()
            if lo:
                own[0] += a[OUT]
            if hi + 1 < len(e):
                own[-1] += a[:, OUT]
            out[lo:hi + 1] = viterbi(own, a)
        return out


def tagged_spans(data: bytes, states: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs begin, inside, inside ...; an inside word after an outside
    one begins a run."""
    if not states.any():
        return []
    out: list[list[int]] = []
    last = OUT
    for m, s in zip(_WORD.finditer(data), states.tolist()):
        if s == INSIDE and last != OUT:
            out[-1][1] = m.end()
        elif s != OUT:
            out.append([m.start(), m.end()])
        last = s
    return [(a, b) for a, b in out]


def all_spans(data: bytes, tagger: Tagger | None) -> tuple[list, list]:
    """Base spans, and the tagger's spans that touch none of them."""
    base = base_spans(data)
    extra = tagged_spans(data, tagger.tags(data)) if tagger else []
    solid = merged(base)
    return base, [(a, b, 3) for a, b in extra if not any(a < y and x < b for x, y in solid)]


# ---- training windows ----

def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Around each base span, and one stretch elsewhere chosen by a checksum: words with
    one neighbour on either side, states, and the file features."""
    for batch in batches:
        out = []
        for data in batch.column(0).to_pylist():
            data = data or b""
            spans = merged(base_spans(data))
            at = [m.span() for m in _WORD.finditer(data)]
            if not at:
                continue
            words = [data[a:b] for a, b in at]
            states, starts = np.zeros(len(at), np.int64), np.array([a for a, _ in at])
            ends = np.array([b for _, b in at])
            marks = []
            for a, b in spans:
                own = np.flatnonzero((starts < b) & (ends > a))
                states[own], states[own[0]] = INSIDE, BEGIN
                marks.append((int(own[0]), int(own[-1])))
            tail = file_features(len(words), sum(map(_has_digit, words)))
            sum_ = zlib.crc32(data)
            marks = marks or [(sum_ % len(words),) * 2]
            for lo, hi in marks:
                lo, hi = max(0, lo - REACH), min(len(words), hi + 1 + REACH)
                out.append((words[max(0, lo - 1):hi + 1], lo > 0, hi < len(words), states[lo:hi].tolist(), tail,
                            bool(spans), zlib.crc32(b"%d:%d" % (sum_, lo))))
        cols = list(zip(*out)) if out else [[]] * 7
        kinds = (pa.list_(pa.binary()), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                         names=["words", "before", "after", "states", "file", "secret", "draw"])


def train(docs: DataFrame, text: str = "text", documents: int = 20_000, windows: int = 4_000) -> Crf | None:
    """A CRF fitted on a bounded sample labelled by the base patterns: the ``documents``
    distinct texts with the smallest draws, of their distinct windows at most ``windows``
    with and as many without a secret.  None if no secret is found."""
    drawn = docs.select(uniform(8, F.xxhash64(F.col(text))).alias("u"), F.col(text).cast("binary").alias("t"))
    limit = drawn.where("t IS NOT NULL").select("u").distinct().orderBy("u").limit(documents).agg(F.max("u")).first()[0]
    if limit is None:
        return None
    rows = drawn.where((F.col("u") <= limit) & F.col("t").isNotNull()).select("t").distinct().mapInArrow(
        _windows, "words array<binary>, before boolean, after boolean, states array<int>, file array<int>, secret boolean, draw long")
    rows = rows.groupBy("words", "before", "after", "states", "file", "secret").agg(F.min("draw").alias("draw"))
    sample = rows.where("secret").orderBy("draw", "words").limit(windows).collect()
    if not sample:
        return None
    sample += rows.where("NOT secret").orderBy("draw", "words").limit(windows).collect()
    sequences = []
    for r in sample:
        words = [bytes(w) for w in r.words]
        none = [b" "]
        words = (none if not r.before else []) + words + (none if not r.after else [])
        own = np.array([word_features(w) for w in words])
        feats = np.concatenate([own[1:-1, :8], own[:-2, 8:11], own[2:, 11:], np.tile(r.file, (len(words) - 2, 1))], axis=1)
        sequences.append((feats, np.array(r.states)))
    return fit(sequences)


# ---- operators ----

def _point_offsets(data: bytes, at: list[int]) -> list[int]:
    """Byte offsets as counts of code points."""
    if not at:
        return []
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return heads[at].tolist()


def _told(data: bytes, spans: list[tuple[int, int, int]]) -> str:
    flat = _point_offsets(data, [x for a, b, _ in spans for x in (a, b)])
    rows = sorted((a, k, b) for a, b, k in zip(flat[::2], flat[1::2], (s[2] for s in spans)))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def scan(docs: DataFrame, model: Crf | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_crf, base and
    spans as text ``kind:start:end`` in code points, end exclusive, ordered by start and
    then kind.  Null and empty texts have no spans; a null doc_id stays null; texts of
    any length are scanned whole."""
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_crf")]
                        + [T.StructField(n, T.StringType()) for n in ("base", "spans")])

    @F.pandas_udf(kind)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model) if model else None
        for texts in parts:
            rows = []
            for data in texts:
                data = data or b""
                base, extra = all_spans(data, tagger)
                counts = [sum(s[2] == k for s in base) for k in range(3)]
                rows.append((*counts, len(extra), _told(data, base), _told(data, base + extra)))
            yield pd.DataFrame(rows, columns=kind.names)

    return whole_texts(docs).select(F.col(doc_id).alias("doc_id"), found(F.col(text).cast("binary")).alias("f")).select("doc_id", "f.*")


def redacted(docs: DataFrame, model: Crf | None, text: str = "text", mark: str = "[secret]", size: str = "n_chars") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark``, and ``size`` (if it is there)
    counted anew.  No row is dropped; null texts stay null."""
    @F.pandas_udf(T.StringType())
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger(model) if model else None
        for texts in parts:
            rows = []
            for data in texts:
                if data is not None:
                    base, extra = all_spans(data, tagger)
                    cuts = merged(base + extra)
                    if cuts:
                        ends = [0, *itertools.chain(*cuts), len(data)]
                        data = mark.encode().join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                rows.append(None if data is None else data.decode("utf-8", "replace"))
            yield pd.Series(rows, dtype=object)

    new = fresh(docs.columns, "clean_text")
    out = whole_texts(docs).withColumn(new, clean(F.col(text).cast("binary")))
    cols = [F.col(new).alias(c) if c == text else
            F.char_length(F.col(new)).cast(docs.schema[c].dataType).alias(c) if c == size else F.col(c) for c in docs.columns]
    return out.select(*cols)


def query(docs: DataFrame) -> DataFrame:
    out = scan(docs, train(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_crf")
