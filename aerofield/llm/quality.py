"""Quality rules: counts of a text, and perplexity bands under a Kneser-Ney model."""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from aerofield.llm.common import whole_texts, word_blocks
from aerofield.session import materialized, small

# Fixed values of the base rules.
MIN_WORDS, WINDOW, REPEAT_SHARE = 20, 8, 30
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"

SLACK = 8.0  # nats over sqrt(words): the mean of few words varies more, by about 4 / sqrt(n)
LOW_SLACK = 32.0  # the same below, where short texts of common lines lie; README has the labelled rows behind it
SHINGLE, SKETCH = 5, 8  # words of a shingle, smallest shingle hashes kept
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return (h ^ (h >> np.uint64(29))) * _MIX


def joined(*hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key of word hashes in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * _STEP + h)
    return out


class Hashes(dict):
    """64-bit hashes of words, kept by word; emptied when full."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(data: bytes, hashes: Hashes) -> np.ndarray:
    parts = [hashes.of(w) for w in word_blocks(data, lower=False) if w]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def repeated(h: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in some window of ``width`` words found twice or more."""
    n = len(h) - width + 1
    if n < 2:
        return 0
    key = joined(*[h[i:i + n] for i in range(width)])
    rank = np.sort(key)
    twice = rank[1:][rank[1:] == rank[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(key, twice))
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + width, -1)
    return int((np.cumsum(change) > 0).sum())


def sketch(h: np.ndarray) -> np.ndarray:
    """The smallest distinct hashes of the text's shingles."""
    n = len(h) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    key = joined(*[h[i:i + n] for i in range(SHINGLE)])
    if len(key) > 64 * SKETCH:
        key = np.partition(key, 8 * SKETCH)[:8 * SKETCH + 1]
    return np.unique(key)[:SKETCH]


def base_counts(data: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    solid = data.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else int(((np.frombuffer(solid, np.uint8) & 0xC0) != 0x80).sum())
    lines = [x for x in data.split(b"\n") if x.translate(None, SPACES)]
    return len(h), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(h)


# ---- the model ----

@dataclass(frozen=True)
class KneserNey:
    """An interpolated modified Kneser-Ney trigram model in sorted arrays, the plain form
    of what ``kneser.scores`` computes in ranges of the n-grams.

    ``words`` (sorted hashes) with p1 and back1 (what a word as context leaves to lower
    orders); ``pairs`` (sorted keys of two words) with p2 and back2; ``triples`` with p3.
    A missing context leaves everything to the next order; ``unknown`` is the
    probability of a word outside the vocabulary."""
    words: np.ndarray
    p1: np.ndarray
    back1: np.ndarray
    pairs: np.ndarray
    p2: np.ndarray
    back2: np.ndarray
    triples: np.ndarray
    p3: np.ndarray
    unknown: float

    def log_probability(self, h: np.ndarray, places: np.ndarray) -> float:
        """Sum of natural logs over the words; ``places`` are their indices in ``words``
        or -1.  The two words before the text are the start mark, hash 0."""
        w = np.concatenate([[np.uint64(0)] * 2, h])
        at = np.concatenate([[find(self.words, np.zeros(1, np.uint64))[0]] * 2, places])
        p = np.where(places >= 0, self.p1[places], self.unknown)
        v = at[1:-1]
        known = v >= 0
        q = np.where(known, self.back1[v], 1.0) * p
        both = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0))  # pairs (w[i], w[i + 1])
        pair = np.full(len(w) - 1, -1, np.int64)
        pair[both] = find(self.pairs, joined(w[both], w[both + 1]))
        seen = pair[1:] >= 0
        q[seen] = self.p2[pair[1:][seen]]
        context = pair[:-1]
        r = np.where(context >= 0, self.back2[context], 1.0) * q
        whole = np.flatnonzero((context >= 0) & seen)
        triple = find(self.triples, joined(w[whole], w[whole + 1], w[whole + 2]))
        r[whole[triple >= 0]] = self.p3[triple[triple >= 0]]
        return float(np.log(r).sum())


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in a sorted array, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def discounts(counts: np.ndarray) -> np.ndarray:
    return discounts_of([int((counts == k).sum()) for k in range(5)])


def discounts_of(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers
    ``n[1]`` to ``n[4]`` of n-grams seen once to four times."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    out = [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) if n[k] else 0.0 for k in (1, 2, 3)]
    return np.array([out[0], out[1] or 0.5, out[2] or 0.5, out[3] or 0.5])


def estimate(triples: pd.DataFrame, pairs: pd.DataFrame, words: pd.DataFrame) -> KneserNey:
    """The model from counted n-grams: ``triples(a, b, c, n)`` with occurrences,
    ``pairs(b, c, n)`` and ``words(c, n)`` with numbers of distinct words before them."""
    def parts(n: np.ndarray, context: np.ndarray):
        """Discounted share of each n-gram in its context, and by context what is left."""
        cut = discounts(n)[np.minimum(n, 3)]
        _, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, n)
        return (n - cut) / total[at], (np.bincount(at, cut) / total)[at]

    u8 = lambda s: s.to_numpy(np.int64).view(np.uint64)
    n1, one = words["n"].to_numpy(), u8(words["c"])
    share, left = parts(n1, np.zeros(len(n1), np.int64))
    uniform_share = left[0] / (len(n1) + 1)
    heads = np.unique(np.concatenate([one, u8(pairs["b"]), np.zeros(1, np.uint64)]))
    p1 = np.full(len(heads), uniform_share)
    p1[find(heads, one)] = share + uniform_share
    b, c, n2 = u8(pairs["b"]), u8(pairs["c"]), pairs["n"].to_numpy()
    share, left = parts(n2, b)
    back1 = np.ones(len(heads))
    back1[find(heads, b)] = left
    order = np.argsort(joined(b, c))
    keys2, p2 = joined(b, c)[order], (share + left * p1[find(heads, c)])[order]
    a, b, c, n3 = u8(triples["a"]), u8(triples["b"]), u8(triples["c"]), triples["n"].to_numpy()
    share, left = parts(n3, joined(a, b))
    back2 = np.ones(len(keys2))
    at = find(keys2, joined(a, b))
    back2[at[at >= 0]] = left[at >= 0]
    p3 = share + left * p2[find(keys2, joined(b, c))]
    order = np.argsort(joined(a, b, c))
    f4 = np.float32
    return KneserNey(heads, p1.astype(f4), back1.astype(f4), keys2, p2.astype(f4), back2.astype(f4),
                     joined(a, b, c)[order], p3[order].astype(f4), float(uniform_share))


@dataclass(frozen=True)
class Model:
    """The documents whose n-grams are the model: those of ``docs`` with an id in ``ids``."""
    docs: DataFrame
    ids: DataFrame
    doc_id: str
    text: str


def train(docs: DataFrame, good: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model of all documents of ``docs`` whose id is in ``good(doc_id)``, however many.
    Nothing is counted before texts are measured: ``kneser.scores`` counts the n-grams in
    the ranges of their hash in which texts ask for theirs."""
    return Model(docs, good.select(F.col("doc_id").alias("id")).where("id IS NOT NULL").distinct(), doc_id, text)


# ---- operators ----

STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                     + [T.StructField("log_perplexity", T.DoubleType())])


def base_statistics(docs: DataFrame, text: str) -> Column:
    """A struct of the base counts, without a perplexity."""
    whole_texts(docs)

    @F.pandas_udf(STATS)
    def measured(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for texts in parts:
            rows = [(*base_counts(data or b"", word_hashes(data or b"", hashes)), None) for data in texts]
            yield pd.DataFrame(rows, columns=STATS.names).astype({"log_perplexity": "float64"})

    return measured(F.col(text).cast("binary"))


def statistics(docs: DataFrame, model: Model | None, key: str, doc_id: str, text: str, lang: str, same: bool) -> DataFrame:
    """``id, lang, s`` for each row: its ``key``, language, base counts and log perplexity
    (null without words or model).  ``same``: the rows are the model's own documents; if
    not, those come along to teach."""
    if model is None:
        return docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), base_statistics(docs, text).alias("s"))
    from aerofield.llm import kneser  # which needs this module

    ids = small(model.ids.withColumnRenamed("id", "good_id"), 4_000_000)
    rows = docs.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"),
                       (F.col(doc_id) if same else F.lit(None)).alias("own"))
    good = F.col("good_id").isNotNull()
    if same:
        rows = rows.join(ids, rows["own"] == ids["good_id"], "left").select("id", "lang", "text", good.alias("good"), F.lit(True).alias("out"))
    else:
        taught = model.docs.select(F.col(model.doc_id).alias("own"), F.col(model.text).cast("binary").alias("text"))
        rows = rows.select("id", "lang", "text", F.lit(False).alias("good"), F.lit(True).alias("out")).unionByName(
            taught.join(ids, taught["own"] == ids["good_id"]).select(
                F.lit(None).cast(docs.schema[key].dataType).alias("id"), F.lit(None).cast("string").alias("lang"), "text",
                F.lit(True).alias("good"), F.lit(False).alias("out")))
    return kneser.scores(rows).select("id", "lang", F.struct(*STATS.names).alias("s"))


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words)"


def bands(stats: DataFrame, above: float = 1.5, below: float = 3.0, least: int = 50) -> DataFrame:
    """``band_lang, low, top``: fences around the quartiles of the log perplexity of all
    documents of a language that pass the base rules; both move out by a slack over the
    root of a text's words (``_verdicts``).  A language of fewer than ``least`` such
    documents takes the band of all languages together, if they have as many."""
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 1000)
    ok = stats.where(f"NOT {BASE_FAILED} AND log_perplexity IS NOT NULL")
    every = ok.agg(F.count("*").alias("all_n"), q.alias("all_q"))
    own = ok.groupBy(F.col("lang").alias("band_lang")).agg(F.count("*").alias("n"), q.alias("q"))
    return own.crossJoin(F.broadcast(every)).where(f"greatest(n, all_n) >= {least}").withColumn(
        "q", F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("all_q"))).select(
        "band_lang", F.expr(f"q[0] - {below} * (q[1] - q[0])").alias("low"), F.expr(f"q[1] + {above} * (q[1] - q[0])").alias("top"))


def judged(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, log_perplexity, low and high
    (the band), base_failed and kept.

    A null or empty text has no words and fails the base rules.  Null languages are a
    language of their own.  Without a model, or where too few documents of all
    languages make a band, only the base rules count."""
    same = model is not None and model.docs is docs
    stats = materialized(statistics(docs, model, doc_id, doc_id, text, lang, same).withColumnRenamed("id", "doc_id"), "quality")
    return _verdicts(stats, "lang", "s").select("doc_id", "s.*", "low", "high", "base_failed", "kept")


def _verdicts(rows: DataFrame, lang: str, s: str) -> DataFrame:
    """``rows`` with a struct ``s`` of statistics and the columns low, high, base_failed and
    kept.  The bands are a row per language."""
    band = materialized(bands(rows.select(F.col(lang).alias("lang"), f"{s}.*")), "bands").withColumnRenamed("low", "band_low")
    n, score = F.col(f"{s}.n_words"), F.col(f"{s}.log_perplexity")
    failed = (n < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > REPEAT_SHARE * n)
    root = F.sqrt(F.greatest(n, F.lit(1)))
    low, high = F.col("band_low") - LOW_SLACK / root, F.col("top") + SLACK / root
    outside = F.coalesce((score < low) | (score > high), F.lit(False))
    return rows.join(band, F.col(lang).eqNullSafe(F.col("band_lang")), "left").select(
        rows["*"], low.alias("low"), high.alias("high"), failed.alias("base_failed"), (~failed & ~outside).alias("kept"))


def filtered(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows that the rules reject.  Rows are written with a number
    and read back; the numbers of rejected rows are small beside the texts."""
    inner = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    place = dict(zip(docs.columns, inner))
    rows = materialized(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "numbered")
    same = model is not None and model.docs is docs
    stats = materialized(statistics(rows, model, "row", place[model.doc_id] if same else "row", place[text], place[lang], same), "measured")
    out = small(_verdicts(stats, "lang", "s").where("NOT kept").select("id"), 4_000_000)
    return rows.join(out, rows["row"] == out["id"], "left_anti").select(*inner).toDF(*docs.columns)


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judged(docs, train(docs, good_ids(labels)))
    return out.select("doc_id", *STATS.names[:5], "base_failed", "kept", "log_perplexity", "low", "high")
