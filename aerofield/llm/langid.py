"""Language ID: blended-spectrum string kernels, Nyström landmarks, ridge regression."""
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from aerofield.llm.common import crc_mod, uniform, whole_texts
from aerofield.session import materialized

SYMBOLS = 64  # 0: no letter, 1-26: a-z, the rest: other letters by code point
GRAMS = SYMBOLS + SYMBOLS ** 2 + SYMBOLS ** 3  # all 1-, 2- and 3-grams of symbols
UNDETERMINED = "und"


def _symbol(char: str) -> int:
    if not char.isalpha():
        return 0
    low = char.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SYMBOLS - 27)


@functools.cache
def _symbols() -> np.ndarray:
    return np.array([_symbol(chr(i)) for i in range(1 << 16)], np.uint8)


def symbols(text: str) -> np.ndarray:
    """The text as symbols, runs of non-letters as one; empty without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _symbols()[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]).tolist():
        out[points == p] = _symbol(chr(p))
    if not out.any():
        return out[:0]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return np.concatenate([[0], out[keep], [0]]).astype(np.int32)


class Presence:
    """Distinct n-grams of a text, by a table of marks."""

    def __init__(self):
        self.marks = np.zeros(GRAMS, bool)

    def of(self, text: str | None) -> np.ndarray:
        c = symbols(text or "")
        if not len(c):
            return np.zeros(0, np.int64)
        two = c[:-1] * SYMBOLS + c[1:]
        self.marks[c] = True
        self.marks[SYMBOLS + two] = True
        self.marks[SYMBOLS + SYMBOLS ** 2 + two[:-1] * SYMBOLS + c[2:]] = True
        found = np.flatnonzero(self.marks)
        self.marks[found] = False
        return found


@dataclass(frozen=True)
class Model:
    """One score per language.  A text x has the normalised kernels k(x, z) / sqrt(k(x, x)
    k(z, z)) with the landmarks z, where k counts common n-grams; scores are those
    kernels times the ridge weights.  As k(x, z) is the product of presence vectors, the
    landmarks' vectors and the weights are multiplied once into ``table`` (n-gram row,
    language), and a batch of texts is one product with it."""
    langs: list[str]
    rows: np.ndarray  # n-gram to row of table, or -1
    table: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(texts), 64):
            part = texts[at:at + 64]
            own = [self.rows[t] for t in part]
            x = np.zeros((len(part), len(self.table)), np.float32)
            for i, r in enumerate(own):
                x[i, r[r >= 0]] = 1.0
            size = np.sqrt([max(len(t), 1) for t in part])
            out[at:at + 64] = x @ self.table / size[:, None] + self.bias
        return out


def fit(langs: list[str], texts: list[np.ndarray], landmarks: int = 128, ridge: float = 1e-2) -> Model:
    """One-versus-rest kernel ridge regression on Nyström features.  Landmarks are the
    first texts of each language in turn."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    order = sorted(range(len(langs)), key=lambda i: (int((label[:i] == label[i]).sum()), label[i]))
    marks = order[:landmarks]
    grams = np.unique(np.concatenate([texts[i] for i in marks]))
    rows = np.full(GRAMS, -1, np.int32)
    rows[grams] = np.arange(len(grams))
    z = np.zeros((len(grams), len(marks)), np.float32)
    for j, i in enumerate(marks):
        z[rows[texts[i]], j] = 1.0
    z /= np.sqrt(z.sum(axis=0, keepdims=True))
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    use = values > 1e-6 * values.max()
    whiten = vectors[:, use] / np.sqrt(values[use])
    kernels = Model(list(map(str, marks)), rows, z, np.zeros(len(marks))).scores(texts)
    phi = kernels @ whiten
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, middle = phi.mean(axis=0), y.mean(axis=0)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + ridge * len(y) * np.eye(phi.shape[1]), centred.T @ (y - middle))
    return Model(names, rows, (z @ (whiten @ w)).astype(np.float32), middle - mean @ w)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = 1_600) -> Model | None:
    """A model of a bounded sample: ``documents`` labelled texts, taken from the
    languages in turn by smallest draw.  None without a labelled text with letters."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "key"))
    drawn = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), uniform(10, F.col(doc_id)).alias("u"), F.xxhash64(F.col(text)).alias("key"))
    # of a language with many texts only about 4 * documents small draws are ranked
    many = materialized(drawn.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    drawn = drawn.join(many, "lang").where(F.col("u") * F.col("n") <= 4 * documents).drop("n")
    chosen = (drawn.withColumn("rank", rank).where(F.col("rank") <= documents).orderBy("rank", "u").limit(documents)
              .select("lang", "u", "key").distinct())

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Presence()
        for batch in batches:
            found = [seen.of(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["lang", "u", "grams"])

    texts = docs.select(F.col(lang).cast("string").alias("own"), F.col(text).alias("text"), uniform(10, F.col(doc_id)).alias("draw"))
    rows = (texts.join(F.broadcast(chosen), (F.col("own") == F.col("lang")) & (F.col("draw") == F.col("u")) & (F.xxhash64("text") == F.col("key")))
            .select("lang", "text", "u").mapInArrow(grams, "lang string, u double, grams array<int>").where("size(grams) > 0").toArrow())
    langs, draws = rows["lang"].to_pylist(), rows["u"].to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (draws[i], langs[i]))
    return fit([langs[i] for i in order], [rows["grams"][i].values.to_numpy() for i in order]) if langs else None


def identified(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred and score (0 to 1).

    A null text, one without a letter, and every text if nothing was learned is ``und``
    with score 0.  Of equal scores the first language in order wins.  Texts are used
    whole; only the text is an input."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, seen = held.value, Presence()
        for texts in parts:
            names, scores = [], []
            for at in range(0, len(texts), 512):
                grams = [seen.of(t) for t in texts.iloc[at:at + 512]]
                values = own.scores(grams) if own else np.zeros((len(grams), 1))
                best = values.argmax(axis=1)
                for g, i, v in zip(grams, best, values):
                    known = own is not None and len(g) > 0
                    names.append(own.langs[i] if known else UNDETERMINED)
                    scores.append(min(max((v[i] + 1) / 2, 0.0), 1.0) if known else 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return whole_texts(docs).select(F.col(doc_id).alias("doc_id"), predict(F.col(text)).alias("p")).select("doc_id", "p.*")


def query(docs: DataFrame) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    return identified(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
