"""Operator 10: linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, read, record, utf8
from quantloom.llm.linear import MIX, Rows, fit_logistic, fit_platt, once, sigmoid

SCHEMA = (("doc_id", pa.int64()), ("score", pa.float64()))
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


@dataclass(frozen=True)
class ToxicityModel:
    """orders: lengths of the n-grams in bytes of the text in lower case with signs as blanks.

    bits: the features are 2 ** bits hash buckets. max_positive, max_negative: the fit takes at most so many
    labelled rows of either class, the first by hash of doc_id. smoothing: of the log-count ratios. penalty,
    steps: of the regression. least_rows, least_ratio: a feature needs so many rows in the fit,
    and so large a ratio. folds: fits whose scores of unseen rows calibrate the last fit on all.
    """

    orders: tuple[int, ...] = (4, 6)
    bits: int = 18
    max_positive: int = 2000
    max_negative: int = 2400
    smoothing: float = 1.0
    penalty: float = 3e-4
    steps: int = 40
    least_rows: int = 3
    least_ratio: float = 0.3
    folds: int = 2


def ngrams(text: bytes, orders: tuple[int, ...], bits: int, scratch: np.ndarray) -> np.ndarray:
    """Buckets of the text's n-grams, each once; blanks stand before and after the text."""
    clean = b" " + b" ".join(text.translate(LOWER).split()) + b" "
    codes = np.frombuffer(clean, np.uint8).astype(np.uint64)
    found = []
    for n in orders:
        size = len(codes) - n + 1
        if size > 0:
            h = codes[:size].copy()
            for i in range(1, n):
                h = (h << np.uint64(8)) | codes[i : size + i]
            found.append(((h * MIX) >> np.uint64(64 - bits)).astype(np.int64))
    return once(np.concatenate(found), scratch) if found else np.empty(0, np.int64)


def crc_mod(doc_id, mod: int = 5):
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, limits: dict[int, int], held_out: bool = True) -> DataFrame:
    """doc_id, text and y of at most limits[y] labelled rows for each y, the first by hash of doc_id, one row each.

    The chosen ids are bounded by the limits, so they are broadcast and only their texts are shuffled. Of rows that
    share a doc_id, the one with the least text is taken, so that the rows are bounded as the ids are.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out:
        own = own.filter(crc_mod(F.col("doc_id")) != 0)
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in limits.items()]
    chosen = parts[0].unionByName(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


@dataclass
class Fitted:
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, index: np.ndarray) -> float:
        return float(sigmoid(self.slope * (self.weights[index].sum() + self.intercept) + self.shift))


def fit(rows: list[np.ndarray], y: np.ndarray, model: ToxicityModel) -> Fitted:
    """Weights times log-count ratios. Without both classes every score is on the side of the one there is, or 0.5.

    Calibrated on scores of rows by fits that haven't seen them, one for each fold.
    """
    width = 1 << model.bits
    if not len(y) or y.min() == y.max():
        return Fitted(np.zeros(width), 0.0, 1.0, 0.0 if not len(y) else (2.0 if y[0] else -2.0))
    x = Rows(rows, width)
    rows.clear()
    folds = np.arange(len(y)) % model.folds
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        folds[own] = np.arange(len(own)) % model.folds
    unseen = np.zeros(len(y))
    for k in range(model.folds):
        seen = folds != k
        if y[seen].min() < y[seen].max():
            w, b = weigh(x, y, seen.astype(float), model)
            unseen[~seen] = (x.dot(w) + b)[~seen]
    slope, shift = fit_platt(unseen, y)
    w, b = weigh(x, y, np.ones(len(y)), model)
    return Fitted(w, b, max(slope, 1e-3), shift)


def weigh(x: Rows, y: np.ndarray, use: np.ndarray, model: ToxicityModel) -> tuple[np.ndarray, float]:
    """Weights, ratios included, and intercept from the rows with use 1."""
    pos, neg = x.back(y * use), x.back((1 - y) * use)
    n_pos, n_neg, smooth = (y * use).sum(), ((1 - y) * use).sum(), model.smoothing
    ratio = np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((neg + smooth) / (n_neg + 2 * smooth))
    kept = np.flatnonzero((pos + neg >= model.least_rows) & (np.abs(ratio) > model.least_ratio))
    own, scale = x.narrowed(kept), ratio[kept]
    weight = use * np.where(y > 0, 0.5 / n_pos, 0.5 / n_neg)
    w, b = fit_logistic(lambda w: own.dot(w * scale), lambda g: own.back(g) * scale, len(kept), y, weight, model.penalty, model.steps)
    out = np.zeros(x.width)
    out[kept] = w * scale
    return out, b


def sampled(chosen: DataFrame, model: ToxicityModel) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of the chosen rows, made on the executors."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        scratch = np.empty(1 << model.bits, np.int32)
        rows = [ngrams(t, model.orders, model.bits, scratch).astype(np.int32).tobytes() for t in utf8(batch)]
        return record((("doc_id", pa.int64()), ("x", pa.binary()), ("y", pa.int32())), [batch.column(0), rows, batch.column(2)])

    out = arrow_map(chosen.select("doc_id", "text", "y"), of, "doc_id long, x binary, y int")
    rows = [(r["doc_id"], np.frombuffer(r["x"], np.int32), r["y"]) for r in out.toLocalIterator()]
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    return [r[1] for r in rows], np.asarray([r[2] for r in rows], float)


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel = ToxicityModel()) -> DataFrame:
    """doc_id and score, the probability of label 1, for each row of docs; held_out if its label was never used.

    Fitted on a bounded sample (see ToxicityModel) of rows whose crc32(doc_id) mod 5 isn't 0; only the text is
    an input. Null and empty texts get the score of a text without n-grams of words. Null doc_id: scored,
    held_out null. Labels without a document, or null, are ignored; of several labels the largest counts. With
    one class or none all scores are alike. Empty docs: no rows.
    """
    chosen = labelled(docs, labels, "toxic", {1: model.max_positive, 0: model.max_negative})
    fitted = fit(*sampled(chosen, model), model)
    sent = docs.sparkSession.sparkContext.broadcast(fitted)  # 2 ** bits numbers, whatever the input

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        scratch = np.empty(1 << model.bits, np.int32)
        return record(SCHEMA, [batch.column(0), [sent.value.score(ngrams(t, model.orders, model.bits, scratch)) for t in utf8(batch)]])

    out = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
