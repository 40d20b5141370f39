"""Operator 2: quality by co-training of a text view and a metadata view, combined after calibration.

Each view is a logistic regression whose features are scaled by log-count ratios. In each round every document is
scored on the executors, and those of which a view is sure, by exact thresholds over the corpus, become labelled
rows of the other view: all of them in the counts behind its ratios, and a bounded sample of them in its fit, beside
the rows that were labelled from the start. A text counts once, however many copies of it there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, dropped, read, record, staged
from quantloom.llm.linear import MIX, Rows, fit_logistic, fit_mix, fit_platt, once, sigmoid

SCHEMA = (("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64()))
#: Margins are told apart in steps of 1 / STEPS up to MOST.
STEPS, MOST = 32, 20
LEVELS = 2 * STEPS * MOST + 1


@dataclass(frozen=True)
class CoTraining:
    """max_labelled: labelled rows of each class in the fit at most, the first by hash of doc_id. rounds; share: of
    the corpus' unlabelled documents, labelled by each view for the other in the first round, twice that in the
    second and so on; confident: least probability of such a label. max_pseudo: of these, about so many of each class
    at most are in the other view's fit, drawn by hash with the texts' weights; trust: the weight of each, that of a
    labelled row being 1. text_bits, meta_bits: buckets of the views, 16 at most. smoothing: of the log-count ratios.
    penalty, steps: of the fits.
    """

    max_labelled: int = 2000
    max_pseudo: int = 1000
    trust: float = 0.5
    rounds: int = 3
    share: float = 0.1
    confident: float = 0.9
    text_bits: int = 16
    meta_bits: int = 12
    smoothing: float = 1.0
    penalty: float = 1e-3
    steps: int = 40


def bucket(*parts: object, bits: int) -> int:
    return zlib.crc32(repr(parts).encode()) & ((1 << bits) - 1)


def text_features(text: bytes, bits: int, scratch: np.ndarray) -> np.ndarray:
    """Buckets of the raw bytes' 3-grams and of stepped shares of repeats, capitals, signs, digits and words' lengths."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    n = max(len(codes), 1)
    upper = ((codes >= 65) & (codes <= 90)).sum() / n
    letters = ((codes >= 97) & (codes <= 122) | (codes >= 128)).sum() / n
    digits = ((codes >= 48) & (codes <= 57)).sum() / n
    shares = (len(set(words)) / max(len(words), 1), upper, letters, digits, len(b"".join(words)) / max(len(words), 1) / 20)
    own = [bucket("share", i, int(min(s, 1) * 20), bits=bits) for i, s in enumerate(shares)]
    own.append(bucket("words", int(np.log2(len(words) + 1)), bits=bits))
    h = codes.astype(np.uint64)
    h = (h[:-2] << np.uint64(16)) | (h[1:-1] << np.uint64(8)) | h[2:] if len(h) > 2 else h[:0]
    grams = ((h * MIX) >> np.uint64(64 - bits)).astype(np.int64)
    return once(np.concatenate([grams, np.asarray(own, np.int64)]), scratch)


def stepped(x: float) -> int:
    return int(2 * np.log2(x + 1))


def meta_features(lang: str | None, source: str | None, n_chars: int | None, text: bytes, bits: int) -> np.ndarray:
    """Buckets of the page's host, language, stepped length and layout: the number of its lines, their mean and
    greatest length and how many of them are new. What the lines say is not in it.
    """
    lines = text.split(b"\n")
    size = None if n_chars is None else stepped(max(n_chars, 0))
    n, mean, most = stepped(len(lines)), stepped(len(text) / len(lines)), stepped(max(map(len, lines)))
    new = int(10 * len(set(lines)) / len(lines))
    parts = (("lang", lang), ("source", source), ("size", size), ("lang size", lang, size), ("lines", n), ("mean", mean), ("most", most), ("new", new), ("lines mean", n, mean), ("mean most", mean, most))
    return np.unique([bucket(*p, bits=bits) for p in parts]).astype(np.int64)


def packed(index: np.ndarray) -> bytes:
    """Distinct indices as bytes: the gaps of the sorted indices, each as often 255 as it holds that, and the rest."""
    gaps = np.diff(np.sort(index), prepend=0)
    out = np.full(int((gaps // 255 + 1).sum()), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(column: pa.Array, width: int) -> Rows:
    """The rows of a column of packed indices."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    total = np.concatenate([[0], np.cumsum(codes, dtype=np.int64)])
    row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(bounds))
    ends = np.flatnonzero(codes != 255)
    out = Rows([], width)
    out.n, out.row = len(column), row[ends]
    out.index = (total[ends + 1] - total[bounds[out.row]]).astype(np.int32)
    return out


@dataclass
class View:
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: Rows) -> np.ndarray:
        """Calibrated log-odds of quality 1 of each row."""
        return self.slope * (x.dot(self.weights) + self.intercept) + self.shift


@dataclass
class Counts:
    """Of the rows of either class (0, 1): their weight, and that of those with each feature."""

    n: np.ndarray
    each: np.ndarray

    @classmethod
    def of(cls, x: Rows, weight: np.ndarray, positive: np.ndarray) -> Counts:
        both = [weight * ~positive, weight * positive]
        return cls(np.asarray([w.sum() for w in both]), np.stack([x.back(w) for w in both]))

    def ratios(self, smooth: float) -> np.ndarray:
        share = np.log((self.each + smooth) / (self.n[:, None] + 2 * smooth))
        return share[1] - share[0]


def level(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(margin * STEPS), -STEPS * MOST, STEPS * MOST).astype(np.int64) + STEPS * MOST


def cuts(weight: np.ndarray, share: float, prior: float, confident: float) -> tuple[int, int]:
    """Levels from which on up, and down, labels are confident. weight: of the documents at each level.

    weight is by margins for classes of one size. At most share of all, parted by the prior, is taken, whole levels
    alone, and none below the confident odds, be the classes of one size or as the prior has them: the rarer class is
    else mostly taken in error, and the other for its size alone.
    """
    sure, positive, total = np.log(confident / (1 - confident)), sigmoid(np.asarray(prior)), weight.sum()
    down, up = np.cumsum(weight), np.cumsum(weight[::-1])[::-1]
    high = np.flatnonzero((up <= share * positive * total) & (np.arange(LEVELS) >= level(np.asarray(max(sure, sure - prior)))))
    low = np.flatnonzero((down <= share * (1 - positive) * total) & (np.arange(LEVELS) <= level(np.asarray(min(-sure, -sure - prior)))))
    return (int(high[0]) if len(high) else LEVELS), (int(low[-1]) if len(low) else -1)


def drawn(doc_id: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that look random, by hash of a row's id and text."""
    h = (doc_id.view(np.uint64) * MIX) ^ digest.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) / 2.0**64


#: Labelled rows of a view, and their labels.
Labelled = tuple[Rows, np.ndarray]


class Pool:
    """Unlabelled rows, of which the rounds ask for the weight at each level of margin, for counts by label and for
    labelled rows. draw: numbers from 0 to 1 by which rows are sampled.
    """

    def __init__(self, views: list[Rows], weight: np.ndarray, draw: np.ndarray | None = None):
        self.views, self.weight = views, weight
        self.draw = np.zeros(len(weight)) if draw is None else draw

    def levels(self, fitted: list[View]) -> np.ndarray:
        return np.stack([np.bincount(level(f.margin(x)), self.weight, LEVELS) for f, x in zip(fitted, self.views, strict=True)])

    def labels(self, fitted: list[View], between: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each view, which rows the other view labels, and which of them with 1."""
        for v in (0, 1):
            at = level(fitted[1 - v].margin(self.views[1 - v]))
            high, low = between[1 - v]
            yield (at >= high) | (at <= low), at >= high

    def counts(self, fitted: list[View], between: list[tuple[int, int]]) -> list[Counts]:
        """For each view, of the rows that the other view labels."""
        found = self.labels(fitted, between)
        return [Counts.of(x, self.weight * sure, positive) for x, (sure, positive) in zip(self.views, found, strict=True)]

    def chosen(self, fitted: list[View], between: list[tuple[int, int]], rates: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view, the numbers of rows that the other view labels, drawn with rates (by view and label) times weight, and their labels."""
        out = []
        for v, (sure, positive) in enumerate(self.labels(fitted, between)):
            at = np.flatnonzero(sure & (self.draw < self.weight * rates[v][positive.astype(int)]))
            out.append((at, positive[at].astype(float)))
        return out

    def rows(self, fitted: list[View], between: list[tuple[int, int]], rates: np.ndarray) -> list[Labelled]:
        return [(x.taken(at), y) for x, (at, y) in zip(self.views, self.chosen(fitted, between, rates), strict=True)]


class Corpus(Pool):
    """A staged table of features (doc_id, digest, text, meta, y, weight), worked through on the executors; its totals are summed there too.

    fan: rows that are summed into one at most, so that the driver gets as many vectors at most.
    """

    def __init__(self, features: DataFrame, rules: CoTraining, fan: int = 16):
        self.features, self.fan = features, fan
        self.widths = (1 << rules.text_bits, 1 << rules.meta_bits)

    def summed(self, of, size: int) -> np.ndarray:
        """Sum over the table's batches of of(Pool), a vector of so many numbers."""
        widths = self.widths
        schema = (("total", pa.binary()),)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                views = [unpacked(batch.column(k), w) for k, w in zip(("text", "meta"), widths, strict=True)]
                total += of(Pool(views, batch.column("weight").to_numpy()))
            yield record(schema, [[total.tobytes()]])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for each in batch.column("total").to_pylist():
                    total += np.frombuffer(each)
            yield record(schema, [[total.tobytes()]])

        out = self.features.filter("y IS NULL").select("text", "meta", "weight").mapInArrow(scan, "total binary")
        n = self.features.rdd.getNumPartitions()
        while n > self.fan:
            n = -(-n // self.fan)
            out = out.repartition(n).mapInArrow(add, "total binary")
        total = np.zeros(size)
        for row in out.toLocalIterator():
            total += np.frombuffer(row["total"])
        return total

    def levels(self, fitted: list[View]) -> np.ndarray:
        return self.summed(lambda pool: pool.levels(fitted).ravel(), 2 * LEVELS).reshape(2, LEVELS)

    def counts(self, fitted: list[View], between: list[tuple[int, int]]) -> list[Counts]:
        def of(pool: Pool) -> np.ndarray:
            return np.concatenate([x for c in pool.counts(fitted, between) for x in (c.n, c.each.ravel())])

        total, out = self.summed(of, sum(2 + 2 * w for w in self.widths)), []
        for width in self.widths:
            own, total = np.split(total, [2 + 2 * width])
            out.append(Counts(own[:2], own[2:].reshape(2, width)))
        return out

    def rows(self, fitted: list[View], between: list[tuple[int, int]], rates: np.ndarray) -> list[Labelled]:
        """Those drawn on the executors alone come to the driver: rates bound their number."""
        widths = self.widths
        schema = (("view", pa.int32()), ("y", pa.float64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("x", pa.binary()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                views = [unpacked(batch.column(k), w) for k, w in zip(("text", "meta"), widths, strict=True)]
                ids = [batch.column(k).fill_null(0).to_numpy() for k in ("doc_id", "digest")]
                pool = Pool(views, batch.column("weight").to_numpy(), drawn(*ids))
                for v, (at, y) in enumerate(pool.chosen(fitted, between, rates)):
                    x = batch.column(("text", "meta")[v]).take(pa.array(at))
                    yield record(schema, [np.full(len(at), v, np.int32), y, ids[0][at], ids[1][at], x])

        out = self.features.filter("y IS NULL").select("doc_id", "digest", "text", "meta", "weight")
        out = out.mapInArrow(scan, "view int, y double, doc_id long, digest long, x binary").groupBy("view", "doc_id", "digest").agg(F.min(F.struct("y", "x")).alias("r"))
        found = sorted((r["view"], r["doc_id"], r["digest"], r["r"]["y"], bytes(r["r"]["x"])) for r in out.toLocalIterator())
        own = [[r for r in found if r[0] == v] for v in (0, 1)]
        return [(unpacked(pa.array([r[4] for r in of], pa.binary()), w), np.asarray([r[3] for r in of], float)) for of, w in zip(own, widths, strict=True)]


def rates_of(at: np.ndarray, between: list[tuple[int, int]], most: int) -> np.ndarray:
    """By view and label, the share of the rows that the other view labels which gives most rows. at: weights by view and level."""
    sure = [(at[v][: between[v][1] + 1].sum(), at[v][between[v][0] :].sum()) for v in (1, 0)]
    return np.minimum(1.0, most / np.maximum(sure, 1e-9))


def fit_view(x: Rows, y: np.ndarray, use: np.ndarray, more: Counts | None, pseudo: Labelled | None, rules: CoTraining) -> View:
    """y and use: labels and weights of all rows of x, classes weigh alike. Of the rows labelled by the other view,
    more has the counts of all, and pseudo those that are in the fit.
    """
    counts = Counts.of(x, use, y > 0.5)
    if more is not None:
        counts = Counts(counts.n + more.n, counts.each + more.each)
    scale = counts.ratios(rules.smoothing)
    if pseudo is not None:
        x, y, use = x.followed(pseudo[0]), np.concatenate([y, pseudo[1]]), np.concatenate([use, np.full(len(pseudo[1]), rules.trust)])
    pos, neg = (use * y).sum(), (use * (1 - y)).sum()
    weight = use * np.where(y > 0.5, 0.5 / max(pos, 1e-9), 0.5 / max(neg, 1e-9))
    w, b = fit_logistic(lambda w: x.dot(w * scale), lambda g: x.back(g) * scale, x.width, y, weight, rules.penalty, rules.steps)
    return View(w * scale, b)


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float
    mix: tuple[float, float, float] = (1.0, 1.0, 0.0)

    def score(self, text: Rows, meta: Rows) -> list[np.ndarray]:
        """Each view's probability and that of both: log-odds add, weighed by mix, and the prior's once."""
        a, b = self.text.margin(text), self.meta.margin(meta)
        u, v, shift = self.mix
        return [sigmoid(m) for m in (a, b, u * (a - self.prior) + v * (b - self.prior) + shift + self.prior)]


def co_train(x: list[Rows], y: np.ndarray, prior: float, rules: CoTraining, pool: Pool) -> CoTrained:
    """x, y: labelled rows of both views, 1 or 0. One in four calibrates and is in no fit.

    In each round, each view, calibrated anew, labels the pool rows of which it is surest, by class in the share
    of the prior, for the other view, which is fitted anew with them: its ratios count all, its regression has a
    sample of them. A view that tells nothing is never sure. With one class or none, all scores are that class's or 0.5.
    """
    if not len(y) or y.min() == y.max():
        shift = 0.0 if not len(y) else (2.0 if y[0] == 1 else -2.0)
        return CoTrained(*(View(np.zeros(v.width), 0.0, 1.0, shift) for v in x), prior=shift)
    held = np.arange(1, len(y) + 1) % 4 == 0
    more: list[Counts | None] = [None, None]
    pseudo: list[Labelled | None] = [None, None]
    for turn in range(rules.rounds + 1):
        fitted = [fit_view(x[v], y, (~held).astype(float), more[v], pseudo[v], rules) for v in (0, 1)]
        for v in (0, 1):
            raw = fitted[v].margin(x[v])
            slope, shift = fit_platt(raw[held], y[held], balanced=True)
            fitted[v].slope, fitted[v].shift = (slope, shift) if slope > 0 else (0.0, 0.0)
        if turn == rules.rounds:
            break
        at = pool.levels(fitted)
        between = [cuts(at[v], min(rules.share * (turn + 1), 1.0), prior, rules.confident) for v in (0, 1)]
        more, pseudo = pool.counts(fitted, between), pool.rows(fitted, between, rates_of(at, between, rules.max_pseudo))
    mix = fit_mix(*(f.margin(v)[held] for f, v in zip(fitted, x, strict=True)), y[held])
    for view in fitted:
        view.shift += prior
    return CoTrained(*fitted, prior=prior, mix=mix)


def chosen_rows(labels: DataFrame, rules: CoTraining) -> tuple[DataFrame, float]:
    """id and y of the labels of the fit, bounded by the rules, and the labels' prior log-odds."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    parts = [own.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rules.max_labelled) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), prior


def features(docs: DataFrame, rules: CoTraining) -> DataFrame:
    """doc_id, digest (hash of the text) and the packed features of both views for each row of docs."""
    columns = ["text", "lang", "source", "n_chars"]
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))

    def scan(batches):
        scratch = np.empty(1 << rules.text_bits, np.int32)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
            text = [packed(text_features(t or b"", rules.text_bits, scratch)) for t, *_ in rows]
            meta = [packed(meta_features(*m, t or b"", rules.meta_bits)) for t, *m in rows]
            yield record((("doc_id", pa.int64()), ("digest", pa.int64()), ("text", pa.binary()), ("meta", pa.binary())), [batch.column("doc_id"), batch.column("digest"), text, meta])

    return bare.mapInArrow(scan, "doc_id long, digest long, text binary, meta binary")


def quality_classifier(docs: DataFrame, labels: DataFrame, rules: CoTraining = CoTraining()) -> DataFrame:
    """doc_id, text_score, meta_score and score, the probability of quality 1, for each row of docs.

    The regressions are fitted on the driver on a bounded sample of labelled rows (see CoTraining), one row a
    doc_id; the rounds go over all other rows. There, the copies of a text weigh as one row together. The text view
    reads the text, the metadata view lang, source, n_chars and the layout of the text's lines. Null or empty texts
    have no n-grams; nulls in the metadata are values of their own. Repeated rows: one result each.
    Empty docs: no rows.
    """
    context = docs.sparkSession.sparkContext
    chosen, prior = chosen_rows(labels, rules)
    table = features(docs, rules).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"), "left").drop("id")
    table = staged(table, "features")
    copies = staged(table.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1"), "copies")
    each = counted_join(table, copies, ["digest"], table.count(), "left")
    bare, table = table, staged(each.withColumn("weight", F.lit(1.0) / F.coalesce("n", F.lit(1))).drop("n"), "weighed")
    dropped(bare)
    known = table.filter("y IS NOT NULL").groupBy("doc_id", "y").agg(F.min(F.struct("text", "meta")).alias("x"))
    rows = sorted((r["doc_id"], r["y"], bytes(r["x"]["text"]), bytes(r["x"]["meta"])) for r in known.toLocalIterator())
    widths = (1 << rules.text_bits, 1 << rules.meta_bits)
    views = [unpacked(pa.array([r[i] for r in rows], pa.binary()), w) for i, w in zip((2, 3), widths, strict=True)]
    sent = context.broadcast(co_train(views, np.asarray([r[1] for r in rows], float), prior, rules, Corpus(table, rules)))  # 2 ** bits numbers a view

    def score(batches):
        for batch in batches:
            x = [unpacked(batch.column(k), w) for k, w in zip(("text", "meta"), widths, strict=True)]
            yield record(SCHEMA, [batch.column("doc_id"), *sent.value.score(*x)])

    return table.select("doc_id", "text", "meta").mapInArrow(score, "doc_id long, text_score double, meta_score double, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.withColumn("kept", F.col("score") >= 0.5)
