"""Operator 11: URLs judged by rules, the others by the ratio of two character language models.

The models are interpolated Markov models of variable order: a symbol's probability after the last order symbols
rests on what is known of the longest such context, then on shorter ones (Witten-Bell). One is counted on the
accepted URLs, one on the rejected ones, whole and all of them. The difference of the logarithms, by length, is
calibrated on URLs of hosts that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, fresh, read, record, staged, utf8

BEGIN, END = "\x02", "\x03"
#: Code points there are: the models' last resort is that all are alike.
SYMBOLS = 1_114_112
SCHEMA = (("row", pa.int64()), ("gram", pa.string()), ("label", pa.string()), ("half", pa.int32()))


@dataclass(frozen=True)
class Rule:
    """verdict for host and its subdomains where the path starts with path; name is what the result shows."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class UrlModels:
    """order: symbols of the longest context. prior: share of acceptable URLs among those without a rule.

    A URL is allowed if it is acceptable with a probability of at least sure.
    """

    order: int = 5
    prior: float = 0.5
    sure: float = 0.5


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equally long ones the first), or null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(reversed(list(rules)), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(rows: DataFrame, order: int, at_once: int = 50_000) -> DataFrame:
    """row, label and half with each symbol of the url, and the end, after the order symbols before it.

    Batches hold about at_once symbols however long a URL is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for row, label, half, url in zip(*(batch.column(k).to_pylist() for k in ("row", "label", "half")), utf8(batch, "url"), strict=True):
                text = BEGIN * order + url.decode("utf-8", "replace") + END
                for i in range(len(text) - order):
                    held.append((row, text[i : i + order + 1], label, half))
                    if len(held) >= at_once:
                        yield record(SCHEMA, list(zip(*held)))
                        held = []
            if held:
                yield record(SCHEMA, list(zip(*held)))

    return rows.select("row", "url", "label", "half").mapInArrow(scan, "row long, gram string, label string, half int")


#: Models: counted on both halves of the hosts, on the first, on the second.
HALVES = (None, 0, 1)
MODELS = [f"{kind}{k}" for kind in ("a", "r") for k in range(len(HALVES))]


def counts(found: DataFrame) -> DataFrame:
    """gram with n (its rows) and its count for each model; found has gram, label and half."""
    cells = []
    for kind, label in (("a", "allow"), ("r", "block")):
        for k, half in enumerate(HALVES):
            here = (F.col("label") == label) if half is None else (F.col("label") == label) & (F.col("half") == half)
            cells.append(F.sum(here.cast("long")).alias(f"{kind}{k}"))
    out = found.groupBy("gram").agg(F.count("*").alias("n"), *cells)
    return out.fillna(0, MODELS)


def smoothed(n: Column, total: Column, kinds: Column, shorter: Column) -> Column:
    """Witten-Bell: a context's kinds of successors are the weight of what is known after shorter ones."""
    return F.when(total + kinds > 0, (n + kinds * shorter) / (total + kinds)).otherwise(shorter)


def models(counted: DataFrame, order: int) -> DataFrame:
    """gram, n and lr0 to lr2, the logarithm of the ratio of its last symbol's probabilities, for each of HALVES.

    Only distinct grams are joined: with their context's sums, and with the gram without its first symbol. Either
    has as many partners as there are symbols, at most.
    """
    tables = [counted]
    for _ in range(order):
        shorter = tables[-1].groupBy(F.substring("gram", 2, order + 1).alias("gram")).agg(*(F.sum(c).alias(c) for c in ("n", *MODELS)))
        tables.append(staged(shorter, "grams"))
    known = None
    for size, table in enumerate(reversed(tables)):
        totals = [F.sum(m).alias(f"t_{m}") for m in MODELS] + [F.sum((F.col(m) > 0).cast("long")).alias(f"k_{m}") for m in MODELS]
        if known is None:
            sums = table.agg(*totals).first()
            shown = table.select("*", *(F.lit(sums[c] or 0).alias(c) for c in sums.asDict()), *(F.lit(1 / SYMBOLS).alias(f"s_{m}") for m in MODELS))
        else:
            keyed = table.withColumns({"context": F.substring("gram", 1, size), "rest": F.substring("gram", 2, size)})
            contexts = keyed.groupBy("context").agg(*totals)
            shown = keyed.join(contexts, "context").join(known.select(F.col("gram").alias("rest"), *(F.col(f"p_{m}").alias(f"s_{m}") for m in MODELS)), "rest")
        known = staged(shown.select("gram", "n", *(smoothed(F.col(m), F.col(f"t_{m}"), F.col(f"k_{m}"), F.col(f"s_{m}")).alias(f"p_{m}") for m in MODELS)), "known")
    return known.select("gram", "n", *((F.log(f"p_a{k}") - F.log(f"p_r{k}")).alias(f"lr{k}") for k in range(len(HALVES))))


def calibration(scored: DataFrame, prior: float) -> tuple[float, float]:
    """Slope and intercept of the log odds of a score, from labelled URLs scored by the model of the other hosts.

    The two labels' scores are taken as normal with one variance, which makes the log odds a line. Scores that do
    not tell the labels apart, or not the right way round, and a missing label give a slope of 0.
    """
    other = F.when(F.col("half") == 0, F.col("score2")).otherwise(F.col("score1"))
    sums = {r["label"]: r for r in scored.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"), F.avg(other).alias("mean"), F.var_pop(other).alias("var")).collect()}
    base = log(prior / (1 - prior))
    if len(sums) < 2:
        return 0.0, base
    a, r = sums["allow"], sums["block"]
    variance = (a["n"] * a["var"] + r["n"] * r["var"]) / (a["n"] + r["n"])
    slope = max(a["mean"] - r["mean"], 0.0) / max(variance, 1e-9)
    return slope, base - slope * (a["mean"] + r["mean"]) / 2


def url_filter(pages: DataFrame, rules: Sequence[Rule] = RULES, config: UrlModels = UrlModels(), url: str = "url", label: str | None = None) -> DataFrame:
    """The rows of pages with host, path, rule, verdict, score and probability added (under further underscores where taken).

    URLs that a rule fits get its verdict and teach the models, as accepted or rejected, all of them, copies
    included. The others are allowed if they are acceptable with a probability of at least config.sure; score is
    the difference of log likelihoods a symbol, the end among them. label: a column that says allow or block of
    the URLs to learn from, in place of the rules' verdicts.
    A null or empty URL has its end alone; one without :// has neither host nor path, and no rule. Without URLs of
    both kinds all without a rule have the prior's probability. An empty table gives no rows. rules are a stated
    list, tested one by one.
    """
    taken = pages.columns
    host, path = host_of(F.col(url)), path_of(F.col(url))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    bare = pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*taken).alias("page"), F.col(url).alias("url"), (F.col(label) if label else F.lit(None).cast("string")).alias("given"), host.alias("host"), path.alias("path"))
    bare = bare.withColumns({"rule": name, "by_rule": verdict})
    own = F.col("given") if label else F.col("by_rule")
    own = F.when(own.isin("allow", "block"), own)
    rows = staged(bare.withColumn("label", own).withColumn("half", F.ascii(F.md5("host")) % 2).drop("given"), "urls")
    found = staged(grams(rows, config.order), "found")
    known = models(staged(counts(found), "counts"), config.order)
    told = counted_join(found.select("row", "gram"), staged(known, "ratios"), ["gram"], found.count())
    scores = told.groupBy("row").agg(*(F.avg(f"lr{k}").alias(f"score{k}") for k in range(len(HALVES))))
    scored = staged(rows.join(scores, "row"), "scored")
    slope, intercept = calibration(scored, config.prior)
    probability = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score0") + F.lit(intercept))))
    judged = F.coalesce("by_rule", F.when(probability >= config.sure, "allow").otherwise("block"))
    added = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule"), "verdict": judged, "score": F.col("score0"), "probability": probability}
    return scored.select("page.*", *(c.alias(fresh(taken, k)) for k, c in added.items()))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")
