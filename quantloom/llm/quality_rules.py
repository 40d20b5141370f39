"""Operator 8: document rules, host verdicts shrunk by an empirical beta prior, joined back to the documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import arrow_map, counted_join, read, record, staged, utf8

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SCHEMA = (("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in COUNTS))
DDL = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat_percent: the base rules, by which a document goes itself.

    Rules that count against the host alone: max_symbol_percent of word_chars, max_dup_line_percent of lines with a
    word, and characters a word from least_word_chars to most_word_chars.
    A host goes if its failure rate is surely too high: if the rate, shrunk by the prior, less sure standard
    deviations, is above the corpus' rate by more than excess of what is between that and 1.
    least_prior, most_prior: bounds of the beta prior's weight in documents.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 25
    max_dup_line_percent: int = 50
    least_word_chars: int = 2
    most_word_chars: int = 14
    excess: float = 0.25
    sure: float = 2.0
    least_prior: float = 2.0
    most_prior: float = 10_000.0


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    often = Counter(grams)
    total, end = 0, 0
    for i, gram in enumerate(grams):
        if often[gram] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(b"".join(words).translate(None, CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measures(docs: DataFrame, host: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row of counts a document, with the columns carry in a struct, carried; a null text counts as empty."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t) for t in utf8(batch)]
        own = record(SCHEMA, [batch.column(0), batch.column(1), *zip(*rows)])
        return pa.RecordBatch.from_arrays([*own.columns, batch.column("carried")], names=[*own.schema.names, "carried"])

    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text", carried.alias("carried"))
    return arrow_map(bare, of, f"{DDL}, carried {bare.schema['carried'].dataType.simpleString()}")


def beta_prior(hosts: DataFrame, rules: QualityRules) -> tuple[float, float]:
    """Moments of the hosts' failure rates as the two weights of a beta distribution; hosts has n and failed."""
    k, mean, inverse, spread = hosts.agg(
        F.count("*"),
        F.sum("failed") / F.sum("n"),
        F.avg(1 / F.col("n")),
        F.var_samp(F.col("failed") / F.col("n")),
    ).first()
    if not k:
        return 1.0, 1.0
    noise = mean * (1 - mean)
    between = (spread or 0.0) - noise * inverse
    weight = rules.most_prior if between <= 0 else noise / between - 1
    weight = min(max(weight, rules.least_prior), rules.most_prior)
    return mean * weight, (1 - mean) * weight


def failures(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """measured with base_failed and any_failed."""
    n, chars = F.col("n_words"), F.col("word_chars")
    base = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n)
    more = (100 * F.col("n_symbols") > rules.max_symbol_percent * chars) | (100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
    more = more | (chars < rules.least_word_chars * n) | (chars > rules.most_word_chars * n)
    return measured.withColumn("base_failed", base).withColumn("any_failed", base | more)


def host_verdicts(measured: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """host, n, failed, host_rate (posterior mean) and host_failed for each host; a null host is a host."""
    hosts = staged(measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("any_failed").cast("long")).alias("failed")), "hosts")
    a, b = beta_prior(hosts, rules)
    rate, mean = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b)), a / (a + b)
    apart = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(a + b + 1)))
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", rate - rules.sure * apart > mean + rules.excess * (1 - mean))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Counts, rule results, host verdict and kept for each row of docs; with carry, carried, a struct of these columns.

    Documents are measured once and staged; hosts are pre-aggregated, so a host with a third of all rows is a
    few partial sums. The verdicts go back by counted_join. Null or empty text: no words, so it fails. Null
    host: a host of its own. Repeated rows: one result each. Empty table: no rows. Other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("="), "host"), F.lit("null"))
    measured = staged(failures(measures(docs, host, carry), rules).withColumn("host_key", key), "measured")
    verdicts = host_verdicts(measured, rules).withColumn("host_key", key)
    judged = counted_join(measured, verdicts.select("host_key", "n", "host_rate", "host_failed"), ["host_key"], measured.count())
    out = judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host_key", "n")
    return out if carry else out.drop("carried")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
