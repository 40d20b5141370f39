"""Fundamentals from CSV files with uncertain headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import finite, symbol
from quantloom.operators.calendar import align_to_sessions
from quantloom.operators.frames import merge_first_wins, only_in
from quantloom.sources.files import write_table

#: Header names that stand for the key columns.
SYMBOLS = ("symbol", "ticker", "sym")
DATES = ("date", "report_date", "ref_date", "fiscal_date", "filing_date", "period_end", "period_end_date", "asof", "as_of", "datadate")


def clean_header(name: str) -> str:
    return "_".join(name.strip().lower().replace("-", " ").replace("/", " ").split())


def normal_form(header: str) -> str:
    """What a header and the aliases are compared by: the cleaned name, in the singular."""
    return clean_header(header).rstrip("s")


def key_column(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The column that stands for the earliest alias; of several for one alias, one that is named just so, else the first."""
    places: dict[str, int] = {}
    for place, alias in enumerate(aliases):
        places.setdefault(normal_form(alias), place)
    ranked = [(places[normal_form(c)], c not in aliases, nth, c) for nth, c in enumerate(columns) if normal_form(c) in places]
    return min(ranked)[-1] if ranked else None


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date, metrics as doubles): keys found by alias, rows without them dropped, the last row of a key kept."""
    df = spark.read.option("header", True).csv(path)
    df = df.select("*", F.monotonically_increasing_id().alias("_nth"))
    df = df.toDF(*(c if c == "_nth" else clean_header(c) for c in df.columns))
    key, date = key_column(df.columns, SYMBOLS), key_column(df.columns, DATES)
    if key is None or date is None:
        raise ValueError(f"no symbol or date column among {df.columns}")
    metrics = [c for c in df.columns if c not in (key, date, "_nth")]
    df = df.select(symbol(key).alias("symbol"), F.to_date(F.try_to_timestamp(F.col(date))).alias("date"), *(finite(F.col(c).try_cast("double")).alias(c) for c in metrics), "_nth")
    df = df.filter((F.col("symbol") != "") & F.col("date").isNotNull())
    last = F.row_number().over(W.partitionBy("symbol", "date").orderBy(F.desc("_nth")))
    return df.withColumn("_last", last).filter("_last = 1").drop("_last", "_nth")


def load_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a (symbol, date); in a cell, the first file that has a value wins."""
    return merge_first_wins(*(load_csv(spark, p) for p in paths))


def fundamentals(spark: SparkSession, paths: list[str], universe: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    df = load_csvs(spark, paths)
    df = only_in(df, universe) if universe is not None else df
    if sessions is not None:
        df = align_to_sessions(df, sessions, [c for c in df.columns if c not in ("symbol", "date")])
    return df


def write_fundamentals(df: DataFrame, folder: str, freq: str = "Q") -> str:
    """Write the table under the name of its frequency, Q or A; the path."""
    if freq.upper() not in ("Q", "A"):
        raise ValueError(f"frequency {freq!r} is neither Q nor A")
    path = f"{folder.rstrip('/')}/fundamentals_{freq.upper()}.parquet"
    write_table(df, path)
    return path
