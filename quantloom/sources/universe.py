"""The set of symbols, from lists, CSV or YAML, and its filters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import symbol
from quantloom.operators.frames import except_in
from quantloom.sources.files import write_table
from quantloom.sources.schemas import UNIVERSE

FIELDS = [f.split()[0] for f in UNIVERSE.split(", ")]


def parse_yaml(text: str) -> Any:
    """YAML, where a parser is installed."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML") from missing
    return yaml.safe_load(text)


def symbols_of(config: Any) -> list[str]:
    """A list, or the list under symbols, of a parsed file."""
    return list(config.get("symbols", []) if isinstance(config, dict) else config or [])


def cleaned(df: DataFrame) -> DataFrame:
    """All fields, symbols in canonical form, the first row of each; further columns stay."""
    df = df.withColumn("_nth", F.monotonically_increasing_id())
    df = df.toDF(*(c if c == "_nth" else c.lower().strip() for c in df.columns))
    df = df.withColumnRenamed("ticker", "symbol") if "symbol" not in df.columns else df
    df = df.withColumns({c: F.lit(None).cast("string") for c in FIELDS if c not in df.columns}).withColumn("symbol", symbol("symbol"))
    first = F.row_number().over(W.partitionBy("symbol").orderBy("_nth"))
    extra = [c for c in df.columns if c not in FIELDS and c != "_nth"]
    return df.filter(F.col("symbol") != "").withColumn("_first", first).filter("_first = 1").select(*FIELDS, *extra)


def build_universe(spark: SparkSession, symbols: Sequence[str] | None = None, csv: str | None = None, config: Any = None, fallback: Sequence[str] = ()) -> DataFrame:
    """The first given source of: symbols, a CSV file, a parsed configuration, the fallback."""
    if symbols:
        chosen = list(symbols)
    elif csv:
        return cleaned(spark.read.option("header", True).csv(csv))
    else:
        chosen = symbols_of(config) or list(fallback)
    return cleaned(spark.createDataFrame([(s,) for s in chosen], "symbol string"))


def include_exclude(universe: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    return except_in(universe.select("symbol").unionByName(include.select("symbol")).distinct(), exclude)


def investable(df: DataFrame, min_price: float | None = None, min_dollar_volume: float | None = None, min_cap: float | None = None) -> DataFrame:
    """Each bound holds only where its columns are there."""
    if min_price is not None and "last_price" in df.columns:
        df = df.filter(F.col("last_price") >= min_price)
    if min_dollar_volume is not None and {"adv", "last_price"} <= set(df.columns):
        df = df.filter(F.col("adv") * F.col("last_price") >= min_dollar_volume)
    if min_cap is not None and "market_cap" in df.columns:
        df = df.filter(F.col("market_cap") >= min_cap)
    return df


def save_universe(df: DataFrame, path: str) -> DataFrame:
    """Write the universe as Parquet and read it back from there."""
    write_table(df, path)
    return df.sparkSession.read.parquet(path)
