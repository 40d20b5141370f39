"""Ingest of prices and fundamentals for a list of symbols, with a table of what came; python -m quantloom.plans.etl."""

from __future__ import annotations

import argparse
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.calendar import PERIODS, hourly_sessions, trading_days
from quantloom.sources.files import read_table, standard_bars, write_jdbc, write_table
from quantloom.sources.fundamentals import fundamentals, write_fundamentals
from quantloom.sources.schemas import BARS
from quantloom.sources.universe import build_universe, include_exclude, investable, parse_yaml, save_universe

#: Gives the raw bars of symbols from start to end: a vendor's client, or a reader of files.
Fetch = Callable[[Sequence[str], str, str, str], DataFrame]


def symbols_list(symbols: Sequence[str]) -> list[str]:
    return sorted({s.strip().upper().replace("/", "_") for s in symbols if s.strip()})


def fetched(fetch: Fetch, names: Sequence[str], start: str, end: str, bar: str, failures: dict[str, str]) -> list[DataFrame]:
    """The batch in one form; if it fails, each symbol of it by itself, those that fail with the reason in failures."""
    try:
        return [standard_bars(fetch(names, start, end, bar))]
    except Exception as problem:  # noqa: BLE001  whatever a vendor raises is that symbol's failure
        if len(names) == 1:
            failures[names[0]] = f"{type(problem).__name__}: {problem}"
            warnings.warn(f"{names[0]}: {failures[names[0]]}", stacklevel=2)
            return []
    return [df for name in names for df in fetched(fetch, [name], start, end, bar, failures)]


def ingest_prices(spark: SparkSession, fetch: Fetch, symbols: Sequence[str], start: str = "1900-01-01", end: str = "2100-01-01", bar: str = "1d", batch: int = 50, failures: dict[str, str] | None = None) -> DataFrame:
    """BARS of the symbols, fetched in batches and brought to one form; those without data have no rows.

    A symbol that fails is a warning, and in failures with the reason; the others of its batch are fetched alone.
    """
    if bar not in PERIODS:
        raise ValueError(f"bar {bar!r} is none of {list(PERIODS)}")
    failures = {} if failures is None else failures
    names, out = symbols_list(symbols), spark.createDataFrame([], BARS)
    for i in range(0, len(names), batch):
        for df in fetched(fetch, names[i : i + batch], start, end, bar, failures):
            out = out.unionByName(df)
    day = F.col("timestamp").cast("date")
    return out.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))


@dataclass(frozen=True)
class Etl:
    """folder: where the tables go; fundamentals: CSV files; align: bar whose sessions the fundamentals are put on; jdbc: URL of a database that gets the tables too."""

    symbols: tuple[str, ...]
    folder: str
    start: str = "1900-01-01"
    end: str = "2100-01-01"
    bar: str = "1d"
    fundamentals: tuple[str, ...] = ()
    freq: str = "Q"
    align: str | None = None
    overwrite: bool = True
    jdbc: str | None = None


def summary(df: DataFrame, kind: str, time: str, bar: str | None) -> DataFrame:
    by = df.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min(F.col(time).cast("date")).alias("start"), F.max(F.col(time).cast("date")).alias("end"))
    return by.select(F.lit(kind).alias("type"), "symbol", "n_rows", "start", "end", F.lit(bar).cast("string").alias("bar"))


def run_etl(spark: SparkSession, job: Etl, fetch: Fetch) -> DataFrame:
    """Write prices_<bar>.parquet, by symbol, and fundamentals_<freq>.parquet; (type, symbol, n_rows, start, end, bar) of what is there.

    Symbols that failed are of type failed, with no rows.
    """
    path = f"{job.folder}/prices_{job.bar}.parquet"
    failures: dict[str, str] = {}
    write_table(ingest_prices(spark, fetch, job.symbols, job.start, job.end, job.bar, failures=failures), path, job.overwrite, by="symbol")
    tables = {f"prices_{job.bar}": read_table(spark, path, BARS)}
    out = summary(tables[f"prices_{job.bar}"], "prices", "timestamp", job.bar)
    if job.fundamentals:
        sessions = None
        if job.align:
            make = hourly_sessions if job.align == "1h" else trading_days
            sessions = make(spark, job.start, job.end)
        df = fundamentals(spark, list(job.fundamentals), build_universe(spark, symbols=job.symbols), sessions)
        tables[f"fundamentals_{job.freq}"] = spark.read.parquet(write_fundamentals(df, job.folder, job.freq))
        out = out.unionByName(summary(tables[f"fundamentals_{job.freq}"], "fundamentals", "date", None))
    if failures:
        lost = spark.createDataFrame([("failed", name, 0, None, None, job.bar) for name in sorted(failures)], "type string, symbol string, n_rows long, start date, end date, bar string")
        out = out.unionByName(lost)
    if job.jdbc:
        for name, table in tables.items():
            write_jdbc(table, job.jdbc, name)
    return out


def refresh_universe(universe: DataFrame, path: str, include: DataFrame | None = None, exclude: DataFrame | None = None, min_price: float | None = None, min_dollar_volume: float | None = None, min_cap: float | None = None) -> DataFrame:
    """The universe with symbols put in and taken out, those that can be invested in, written to path."""
    none = universe.select("symbol").filter("false")
    chosen = include_exclude(universe, include if include is not None else none, exclude if exclude is not None else none)
    held = chosen.join(universe, "symbol", "left")
    return save_universe(investable(held, min_price, min_dollar_volume, min_cap), path)


def defaults_of(config: dict) -> dict:
    """The command line's defaults from a parsed configuration: universe.symbols, dates.start, .end and .bar, storage.sql_url."""
    dates, held = config.get("dates") or {}, {}
    symbols = (config.get("universe") or {}).get("symbols")
    if symbols:
        held["symbols"] = ",".join(symbols)
    held |= {k: str(dates[k]) for k in ("start", "end", "bar") if dates.get(k)}
    url = (config.get("storage") or {}).get("sql_url")
    return held | ({"jdbc": url} if url else {})


def arguments(argv: Sequence[str] | None = None, parse: Callable[[str], dict] = parse_yaml) -> argparse.Namespace:
    """What the command line says; what it doesn't, from the file of --config where that can be read."""
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--config", help="YAML with defaults: universe.symbols, dates, storage.sql_url")
    args.add_argument("--symbols", help="comma-separated")
    args.add_argument("--bars", required=True, help="Parquet or CSV with raw bars")
    args.add_argument("--folder", required=True)
    args.add_argument("--fundamentals", nargs="*", default=[])
    args.add_argument("--freq", default="Q", choices=["Q", "A"])
    args.add_argument("--align", choices=["1d", "1h"])
    args.add_argument("--start", default="1900-01-01")
    args.add_argument("--end", default="2100-01-01")
    args.add_argument("--bar", default="1d", choices=list(PERIODS))
    args.add_argument("--keep", action="store_true", help="leave tables that are there")
    args.add_argument("--jdbc")
    path = args.parse_known_args(argv)[0].config
    if path:
        try:
            with open(path, encoding="utf-8") as held:
                args.set_defaults(**defaults_of(parse(held.read()) or {}))
        except (OSError, RuntimeError) as problem:
            warnings.warn(f"{path}: {problem}", stacklevel=2)
    out = args.parse_args(argv)
    if not out.symbols:
        args.error("no symbols, neither by --symbols nor in --config")
    return out


def main(argv: Sequence[str] | None = None) -> None:
    from quantloom.session import session

    a = arguments(argv)
    spark = session(app="quantloom-etl")
    bars = standard_bars(read_table(spark, a.bars))
    job = Etl(tuple(a.symbols.split(",")), a.folder, a.start, a.end, a.bar, tuple(a.fundamentals), a.freq, a.align, not a.keep, a.jdbc)
    run_etl(spark, job, lambda symbols, start, end, bar: bars.filter(F.col("symbol").isin(list(symbols)))).orderBy("type", "symbol").show(1000, False)


if __name__ == "__main__":
    main()
