"""Schemas of the panels and of the relational warehouse, with their keys."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.frames import duplicate_keys, orphans

PRICE = "date DATE, ticker STRING, adj_close DOUBLE"
BARS = "timestamp TIMESTAMP_NTZ, symbol STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, adj_close DOUBLE, volume DOUBLE"
CLASSIFICATION = "date DATE, ticker STRING, grp STRING"
UNIVERSE = "symbol STRING, name STRING, asset_class STRING, currency STRING, exchange STRING, sector STRING, industry STRING"


@dataclass(frozen=True)
class Table:
    """partition: the column whose folders stand in for an index; parents: foreign key column to parent table."""

    ddl: str
    key: tuple[str, ...]
    partition: str | None = None
    parents: tuple[tuple[str, str], ...] = ()


#: The warehouse's tables, their columns and keys.
WAREHOUSE = {
    "securities": Table("secid INT, symbol STRING, name STRING, exchange STRING, is_active INT", ("secid",)),
    "prices": Table("secid INT, trade_date DATE, px_close DOUBLE, px_adj_close DOUBLE, px_volume DOUBLE", ("secid", "trade_date"), None, (("secid", "securities"),)),
    "fundamentals": Table("secid INT, period_end_date DATE, pe DOUBLE, roe DOUBLE, debt_to_equity DOUBLE", ("secid", "period_end_date"), None, (("secid", "securities"),)),
    "factor_levels": Table("secid INT, trade_date DATE, value_raw DOUBLE, mom6_raw DOUBLE, qual_raw DOUBLE", ("secid", "trade_date"), None, (("secid", "securities"),)),
    "factor_scores": Table("secid INT, trade_date DATE, value_z DOUBLE, mom6_z DOUBLE, qual_z DOUBLE, value_score DOUBLE, mom6_score DOUBLE, qual_score DOUBLE", ("secid", "trade_date"), None, (("secid", "securities"),)),
    "portfolios": Table("rebalance_date DATE, factor_name STRING, quintile INT, secid INT, weight DOUBLE", ("rebalance_date", "factor_name", "quintile", "secid"), "factor_name", (("secid", "securities"),)),
    "portfolio_returns": Table("trade_date DATE, factor_name STRING, quintile INT, ret DOUBLE, cumret DOUBLE", ("trade_date", "factor_name", "quintile"), "factor_name"),
    "metadata": Table("meta_key STRING, meta_value STRING", ("meta_key",)),
    "runs": Table("id STRING, strategy STRING, params STRING, start_ts TIMESTAMP_NTZ, end_ts TIMESTAMP_NTZ, status STRING", ("id",)),
    "trades": Table("id BIGINT, run_id STRING, timestamp TIMESTAMP_NTZ, symbol STRING, side STRING, qty DOUBLE, price DOUBLE, fees DOUBLE", ("id",), None, (("run_id", "runs"),)),
    "daily_pnl": Table("run_id STRING, timestamp TIMESTAMP_NTZ, pnl DOUBLE, equity DOUBLE, drawdown DOUBLE", ("run_id", "timestamp"), None, (("run_id", "runs"),)),
    "risk_events": Table("id BIGINT, run_id STRING, timestamp TIMESTAMP_NTZ, kind STRING, detail STRING", ("id",), None, (("run_id", "runs"),)),
}


def create_tables(spark: SparkSession, names: list[str] | None = None) -> None:
    for name in names or WAREHOUSE:
        own = WAREHOUSE[name]
        by = f" PARTITIONED BY ({own.partition})" if own.partition else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({own.ddl}) USING parquet{by}")


def checked(name: str, df: DataFrame, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """df, if its key is unique and its foreign keys are found; two jobs of pre-aggregated counts."""
    table = WAREHOUSE[name]
    if not duplicate_keys(df, table.key).isEmpty():
        raise ValueError(f"{name}: duplicate {table.key}")
    for column, parent in table.parents:
        if parents and parent in parents:
            target = parents[parent].withColumnRenamed(WAREHOUSE[parent].key[0], column)
            if not orphans(df, target, column).isEmpty():
                raise ValueError(f"{name}: {column} without a row of {parent}")
    return df


def bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int = 32, name: str | None = None) -> DataFrame:
    """df as a table at path, bucketed and sorted by keys: what an index on them is for, joins and windows by all of keys need no exchange.

    Each bucket is one file. name: of the table in the catalog, else one of its own.
    """
    name = name or f"quantloom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def cascaded(tables: Mapping[str, DataFrame], name: str, gone: Column, keys: Mapping[str, Sequence[str]] | None = None, parents: Mapping[str, Sequence[tuple[str, str]]] | None = None) -> dict[str, DataFrame]:
    """tables without the rows of name that gone says, and without those that refer to them, level by level.

    keys and parents (foreign key column, table): of the warehouse, or other ones without cycles; a foreign key
    refers to its table's first key column. A row with several parents goes with the first of them that goes; a
    null refers to nothing. Each table is joined once for each of its foreign keys.
    """
    keys = keys or {t: w.key for t, w in WAREHOUSE.items()}
    parents = parents or {t: w.parents for t, w in WAREHOUSE.items()}
    dead = {name: tables[name].filter(gone).select(keys[name][0]).distinct()}
    left = {**tables, name: tables[name].filter(~F.coalesce(gone, F.lit(False)))}
    open_ = [name]
    while open_:
        level = {child for parent in open_ for child, refs in parents.items() if child in tables and any(p == parent for _, p in refs)}
        open_ = []
        for child in sorted(level):
            rows, lost = tables[child], None
            for column, parent in parents.get(child, ()):
                if parent in dead:
                    hit = rows.join(dead[parent].withColumnRenamed(keys[parent][0], column), column, "left_semi").select(*rows.columns)
                    lost = hit if lost is None else lost.unionByName(hit)
                    left[child] = (left[child] if left[child] is not tables[child] else rows).join(dead[parent].withColumnRenamed(keys[parent][0], column), column, "left_anti").select(*rows.columns)
            dead[child] = lost.select(keys[child][0]).distinct()
            open_.append(child)
    return left
