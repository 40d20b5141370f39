"""Parquet, CSV, JSON and JDBC, with empty frames where there is nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import finite, symbol
from quantloom.operators.frames import normalize, upsert, wide_to_long


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """The Parquet at path, else the CSV beside it, else an empty frame of the schema."""
    if exists(spark, path):
        return spark.read.parquet(path)
    csv = path.removesuffix(".parquet") + ".csv"
    if exists(spark, csv):
        reader = spark.read.option("header", True)
        return (reader.schema(ddl) if ddl else reader).csv(csv)
    return spark.createDataFrame([], ddl or "date DATE")


def write_table(df: DataFrame, path: str, overwrite: bool = True, by: str | None = None) -> None:
    """Parquet, by folders of a column where one is named; without overwrite, what is there stays."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_csv(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(ddl) if ddl else reader).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def canonical_prices(df: DataFrame) -> DataFrame:
    """(date, ticker, adj_close) of a price table under any usual names, long or with adj_close_<ticker> columns."""
    df = df.toDF(*(c.lower().strip() for c in df.columns))
    if any(c.startswith("adj_close_") for c in df.columns):
        df = wide_to_long(df)
    pick = lambda *names: next((c for c in names if c in df.columns), None)
    # fixed values: the names under which a price table has its columns
    ticker, date, price = pick("ticker", "symbol"), pick("date", "timestamp", "trade_date"), pick("adj_close", "px_adj_close", "close")
    if not (ticker and date and price):
        raise ValueError(f"no date, ticker and price in {df.columns}")
    df = df.select(F.col(date).alias("date"), symbol(ticker).alias("ticker"), F.col(price).alias("adj_close"))
    return normalize(df, ("date", "ticker", "adj_close"), ("adj_close",))


def standard_bars(df: DataFrame) -> DataFrame:
    """BARS columns; adj_close is close where there is none."""
    df = df.toDF(*(c.lower().strip().replace(" ", "_") for c in df.columns))
    pick = lambda *names: next((F.col(c) for c in names if c in df.columns), None)
    known = {c: finite(F.col(c).try_cast("double")) if c in df.columns else F.lit(None).cast("double") for c in ("open", "high", "low", "close", "volume")}
    adj = pick("adj_close")
    return df.select(
        pick("timestamp", "datetime", "date").cast("timestamp_ntz").alias("timestamp"),
        symbol(pick("symbol", "ticker")).alias("symbol"),
        *(known[c].alias(c) for c in ("open", "high", "low", "close")),
        (known["close"] if adj is None else F.coalesce(finite(adj.try_cast("double")), known["close"])).alias("adj_close"),
        known["volume"].alias("volume"),
    )


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    df.write.mode(mode).format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).save()


#: Fixed formats of the dialects' statements; {set} is what a row that is there gets.
UPSERTS = {
    "postgresql": "INSERT INTO {t} ({c}) VALUES ({v}) ON CONFLICT ({k}) DO {set}",
    "mysql": "INSERT INTO {t} ({c}) VALUES ({v}) ON DUPLICATE KEY UPDATE {set}",
    "sqlite": "INSERT INTO {t} ({c}) VALUES ({v}) ON CONFLICT ({k}) DO {set}",
}


def quoted(name: str, dialect: str) -> str:
    """A name as the dialect's identifier, whatever is in it."""
    mark = "`" if dialect == "mysql" else '"'
    return mark + name.replace(mark, mark * 2) + mark


def upsert_statement(dialect: str, table: str, columns: Sequence[str], keys: Sequence[str], mark: str = "?") -> str:
    """The statement that writes a row by key; one of keys alone changes nothing where the row is there.

    postgres is postgresql. Of a dialect that is not known, rows are appended.
    """
    dialect = "postgresql" if dialect == "postgres" else dialect
    if missing := [k for k in keys if k not in columns]:
        raise ValueError(f"keys that are no columns: {missing}")
    name = lambda c: quoted(c, dialect)
    listed, marks = ", ".join(map(name, columns)), ", ".join(mark for _ in columns)
    if dialect not in UPSERTS:
        return f"INSERT INTO {name(table)} ({listed}) VALUES ({marks})"
    rest = [c for c in columns if c not in keys]
    if dialect == "mysql":
        sets = ", ".join(f"{name(c)} = VALUES({name(c)})" for c in rest or [keys[0]])
    else:
        sets = "UPDATE SET " + ", ".join(f"{name(c)} = excluded.{name(c)}" for c in rest) if rest else "NOTHING"
    return UPSERTS[dialect].format(t=name(table), c=listed, v=marks, k=", ".join(map(name, keys)), set=sets)


def upsert_rows(df: DataFrame, connect, table: str, keys: Sequence[str], dialect: str, batch: int = 10_000) -> int:
    """Upsert over connections that connect() opens in each partition (PEP 249), in batches; the rows that were sent.

    Keys that come twice in df are to be settled before (see frames.upsert and dedup_first), as partitions write
    side by side.
    """
    columns, statement = df.columns, upsert_statement(dialect, table, df.columns, keys, "?" if dialect == "sqlite" else "%s")
    sent = df.sparkSession.sparkContext.accumulator(0)

    def write(rows) -> None:
        link = connect()
        held: list[tuple] = []
        n = 0
        try:
            for row in rows:
                held.append(tuple(row[c] for c in columns))
                if len(held) == batch:
                    link.cursor().executemany(statement, held)
                    n, held = n + len(held), []
            if held:
                link.cursor().executemany(statement, held)
            link.commit()
            sent.add(n + len(held))
        finally:
            link.close()

    df.foreachPartition(write)
    return sent.value


def upsert_parquet(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], staging: str, order: Column | None = None) -> None:
    """Upsert into a Parquet table. The new state is written to staging whole, then takes the table's place by renames.

    A reader finds the old table, the new one, or for the moment between two renames none, but never a half; what
    was there before is at path.old until the next call.
    """
    jvm = spark.sparkContext._jvm
    new = upsert(spark.read.parquet(path), source, keys, order) if exists(spark, path) else upsert(source.filter("false"), source, keys, order)
    new.write.mode("overwrite").parquet(staging)
    here, there, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, path.rstrip("/") + ".old"))
    system = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(old, True)
    if system.exists(here) and not system.rename(here, old) or not system.rename(there, here):
        raise OSError(f"{staging} can't take the place of {path}")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or on one machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quantloom-")
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"
