"""Bars from a vendor as a data source: a partition a batch of symbols, and a symbol that fails is a row that says so.

A client is any picklable object with fetch(symbol, start, end, bar), which gives an Arrow table of raw bars, or
raises. It is called in the tasks, one symbol after another.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import compute as pc
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quantloom.functions.columns import symbol
from quantloom.sources.schemas import BARS

NAME = "quantloom_bars"
VALUES = ("open", "high", "low", "close", "adj_close", "volume")
SCHEMA = pa.schema([("timestamp", pa.timestamp("us")), ("symbol", pa.string()), *((c, pa.float64()) for c in VALUES), ("error", pa.string())])


class Client(Protocol):
    def fetch(self, symbol: str, start: str, end: str, bar: str) -> pa.Table: ...


@dataclass(frozen=True)
class Stored:
    """A client that reads what store() has written, from any file system that Arrow knows; broken: symbols that fail."""

    path: str
    broken: tuple[str, ...] = ()

    def fetch(self, symbol: str, start: str, end: str, bar: str) -> pa.Table:
        if symbol in self.broken:
            raise ValueError(symbol.lower())
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        table = ds.dataset(root, filesystem=system, format="parquet", exclude_invalid_files=True)
        return table.to_table(filter=pc.field("symbol") == symbol)


def store(bars: DataFrame, path: str) -> None:
    """Bars in files sorted by symbol, so that a client reads only those row groups that have its symbol."""
    shown = bars.withColumn("symbol", symbol("symbol"))
    shown.repartition("symbol").sortWithinPartitions("symbol").write.parquet(path)


@dataclass
class Batch(InputPartition):
    symbols: list[str]


def formed(raw: pa.Table, name: str, start: str, end: str) -> pa.Table:
    """Raw bars of a symbol in SCHEMA, from start to the end of end; adj_close is close where there is none."""
    raw = raw.rename_columns([c.lower().strip().replace(" ", "_") for c in raw.column_names])
    at = next((c for c in ("timestamp", "datetime", "date") if c in raw.column_names), None)
    if at is None:
        raise ValueError(f"no time among {raw.column_names}")
    time = raw.column(at).cast(pa.timestamp("us"))
    none = pa.nulls(raw.num_rows, pa.float64())
    held = {c: raw.column(c).cast(pa.float64()) if c in raw.column_names else none for c in VALUES}
    held["adj_close"] = pc.coalesce(held["adj_close"], held["close"])
    out = pa.table([time, pa.array([name] * raw.num_rows, pa.string()), *(held[c] for c in VALUES), pa.nulls(raw.num_rows, pa.string())], schema=SCHEMA)
    day = pc.cast(out.column("timestamp"), pa.date32())
    return out.filter(pc.and_(pc.greater_equal(day, pa.scalar(start).cast(pa.date32())), pc.less_equal(day, pa.scalar(end).cast(pa.date32()))))


class BarsReader(DataSourceReader):
    def __init__(self, options):
        self.client = pickle.loads(base64.b64decode(options["client"]))
        self.symbols = [s for s in options["symbols"].split(",") if s]
        self.start, self.end, self.bar, self.batch = options["start"], options["end"], options["bar"], int(options["batch"])

    def partitions(self) -> Sequence[InputPartition]:
        return [Batch(self.symbols[i : i + self.batch]) for i in range(0, len(self.symbols), self.batch)] or [Batch([])]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        for name in partition.symbols:
            try:
                yield from formed(self.client.fetch(name, self.start, self.end, self.bar), name, self.start, self.end).to_batches()
            except Exception as problem:  # noqa: BLE001  whatever a client raises is that symbol's error
                said = f"{type(problem).__name__}: {problem}"
                row = {"symbol": [name], "error": [said]}
                yield pa.RecordBatch.from_arrays([pa.array(row.get(f.name, [None]), f.type) for f in SCHEMA], schema=SCHEMA)


class Bars(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{BARS}, error STRING"

    def reader(self, schema) -> BarsReader:
        return BarsReader(self.options)


def read_bars(spark: SparkSession, symbols: Sequence[str], client: Client, start: str = "1900-01-01", end: str = "2100-01-01", bar: str = "1d", batch: int = 50) -> DataFrame:
    """BARS with error: null in bars, and for a symbol that failed one row with its name and what went wrong."""
    spark.dataSource.register(Bars)
    names = sorted({s.strip().upper().replace("/", "_") for s in symbols if s.strip()})
    held = base64.b64encode(cloudpickle.dumps(client)).decode()
    reader = spark.read.format(NAME).options(client=held, symbols=",".join(names), start=start, end=end, bar=bar, batch=str(batch))
    return reader.load()


def failed(df: DataFrame) -> DataFrame:
    """(symbol, error) of the symbols that failed."""
    return df.filter(F.col("error").isNotNull()).select("symbol", "error")


def bars_of(df: DataFrame) -> DataFrame:
    """BARS alone."""
    return df.filter(F.col("error").isNull()).drop("error")
