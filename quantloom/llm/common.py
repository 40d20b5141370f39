"""Shared plumbing of the corpus operators: staged tables, counted joins, Arrow scans."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least one row in HEAVY_KEYS of a table is heavy; there are at most HEAVY_KEYS such keys.
HEAVY_KEYS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: The list to which staged() adds its paths, within collecting().
COLLECTED: ContextVar[list[str] | None] = ContextVar("collected", default=None)


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Within, the paths of staged tables are added to paths, for deleted() once nothing reads them any more."""
    token = COLLECTED.set(paths)
    try:
        yield
    finally:
        COLLECTED.reset(token)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Delete the staged tables at paths, and empty the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quantloom/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if (paths := COLLECTED.get()) is not None:
        paths.append(path)
    return spark.read.schema(schema).parquet(path)


def shares_ids(docs: DataFrame, name: str = "doc_id") -> bool:
    """Whether rows share an id; nulls aside."""
    return not docs.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete the files behind a staged table that is no longer read."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    deleted(df.sparkSession, [f for f in folders if "/quantloom/" in f])


def counted_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n_rows: int, how: str = "inner", n: str = "n") -> DataFrame:
    """Inner or left equi-join of rows with groups, where groups has one row a key and n >= that key's number of rows.

    Keys that hold at least 1/HEAVY_KEYS of all rows number at most HEAVY_KEYS whatever the input's size, so
    their hashes are fetched, those groups are broadcast and their rows never meet in one task. All other keys
    go through a shuffle join in which no key has more than that share. Both are read twice, so stage them.
    """
    keys = list(keys)
    floor = max(2, -(-n_rows // HEAVY_KEYS))
    hashed = F.xxhash64(*keys)
    heavy = sorted({r[0] for r in groups.filter(F.col(n) >= floor).select(hashed).collect()})
    if not heavy:
        return rows.join(groups, keys, how)
    own = hashed.isin(heavy)
    return rows.filter(own).join(F.broadcast(groups.filter(own)), keys, how).unionByName(rows.filter(~own).join(groups.filter(~own), keys, how))


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def record(schema: Sequence[tuple[str, pa.DataType]], columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, kind) for (_, kind), c in zip(schema, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in schema])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: Sequence[str], name: str) -> str:
    """name, with as many underscores before it as it takes to be none of taken, in whatever case."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def spread(columns: Sequence[Column], n: int) -> Column:
    """A number from 0 to n - 1 that deals rows out evenly whatever their keys."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
