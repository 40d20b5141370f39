"""Upserts into a partitioned Parquet table that rewrite only the partitions a batch changes.

The new state of those partitions is written aside, under the table's _upsert folder, which readers don't see.
Once it is whole, a list of the partitions to be switched is put beside it; from then on the upsert counts as made
and any later call finishes it, whatever became of the one that began it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.frames import dedup_first, upsert
from quantloom.sources.files import exists

ASIDE = "_upsert"


class Folder:
    """A table's folder on whatever file system it is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.system = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def there(self, name: str) -> bool:
        return self.system.exists(self.at(name))

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.at(name))) if self.there(name) else []

    def move(self, name: str, to: str) -> None:
        self.system.mkdirs(self.at(to).getParent())
        if not self.system.rename(self.at(name), self.at(to)):
            raise OSError(f"{self.path}: {name} can't be moved to {to}")

    def drop(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def write(self, name: str, lines: Sequence[str]) -> None:
        """A file that is there whole or not at all."""
        out = self.system.create(self.at(f"{name}.part"), True)
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        out.close()
        self.move(f"{name}.part", name)

    def read(self, name: str) -> list[str]:
        held = self.system.open(self.at(name))
        reader = self.jvm.java.io.BufferedReader(self.jvm.java.io.InputStreamReader(held, "UTF-8"))
        lines = []
        while (line := reader.readLine()) is not None:
            lines.append(line)
        reader.close()
        return lines


def switched(spark: SparkSession, path: str) -> list[str]:
    """Finish an upsert that was interrupted; the partitions that were still to be switched.

    Without a list of partitions the new state isn't whole, and goes. With one, each partition's old state goes
    aside and the new one takes its place; every step can be repeated.
    """
    folder = Folder(spark, path)
    if not folder.there(f"{ASIDE}/ready"):
        folder.drop(ASIDE)
        return []
    done = []
    for name in folder.read(f"{ASIDE}/ready"):
        new, old = f"{ASIDE}/new/{name}", f"{ASIDE}/old/{name}"
        if folder.there(name) and not folder.there(old):
            folder.move(name, old)
        if folder.there(new):
            folder.move(new, name)
            done.append(name)
    folder.drop(f"{ASIDE}/ready")
    folder.drop(ASIDE)
    return done


def folders_of(spark: SparkSession, rows: DataFrame) -> list[str]:
    """The partition folders that rows of a table at path are in."""
    paths = [r[0] for r in rows.select(F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1)).distinct().collect()]
    return sorted(spark.sparkContext._jvm.java.net.URI(p).getPath().rsplit("/", 1)[1] for p in paths)


def upsert_partitions(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], by: str, order: Column | None = None) -> list[str]:
    """Put source's rows by key into the Parquet table at path, partitioned by a column; the folders that were rewritten.

    Of rows of one key the last by order counts, as in upsert. Rows that are in the table as they are change
    nothing: a batch that is repeated rewrites nothing, and partitions without a changed row keep their files. If
    by is one of keys, only the batch's partitions are read; else a key's row may move, and where it was is
    rewritten too. Values of by are listed on the driver, one a partition that changes. One writer at a time.
    """
    keys = list(keys)
    rest = [c for c in source.columns if c not in keys]
    rank = [order.desc_nulls_last()] if order is not None else []
    source = dedup_first(source, keys, [*rank, *(F.desc_nulls_last(c) for c in (rest or keys))])
    if not exists(spark, path):
        upsert(source.filter("false"), source, keys).write.partitionBy(by).parquet(path)
        return Folder(spark, path).names("")
    switched(spark, path)
    kinds = dict(source.dtypes)
    table = spark.read.parquet(path)
    table = table.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in table.columns))
    columns = [c for c in table.columns if c in source.columns]
    source = source.select(*columns)
    within = lambda df, values: df.filter(F.col(by).isin([v for v in values if v is not None]) | (F.col(by).isNull() if None in values else F.lit(False)))
    values = lambda df: {r[0] for r in df.select(by).distinct().collect()}
    near = within(table, values(source)) if by in keys else table
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns]
    changed = source.alias("s").join(near.select(*columns).alias("t"), same, "left_anti")
    touched = values(changed)
    if by not in keys:
        moved = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        touched |= values(table.alias("t").join(changed.alias("s"), moved, "left_semi"))
    if not touched:
        return []
    old = within(table, touched)
    upsert(old, within(source, touched), keys).write.partitionBy(by).parquet(f"{path.rstrip('/')}/{ASIDE}/new")
    folder = Folder(spark, path)
    names = {n for n in folder.names(f"{ASIDE}/new") if "=" in n} | set(folders_of(spark, old))
    folder.write(f"{ASIDE}/ready", sorted(names))
    return switched(spark, path)
