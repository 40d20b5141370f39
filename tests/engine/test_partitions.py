"""Upserts that rewrite only what they change."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from quantloom.sources import files
from quantloom.sources import partitions as pt

DDL = "k int, year int, v string, w double"


def rows(spark, path):
    return sorted(((r["k"], r["year"], r["v"], r["w"]) for r in spark.read.parquet(path).collect()), key=str)


def times(path):
    return {f"{os.path.relpath(d, path)}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, path):
    first = [(1, 2000, "a", 1.0), (2, 2000, "b", 2.0), (3, 2001, "c", 3.0), (4, 2002, None, None), (5, None, "n", 5.0)]
    pt.upsert_partitions(spark, path, spark.createDataFrame(first, DDL), ["k", "year"], "year")
    return first


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = table(spark, path)
    assert rows(spark, path) == sorted(first, key=str)
    before = times(path)
    batch = spark.createDataFrame([(2, 2000, "B", 2.0), (6, 2003, "new", 6.0), (3, 2001, "c", 3.0), (5, None, "N", 5.0)], DDL)
    done = pt.upsert_partitions(spark, path, batch, ["k", "year"], "year")
    assert done == ["year=2000", "year=2003", "year=__HIVE_DEFAULT_PARTITION__"]
    assert rows(spark, path) == sorted([(1, 2000, "a", 1.0), (2, 2000, "B", 2.0), (3, 2001, "c", 3.0), (4, 2002, None, None), (5, None, "N", 5.0), (6, 2003, "new", 6.0)], key=str)
    after = times(path)
    assert {k: v for k, v in before.items() if k.startswith(("year=2001", "year=2002"))} == {k: v for k, v in after.items() if k.startswith(("year=2001", "year=2002"))}
    assert not [n for n in os.listdir(path) if n == "_upsert"]
    assert pt.upsert_partitions(spark, path, batch, ["k", "year"], "year") == [] and times(path) == after


def test_last_of_a_key_and_missing_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path)
    batch = spark.createDataFrame([(1, 2000, "x", 1), (1, 2000, "y", 2)], "k int, year int, v string, nth int")
    pt.upsert_partitions(spark, path, batch, ["k", "year"], "year", order=F.col("nth"))
    assert (1, 2000, "y", None) in rows(spark, path) and len(rows(spark, path)) == 5


def test_rows_that_move_leave_their_partition(spark, tmp_path):
    path = f"{tmp_path}/t"
    table(spark, path)
    done = pt.upsert_partitions(spark, path, spark.createDataFrame([(3, 2000, "c", 3.0)], DDL), ["k"], "year")
    assert done == ["year=2000"] and not os.path.exists(f"{path}/year=2001")
    assert (3, 2000, "c", 3.0) in rows(spark, path) and len(rows(spark, path)) == 5


@pytest.mark.parametrize("at", [0, 1, 2, 3, 4])
def test_an_interrupted_switch_is_finished(spark, tmp_path, monkeypatch, at):
    """However many moves were made before the writer was lost, the next call or a repair leaves the new state."""
    path = f"{tmp_path}/t"
    table(spark, path)
    moves, move = [], pt.Folder.move

    def lost(self, name, to):
        if len(moves) == at + 1:
            raise OSError("lost")
        moves.append(name)
        move(self, name, to)

    batch = spark.createDataFrame([(1, 2000, "A", 9.0), (3, 2001, "C", 9.0)], DDL)
    monkeypatch.setattr(pt.Folder, "move", lost)
    try:
        pt.upsert_partitions(spark, path, batch, ["k", "year"], "year")
    except OSError:
        pass
    monkeypatch.setattr(pt.Folder, "move", move)
    pt.switched(spark, path)
    assert {(1, 2000, "A", 9.0), (3, 2001, "C", 9.0)} <= set(rows(spark, path)) and len(rows(spark, path)) == 5
    assert not os.path.exists(f"{path}/_upsert")


def test_what_was_not_ready_goes(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = table(spark, path)
    spark.createDataFrame([(1, "half", 0.0)], "k int, v string, w double").write.parquet(f"{path}/_upsert/new/year=2000")
    assert rows(spark, path) == sorted(first, key=str)
    assert pt.switched(spark, path) == [] and not os.path.exists(f"{path}/_upsert") and rows(spark, path) == sorted(first, key=str)


def test_odd_values_of_the_partition_column(spark, tmp_path):
    path, ddl = f"{tmp_path}/t u", "k int, by string, v int"
    pt.upsert_partitions(spark, path, spark.createDataFrame([(1, "a b/#%", 1), (2, "é=x", 1), (3, "plain", 1)], ddl), ["k"], "by")
    done = pt.upsert_partitions(spark, path, spark.createDataFrame([(1, "plain", 2), (2, "é=x", 3)], ddl), ["k"], "by")
    assert len(done) == 2
    assert sorted((r["k"], r["by"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "plain", 2), (2, "é=x", 3), (3, "plain", 1)]


def test_statements_quote_names(spark, tmp_path):
    assert files.upsert_statement("postgres", "t", ["a b", 'q"'], ["a b"]) == files.upsert_statement("postgresql", "t", ["a b", 'q"'], ["a b"])
    assert files.upsert_statement("mysql", "t", ["k`", "order"], ["k`"]) == "INSERT INTO `t` (`k```, `order`) VALUES (?, ?) ON DUPLICATE KEY UPDATE `order` = VALUES(`order`)"
    assert files.upsert_statement("other", "t", ["k"], ["k"]) == 'INSERT INTO "t" ("k") VALUES (?)'
    with pytest.raises(ValueError, match="no columns"):
        files.upsert_statement("sqlite", "t", ["k"], ["z"])
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as link:
        link.execute('CREATE TABLE "order by" ("group" INTEGER PRIMARY KEY, "a ""b" TEXT)')
    for v in ("x", "y"):
        df = spark.createDataFrame([(1, v), (2, v)], 'group int, `a "b` string').coalesce(1)
        assert files.upsert_rows(df, lambda: sqlite3.connect(path), "order by", ["group"], "sqlite", batch=1) == 2
    with sqlite3.connect(path) as link:
        assert link.execute('SELECT * FROM "order by"').fetchall() == [(1, "y"), (2, "y")]
