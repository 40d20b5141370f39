"""Bars from a data source, deletions along keys, buckets, and the ETL's failures and defaults."""

import datetime as dt
import warnings

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.operators import calendar as cal
from quantloom.plans import etl
from quantloom.sources import schemas, vendor


def quotes():
    """A client with a bar a day from 2020-01-01 on; B fails, E has nothing, T has no time. Defined here, it travels by value."""

    class Quotes:
        def fetch(self, symbol, start, end, bar):
            if symbol == "B":
                raise KeyError("no B")
            n = 0 if symbol == "E" else 3
            times = [dt.datetime(2020, 1, 1 + i) for i in range(n)]
            return pa.table({"When" if symbol == "T" else "Datetime": pa.array(times, pa.timestamp("us")), "Close": pa.array([1.0 + i for i in range(n)]), "Volume": pa.array(list(range(n)), pa.int64())})

    return Quotes()


@pytest.mark.parametrize("batch", [1, 2, 50])
def test_a_symbol_that_fails_leaves_the_others(spark, batch):
    df = vendor.read_bars(spark, ["a", "b", " c", "e", "t", "a", ""], quotes(), "2020-01-02", "2020-01-02", batch=batch)
    assert [f.name for f in df.schema][-1] == "error"
    got = [(r["symbol"], r["timestamp"], r["close"], r["adj_close"], r["volume"]) for r in vendor.bars_of(df).orderBy("symbol").collect()]
    assert got == [(s, dt.datetime(2020, 1, 2), 2.0, 2.0, 1.0) for s in ("A", "C")]
    said = {r["symbol"]: r["error"] for r in vendor.failed(df).collect()}
    assert said["B"] == "KeyError: 'no B'" and said["T"].startswith("ValueError: no time") and set(said) == {"B", "T"}
    assert df.rdd.getNumPartitions() == -(-5 // batch)
    assert vendor.read_bars(spark, [], quotes()).collect() == []


def test_stored_bars_read_only_their_symbol(spark, tmp_path):
    bars = spark.range(100).select(F.concat(F.lit("s"), F.col("id") % 4).alias("symbol"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("timestamp"), F.col("id").cast("double").alias("close"))
    vendor.store(bars, f"{tmp_path}/bars")
    df = vendor.read_bars(spark, ["s1", "s3", "none"], vendor.Stored(f"{tmp_path}/bars"))
    assert {(r["symbol"], r["n"]) for r in df.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {("S1", 25), ("S3", 25)}


def test_batches_with_a_failure_are_fetched_one_by_one(spark, tmp_path):
    bars = spark.createDataFrame([("A", "2020-01-02", 1.0), ("C", "2020-01-03", 2.0)], "symbol string, date string, close double")

    def fetch(symbols, start, end, bar):
        if "B" in symbols:
            raise ConnectionError("gone")
        return bars.filter(F.col("symbol").isin(symbols))

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        out = etl.run_etl(spark, etl.Etl(("a", "b", "c"), str(tmp_path)), fetch)
    assert {(r["type"], r["symbol"], r["n_rows"]) for r in out.collect()} == {("prices", "A", 1), ("prices", "C", 1), ("failed", "B", 0)}
    assert any("B: ConnectionError: gone" in str(w.message) for w in said)


def test_defaults_of_a_configuration(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("anything")
    held = {"universe": {"symbols": ["X", "Y"]}, "dates": {"start": dt.date(2020, 1, 1), "bar": "1h"}, "storage": {"sql_url": "jdbc:x"}}
    a = etl.arguments(["--config", str(path), "--bars", "b", "--folder", "f", "--start", "2021-01-01"], lambda text: held)
    assert (a.symbols, a.start, a.end, a.bar, a.jdbc) == ("X,Y", "2021-01-01", "2100-01-01", "1h", "jdbc:x")
    with pytest.warns(UserWarning), pytest.raises(SystemExit):
        etl.arguments(["--config", str(tmp_path / "none.yaml"), "--bars", "b", "--folder", "f"])
    assert etl.defaults_of({}) == {}


def test_deleting_a_run_takes_what_refers_to_it(spark):
    t = dt.datetime(2020, 1, 1)
    make = lambda name, rows: spark.createDataFrame(rows, schemas.WAREHOUSE[name].ddl)
    tables = {
        "runs": make("runs", [(k, "s", None, t, t, "done") for k in ("r1", "r2")]),
        "trades": make("trades", [(1, "r1", t, "A", "buy", 1.0, 1.0, 0.0), (2, "r2", t, "A", "buy", 1.0, 1.0, 0.0), (3, None, t, "A", "buy", 1.0, 1.0, 0.0)]),
        "daily_pnl": make("daily_pnl", [("r1", t, 1.0, 1.0, 0.0), ("r2", t, 1.0, 1.0, 0.0)]),
        "risk_events": make("risk_events", [(1, "r1", t, "k", "d")]),
        "securities": make("securities", [(1, "A", None, None, 1)]),
    }
    left = schemas.cascaded(tables, "runs", F.col("id") == "r1")
    ids = lambda name, key: sorted((r[key] for r in left[name].collect()), key=str)
    assert ids("runs", "id") == ["r2"] and ids("trades", "id") == [2, 3] and ids("daily_pnl", "run_id") == ["r2"]
    assert ids("risk_events", "id") == [] and left["securities"] is tables["securities"]
    assert all(left[k].columns == tables[k].columns for k in tables)


def test_levels_and_several_parents(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    tables = {"a": one([(1,), (2,), (None,)], "a int"), "b": one([(10, 1), (20, 2), (30, None)], "b int, a int"), "c": one([(100, 10, 2), (200, 20, 1), (300, 20, 2), (400, None, None)], "c int, b int, a int")}
    keys = {"a": ("a",), "b": ("b",), "c": ("c",)}
    parents = {"b": (("a", "a"),), "c": (("b", "b"), ("a", "a"))}
    left = schemas.cascaded(tables, "a", F.col("a") == 1, keys, parents)
    assert {k: sorted((r[0] for r in df.collect()), key=str) for k, df in left.items()} == {"a": [2, None], "b": [20, 30], "c": [300, 400]}


def test_joins_of_bucketed_tables_need_no_exchange(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") % 50).cast("int").alias("secid"), F.date_add(F.lit("2020-01-01"), (F.col("id") / 50).cast("int")).alias("trade_date"), F.col("id").alias("v"))
    a, b = (schemas.bucketed(df.withColumnRenamed("v", n), f"{tmp_path}/{n}", ["secid", "trade_date"], 4) for n in ("x", "y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = a.join(b, ["secid", "trade_date"])
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.filter("x = y").count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_days_over_a_table(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 12, 24, 10),), (dt.datetime(2021, 12, 31, 23),), (None,)], "t timestamp")
    assert [r[0].day for r in cal.opened(cal.days_over(df, "t")).orderBy("session").collect()] == [24, 27, 28, 29, 30, 31]
    assert [r[0] for r in cal.rebalance_dates_over(df, "t").collect()] == [dt.date(2021, 12, 31)]
    assert cal.days_over(df.filter("false"), "t").count() == 0
