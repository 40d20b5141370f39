"""Files, universes, calendars, warehouse checks, JDBC statements and streams."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from quantloom.operators import calendar as cal
from quantloom.operators.frames import normalize, upsert
from quantloom.plans.pipelines import dashboard, reports, tearsheet
from quantloom.plans.registry import momentum_backtest
from quantloom.plans import panels
from quantloom.sources import files, schemas, universe
from quantloom.sources.fundamentals import fundamentals, load_csv
from quantloom.streaming import bars

DATA = "/root/testdata/sf0.001"


def test_fundamentals_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Ticker,Report Date,PE TTM,Note\n aa/b ,2020-03-31,10,x\nAA/B,2020-03-31,11,y\nCC,bad,1,\n,2020-03-31,2,\nDD,2020-03-31,n/a,\n")
    (tmp_path / "b.csv").write_text("symbol,date,pe_ttm,roe\nDD,2020-03-31,7,0.5\nEE,2020-06-30,3,inf\n")
    one = {r["symbol"]: r["pe_ttm"] for r in load_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert one == {"AA_B": 11.0, "DD": None}
    both = {r["symbol"]: (r["pe_ttm"], r["roe"]) for r in fundamentals(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert both == {"AA_B": (11.0, None), "DD": (7.0, 0.5), "EE": (3.0, None)}
    sessions = cal.trading_days(spark, "2020-03-30", "2020-04-01")
    rows = fundamentals(spark, [str(tmp_path / "b.csv")], spark.createDataFrame([("DD",)], "symbol string"), sessions).orderBy("date").collect()
    assert [(r["date"].day, r["pe_ttm"]) for r in rows] == [(30, None), (31, 7.0), (1, 7.0)]


def test_reading_what_is_there(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    assert files.read_table(spark, path, schemas.PRICE).count() == 0
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1.0)], schemas.PRICE)
    files.write_table(df, path)
    files.write_table(df.unionAll(df), path, overwrite=False)
    assert files.read_table(spark, path).count() == 1
    wide = spark.createDataFrame([("2020-01-01", "1.5", None)], "Date string, adj_close_aa string, adj_close_bb string")
    assert {(r["ticker"], r["adj_close"]) for r in files.canonical_prices(wide).collect()} == {("AA", 1.5), ("BB", None)}
    with pytest.raises(ValueError):
        normalize(wide, ["ticker"])


def test_universe(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Ticker,sector,rating\nbrk/b,Fin,A\nBRK_B,Other,B\n,x,C\n")
    rows = universe.build_universe(spark, csv=str(tmp_path / "u.csv")).collect()
    assert [(r["symbol"], r["sector"], r["rating"]) for r in rows] == [("BRK_B", "Fin", "A")]
    assert [r["symbol"] for r in universe.build_universe(spark, config={"symbols": ["a", "b"]}, fallback=["z"]).collect()] == ["A", "B"]
    assert [r["symbol"] for r in universe.build_universe(spark, fallback=["z"]).collect()] == ["Z"]


def test_calendar(spark):
    july = [r["session"].day for r in cal.trading_days(spark, "2022-07-01", "2022-07-08").orderBy("session").collect()]
    assert july == [1, 5, 6, 7, 8]
    holiday = spark.createDataFrame([(dt.date(2022, 7, 6),)], "day date")
    assert cal.trading_days(spark, "2022-07-05", "2022-07-07", holiday).count() == 2
    ends = [r["session"] for r in cal.rebalance_dates(spark, "2022-12-01", "2022-12-31").collect()]
    assert ends == [dt.date(2023, 1, 2)]
    assert cal.hourly_sessions(spark, "2022-07-05", "2022-07-06").count() == 8
    assert cal.trading_days(spark, "2022-07-05", "2022-07-01").count() == 0


def test_warehouse(spark):
    securities = spark.createDataFrame([(1, "A", None, None, 1)], schemas.WAREHOUSE["securities"].ddl)
    prices = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0, 1.0, 1.0), (2, dt.date(2020, 1, 1), 1.0, 1.0, 1.0)], schemas.WAREHOUSE["prices"].ddl)
    assert schemas.checked("prices", prices).count() == 2
    with pytest.raises(ValueError, match="without a row"):
        schemas.checked("prices", prices, {"securities": securities})
    with pytest.raises(ValueError, match="duplicate"):
        schemas.checked("prices", prices.unionAll(prices))


def test_upserts(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, s string, v double")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, s string")
    assert {tuple(r) for r in upsert(a, b, ["k"]).collect()} == {(1, "x", 1.0), (2, "z", None), (3, "w", None)}
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as link:
        link.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, s TEXT)")
    for df in (a.select("k", "s"), b):
        files.upsert_rows(df.coalesce(1), lambda: sqlite3.connect(path), "t", ["k"], "sqlite", batch=1)
    with sqlite3.connect(path) as link:
        assert link.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, "x"), (2, "z"), (3, "w")]
    assert files.upsert_statement("postgres", "t", ["k"], ["k"], "%s").endswith("DO NOTHING")
    assert "ON DUPLICATE KEY" in files.upsert_statement("mysql", "t", ["k", "s"], ["k"])


def test_streamed_bars_and_upserts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    live = bars.bars(bars.stream(spark, f"{tmp_path}/in", ddl))
    run = live.writeStream.format("memory").queryName("live_bars").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = {tuple(r) for r in spark.sql("SELECT * FROM live_bars").collect()}
    assert got == {tuple(r) for r in bars.bars(events).collect()}
    rows = bars.stream(spark, f"{tmp_path}/in", ddl).select("event_type", "event_id", "value")
    bars.upsert_stream(rows, f"{tmp_path}/out", ["event_type"], "event_id", f"{tmp_path}/check").awaitTermination(60)
    want = {r[0]: r[1] for r in events.groupBy("event_type").agg(F.max("event_id")).collect()}
    assert {r["event_type"]: r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_runs_write_their_artifacts(spark, tmp_path):
    px = panels.prices(spark, DATA, "week").cache()
    dashboard(px, f"{tmp_path}/dash")
    reports(px, f"{tmp_path}/reports")
    assert spark.read.parquet(f"{tmp_path}/dash/drawdown.parquet").count() == spark.read.parquet(f"{tmp_path}/dash/returns.parquet").count() > 0
    assert spark.read.json(f"{tmp_path}/dash/perf_summary.json").count() == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/reports/performance_summary.csv").count() == 1
    run = momentum_backtest(px)
    tables = tearsheet(px, run["weights"], run["factors"], ["momentum_z"], 4, panels.wide_returns(spark, DATA), panels.BRANDS[:2])
    assert set(tables) == {"summary", "returns", "drawdowns", "cs_corr", "ic", "ts_corr"} and all(t.count() for t in tables.values())
