"""Edge cases of upserts, price frames, headers, dummies and regressions, and that queries have values."""

import datetime

import numpy as np
import pandas as pd
import pytest

from quantloom.functions import columns as C
from quantloom.operators import frames as fr
from quantloom.operators import statistics as st
from quantloom.operators.calendar import annual_factor, periods_from_bar
from quantloom.plans import etl, registry
from quantloom.sources import files
from quantloom.sources import fundamentals as fun
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rc5_series_corr", "rc7_rolling_matrices", "e3_ts_regression_two", "e5_fama_macbeth_groups"])
def test_queries_have_values(spark, name):
    out = registry.QUERIES[name](spark, DATA)
    measures = [c for c, kind in out.dtypes if kind == "double"]
    counts = out.agg(*(F.count(c).alias(c) for c in measures), F.count("*").alias("_n")).first()
    assert counts["_n"] >= 3 and all(counts[c] > 0.9 * counts["_n"] for c in measures)


def test_upsert_of_repeated_and_null_keys(spark):
    target = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 1), (4, None, 1)], "k int, v string, nth int")
    out = fr.upsert(target, source, ["k"], order=F.col("nth")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "y"), (None, "z"), (3, "c"), (4, None)], key=str)
    assert sorted(r["k"] for r in fr.upsert(target.filter("k = 1"), source.select("k"), ["k"]).filter("k IS NOT NULL").collect()) == [1, 4]


def test_upsert_parquet_keeps_what_was_before(spark, tmp_path):
    path, stage = f"{tmp_path}/t", f"{tmp_path}/stage"
    for v in ("a", "b"):
        files.upsert_parquet(spark, path, spark.createDataFrame([(1, v), (1, v)], "k int, v string"), ["k"], stage)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "b")]
    assert [tuple(r) for r in spark.read.parquet(path + ".old").collect()] == [(1, "a")] and not files.exists(spark, stage)


def test_asof_by_stretches_of_time(spark):
    rng = np.random.default_rng(4)
    day = lambda: datetime.date(2020, 1, 1) + datetime.timedelta(int(rng.integers(0, 900)))
    left = spark.createDataFrame([(str(rng.integers(0, 3)), day(), i) for i in range(300)] + [(None, day(), 900), ("0", None, 901)], "ticker string, date date, i int")
    right = spark.createDataFrame([(str(k), datetime.date(2020, 1, 1) + datetime.timedelta(int(d)), float(d), None if d % 5 == 0 else "x") for k in range(2) for d in rng.choice(900, 25, replace=False)], "ticker string, date date, v double, w string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[2])
    want = rows(fr.asof(left, right))
    assert len(want) == 302 and sum(r[3] is not None for r in want) > 100
    for chunk in ("year", "month", "day"):
        assert rows(fr.asof(left, right, chunk=chunk)) == want


def test_price_frame(spark):
    rows = [("x", "2020-01-02 10:00:00", "1.5", 1), ("x", "2020-01-02 10:00:00", "2.5", 2), ("x", "nonsense", "3", 3), ("y", "2020-01-02", "oops", 4)]
    df = spark.createDataFrame(rows, "Ticker string, Date string, `Adj Close` string, nth int")
    out = fr.price_frame(df, order=F.col("nth")).collect()
    assert {(r["ticker"], r["date"], r["adj_close"]) for r in out} == {("x", datetime.datetime(2020, 1, 2, 10), 2.5), ("y", datetime.datetime(2020, 1, 2), None)}
    with pytest.raises(ValueError, match="missing"):
        fr.price_frame(df.drop("Adj Close"))


def test_headers():
    assert fun.key_column(["ref_date", "x"], fun.DATES) == "ref_date" and fun.key_column(["filing_dates"], fun.DATES) == "filing_dates"
    assert fun.key_column(["tickers"], fun.SYMBOLS) == "tickers" and fun.key_column(["x"], fun.DATES) is None


def test_small_helpers(spark):
    assert [periods_from_bar(b) for b in ("1D ", "1h", None)] == [252, 1638, 252] and annual_factor("weekly") == 52
    with pytest.raises(ValueError):
        annual_factor("yearly")
    with pytest.raises(ValueError, match="twice"):
        st.named_once(["a", "b", "a"])
    out = spark.createDataFrame([(1234.5,), (None,), (float("nan"),)], "x double").select(C.money("x"), C.percent("x", 1), C.fixed("x", 1)).collect()
    assert [tuple(r) for r in out] == [("$1,234.50", "123450.0%", "1234.5"), ("n/a",) * 3, ("n/a",) * 3]


def test_regressions_without_complete_rows(spark):
    df = spark.createDataFrame([(datetime.date(2020, 1, d), 1.0, None, 2.0) for d in range(1, 9)], "date date, a double, b double, c double")
    assert st.ts_regression(df, "a", ["b", "c"]).collect() == [] and st.residuals(df, "a", ["b"]).collect() == []
    assert st.rolling_regression(df, "a", ["b"], 3).collect() == [] and st.series_corr(df, ["a", "b"]).collect() == []
    assert st.cross_section_betas(df.withColumn("ticker", F.lit("x")).withColumn("g", F.lit("h")), "a", ["b"], min_names=1, group="g").collect() == []


def test_group_dummies_against_least_squares(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(1, 5):
        for i in range(40):
            x, z, g = rng.normal(), rng.normal(), "abc"[rng.integers(0, 3)]
            rows.append((datetime.date(2020, 1, day), f"t{i}", 0.3 * x - 0.2 * z + ord(g) / 50 + rng.normal() / 9, x, z if i else None, g))
    df = spark.createDataFrame(rows, "date date, ticker string, r double, x double, z double, g string")
    got = {(r["date"], r["param"]): r["beta"] for r in st.cross_section_betas(df, "r", ["x", "z"], winsor=(0.0, 1.0), group="g").collect()}
    for date, block in pd.DataFrame(rows, columns=["date", "ticker", "r", "x", "z", "g"]).dropna().groupby("date"):
        dummies = pd.get_dummies(block["g"], prefix="g", dtype=float).iloc[:, 1:]
        design = np.column_stack([np.ones(len(block)), block[["x", "z"]], dummies])
        for name, beta in zip(["alpha", "x", "z", *dummies.columns], np.linalg.lstsq(design, block["r"], rcond=None)[0]):
            assert abs(got.pop((date, name)) - beta) < 1e-9
    assert not got


def test_etl_and_universe(spark, tmp_path):
    bars = spark.createDataFrame([("A", "2020-01-02", 1.0), ("B", "2020-01-03", 2.0), ("A", "2021-01-03", 3.0)], "symbol string, date string, close double")
    job = etl.Etl(("a", "b", "c"), str(tmp_path), "2020-01-01", "2020-12-31")
    out = etl.run_etl(spark, job, lambda symbols, start, end, bar: bars.filter(F.col("symbol").isin(symbols)))
    assert {(r["symbol"], r["n_rows"]) for r in out.collect()} == {("A", 1), ("B", 1)}
    known = spark.createDataFrame([("A", 5.0), ("B", 0.5)], "symbol string, last_price double")
    extra = spark.createDataFrame([("Z",)], "symbol string")
    kept = etl.refresh_universe(known, f"{tmp_path}/u", extra, known.filter("symbol = 'B'").select("symbol"))
    assert {r["symbol"] for r in kept.collect()} == {"A", "Z"}
    assert {r["symbol"] for r in etl.refresh_universe(known, f"{tmp_path}/v", min_price=1.0).collect()} == {"A"}
