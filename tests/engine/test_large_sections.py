"""Ranks, quantiles and as-of joins of very large keys, against their plain forms."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import average_rank
from quantloom.operators import frames as fr
from quantloom.operators import ranks as rk
from quantloom.operators import statistics as st


def values(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"i": range(n), "g": rng.choice(["a", "a", "a", "b", "c"], n), "x": np.round(rng.standard_cauchy(n), 2), "y": rng.choice([0.0, -0.0, 1.0, 2.5], n)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("i") % 7 > 0, F.col("x")))
    return df.repartition(5)


@pytest.mark.parametrize("per_range", [10**6, 100, 3])
def test_ranks_in_ranges(spark, per_range):
    df = values(spark)
    got = rk.whole_ranks(df, ["x", "y"], per_range=per_range).orderBy("i").toPandas()
    want = df.select("i", average_rank("x").alias("x"), average_rank("y").alias("y")).orderBy("i").toPandas()
    assert len(got) == 2000
    pd.testing.assert_series_equal(got["_r_x"], want["x"], check_names=False)
    pd.testing.assert_series_equal(got["_r_y"], want["y"], check_names=False)


def test_ranges_are_searched(spark):
    edges = [float(e) for e in range(0, 200, 3)]
    df = spark.range(-5, 210).select((F.col("id") / 2.0).alias("v"))
    got = df.select("v", rk.range_of(F.col("v"), edges).alias("r")).collect()
    assert all(r["r"] == sum(r["v"] > e for e in edges) for r in got)


def test_no_values(spark):
    none = spark.createDataFrame([(None, 1)], "x double, i int")
    assert [r["_r_x"] for r in rk.whole_ranks(none, ["x"]).collect()] == [None]
    assert rk.whole_ranks(none.filter("false"), ["x"]).collect() == [] and rk.exact_quantiles(none, "x", [0.5]).collect() == []


def test_spearman_of_a_whole_frame_has_no_single_task(spark):
    df = values(spark)
    got = {(r["row"], r["col"]): r["corr"] for r in st.corr_long(df, ["x", "y"], method="spearman").collect()}
    pdf = df.toPandas()
    both = pdf[["x", "y"]].rank()
    assert got["x", "y"] == pytest.approx(both.corr().loc["x", "y"], abs=1e-9) and got["x", "x"] == pytest.approx(1)


@pytest.mark.parametrize("accuracy", [10_000, 50])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_those_of_percentile(spark, accuracy, by):
    shares = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    df = values(spark)
    for c in ("x", "y"):
        got = rk.exact_quantiles(df, c, shares, by, accuracy)
        want = df.groupBy(*by).agg(F.percentile(c, F.array(*map(F.lit, shares))).alias("quantiles"))
        rows = lambda d: sorted((tuple(r[b] for b in by), r["quantiles"]) for r in d.collect())
        assert rows(got) == rows(want)


def test_rows_of_large_groups_are_not_exchanged_for_their_bounds(spark):
    """Only sums, sketches and counts of distinct values are, whatever Spark makes of the sizes of the two sides."""
    df = values(spark)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rk.exact_quantiles(df, "x", [0.01, 0.5], ["g"], 50)
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    below = [b for a, b in zip(lines, lines[1:]) if "- Exchange" in a and "RoundRobin" not in a]
    assert below and all("Aggregate" in b for b in below)
    assert got == sorted(map(tuple, df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.01), F.lit(0.5)))).collect()))


def test_few_values(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, x double")
    got = {r["g"]: r["quantiles"] for r in rk.exact_quantiles(df, "x", [0.25, 0.5], ["g"]).collect()}
    assert got == {"a": [3.0, 3.0], "b": [1.25, 1.5]}


def test_hot_keys_are_sorted_by_stretches(spark):
    rng = random.Random(6)
    day = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(0, 9000))
    left = spark.createDataFrame([(rng.choice(["hot"] * 4 + ["a", "b", None]), day(), i) for i in range(1500)] + [("a", None, 1500)], "ticker string, date timestamp, i int")
    right = spark.createDataFrame([(k, day(), float(j)) for k in ("hot", "a", "b") for j in range(60)], "ticker string, date timestamp, v double").dropDuplicates(["ticker", "date"])
    rows = lambda df: sorted((r["i"], r["v"]) for r in df.withColumn("v", F.coalesce("v", F.lit(-1.0))).collect())
    want = rows(fr.asof(left, right))
    assert len(want) == 1501
    for most in (1, 40, 10**6):
        assert rows(fr.asof(left, right, most=most)) == want
    both = left.select(F.col("ticker").alias("_by"), F.col("date").alias("_at"))
    sizes = fr.stretched(both.filter("_by = 'hot'"), 40).groupBy("_slot").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) <= 80
    assert fr.stretched(both.filter("_by = 'a'"), 10**6).select("_slot").distinct().count() <= 2
