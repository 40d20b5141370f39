"""Blocked matrices, tree QR and two-level scans against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import least_squares as ls
from quantloom.operators import matrices as mx
from quantloom.operators import portfolio as pf
from quantloom.operators import scans
from quantloom.operators import statistics as st


def panel(spark, n_names=23, n_times=120, seed=1, gaps=0.2):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=n_times)
    wide = pd.DataFrame({f"n{k:03d}": 1000 * (k % 3) + common * (k % 4) + rng.normal(size=n_times) for k in range(n_names)}, index=pd.date_range("1996-11-01", periods=n_times).date)
    wide = wide.mask(rng.random(wide.shape) < gaps)
    wide["flat"], wide["once"] = 0.1, np.nan
    wide.loc[wide.index[5], "once"] = 3.0
    long = wide.rename_axis("date").reset_index().melt("date", var_name="ticker", value_name="ret")
    return wide, spark.createDataFrame(long.astype({"ret": object}).where(long["ret"].notna(), None), "date date, ticker string, ret double")


def matrix(df):
    return df.toPandas().pivot(index="row", columns="col", values="corr")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_blocks_and_stripes_give_the_whole_matrix(spark, method):
    wide, long = panel(spark)
    got = matrix(mx.panel_corr(long, method=method, block=4, rows=16))
    want = (wide.rank() if method == "spearman" else wide).corr(min_periods=2)
    want.loc["flat"], want["flat"] = np.nan, np.nan
    pd.testing.assert_frame_equal(got, want.reindex(index=got.index, columns=got.columns), check_names=False, rtol=1e-9)
    assert set(got.index) == set(wide.columns)


def test_only_times_known_to_all(spark):
    wide, long = panel(spark, 5, 60, gaps=0.05)
    long = long.filter("ticker <> 'once'")
    want = wide.drop(columns=["once"]).dropna().corr()
    want.loc["flat"], want["flat"] = np.nan, np.nan
    got = matrix(mx.panel_corr(long, dropna="any", block=2, rows=10))
    pd.testing.assert_frame_equal(got, want.reindex(index=got.index, columns=got.columns), check_names=False, rtol=1e-9)


def test_no_series(spark):
    none = spark.createDataFrame([], "date date, ticker string, ret double")
    assert mx.panel_corr(none).collect() == [] and mx.panel_rolling(none).collect() == []


def test_rolling_matrices_across_stripes(spark):
    wide, long = panel(spark, 9, 70)
    got = mx.panel_rolling(long, 20, block=4, rows=19).toPandas()
    assert len(got) == 51 * 11 * 10 / 2 and (got["row"] < got["col"]).all()
    by = got.set_index(["date", "row", "col"])["corr"]
    for end in range(19, 70):
        part = wide.iloc[end - 19 : end + 1]
        want = part.corr(min_periods=2).where(lambda m: (m.abs() <= 1 + 1e-9))
        for a, b in [("n000", "n001"), ("n003", "n008"), ("n002", "n007")]:
            assert by[wide.index[end], a, b] == pytest.approx(want.loc[a, b], nan_ok=True)
        assert pd.isna(by[wide.index[end], "flat", "n001"])


def test_candidates_grow_with_stripes_not_times(spark):
    """Rows that leave the products: pairs of names for each stripe, whatever the times in it."""
    parts = []
    for times in (64, 128):
        _, long = panel(spark, 20, times, gaps=0.0)
        df = long.filter("ticker LIKE 'n%'").select(F.col("date").alias("_on"), F.col("ticker").alias("_name"), F.col("ret").alias("_v"))
        names = mx.in_blocks(df, "_name", 8)
        at = df.select("_on").distinct().withColumn("_stripe", F.lit(0)).withColumn("_t", F.datediff("_on", F.lit("1996-11-01")))
        placed = df.join(names, "_name").join(at, "_on")
        import pyarrow as pa

        schema = pa.schema([("row", pa.string()), ("col", pa.string()), *((s, pa.float64()) for s in mx.SUMS)])
        parts.append(mx.met_pairs(placed, names, "_name", at.select("_stripe").distinct(), mx.pair_sums, schema, "row string, col string, " + ", ".join(f"{s} double" for s in mx.SUMS)).count())
    assert parts == [210, 210]


def near_collinear(n=400, seed=3, gap=1e-7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    near = x + gap * rng.normal(size=n)
    y = 1 + 2 * x - 3 * near / 1 + 0.1 * rng.normal(size=n)
    return pd.DataFrame({"date": pd.date_range("2000-01-01", periods=n).date, "g": np.where(np.arange(n) % 3, "a", "b"), "y": y, "x": x, "near": near})


def test_near_collinear_columns_are_told_apart(spark):
    pdf = near_collinear()
    df = spark.createDataFrame(pdf).repartition(7)
    for key, part in pdf.groupby("g"):
        want = np.linalg.pinv(np.c_[np.ones(len(part)), part["x"], part["near"]]) @ part["y"]
        got = ls.least_squares(df, "y", ["x", "near"], ["g"]).filter(F.col("g") == key).first()
        np.testing.assert_allclose([got["alpha"], got["x"], got["near"]], want, rtol=1e-6)
        assert got["n"] == len(part)


def test_dependent_columns_give_the_least_norm(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    pdf = pd.DataFrame({"y": 1 + 4 * x, "x": x, "twice": x, "z": rng.normal(size=50)})
    got = ls.least_squares(spark.createDataFrame(pdf).repartition(3), "y", ["x", "twice", "z"]).first()
    np.testing.assert_allclose([got["alpha"], got["x"], got["twice"], got["z"]], [1, 2, 2, 0], atol=1e-9)


def test_few_rows_and_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 1.0), ("c", 2.0, 1.0), ("c", 4.0, 2.0), ("c", 9.0, None)], "g string, y double, x double")
    got = {r["g"]: r for r in ls.least_squares(df, "y", ["x"], ["g"]).collect()}
    assert set(got) == {"a", "c"} and got["c"]["n"] == 2
    np.testing.assert_allclose([got["c"]["alpha"], got["c"]["x"]], [0, 2], atol=1e-12)
    np.testing.assert_allclose([got["a"]["alpha"], got["a"]["x"]], [0.2, 0.4])
    assert ls.least_squares(df.filter("false"), "y", ["x"]).collect() == []


def test_dummies_without_an_intercept(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"date": [pd.Timestamp("2000-01-01").date()] * 30, "ticker": [f"t{i}" for i in range(30)], "g": [f"g{i % 3}" for i in range(30)], "x": rng.normal(size=30), "y": rng.normal(size=30)})
    got = {r["param"]: r["beta"] for r in st.cross_section_betas(spark.createDataFrame(pdf), "y", ["x"], winsor=(0.0, 1.0), group="g", intercept=False).collect()}
    design = np.c_[pdf["x"], pdf["g"] == "g1", pdf["g"] == "g2"].astype(float)
    want = np.linalg.pinv(design) @ pdf["y"]
    np.testing.assert_allclose([got["x"], got["g_g1"], got["g_g2"]], want, rtol=1e-9)


def ticks(spark, n=500, seed=2):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"date": pd.Timestamp("1999-12-29") + pd.to_timedelta(np.sort(rng.choice(20_000, n, replace=False)), "min"), "port_ret": rng.normal(0, 0.01, n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None))).repartition(5)


def test_places_across_slots(spark):
    pdf, df = ticks(spark)
    got = scans.numbered(df, "date", "day").orderBy("date").toPandas()
    assert got["_at"].tolist() == list(range(len(pdf)))


@pytest.mark.parametrize("kind, want", [("sum", lambda s: s.cumsum().ffill()), ("max", lambda s: s.cummax().ffill()), ("min", lambda s: s.cummin().ffill()), ("last", lambda s: s.ffill())])
def test_running_values_across_slots(spark, kind, want):
    pdf, df = ticks(spark)
    got = scans.scanned(df, "date", "day", {"v": (kind, F.col("a"))}).orderBy("date").toPandas()["v"]
    np.testing.assert_allclose(got, want(pdf["a"]).fillna(0.0 if kind == "sum" else np.nan), rtol=1e-9)


def test_series_in_slots_are_as_in_one_window(spark):
    _, df = ticks(spark)
    rows = lambda d: d.orderBy("date").toPandas()
    pd.testing.assert_frame_equal(rows(pf.drawdown_curve(df, "day")), rows(pf.drawdown_curve(df)), rtol=1e-9)
    pd.testing.assert_frame_equal(rows(pf.rolling_risk(df, 21, chunk="day")), rows(pf.rolling_risk(df, 21)), rtol=1e-9)
    pd.testing.assert_frame_equal(rows(st.rolling_corr(df, "a", "b", 21, chunk="day")), rows(st.rolling_corr(df, "a", "b", 21)), rtol=1e-9)
    pd.testing.assert_frame_equal(pf.drawdown_episodes(df, "day").orderBy("start").toPandas(), pf.drawdown_episodes(df).orderBy("start").toPandas(), rtol=1e-9)
    one, other = (st.ts_regression(df, "a", ["b"], chunk=c).toPandas() for c in (None, "day"))
    pd.testing.assert_frame_equal(one, other, rtol=1e-9)


def test_edges_are_carried_whatever_the_block(spark):
    pdf, df = ticks(spark, 200)
    framed = scans.framed(df, 30, "date", "day", size=29)
    own = framed.withColumn("n", F.count(F.lit(1)).over(scans.block_order().rowsBetween(-29, 0))).filter("_own").orderBy("date").toPandas()
    assert own["n"].tolist() == [min(i + 1, 30) for i in range(200)]
    got = ls.windowed(framed, "a", ["b"], 30).orderBy("date").toPandas()
    for end in (29, 30, 57, 58, 199):
        part = pdf.iloc[end - 29 : end + 1].dropna()
        want = np.linalg.lstsq(np.c_[np.ones(len(part)), part["b"]], part["a"], rcond=None)[0]
        row = got[got["date"] == pdf["date"][end]].iloc[0]
        np.testing.assert_allclose([row["alpha"], row["b"]], want, rtol=1e-8)


def test_no_window_over_a_whole_series(spark):
    """What is brought into one partition are slots, one row each: their last values, never a row's time."""
    _, df = ticks(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for plan in (st.rolling_corr(df, "a", "b", chunk="day"), st.rolling_regression(df, "a", ["b"], chunk="day"), pf.drawdown_curve(df, "day")):
            shown = plan._jdf.queryExecution().executedPlan().toString().splitlines()
            alone = [i for i, line in enumerate(shown) if "Exchange SinglePartition" in line]
            assert alone and all(any("Aggregate(key" in line and "=[_slot" in line for line in shown[i + 1 : i + 4]) for i in alone)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_many_blocks_of_a_stripe_shuffle_no_pairs(spark, method):
    """Nothing is exchanged once pairs are made, and no cell is copied for a join."""
    wide, long = panel(spark)
    out = mx.panel_corr(long, method=method, block=4, rows=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("MapInArrow")] and "Generate" not in plan[plan.index("MapInArrow") : plan.index("CartesianProduct")]
    got = matrix(out)
    want = (wide.rank() if method == "spearman" else wide).corr(min_periods=2)
    want.loc["flat"], want["flat"] = np.nan, np.nan
    pd.testing.assert_frame_equal(got, want.reindex(index=got.index, columns=got.columns), check_names=False, rtol=1e-9)
    assert set(got.index) == set(wide.columns)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_stripes_are_added_up_without_a_shuffle(spark, method):
    """Sums of two blocks over all stripes are complete where they are made."""
    wide, long = panel(spark)
    out = mx.panel_corr(long, method=method, block=4, rows=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    got = matrix(out)
    want = (wide.rank() if method == "spearman" else wide).corr(min_periods=2)
    want.loc["flat"], want["flat"] = np.nan, np.nan
    pd.testing.assert_frame_equal(got, want.reindex(index=got.index, columns=got.columns), check_names=False, rtol=1e-9)
    assert set(got.index) == set(wide.columns)


@pytest.mark.parametrize("kind", ["date", "timestamp", "string"])
@pytest.mark.parametrize("block, held", [(4, 1), (30, 1), (2, 1), (30, 4_000_000)])
def test_groups_of_stripes_give_the_whole_matrix(spark, kind, block, held):
    wide, long = panel(spark)
    got = matrix(mx.panel_corr(long.withColumn("date", F.col("date").cast(kind)), block=block, rows=10, held=held))
    want = wide.corr(min_periods=2)
    want.loc["flat"], want["flat"] = np.nan, np.nan
    pd.testing.assert_frame_equal(got, want.reindex(index=got.index, columns=got.columns), check_names=False, rtol=1e-9)
    assert set(got.index) == set(wide.columns)


@pytest.mark.parametrize("rows, more", [(1000, {}), (16, {}), (16, {"held": 1})])
def test_blocks_without_names(spark, rows, more):
    """Hashing deals no name to some of the blocks; those above them are not lost."""
    wide, long = panel(spark, 9)
    got = mx.panel_corr(long, block=1, rows=rows, **more)
    known = wide.notna().astype(int)
    assert got.count() == (known.T @ known > 0).sum().sum()
    rolled = mx.panel_rolling(long, 20, block=1, rows=rows)
    assert rolled.select("row", "col").distinct().count() == 11 * 10 / 2


def test_both_orders_take_the_room_of_one(spark, tmp_path):
    """A pair's number stands near its mirrored one's in the result, so that files hold it once."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"date": np.tile(pd.date_range("2000-01-01", periods=12).date, 700), "ticker": np.repeat([f"n{k:03d}" for k in range(700)], 12), "ret": rng.normal(size=8400)})
    mx.panel_corr(spark.createDataFrame(pdf)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 490_000
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < 6 * 490_000
    mirrored = out.select(F.col("col").alias("row"), F.col("row").alias("col"), "corr")
    assert out.exceptAll(mirrored).isEmpty()
