"""Correlations and regressions against NumPy and pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd

from quantloom.operators import statistics as st
from quantloom.plans.pipelines import small_tearsheet

START = dt.date(2020, 1, 1)


def days(n):
    return [START + dt.timedelta(days=i) for i in range(n)]


def test_corr_matrix(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=300)
    pdf = pd.DataFrame({"date": days(300), "a": a, "b": a + 0.05 * rng.normal(size=300), "c": rng.normal(size=300)})
    pdf.loc[5:9, "b"] = None
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    for method in ("pearson", "spearman"):
        got = {(r["row"], r["col"]): r["corr"] for r in st.corr_long(df, ["a", "b", "c"], method=method).collect()}
        src = pdf[["a", "b", "c"]] if method == "pearson" else pdf[["a", "b", "c"]].rank()
        want = src.corr()
        assert all(math.isclose(v, want.loc[k], abs_tol=1e-9) for k, v in got.items()) and len(got) == 9
    assert st.upper_triangle(st.corr_long(df, ["a", "b", "c"]), ["a", "b", "c"]).count() == 3


def hac(z, u, lags):
    g = z * u[:, None]
    s = g.T @ g
    for h in range(1, lags + 1):
        c = g[:-h].T @ g[h:]
        s += (1 - h / (lags + 1)) * (c + c.T)
    inverse = np.linalg.pinv(z.T @ z)
    return np.sqrt(np.diag(inverse @ s @ inverse))


def test_regression_with_hac(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(scale=0.01, size=(400, 2))
    y = 0.0015 + 1.1 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(scale=0.005, size=400)
    df = spark.createDataFrame(pd.DataFrame({"date": days(400), "y": y, "m": x[:, 0], "s": x[:, 1]}))
    rows = {r["param"]: r for r in st.ts_regression(df, "y", ["m", "s"]).collect()}
    z = np.column_stack([np.ones(400), x])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    se = hac(z, y - z @ beta, 4)
    for i, name in enumerate(("alpha", "m", "s")):
        assert math.isclose(rows[name]["coef"], beta[i], rel_tol=1e-8) and math.isclose(rows[name]["stderr"], se[i], rel_tol=1e-8)
    assert rows["m"]["r2"] > 0.6 and rows["m"]["n_obs"] == 400
    assert st.ts_regression(df.filter("false"), "y", ["m"]).collect() == []


def test_collinear_columns_get_the_least_norm(spark):
    df = spark.createDataFrame(pd.DataFrame({"date": days(30), "y": np.arange(30.0), "m": np.arange(30.0), "s": np.arange(30.0)}))
    got = {r["param"]: r["coef"] for r in st.ts_regression(df, "y", ["m", "s"]).collect()}
    assert math.isclose(got["m"], 0.5, abs_tol=1e-6) and math.isclose(got["s"], 0.5, abs_tol=1e-6)


def panel(spark, t, n, beta, noise, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(t):
        s = rng.normal(size=n)
        s = (s - s.mean()) / s.std()
        r = rng.normal(scale=0.01) + beta * s + rng.normal(scale=noise, size=n)
        rows += [(START + dt.timedelta(days=30 * i), f"T{k}", float(s[k]), float(r[k]), "AB"[k % 2]) for k in range(n)]
    return spark.createDataFrame(rows, "date date, ticker string, score double, fwd_ret double, grp string")


def test_fama_macbeth(spark):
    df = panel(spark, 36, 80, 0.6, 0.03, 1)
    for group in (None, "grp"):
        betas = st.cross_section_betas(df, "fwd_ret", ["score"], winsor=(0.0, 1.0), group=group)
        row = {r["param"]: r for r in st.fama_macbeth(betas).collect()}
        assert abs(row["score"]["mean_beta"] - 0.6) < 0.05 and row["score"]["tstat"] > 5 and row["alpha"]["n_dates"] == 36
        assert ("grp_B" in row) == (group is not None)
    assert st.cross_section_betas(df.filter("ticker < 'T2'"), "fwd_ret", ["score"], min_names=50).collect() == []


def test_small_tearsheet(spark):
    df = panel(spark, 18, 40, 0.7, 0.04, 2)
    port = spark.createDataFrame(pd.DataFrame({"date": days(10), "port_ret": np.linspace(-0.01, 0.02, 10)}))
    row = small_tearsheet(df, port).first()
    assert row["ic_mean"] > 0.2 and math.isclose(row["mean_return"], 0.005) and row["sharpe"] > 0


def test_rolling_against_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"date": days(60), "a": rng.normal(size=60), "b": rng.integers(0, 4, 60).astype(float)})
    df = spark.createDataFrame(pdf)
    for method in ("pearson", "spearman"):
        got = [r["corr"] for r in st.rolling_corr(df, "a", "b", 9, method).orderBy("date").collect()]
        assert got[:8] == [None] * 8
        for i in range(8, 60):
            w = pdf[["a", "b"]].iloc[i - 8 : i + 1]
            assert math.isclose(got[i], (w.rank() if method == "spearman" else w).corr().iloc[0, 1], abs_tol=1e-9)
    fits = st.rolling_regression(df, "a", ["b"], 20).orderBy("date").collect()
    slope, cut = np.polyfit(pdf.b[:20], pdf.a[:20], 1)
    assert len(fits) == 41 and math.isclose(fits[0]["b"], slope, abs_tol=1e-9) and math.isclose(fits[0]["alpha"], cut, abs_tol=1e-9)
