"""Literal cases of bins, weights, returns, drawdowns and information coefficients."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from quantloom.functions.columns import average_rank, xs, zscore
from quantloom.operators import factors as fac
from quantloom.operators import portfolio as pf
from quantloom.operators.frames import asof

D1, D2 = dt.date(2020, 1, 2), dt.date(2020, 1, 3)
NAMES = ["OAK", "ELM", "ASH", "FIR", "YEW"]


def frame(spark, rows, value):
    out = [(d, n, v) for d, vs in rows for n, v in zip(NAMES, vs)]
    return spark.createDataFrame(out, f"date date, ticker string, {value} double")


def wide(df, value):
    return {(r["date"], r["ticker"]): r[value] for r in df.collect()}


@pytest.fixture
def scores(spark):
    return frame(spark, [(D1, [-3.5, 0.25, 4.0, 7.25, 12.0]), (D2, [31.0, 22.5, None, 14.0, 3.0])], "score")


def test_row_quintiles(scores):
    got = wide(fac.row_quintiles(scores), "quintile")
    assert [got[D1, n] for n in NAMES] == [1, 2, 3, 4, 5]
    assert got[D2, "ASH"] is None and got[D2, "OAK"] > got[D2, "ELM"] > got[D2, "FIR"] > got[D2, "YEW"]


def test_long_only_and_long_short(scores):
    ranks = fac.row_quintiles(scores, out="rank")
    long = wide(pf.long_only_bin(ranks), "weight")
    assert long[D1, "YEW"] == 1 and long[D2, "OAK"] == 1 and sum(long.values()) == 2
    both = wide(pf.long_short_bins(ranks), "weight")
    assert both[D1, "YEW"] == 0.5 and both[D1, "OAK"] == -0.5 and sum(map(abs, both.values())) == 2


def test_returns_and_turnover(spark):
    w = frame(spark, [(D1, [0.25, 0.0, 0.75, 0.0, 0.0]), (D2, [0.0, 0.0, 0.5, 0.75, -0.25])], "weight")
    r = frame(spark, [(D1, [0.004, -0.007, 0.016, 0.5, -0.25]), (D2, [0.125, -0.5, 0.032, -0.008, 0.016])], "ret")
    got = {x["date"]: x["port_ret"] for x in pf.weighted_returns(w, r).collect()}
    assert math.isclose(got[D1], 0.013) and math.isclose(got[D2], 0.006)
    assert {x["date"]: x["turnover"] for x in pf.turnover(w).collect()} == {D1: 0.0, D2: 0.75}


def path(spark, values, start=dt.date(2020, 1, 1)):
    return spark.createDataFrame([(start + dt.timedelta(days=i), v) for i, v in enumerate(values)], "date date, port_ret double")


def test_drawdowns(spark):
    assert math.isclose(pf.drawdown_curve(path(spark, [0.3, -0.2, -0.15, 0.1])).agg({"drawdown": "min"}).first()[0], -0.32, rel_tol=1e-12)
    rows = pf.drawdown_episodes(path(spark, [0.1, -0.5, 1.0, -0.1, -0.1, 0.5, -0.2])).orderBy("start").collect()
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    assert [(r["start"], r["valley"], r["end"], r["length_days"], r["recovery_days"]) for r in rows[:1]] == [(day(1), day(1), day(2), 1, 1)]
    assert rows[-1]["end"] is None and rows[-1]["recovery_days"] is None
    assert pf.drawdown_episodes(path(spark, [0.1, 0.0, 0.2])).collect() == []


def scan(draw):
    """Spells below the peak, day by day."""
    out, start = [], None
    for i, x in enumerate(draw):
        if start is None and x < -1e-12:
            start = valley = i
        if start is not None:
            valley = i if x < draw[valley] else valley
            if abs(x) <= 1e-12:
                out.append((start, valley, i))
                start = None
    return out + ([(start, valley, None)] if start is not None else [])


def test_episodes_against_a_scan(spark):
    rng = random.Random(5)
    values = [rng.choice([-0.02, -0.01, 0.01, 0.02, 0.0]) for _ in range(300)]
    wealth = np.cumprod(1 + np.array(values))
    draw = wealth / np.maximum.accumulate(wealth) - 1
    got = pf.drawdown_episodes(path(spark, values)).orderBy("start").collect()
    index = lambda d: None if d is None else (d - dt.date(2020, 1, 1)).days
    assert [(index(r["start"]), index(r["valley"]), index(r["end"])) for r in got] == scan(draw)


def test_ic(spark):
    up = frame(spark, [(D1, [-2.0, 0.5, 0.75, 6.0, 40.0]), (D2, [9.0, 8.5, 2.0, -1.0, -7.0])], "score")
    ahead = frame(spark, [(d, [-0.3, -0.07, 0.002, 0.11, 0.6]) for d in (D1, D2)], "fwd")
    got = {r["date"]: r["ic"] for r in pf.cross_section_ic(up.join(ahead, ["date", "ticker"]), "score", "fwd").collect()}
    assert math.isclose(got[D1], 1, abs_tol=1e-12) and math.isclose(got[D2], -1, abs_tol=1e-12)


def test_asof_gives_one_row_each(spark):
    px = spark.createDataFrame([("A", dt.date(2021, 3, d), float(d)) for d in (1, 28, 29, 30, 31)] + [("B", dt.date(2020, 2, 29), 1.0)], "ticker string, date date, adj_close double")
    right = spark.createDataFrame([("A", dt.date(2021, 3, 28), 7.0), ("A", dt.date(2021, 3, 31), None)], "ticker string, date date, v double")
    got = {(r["ticker"], r["date"].day): r["v"] for r in asof(px, right).collect()}
    assert got == {("A", 1): None, ("A", 28): 7.0, ("A", 29): 7.0, ("A", 30): 7.0, ("A", 31): None, ("B", 29): None}
    assert fac.momentum(px).count() == px.count()


def test_bins_against_pandas(spark):
    rng = np.random.default_rng(3)
    rows = [(D1 + dt.timedelta(days=k), f"T{i}", float(v)) for k in range(40) for i, v in enumerate(rng.integers(0, rng.choice([3, 8, 1000]), rng.integers(1, 40)))]
    df = spark.createDataFrame(rows, "date date, ticker string, x double")
    got = wide(fac.assign_bins(df, "x", "bin"), "bin")

    def one(s):
        try:
            return pd.qcut(s, 5, labels=False) + 1
        except ValueError:
            share = s.rank() / s.rank().max()
            return pd.cut(share, 5, labels=False, include_lowest=True) + 1

    pdf = pd.DataFrame(rows, columns=["date", "ticker", "x"])
    want = pdf.groupby("date").x.transform(one)
    assert [got[d, t] for d, t in zip(pdf.date, pdf.ticker)] == list(want)


def test_weights_of_groups_and_caps(spark):
    rows = [(D1, "A", 5.0, "g", 10.0), (D1, "B", 5.0, "g", 30.0), (D1, "C", 5.0, "h", -1.0), (D1, "D", 1.0, None, 5.0), (D1, "E", 1.0, "h", None), (D1, "F", 3.0, "h", 1.0)]
    df = spark.createDataFrame(rows, "date date, ticker string, rank double, grp string, market_cap double")
    w = lambda out: {r["ticker"]: r["weight"] for r in out.collect()}
    assert w(pf.equal_weights(df, pf.Weights(group="grp"))) == {"A": 0.125, "B": 0.125, "C": 0.25, "D": 0.0, "E": -0.5, "F": 0.0}
    assert w(pf.cap_weights(df)) == {"A": 0.125, "B": 0.375, "C": 0.0, "D": -0.5, "E": 0.0, "F": 0.0}
    assert w(pf.cap_weights(df, pf.Weights(group="grp")))["C"] == 0.25
    capped = w(pf.cap_max_weight(pf.cap_weights(df), 0.2))
    assert math.isclose(capped["A"] + capped["B"], 0.5) and capped["D"] == -0.5
    neutral = w(pf.group_neutral(pf.equal_weights(df), "grp"))
    assert math.isclose(neutral["C"] + neutral["E"], 0) and neutral["A"] == 0


def test_signals(spark):
    pe = spark.createDataFrame([("A", 8.0), ("B", 25.0), ("C", None), ("D", 0.0), ("E", -3.0)], "id string, pe double")
    assert [r["earnings_yield"] for r in fac.simple_earnings_yield(pe).orderBy("id").collect()] == [0.125, 0.04, None, None, None]
    px = spark.createDataFrame([("A", D1 + dt.timedelta(days=i), 80 + 0.375 * i) for i in range(200)], "ticker string, date date, adj_close double")
    last = lambda skip: fac.row_momentum(px, skip).orderBy("date").collect()[-1]["mom_6m"]
    p = lambda i: 80 + 0.375 * i
    assert math.isclose(last(True), p(178) / p(52) - 1, rel_tol=1e-12) and math.isclose(last(False), p(199) / p(73) - 1, rel_tol=1e-12)
    assert all(r["mom_6m"] is None for r in fac.row_momentum(px.limit(50)).collect())
    q = spark.createDataFrame([("X", 0.22, None), ("Y", None, 0.3), ("Z", 0.07, 2.25)], "id string, roe double, de double")
    got = {r["id"]: r["quality_score"] for r in fac.simple_quality(q).collect()}
    assert None not in got.values() and got["X"] > got["Z"]


def test_padding_and_constants(spark):
    px = spark.createDataFrame([("A", D1 + dt.timedelta(days=i), v) for i, v in enumerate([None, 10.0, None, 12.0])], "ticker string, date date, adj_close double")
    assert [r["ret"] for r in pf.asset_returns(px).orderBy("date").collect()] == [None, None, 0.0, pytest.approx(0.2)]
    same = frame(spark, [(D1, [0.1] * 5)], "x")
    assert all(r["z"] is None for r in same.select(zscore("x", xs()).alias("z")).collect())
    assert {r["r"] for r in same.select(average_rank("x", "date").alias("r")).collect()} == {3.0}
