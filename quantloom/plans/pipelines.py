"""Whole runs: factor engine, momentum backtest, tearsheets and dashboard artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.factors import Composite, Momentum, Scoring, assign_bins, composite, factors, momentum_scores
from quantloom.operators.portfolio import Weights, drawdown_curve, drawdown_table, equal_weights, histogram, ic_stats, ic_table, cross_section_ic, portfolio_returns, rolling_risk, summary, turnover
from quantloom.operators.statistics import mean_corr, series_corr
from quantloom.sources.files import read_csv, write_json, write_report, write_table


def run_factors(prices: DataFrame, funda: DataFrame, labels: DataFrame | None = None, scoring: Scoring = Scoring(), combine: Composite = Composite()) -> DataFrame:
    """Scores, composite and quintile of every (date, ticker)."""
    return composite(factors(prices, funda, labels, scoring), combine)


def momentum_backtest(prices: DataFrame, scoring: Scoring = Scoring(), how: Momentum = Momentum(), weights: Weights = Weights()) -> dict[str, DataFrame]:
    """factors, ranks, weights and port: daily returns of the top less the bottom momentum quintile."""
    scored = momentum_scores(prices, None, scoring, how)
    ranks = assign_bins(scored, "momentum_z", "rank", min_assets=scoring.min_assets)
    held = equal_weights(ranks, weights)
    return {"factors": scored, "ranks": ranks, "weights": held, "port": portfolio_returns(prices, held)}


def performance_block(prices: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summary rounded to four places, and the returns."""
    port = portfolio_returns(prices, weights)
    figures = summary(port, turnover(weights))
    return figures.select(*(F.bround(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in figures.dtypes)), port


def correlation_block(scores: DataFrame, names: Sequence[str], series: DataFrame | None = None, series_names: Sequence[str] = (), dropna: str = "any") -> dict[str, DataFrame]:
    """cs_corr, the mean over dates of the scores' matrices, and ts_corr, the matrix of return series where there are some."""
    out = {"cs_corr": mean_corr(scores, list(names))}
    if series is not None:
        out["ts_corr"] = series_corr(series, list(series_names), dropna=dropna)
    return out


def tearsheet(prices: DataFrame, weights: DataFrame, scores: DataFrame, names: Sequence[str], horizon: int = 21, series: DataFrame | None = None, series_names: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables by name, each a plan of its own."""
    figures, port = performance_block(prices, weights)
    out = {"summary": figures, "returns": port, "drawdowns": drawdown_table(port), "ic": ic_table(scores, prices, list(names), horizon)}
    return out | correlation_block(scores, names, series, series_names)


def small_tearsheet(scores: DataFrame, port: DataFrame, x: str = "score", y: str = "fwd_ret") -> DataFrame:
    """One row: the IC's statistics and the returns' mean, deviation and their ratio, not annualised."""
    sd = F.stddev_samp("port_ret")
    figures = port.agg(F.avg("port_ret").alias("mean_return"), sd.alias("vol"), F.when(sd > 1e-12, F.avg("port_ret") / sd).alias("sharpe"))
    return ic_stats(cross_section_ic(scores.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y)).join(F.broadcast(figures))


def composite_backtest(prices: DataFrame, scoring: Scoring = Scoring()) -> dict[str, DataFrame]:
    """factors, ranks and weights of the momentum backtest with the momentum score as composite, and port."""
    factors = momentum_scores(prices, None, scoring).select("date", "ticker", "momentum_z", F.col("momentum_z").alias("composite"))
    ranks = assign_bins(factors, "composite", "rank", min_assets=scoring.min_assets).select("date", "ticker", "composite", "rank")
    weights = equal_weights(ranks, Weights())
    return {"factors": factors, "ranks": ranks, "weights": weights, "port": portfolio_returns(prices, weights)}


#: The names under which the dashboard's summary has its figures.
PERF_SUMMARY = {"cagr": "cagr", "vol_annual": "vol_ann", "sharpe": "sharpe", "max_drawdown": "max_dd"}


def dashboard(prices: DataFrame, path: str, scoring: Scoring = Scoring()) -> None:
    """The ten tables of the dashboard as Parquet, and perf_summary.json, under path.

    Scores, ranks, weights and returns are written first; what rests on them reads them back.
    """
    spark, run = prices.sparkSession, composite_backtest(prices, scoring)
    back = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    write_table(run["factors"], f"{path}/factors.parquet")
    ranks = assign_bins(back("factors"), "composite", "rank", min_assets=scoring.min_assets).select("date", "ticker", "composite", "rank")
    write_table(ranks, f"{path}/ranks.parquet")
    write_table(equal_weights(back("ranks"), Weights()), f"{path}/weights.parquet")
    write_table(portfolio_returns(prices, back("weights")), f"{path}/returns.parquet")
    port = back("returns")
    curve, rolled = drawdown_curve(port), rolling_risk(port)
    tables = {
        "equity": curve.select("date", F.col("wealth").alias("equity")),
        "drawdown": curve.select("date", "drawdown"),
        "rolling_vol": rolled.select("date", F.col("vol").alias("rolling_vol")),
        "rolling_sharpe": rolled.select("date", F.col("sharpe").alias("rolling_sharpe")),
        "returns_hist": histogram(port).select(F.col("left").alias("bin_left"), F.col("right").alias("bin_right"), F.col("n").alias("freq")),
        "correlations": mean_corr(back("factors"), ["momentum_z"]),
    }
    for name, table in tables.items():
        write_table(table, f"{path}/{name}.parquet")
    write_json(summary(port).select(*(F.coalesce(c, F.lit(0.0)).alias(k) for c, k in PERF_SUMMARY.items())), f"{path}/perf_summary.json")


def reports(prices: DataFrame, path: str) -> None:
    """The backtest's six report tables as CSV under path; returns are written first and read back by the others."""
    run = composite_backtest(prices)
    write_report(run["port"], f"{path}/portfolio_returns.csv")
    port = read_csv(prices.sparkSession, f"{path}/portfolio_returns.csv", "date DATE, port_ret DOUBLE")
    curve = drawdown_curve(port)
    tables = {
        "performance_summary": summary(port, turnover(run["weights"])),
        "drawdowns": drawdown_table(port),
        "drawdown_curve": curve,
        "equity": curve.select("date", "wealth"),
        "cs_corr_mean": mean_corr(run["factors"], ["momentum_z"]),
    }
    for name, table in tables.items():
        write_report(table, f"{path}/{name}.csv")
