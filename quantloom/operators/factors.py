"""Value, momentum and quality signals, cross-sectional scores and their composite."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import average_rank, distinct_edges, quantile_edges, ratio, ts, winsorize, xs, zscore
from quantloom.functions.columns import bins_by_quantile, bins_by_width
from quantloom.operators.frames import asof

#: The names under which equity and debt come.
EQUITY = ("shareholders_equity", "total_equity", "book_equity", "equity")
DEBT = ("total_debt", "debt_total", "short_long_term_debt_total")


@dataclass(frozen=True)
class Scoring:
    lower: float = 0.01
    upper: float = 0.99
    min_assets: int = 5
    group: str | None = None


@dataclass(frozen=True)
class Momentum:
    lookback_months: int = 6
    skip_months: int = 1
    min_history_days: int = 120


@dataclass(frozen=True)
class Quality:
    min_equity_abs: float = 1000.0
    max_de: float | None = 20.0


@dataclass(frozen=True)
class Composite:
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(("value_z", "momentum_z", "quality_z"), 1 / 3))
    rescore: bool = True
    lower: float = 0.01
    upper: float = 0.99
    bins: int = 5


def score(df: DataFrame, signal: str, out: str, cfg: Scoring = Scoring()) -> DataFrame:
    """Winsorized z-score of signal by date, or date and group; rows without signal or group go, small ones get NULL."""
    over = xs(*([cfg.group] if cfg.group else []))
    df = df.filter(F.col(signal).isNotNull())
    if cfg.group:
        df = df.filter(F.col(cfg.group).isNotNull())
    df = df.withColumn("_clipped", winsorize(signal, over, cfg.lower, cfg.upper))
    enough = F.count(F.lit(1)).over(over) >= cfg.min_assets
    return df.withColumn(out, F.when(enough, zscore("_clipped", over))).drop("_clipped")


def earnings_yield(prices: DataFrame, funda: DataFrame, prefer: str = "pe_ttm", from_income: bool = True) -> DataFrame:
    """1 / preferred P/E, else 1 / pe, else income over market value; by the latest filing."""
    have = [c for c in dict.fromkeys((prefer, "pe", "net_income_ttm", "market_cap", "shares_out")) if c in funda.columns]
    df = asof(prices.select("date", "ticker", "adj_close"), funda, values=have)
    tries = [ratio(F.lit(1.0), F.col(c)) for c in (prefer, "pe") if c in have]
    if from_income and "net_income_ttm" in have and ("market_cap" in have or "shares_out" in have):
        value = F.col("market_cap") if "market_cap" in have else F.col("adj_close") * F.col("shares_out")
        tries.append(ratio(F.col("net_income_ttm"), value))
    return df.select("date", "ticker", (F.coalesce(*tries) if tries else F.lit(None).cast("double")).alias("earnings_yield"))


def simple_earnings_yield(df: DataFrame, pe: str = "pe") -> DataFrame:
    return df.withColumn("earnings_yield", F.when(F.col(pe) > 0, 1 / F.col(pe)))


def momentum(prices: DataFrame, cfg: Momentum = Momentum()) -> DataFrame:
    """Price as of skip months ago over that of skip and lookback months ago, less 1; one row for each price row."""
    px = prices.select("date", "ticker", "adj_close")
    far = -(cfg.skip_months + cfg.lookback_months)
    price = px.withColumnRenamed("adj_close", "p_end")
    df = asof(px.select("date", "ticker"), price, at=F.add_months("date", -cfg.skip_months))
    df = asof(df, price.withColumnRenamed("p_end", "p_start"), at=F.add_months("date", far))
    old = F.datediff("date", F.add_months("date", far)) >= cfg.min_history_days
    return df.withColumn("mom_ret", F.when(old, ratio(F.col("p_end"), F.col("p_start")) - 1))


def row_momentum(prices: DataFrame, skip: bool = True) -> DataFrame:
    """126 rows' return, 21 rows ago if skip; then each run of known values is cut to its least value from there on."""
    over = ts()
    end = F.lag("adj_close", 21).over(over) if skip else F.col("adj_close")
    start = F.lag("adj_close", 147 if skip else 126).over(over)
    df = prices.withColumn("_raw", ratio(end, start) - 1)
    df = df.withColumn("_run", F.count(F.when(F.col("_raw").isNull(), 1)).over(over))
    least = F.min("_raw").over(W.partitionBy("ticker", "_run").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("mom_6m", F.when(F.col("_raw").isNotNull(), least)).drop("_raw", "_run")


def quality(prices: DataFrame, funda: DataFrame, cfg: Quality = Quality()) -> DataFrame:
    """roe, de and quality_raw, the difference of their z-scores on dates with five of each."""
    pick = lambda names: next((c for c in names if c in funda.columns), None)
    equity, debt = pick(EQUITY), pick(DEBT)
    income = pick(("net_income_ttm",))
    df = asof(prices.select("date", "ticker"), funda, values=[c for c in (equity, debt, income) if c])
    none = F.lit(None).cast("double")
    valid = F.when(F.abs(F.col(equity)) >= cfg.min_equity_abs, F.col(equity)) if equity else none
    roe = ratio(F.col(income), valid) if income and equity else none
    de = ratio(F.col(debt), valid) if debt and equity else none
    if cfg.max_de is not None:
        de = F.when(de.isNotNull(), F.least(de, F.lit(cfg.max_de)))
    df = df.select("date", "ticker", roe.alias("roe"), de.alias("de"))
    return df.transform(component, "roe").transform(component, "de").withColumn("quality_raw", F.col("roe_pre") - F.col("de_pre"))


def component(df: DataFrame, name: str) -> DataFrame:
    df = df.withColumn("_clipped", winsorize(name, xs()))
    return df.withColumn(f"{name}_pre", F.when(F.count(name).over(xs()) >= 5, zscore("_clipped", xs()))).drop("_clipped")


def simple_quality(df: DataFrame) -> DataFrame:
    """Mean of the known ones of z(roe) and -z(de) over the whole frame; its moments are one row."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in ("roe", "de") for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    a, b = z("roe"), -z("de")
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    total = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return df.join(F.broadcast(stats)).withColumn("quality_score", F.when(n > 0, total / n)).select(*df.columns, "quality_score")


def with_group(df: DataFrame, labels: DataFrame | None, group: str | None) -> DataFrame:
    return df if labels is None or group is None else asof(df, labels, values=[group])


def value_scores(prices: DataFrame, funda: DataFrame, labels: DataFrame | None = None, cfg: Scoring = Scoring()) -> DataFrame:
    return score(with_group(earnings_yield(prices, funda), labels, cfg.group), "earnings_yield", "value_z", cfg)


def momentum_scores(prices: DataFrame, labels: DataFrame | None = None, cfg: Scoring = Scoring(), how: Momentum = Momentum()) -> DataFrame:
    return score(with_group(momentum(prices, how).select("date", "ticker", "mom_ret"), labels, cfg.group), "mom_ret", "momentum_z", cfg)


def quality_scores(prices: DataFrame, funda: DataFrame, labels: DataFrame | None = None, cfg: Scoring = Scoring(), how: Quality = Quality()) -> DataFrame:
    """quality_z of quality_raw, with roe_z and de_z of the same rows."""
    df = score(with_group(quality(prices, funda, how), labels, cfg.group), "quality_raw", "quality_z", cfg)
    over = xs(*([cfg.group] if cfg.group else []))
    for name in ("roe", "de"):
        df = df.withColumn("_clipped", winsorize(name, over, cfg.lower, cfg.upper))
        df = df.withColumn(f"{name}_z", F.when(F.count(F.lit(1)).over(over) >= cfg.min_assets, zscore("_clipped", over))).drop("_clipped")
    return df


def factors(prices: DataFrame, funda: DataFrame, labels: DataFrame | None = None, cfg: Scoring = Scoring()) -> DataFrame:
    """date, ticker and the three scores, of all rows that have any."""
    keys = ["date", "ticker"]
    out = value_scores(prices, funda, labels, cfg).select(*keys, "value_z")
    out = out.join(momentum_scores(prices, labels, cfg).select(*keys, "momentum_z"), keys, "outer")
    return out.join(quality_scores(prices, funda, labels, cfg).select(*keys, "quality_z"), keys, "outer")


def composite(df: DataFrame, cfg: Composite = Composite()) -> DataFrame:
    """composite, the weighted sum of the known scores, winsorized and scored again by date; and its quintile."""
    own = [(F.col(c), w) for c, w in cfg.weights.items()]
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in own), F.lit(0.0))
    df = df.withColumn("composite", F.when(F.coalesce(*(c for c, _ in own)).isNotNull(), total))
    if cfg.rescore:
        df = df.withColumn("_clipped", winsorize("composite", xs(), cfg.lower, cfg.upper))
        df = df.withColumn("composite", zscore("_clipped", xs())).drop("_clipped")
    return assign_bins(df, "composite", "quintile", cfg.bins)


def assign_bins(df: DataFrame, c: str, out: str, n: int = 5, group: str | None = None, min_assets: int = 0, method: str = "quantile", high_is_best: bool = True) -> DataFrame:
    """Bins 1 to n as doubles by date, or date and group; n is the best. Equal quantile edges fall back to ranks' widths."""
    part = ["date", *([group] if group else [])]
    over = xs(*part[1:])
    df = df.filter(F.col(group).isNotNull()) if group else df
    df = df.withColumn("_rank", average_rank(c, *part)).withColumn("_edges", quantile_edges(c, over, n))
    df = df.withColumn("_share", F.col("_rank") / F.max("_rank").over(over))
    bins = bins_by_width(F.col("_share"), over, n)
    if method == "quantile":
        bins = F.when(distinct_edges(F.col("_edges"), n), bins_by_quantile(c, F.col("_edges"), n)).otherwise(bins)
    if not high_is_best:
        bins = n + 1 - bins
    known = F.count(c).over(over) >= min_assets
    return df.withColumn(out, F.when(known, bins.cast("double"))).drop("_rank", "_edges", "_share")


def row_quintiles(df: DataFrame, c: str = "score", out: str = "quintile") -> DataFrame:
    """1 to 5 by position among the known values of a date, ties by ticker; NULL with fewer than two."""
    nth = F.row_number().over(W.partitionBy("date").orderBy(F.col(c).asc_nulls_last(), "ticker")) - 1
    n = F.count(c).over(xs())
    df = df.withColumn("_nth", nth).withColumn("_n", n)
    bins = F.greatest(F.lit(1), F.floor((5 * F.col("_nth") + F.col("_n") - 2) / F.greatest(F.col("_n") - 1, F.lit(1))).cast("int"))
    return df.withColumn(out, F.when(F.col(c).isNotNull() & (F.col("_n") >= 2), bins.cast("double"))).drop("_nth", "_n")
