"""Weights, portfolio returns, turnover, drawdowns, summaries and information coefficients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import EPS, average_rank, corr, full, log_return, ratio, rolling, running, simple_return, ts, xs
from quantloom.operators.scans import block_order, framed, own_rows, scanned


@dataclass(frozen=True)
class Weights:
    mode: str = "long_short"
    gross: float = 1.0
    long_share: float = 0.5
    rank: str = "rank"
    long_bin: int = 5
    short_bin: int = 1
    group: str | None = None
    max_abs: float | None = None
    cap: str = "market_cap"

    @property
    def targets(self) -> tuple[float, float]:
        """Sums of the long and the short sleeve."""
        if self.mode == "long_only":
            return self.gross, 0.0
        if self.mode == "short_only":
            return 0.0, -self.gross
        return self.gross * self.long_share, -self.gross * (1 - self.long_share)


@dataclass(frozen=True)
class Summary:
    periods: int = 252
    rf_annual: float = 0.0
    downside: float = 0.0


def flags(df: DataFrame, rank: str = "rank", long_bin: int = 5, short_bin: int = 1) -> DataFrame:
    is_bin = lambda k: F.coalesce(F.col(rank) == float(k), F.lit(False))
    return df.withColumns({"is_long": is_bin(long_bin), "is_short": is_bin(short_bin)})


def extremes(df: DataFrame, rank: str = "rank", bins: tuple[int, ...] = (1, 5)) -> DataFrame:
    return df.filter(F.col(rank).isin(*map(float, bins)))


def sleeves(df: DataFrame, cfg: Weights) -> DataFrame:
    """_sleeve: 1 long, -1 short, 0 neither; _target: its sum."""
    long, short = cfg.mode in ("long_only", "long_short"), cfg.mode in ("short_only", "long_short")
    side = F.when(F.lit(long) & (F.col(cfg.rank) == float(cfg.long_bin)), 1).when(F.lit(short) & (F.col(cfg.rank) == float(cfg.short_bin)), -1).otherwise(0)
    up, down = cfg.targets
    return df.withColumn("_sleeve", side).withColumn("_target", F.when(F.col("_sleeve") == 1, up).when(F.col("_sleeve") == -1, down).otherwise(0.0))


def capped(df: DataFrame, cfg: Weights) -> DataFrame:
    """Weights cut to max_abs, then sleeves scaled to their targets once more, which may lift names over it again."""
    if cfg.max_abs is None:
        return df
    df = df.withColumn("weight", F.greatest(F.least("weight", F.lit(cfg.max_abs)), F.lit(-cfg.max_abs)))
    total = F.sum("weight").over(xs("_sleeve"))
    scaled = F.when(F.abs(total) > EPS, F.col("weight") * F.col("_target") / total).otherwise(0.0)
    return df.withColumn("weight", F.when(F.col("_sleeve") == 0, F.col("weight")).otherwise(scaled))


def finished(df: DataFrame) -> DataFrame:
    return df.drop("_sleeve", "_target")


def equal_weights(df: DataFrame, cfg: Weights = Weights()) -> DataFrame:
    """weight: the sleeve's target over its names, or over its groups and then each one's names. No group, no weight."""
    df = sleeves(df, cfg)
    if cfg.group:
        over = xs("_sleeve")
        groups = F.size(F.collect_set(cfg.group).over(over))
        share = F.when(F.col(cfg.group).isNotNull(), F.col("_target") / groups / F.count(F.lit(1)).over(xs("_sleeve", cfg.group))).otherwise(0.0)
    else:
        share = F.col("_target") / F.count(F.lit(1)).over(xs("_sleeve"))
    return finished(capped(df.withColumn("weight", F.when(F.col("_sleeve") != 0, share).otherwise(0.0)), cfg))


def cap_weights(df: DataFrame, cfg: Weights = Weights()) -> DataFrame:
    """weight: the target by share of positive market values in the sleeve (and group); equal where there are none.

    A name without a positive value has weight 0 beside names that have one.
    """
    df = sleeves(df, cfg).withColumn("_cap", F.when(F.col(cfg.cap) > 0, F.col(cfg.cap)))
    over = xs("_sleeve", *([cfg.group] if cfg.group else []))
    total, n = F.sum("_cap").over(over), F.count(F.lit(1)).over(over)
    share = F.when(total.isNull(), 1 / n).otherwise(F.coalesce(F.col("_cap") / total, F.lit(0.0)))
    if cfg.group:
        groups = F.size(F.collect_set(cfg.group).over(xs("_sleeve")))
        share = F.when(F.col(cfg.group).isNotNull(), share / groups).otherwise(0.0)
    df = df.withColumn("weight", F.when(F.col("_sleeve") != 0, share * F.col("_target")).otherwise(0.0)).drop("_cap")
    return finished(capped(df, cfg))


def cap_max_weight(df: DataFrame, max_abs: float) -> DataFrame:
    """Weights cut to max_abs, then the longs and the shorts of a date scaled back to their sums before."""
    df = df.withColumn("_side", F.signum("weight"))
    before = F.sum("weight").over(xs("_side"))
    df = df.withColumn("_before", before).withColumn("weight", F.greatest(F.least("weight", F.lit(max_abs)), F.lit(-max_abs)))
    after = F.sum("weight").over(xs("_side"))
    return df.withColumn("weight", F.when(F.abs(after) > EPS, F.col("weight") * F.col("_before") / after).otherwise(F.col("weight"))).drop("_side", "_before")


def group_neutral(df: DataFrame, group: str) -> DataFrame:
    """On dates with longs and shorts, each group's two sides scaled to the smaller one's gross; else as they were.

    A group with one side alone gets 0, as only that is neutral. Names without a group stay.
    """
    w, side = F.col("weight"), xs(group)
    date = xs()
    both = (F.max("weight").over(date) > 0) & (F.min("weight").over(date) < 0)
    long, short = F.sum(F.when(w > 0, w).otherwise(0.0)).over(side), -F.sum(F.when(w < 0, w).otherwise(0.0)).over(side)
    own = F.when(w > 0, long).otherwise(short)
    scaled = F.when(w == 0, w).otherwise(w * F.least(long, short) / own)
    return df.withColumn("weight", F.when(both & F.col(group).isNotNull(), scaled).otherwise(w))


def long_only_bin(df: DataFrame, rank: str = "rank", pick: int = 5) -> DataFrame:
    hit = F.coalesce(F.col(rank) == float(pick), F.lit(False))
    return df.withColumn("weight", F.when(hit, 1 / F.sum(hit.cast("int")).over(xs())).otherwise(0.0))


def long_short_bins(df: DataFrame, gross: float = 1.0, net: float = 0.0, rank: str = "rank", long_bin: int = 5, short_bin: int = 1) -> DataFrame:
    """Equal weights in either bin; where one is empty, the other takes net if it has that sign, else all gross."""
    is_long, is_short = (F.coalesce(F.col(rank) == float(b), F.lit(False)) for b in (long_bin, short_bin))
    n_long, n_short = (F.sum(c.cast("int")).over(xs()) for c in (is_long, is_short))
    long = F.when(n_short > 0, F.lit((gross + net) / 2)).otherwise(F.lit(net if net > 0 else gross))
    short = F.when(n_long > 0, F.lit(-(gross - net) / 2)).otherwise(F.lit(net if net < 0 else -gross))
    return df.withColumn("weight", F.when(is_long, long / n_long).when(is_short, short / n_short).otherwise(0.0))


def asset_returns(prices: DataFrame, method: str = "simple") -> DataFrame:
    ret = simple_return("adj_close", ts()) if method == "simple" else log_return("adj_close", ts())
    return prices.select("date", "ticker", ret.alias("ret"))


def forward_returns(prices: DataFrame, horizon: int = 21, method: str = "simple") -> DataFrame:
    ahead = F.lead("adj_close", horizon).over(ts())
    ret = ratio(ahead, F.col("adj_close")) - 1 if method == "simple" else F.ln(ahead) - F.ln("adj_close")
    return prices.select("date", "ticker", ret.alias("fwd_ret"))


def portfolio_returns(prices: DataFrame, weights: DataFrame, delay: int = 1, method: str = "simple") -> DataFrame:
    """port_ret by date: returns times each ticker's weight delay rows before; no weight counts as 0."""
    eff = weights.select("date", "ticker", (F.lag("weight", delay).over(ts()) if delay else F.col("weight")).alias("_eff"))
    joined = asset_returns(prices, method).join(eff, ["date", "ticker"], "left")
    return joined.groupBy("date").agg(F.coalesce(F.sum(F.col("_eff") * F.col("ret")), F.lit(0.0)).alias("port_ret"))


def weighted_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """port_ret by date of weights as they are; missing returns count as 0."""
    joined = weights.select("date", "ticker", "weight").join(returns.select("date", "ticker", "ret"), ["date", "ticker"], "left")
    return joined.groupBy("date").agg(F.coalesce(F.sum(F.col("weight") * F.col("ret")), F.lit(0.0)).alias("port_ret"))


def turnover(weights: DataFrame) -> DataFrame:
    change = F.abs(F.col("weight") - F.lag("weight").over(ts()))
    return weights.select("date", change.alias("_dw")).groupBy("date").agg((0.5 * F.coalesce(F.sum("_dw"), F.lit(0.0))).alias("turnover"))


def drawdown_curve(returns: DataFrame, chunk: str | None = None) -> DataFrame:
    """wealth, peak and drawdown by date. chunk (year, month, day ...): scanned in slots of time, for series of many rows."""
    growth = 1 + F.coalesce("port_ret", F.lit(0.0))
    if chunk:
        df = scanned(returns.select("date", growth.alias("_growth")), "date", chunk, {"wealth": ("product", F.col("_growth"))})
        df = scanned(df.drop("_growth"), "date", chunk, {"peak": ("max", F.col("wealth"))})
    else:
        over = running(W.orderBy("date"))
        df = returns.select("date", F.product(growth).over(over).alias("wealth"))
        df = df.withColumn("peak", F.max("wealth").over(over))
    return df.withColumn("drawdown", ratio(F.col("wealth"), F.col("peak")) - 1)


def drawdown_episodes(returns: DataFrame, chunk: str | None = None) -> DataFrame:
    """start, valley, end, depth, length_days and recovery_days of each spell below a peak; an open one has no end.

    The valley is the first day of the greatest fall, to 12 places. chunk: as in drawdown_curve.
    """
    curve, flat = drawdown_curve(returns, chunk).select("date", "drawdown"), F.abs("drawdown") <= EPS
    if chunk:
        curve = scanned(curve, "date", chunk, {"_spell": ("sum", flat.cast("double"))}).withColumn("_spell", F.col("_spell").cast("long"))
    else:
        curve = curve.withColumn("_spell", F.sum(flat.cast("int")).over(running(W.orderBy("date"))))
    curve = curve.withColumn("_flat", flat)
    ends = curve.filter("_flat").select((F.col("_spell") - 1).alias("_spell"), F.col("date").alias("end"))
    low = curve.filter(~F.col("_flat") & (F.col("drawdown") < 0)).groupBy("_spell")
    spells = low.agg(F.min("date").alias("start"), F.min_by("date", F.struct(F.round("drawdown", 12), "date")).alias("valley"), F.min("drawdown").alias("depth"), F.max("date").alias("_last"))
    out = spells.join(ends, "_spell", "left")
    return out.select(
        "start",
        "valley",
        "end",
        "depth",
        F.datediff(F.coalesce("end", "_last"), "start").cast("long").alias("length_days"),
        F.datediff("end", "valley").cast("long").alias("recovery_days"),
    )


def drawdown_table(returns: DataFrame, top: int = 5) -> DataFrame:
    deepest = drawdown_episodes(returns).orderBy("depth", "start").limit(top)
    nth = F.row_number().over(W.orderBy("depth", "start"))
    return deepest.select(nth.cast("long").alias("rank"), "start", "valley", "end", F.bround("depth", 4).alias("depth"), "length_days", "recovery_days")


def summary(returns: DataFrame, turned: DataFrame | None = None, cfg: Summary = Summary()) -> DataFrame:
    """One row of performance figures."""
    r, root = F.col("port_ret"), float(cfg.periods) ** 0.5
    rf = (1 + cfg.rf_annual) ** (1 / cfg.periods) - 1
    down = F.least(r - cfg.downside, F.lit(0.0))
    known = returns.filter(r.isNotNull()).agg(
        F.product(1 + r).alias("_w"),
        F.count(r).alias("periods"),
        F.avg(r).alias("_mean"),
        F.stddev_pop(r).alias("_sd"),
        F.sqrt(F.avg(down * down)).alias("_down"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r < 0, r)).alias("avg_loss"),
    )
    low = drawdown_curve(returns).agg(F.min("drawdown").alias("max_drawdown"))
    out = known.join(F.broadcast(low))
    if turned is not None:
        out = out.join(F.broadcast(turned.agg(F.avg("turnover").alias("avg_turnover"))))
    else:
        out = out.withColumn("avg_turnover", F.lit(None).cast("double"))
    out = out.withColumn("cagr", F.pow("_w", F.lit(float(cfg.periods)) / F.col("periods")) - 1)
    return out.select(
        "cagr",
        (F.col("_sd") * root).alias("vol_annual"),
        F.when(F.col("_sd") > 0, (F.col("_mean") - rf) / F.col("_sd") * root).alias("sharpe"),
        F.when(F.col("_down") > 0, (F.col("_mean") - cfg.downside) / F.col("_down") * root).alias("sortino"),
        "max_drawdown",
        F.when(F.abs("max_drawdown") > 0, F.col("cagr") / F.abs("max_drawdown")).alias("calmar"),
        "hit_rate",
        "avg_win",
        "avg_loss",
        "avg_turnover",
        "periods",
    )


def rolling_risk(returns: DataFrame, window: int = 63, periods: int = 252, chunk: str | None = None) -> DataFrame:
    """vol and sharpe by date over full windows; chunk: in blocks with carried edges, numbered by slots of time."""
    returns = framed(returns.select("date", "port_ret"), window, "date", chunk) if chunk else returns
    over, root = block_order() if chunk else W.orderBy("date"), float(periods) ** 0.5
    sd, mean = F.stddev_samp("port_ret").over(rolling(window, over)), F.avg("port_ret").over(rolling(window, over))
    values = {"vol": full(sd * root, "port_ret", window, over), "sharpe": full(F.when(sd > EPS, mean / sd * root), "port_ret", window, over)}
    if not chunk:
        return returns.select("date", *(v.alias(k) for k, v in values.items()))
    return own_rows(returns.withColumns(values)).select("date", *values)


def histogram(returns: DataFrame, bins: int = 40) -> DataFrame:
    """bin, left, right and count of equal bins over the range, the last one closed; empty bins too."""
    span = returns.agg(F.min("port_ret").alias("_low"), F.max("port_ret").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    placed = returns.filter(F.col("port_ret").isNotNull()).join(F.broadcast(span))
    nth = sum((F.col("port_ret") >= F.col("_low") + width * i).cast("int") for i in range(1, bins))
    counts = placed.groupBy(nth.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    grid = returns.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(span))
    left = F.col("_low") + width * F.col("bin")
    right = F.when(F.col("bin") == bins - 1, F.col("_high")).otherwise(F.col("_low") + width * (F.col("bin") + 1))
    return grid.join(counts, "bin", "left").select("bin", left.alias("left"), right.alias("right"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ic_by_date(factors: DataFrame, prices: DataFrame, factor: str, horizon: int = 21, method: str = "spearman", group: str | None = None) -> DataFrame:
    """ic by date of factor with returns ahead; by group, the mean of the groups' weighted by their sizes."""
    df = factors.join(forward_returns(prices, horizon), ["date", "ticker"]).filter(F.col(factor).isNotNull() & F.col("fwd_ret").isNotNull())
    return cross_section_ic(df, factor, "fwd_ret", method, group)


def cross_section_ic(df: DataFrame, x: str, y: str, method: str = "spearman", group: str | None = None) -> DataFrame:
    part = ["date", *([group] if group else [])]
    if group:
        df = df.filter(F.col(group).isNotNull())
    a, b = (F.col(x), F.col(y)) if method == "pearson" else (F.col("_a"), F.col("_b"))
    if method != "pearson":
        df = df.withColumn("_a", average_rank(x, *part)).withColumn("_b", average_rank(y, *part))
    by = df.groupBy(*part).agg(corr(a, b).alias("ic"), F.count(F.lit(1)).alias("_n"))
    if not group:
        return by.select("date", "ic")
    known: Column = F.col("ic").isNotNull()
    return by.groupBy("date").agg(ratio(F.sum(F.col("ic") * F.col("_n")), F.sum(F.when(known, F.col("_n")))).alias("ic"))


def ic_stats(by_date: DataFrame) -> DataFrame:
    sd = F.stddev_pop("ic")
    return by_date.agg(F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.when(sd > EPS, F.avg("ic") / sd).alias("ic_ir"), F.count("ic").alias("n_obs"))


def ic_table(factors: DataFrame, prices: DataFrame, names: list[str], horizon: int = 21, method: str = "spearman") -> DataFrame:
    """A row for each factor, rounded to two places."""
    rows = None
    for name in names:
        one = ic_stats(ic_by_date(factors, prices, name, horizon, method)).select(F.lit(name).alias("factor"), *(F.bround(c, 2).alias(c) for c in ("ic_mean", "ic_std", "ic_ir")), "n_obs")
        rows = one if rows is None else rows.unionByName(one)
    return rows
