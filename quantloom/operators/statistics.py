"""Correlation matrices of named columns in long form, and regressions by tree QR."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import average_rank, corr, full, ratio, rolling, winsorize, xs
from quantloom.operators.least_squares import least_squares, windowed
from quantloom.operators.ranks import whole_ranks
from quantloom.operators.scans import block_order, framed, own_rows


def corr_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), method: str = "pearson", min_rows: int = 0) -> DataFrame:
    """(by, row, col, corr): all ordered pairs of columns, over pairwise complete rows.

    Spearman ranks each column's known values first, pairs are completed after. min_rows: rows with any value.
    """
    by = list(by)
    used = list(columns)
    if method == "spearman":
        df = df.withColumns({f"_r_{c}": average_rank(c, *by) for c in columns}) if by else whole_ranks(df, columns)
        used = [f"_r_{c}" for c in columns]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    some = F.count(F.when(F.coalesce(*columns).isNotNull(), 1))
    wide = df.groupBy(*by).agg(some.alias("_n"), *(corr(F.col(used[i]), F.col(used[j])).alias(f"_{i}_{j}") for i, j in pairs)).filter(F.col("_n") >= min_rows)
    cells = [F.struct(F.lit(columns[i]).alias("row"), F.lit(columns[j]).alias("col"), F.col(f"_{min(i, j)}_{max(i, j)}").alias("corr")) for i in range(len(columns)) for j in range(len(columns))]
    return wide.select(*by, F.inline(F.array(*cells)))


def mean_corr(df: DataFrame, columns: Sequence[str], method: str = "spearman", min_names: int = 5, weighted: bool = False) -> DataFrame:
    """(row, col, corr): the mean over dates of their matrices, each known cell alike or by the date's tickers."""
    cells = corr_long(df, columns, ["date"], method, min_names)
    if not weighted:
        return cells.groupBy("row", "col").agg(F.avg("corr").alias("corr"))
    sizes = df.groupBy("date").agg(F.count_distinct("ticker").alias("_w"))
    cells = cells.join(sizes, "date")
    known = F.when(F.col("corr").isNotNull(), F.col("_w"))
    return cells.groupBy("row", "col").agg(ratio(F.sum(F.col("corr") * F.col("_w")), F.sum(known)).alias("corr"))


def named_once(columns: Sequence[str]) -> list[str]:
    """The names, refused if one comes twice."""
    if len(set(columns)) < len(columns):
        raise ValueError(f"names come twice: {sorted({c for c in columns if list(columns).count(c) > 1})}")
    return list(columns)


def paired(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), diagonal: bool = False, values: Sequence[str] = ()) -> DataFrame:
    """(keep, row, col, a, b): for each row of df, its values in each pair of columns; values: other columns to take them from."""
    values = list(values or columns)
    pairs = (combinations_with_replacement if diagonal else combinations)(range(len(columns)), 2)
    cells = [F.struct(F.lit(columns[i]).alias("row"), F.lit(columns[j]).alias("col"), F.col(values[i]).alias("a"), F.col(values[j]).alias("b")) for i, j in pairs]
    return df.select(*keep, F.inline(F.array(*cells)))


def series_corr(df: DataFrame, columns: Sequence[str], method: str = "pearson", dropna: str = "any") -> DataFrame:
    """(row, col, corr): all ordered pairs of the columns of a wide frame, one row a date, however many columns.

    Each pair is a group of its own. No rows, no cells.
    """
    columns = named_once(columns)
    if dropna != "none":
        df = df.na.drop(dropna, subset=columns)
    used = columns
    if method == "spearman":
        used = [f"_r_{c}" for c in columns]
        df = df.withColumns({r: average_rank(c) for r, c in zip(used, columns, strict=True)})
    half = paired(df, columns, diagonal=True, values=used).groupBy("row", "col").agg(corr(F.col("a"), F.col("b")).alias("corr"))
    both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col"))).otherwise(F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))))
    return half.select(F.explode(both).alias("cell"), "corr").select("cell.row", "cell.col", "corr")


def rolling_corr(df: DataFrame, x: str, y: str, window: int = 63, method: str = "pearson", by: Sequence[str] = (), chunk: str | None = None) -> DataFrame:
    """(by, date, corr) over full windows. Spearman ranks inside each window, whose rows are few.

    by: the key of many series. chunk (year, month, day ...): one long series is worked on in blocks with carried
    edges, numbered by slots of time.
    """
    by = list(by)
    df = framed(df, window, "date", chunk) if chunk else df
    over = block_order() if chunk else W.partitionBy(*by).orderBy("date")
    both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
    if method == "pearson":
        value = corr(F.col(x), F.col(y), rolling(window, over))
    else:
        held = F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(rolling(window, over))

        def rank(side: str):
            below = lambda p: F.size(F.filter(held, lambda q: q[side] < p[side]))
            tied = lambda p: F.size(F.filter(held, lambda q: q[side] == p[side]))
            return lambda p: below(p) + (tied(p) + 1) / F.lit(2.0)

        mid = (window + 1) / 2
        a, b = rank("x"), rank("y")
        total = lambda f: F.aggregate(F.transform(held, f), F.lit(0.0), lambda s, v: s + v)
        xy, xx, yy = total(lambda p: (a(p) - mid) * (b(p) - mid)), total(lambda p: (a(p) - mid) * (a(p) - mid)), total(lambda p: (b(p) - mid) * (b(p) - mid))
        value = F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))
    df = df.withColumn("corr", full(value, both, window, over))
    return (own_rows(df) if chunk else df).select(*by, "date", "corr")


def rolling_matrices(df: DataFrame, columns: Sequence[str], window: int = 63) -> DataFrame:
    """(date, row, col, corr) of each pair of columns over full windows of dates, on the rows complete for the pair; a partition a pair."""
    over = W.partitionBy("row", "col").orderBy("date")
    cells = paired(df, named_once(columns), ["date"])
    cells = cells.select("date", "row", "col", F.count(F.lit(1)).over(rolling(window, over)).alias("_n"), corr(F.col("a"), F.col("b"), rolling(window, over)).alias("corr"))
    return cells.filter(F.col("_n") == window).drop("_n")


def upper_triangle(cells: DataFrame, columns: Sequence[str], diagonal: bool = False) -> DataFrame:
    """The cells with row before col in the order of columns."""
    nth = lambda c: F.array_position(F.array(*map(F.lit, columns)), F.col(c))
    return cells.filter(nth("row") <= nth("col") if diagonal else nth("row") < nth("col"))


def ts_regression(df: DataFrame, y: str, x: Sequence[str], lags: int = 4, by: Sequence[str] = (), chunk: str | None = None) -> DataFrame:
    """(by, param, coef, stderr, tstat, r2, n_obs): least squares over dates with Bartlett-weighted HAC errors.

    Two passes: tree QR gives the coefficients and the inverse of X'X, then the scores' products at each lag are
    summed. by, chunk: as in rolling_corr.
    """
    by = list(by)
    df = df.select(*by, "date", y, *x).na.drop("any", subset=[y, *x])
    names, z = ["alpha", *x], [F.lit(1.0), *(F.col(c) for c in x)]
    k = len(z)
    fit = least_squares(df, y, x, by).select(*by, F.array(*(F.col(f"`{n}`") for n in names)).alias("_b"), F.col("xx").alias("_xx"))
    if chunk:
        df = framed(df, lags + 1, "date", chunk)
    over = block_order() if chunk else W.partitionBy(*by).orderBy("date")
    scored = (df.join(fit, by) if by else df.join(F.broadcast(fit))).withColumn("_u", F.col(y) - sum(F.col("_b")[i] * c for i, c in enumerate(z)))
    scored = scored.withColumns({f"_g{i}": c * F.col("_u") for i, c in enumerate(z)})
    lagged = {f"_g{i}_{h}": F.lag(f"_g{i}", h).over(over) for i in range(k) for h in range(1, lags + 1)}
    scored = scored.withColumns(lagged) if lagged else scored
    if chunk:
        scored = scored.filter("_own")
    at = lambda i, h: F.col(f"_g{i}_{h}") if h else F.col(f"_g{i}")
    cells = [F.coalesce(F.sum(at(i, h) * F.col(f"_g{j}")), F.lit(0.0)) for h in range(lags + 1) for i in range(k) for j in range(k)]
    sums = scored.groupBy(*by).agg(F.array(*cells).alias("gg"), F.first("_xx").alias("xx"), F.first("_b").alias("b"), F.sum(F.col("_u") * F.col("_u")).alias("uu"), F.var_pop(y).alias("var"), F.count(F.lit(1)).alias("n"))

    def finish(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                if not r["n"]:
                    continue
                g = np.asarray(r["gg"], float).reshape(lags + 1, k, k)
                s = g[0] + sum((1 - h / (lags + 1)) * (g[h] + g[h].T) for h in range(1, lags + 1))
                inverse = np.asarray(r["xx"], float).reshape(k, k)
                se = np.sqrt(np.maximum(np.diag(inverse @ s @ inverse), 0))
                r2 = 1 - r["uu"] / (r["var"] * r["n"]) if r["var"] > 0 else np.nan
                coef = np.asarray(r["b"], float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    tstat = np.where(se > 0, coef / se, np.nan)
                yield pd.DataFrame({**{c: r[c] for c in by}, "param": names, "coef": coef, "stderr": se, "tstat": tstat, "r2": r2, "n_obs": int(r["n"])})

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    return sums.mapInPandas(finish, ", ".join([*kinds, "param string, coef double, stderr double, tstat double, r2 double, n_obs long"]))


def residuals(df: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    df = df.select(*by, "date", y, *x).na.drop("any", subset=[y, *x])
    fit = least_squares(df, y, x, by).select(*by, F.array(*(F.col(f"`{n}`") for n in ("alpha", *x))).alias("_b"))
    joined = df.join(fit, by) if by else df.join(F.broadcast(fit))
    return joined.select(*by, "date", (F.col(y) - F.col("_b")[0] - sum((F.col("_b")[i + 1] * F.col(c) for i, c in enumerate(x)), F.lit(0.0))).alias("resid"))


def rolling_regression(df: DataFrame, y: str, x: Sequence[str], window: int = 63, by: Sequence[str] = (), chunk: str = "year") -> DataFrame:
    """(by, date, alpha, betas) over full windows of dates, from each window's own rows.

    Blocks of a series with carried edges; without by, it is numbered by slots of time (chunk). Windows without
    complete rows have none.
    """
    return windowed(framed(df.select(*by, "date", y, *x), window, "date", chunk, by=by), y, x, window, by)


def enough_names(df: DataFrame, min_names: int) -> DataFrame:
    """The rows of dates with at least so many tickers."""
    return df.withColumn("_names", F.size(F.collect_set("ticker").over(xs()))).filter(F.col("_names") >= min_names)


def cross_section_betas(df: DataFrame, y: str, x: Sequence[str], min_names: int = 10, winsor: tuple[float, float] = (0.01, 0.99), group: str | None = None, intercept: bool = True) -> DataFrame:
    """(date, param, beta): one regression a date on winsorized factors, with dummies for all groups but a date's first."""
    df = enough_names(df, min_names).withColumns({c: winsorize(c, xs(), *winsor) for c in x})
    if group is not None and intercept:
        return grouped_betas(df, y, list(x), group)
    names = [*(["alpha"] if intercept else []), *x]
    if group is not None:
        return uncentred_betas(df, y, list(x), group)
    return least_squares(df, y, x, ["date"], intercept).unpivot(["date"], names, "param", "beta")


def by_dummies(df: DataFrame, y: str, x: list[str], group: str) -> DataFrame:
    """The complete rows of df with _g, the group; a null group counts as the date's first."""
    base = F.min(group).over(xs())
    return df.withColumn("_g", F.coalesce(F.col(group).cast("string"), base.cast("string"), F.lit(""))).na.drop("any", subset=[y, *x])


def grouped_betas(df: DataFrame, y: str, x: list[str], group: str) -> DataFrame:
    """(date, param, beta) with dummies group_<name> for all groups but a date's first among its complete rows.

    Dummies and an intercept take out each group's means, so the factors' betas are those of the rows less their
    group's means; alpha is what is left of the first group's mean, a dummy's beta what is left of its group's
    beside it.
    """
    df = by_dummies(df, y, x, group)
    over = xs("_g")
    within = df.select("date", *((F.col(c) - F.avg(c).over(over)).alias(c) for c in (y, *x)))
    betas = least_squares(within, y, x, ["date"], intercept=False).select("date", F.array(*(F.col(f"`{c}`") for c in x)).alias("_b"))
    means = df.groupBy("date", "_g").agg(F.avg(y).alias("_y"), F.array(*(F.avg(c) for c in x)).alias("_x")).join(betas, "date")
    left = means.withColumn("_rest", F.col("_y") - sum((F.col("_b")[i] * F.col("_x")[i] for i in range(len(x))), F.lit(0.0)))
    first = F.first("_rest").over(xs().orderBy("_g"))
    left = left.select("date", "_g", "_rest", first.alias("_base"), F.row_number().over(xs().orderBy("_g")).alias("_nth"))
    levels = left.select("date", F.when(F.col("_nth") == 1, "alpha").otherwise(F.concat(F.lit(f"{group}_"), "_g")).alias("param"), F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.col("_rest") - F.col("_base")).alias("beta"))
    slopes = betas.select("date", F.inline(F.array(*(F.struct(F.lit(c).alias("param"), F.col("_b")[i].alias("beta")) for i, c in enumerate(x)))))
    return levels.unionByName(slopes)


def uncentred_betas(df: DataFrame, y: str, x: list[str], group: str) -> DataFrame:
    """As grouped_betas, without an intercept: the first group's rows stay as they are, the other groups' lose their means."""
    df = by_dummies(df, y, x, group)
    over, first = xs("_g"), F.min("_g").over(xs())
    kept = df.select("date", "_g", first.alias("_first"), *(F.col(c).alias(f"_raw_{c}") for c in (y, *x)), *(F.when(F.col("_g") == first, F.col(c)).otherwise(F.col(c) - F.avg(c).over(over)).alias(c) for c in (y, *x)))
    betas = least_squares(kept, y, x, ["date"], intercept=False).select("date", F.array(*(F.col(f"`{c}`") for c in x)).alias("_b"))
    means = kept.filter("_g > _first").groupBy("date", "_g").agg(F.avg(f"_raw_{y}").alias("_y"), F.array(*(F.avg(f"_raw_{c}") for c in x)).alias("_x")).join(betas, "date")
    levels = means.select("date", F.concat(F.lit(f"{group}_"), "_g").alias("param"), (F.col("_y") - sum((F.col("_b")[i] * F.col("_x")[i] for i in range(len(x))), F.lit(0.0))).alias("beta"))
    slopes = betas.select("date", F.inline(F.array(*(F.struct(F.lit(c).alias("param"), F.col("_b")[i].alias("beta")) for i, c in enumerate(x)))))
    return levels.unionByName(slopes)


def fama_macbeth_summary(df: DataFrame, min_names: int = 10, lags: int = 4, intercept: bool = True) -> DataFrame:
    """One row: the dates used, the mean number of their tickers, and the settings."""
    used = df.groupBy("date").agg(F.count_distinct("ticker").alias("_n")).filter(F.col("_n") >= min_names)
    return used.agg(F.count(F.lit(1)).alias("n_dates_used"), F.coalesce(F.avg("_n"), F.lit(0.0)).alias("mean_cs_obs"), F.lit(lags).cast("long").alias("hac_lags_time"), F.lit(intercept).alias("add_intercept"))


def fama_macbeth(betas: DataFrame, lags: int = 4) -> DataFrame:
    """(param, mean_beta, stderr, tstat, n_dates): means over dates with HAC errors of the mean, one partition a parameter."""
    over = W.partitionBy("param").orderBy("date")
    df = betas.filter(F.col("beta").isNotNull()).withColumn("_u", F.col("beta") - F.avg("beta").over(W.partitionBy("param")))
    df = df.withColumns({f"_u{h}": F.lag("_u", h).over(over) for h in range(1, lags + 1)})
    s = F.sum(F.col("_u") * F.col("_u")) + sum((2 * (1 - h / (lags + 1)) * F.coalesce(F.sum(F.col("_u") * F.col(f"_u{h}")), F.lit(0.0)) for h in range(1, lags + 1)), F.lit(0.0))
    out = df.groupBy("param").agg(F.avg("beta").alias("mean_beta"), F.count("beta").alias("n_dates"), F.sqrt(F.greatest(s, F.lit(0.0))).alias("_s"))
    out = out.withColumn("stderr", F.col("_s") / F.col("n_dates"))
    return out.select("param", "mean_beta", "stderr", F.when(F.col("stderr") > 0, F.col("mean_beta") / F.col("stderr")).alias("tstat"), "n_dates")
