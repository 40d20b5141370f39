"""Primitives: null-safe arithmetic, cross-sectional statistics, bins, ranks and series.

Missing is NULL everywhere; NaN and infinities become NULL where data comes in (finite). Windows are either xs,
the cross-section of a date, or ts, one ticker's rows in time order, so that plans share two partitionings.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS = 1e-12


def xs(*groups: str) -> WindowSpec:
    return W.partitionBy("date", *groups)


def ts(key: str = "ticker", on: str = "date") -> WindowSpec:
    return W.partitionBy(key).orderBy(on)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either is missing."""
    return F.when(b != 0, a / b)


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def winsorize(c: str | Column, over: WindowSpec, low: float = 0.01, high: float = 0.99) -> Column:
    """Clip to exact, interpolated quantiles."""
    q = F.percentile(col(c), F.array(F.lit(low), F.lit(high))).over(over)
    return clip(col(c), q[0], q[1])


def zscore(c: str | Column, over: WindowSpec) -> Column:
    """Population z-score; NULL where the deviation vanishes."""
    sd = F.stddev_pop(col(c)).over(over)
    return F.when(sd > EPS, (col(c) - F.avg(col(c)).over(over)) / sd)


def average_rank(c: str | Column, *partition: str) -> Column:
    """Rank from 1, ties at their mean; NULL for NULL."""
    value = col(c)
    over = W.partitionBy(*partition).orderBy(value.asc_nulls_last())
    ties = F.count(F.lit(1)).over(W.partitionBy(*partition, value))
    return F.when(value.isNotNull(), F.rank().over(over) + (ties - 1) / F.lit(2.0))


def corr(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson correlation of complete pairs, NULL where a side doesn't vary; an aggregate, or one over a window."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.when((parts[1] > EPS) & (parts[2] > EPS), parts[0] / (parts[1] * parts[2]))


def quantile_edges(c: str | Column, over: WindowSpec, n: int) -> Column:
    """Interpolated quantiles at 0, 1/n ... 1."""
    return F.percentile(col(c), F.array(*(F.lit(k / n) for k in range(n + 1)))).over(over)


def bins_by_quantile(c: str | Column, edges: Column, n: int) -> Column:
    """1 to n by right-closed intervals, the lowest included; meaningful where edges differ (distinct_edges)."""
    value = col(c)
    return F.when(value.isNotNull(), sum((value > edges[k]).cast("int") for k in range(1, n)) + 1)


def distinct_edges(edges: Column, n: int) -> Column:
    return F.size(F.array_distinct(edges)) == n + 1


def bins_by_width(share: Column, over: WindowSpec, n: int) -> Column:
    """1 to n by equal widths of the percentile ranks' range; all tied: the middle bin."""
    low, high = F.min(share).over(over), F.max(share).over(over)
    step = (high - low) / n
    above = sum((share > step * i + low).cast("int") for i in range(1, n)) + 1
    return F.when(share.isNotNull(), F.when(high > low, above).otherwise((n + 1) // 2))


def running(over: WindowSpec) -> WindowSpec:
    return over.rowsBetween(W.unboundedPreceding, W.currentRow)


def last_known(c: str | Column, over: WindowSpec) -> Column:
    return F.last(col(c), ignorenulls=True).over(running(over))


def simple_return(price: str | Column, over: WindowSpec) -> Column:
    """Change over the last known price; a gap's day returns 0 and the next one spans the gap."""
    known = last_known(price, over)
    before = F.last(col(price), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))
    return ratio(known, before) - 1


def log_return(price: str | Column, over: WindowSpec) -> Column:
    return F.ln(col(price)) - F.lag(F.ln(col(price))).over(over)


def rolling(window: int, over: WindowSpec) -> WindowSpec:
    return over.rowsBetween(1 - window, 0)


def full(value: Column, c: str | Column, window: int, over: WindowSpec) -> Column:
    """value where the window holds window known values of c."""
    return F.when(F.count(col(c)).over(rolling(window, over)) == window, value)


def slug(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "_"), F.lit("_"))


def symbol(c: str | Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(col(c), "/", "_")))


def short_hash(c: str | Column, n: int = 12) -> Column:
    return F.substring(F.sha2(col(c).cast("binary"), 256), 1, n)


def fixed(c: str | Column, places: int = 4) -> Column:
    """A number with so many places and no separators; n/a for NULL."""
    return F.coalesce(F.regexp_replace(F.format_number(finite(c), places), ",", ""), F.lit("n/a"))


def percent(c: str | Column, places: int = 2) -> Column:
    return F.coalesce(F.concat(F.regexp_replace(F.format_number(100 * finite(c), places), ",", ""), F.lit("%")), F.lit("n/a"))


def money(c: str | Column, places: int = 2) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(finite(c), places)), F.lit("n/a"))
