"""Trading days, sessions and rebalance dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import last_known

#: The days on which there is no session, as month and day.
CLOSED = ("01-01", "07-04", "12-25")
#: Minutes after midnight of a day's hourly sessions.
HOURLY = (540, 600, 660, 720, 780, 840, 900, 930)
#: Sessions a year of the bar sizes.
PERIODS = {"1d": 252, "1h": 1638}


def periods_from_bar(bar: str | None) -> int:
    """Sessions a year of a bar size; of an unknown one, of days."""
    return PERIODS.get((bar or "").strip().lower(), PERIODS["1d"])


def annual_factor(freq: str, trading_days: int = PERIODS["1d"]) -> int:
    """Rows a year of a frequency of returns."""
    factors = {"daily": trading_days, "weekly": 52, "monthly": 12}
    if freq not in factors:
        raise ValueError(f"frequency {freq!r} is none of {list(factors)}")
    return factors[freq]


def periods_of(bar: Column) -> Column:
    """periods_from_bar of a column."""
    known = F.lower(F.trim(bar))
    out = F.lit(PERIODS["1d"])
    for name, periods in PERIODS.items():
        out = F.when(known == name, periods).otherwise(out)
    return out


def factor_of(freq: Column, trading_days: int = PERIODS["1d"]) -> Column:
    """annual_factor of a column; NULL for a frequency that is unknown."""
    return F.when(freq == "daily", trading_days).when(freq == "weekly", 52).when(freq == "monthly", 12)


def is_trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~F.date_format(day, "MM-dd").isin(*CLOSED)


def days(spark: SparkSession, start: str, end: str, beyond: int = 0) -> DataFrame:
    stop = f"date_add(DATE'{end}', {beyond})"
    return spark.sql(f"SELECT explode(CASE WHEN DATE'{start}' <= {stop} THEN sequence(DATE'{start}', {stop}) ELSE array() END) AS day")


def days_over(df: DataFrame, on: str, beyond: int = 0) -> DataFrame:
    """day: each from the first to the last of a table's times, and as many beyond."""
    span = df.agg(F.to_date(F.min(on)).alias("a"), F.date_add(F.to_date(F.max(on)), beyond).alias("b")).filter("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias("day"))


def opened(each: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """session: those of days that are Mondays to Fridays, aren't closed, nor among holidays (a day column)."""
    out = each.filter(is_trading_day(F.col("day")))
    if holidays is not None:
        out = out.join(holidays.select("day"), "day", "left_anti")
    return out.select(F.col("day").alias("session"))


def hours_of(sessions: DataFrame) -> DataFrame:
    """session as TIMESTAMP_NTZ: the hourly ones of each day."""
    at = F.explode(F.array(*(F.make_dt_interval(mins=F.lit(m)) for m in HOURLY))).alias("at")
    return sessions.select("session", at).select((F.col("session").cast("timestamp_ntz") + F.col("at")).alias("session"))


def period_ends(each: DataFrame, freq: str) -> DataFrame:
    """date: those of days that end a month (M), a quarter (Q) or a week (W, Sundays)."""
    day = F.col("day")
    last = {"M": day == F.last_day(day), "Q": (day == F.last_day(day)) & (F.month(day) % 3 == 0), "W": F.weekday(day) == 6}[freq]
    return each.filter(last).select(day.alias("date"))


def rebalance_dates_over(df: DataFrame, on: str, freq: str = "M", holidays: DataFrame | None = None) -> DataFrame:
    """session: the period ends among the days of a table's times, moved on to a trading day, each once."""
    sessions = opened(days_over(df, on, beyond=15), holidays)
    return next_trading_day(period_ends(days_over(df, on), freq), sessions).select("session").distinct()


def trading_days(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None, beyond: int = 0) -> DataFrame:
    return opened(days(spark, start, end, beyond), holidays)


def hourly_sessions(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """session as TIMESTAMP_NTZ, up to midnight of end."""
    return hours_of(trading_days(spark, start, end, holidays)).filter(F.col("session") <= F.lit(end).cast("timestamp_ntz"))


def next_trading_day(dates: DataFrame, sessions: DataFrame, on: str = "date") -> DataFrame:
    """dates with the first session on or after each date; only the distinct dates are put in order, as one small series."""
    both = dates.select(F.col(on).alias("_at"), F.lit(0).alias("_side")).distinct()
    both = both.unionByName(sessions.select(F.col("session").alias("_at"), F.lit(1).alias("_side"), F.col("session")), allowMissingColumns=True)
    over = W.orderBy(F.desc("_at"), F.desc("_side"))
    found = both.withColumn("session", last_known("session", over)).filter("_side = 0").select(F.col("_at").alias(on), "session")
    return dates.join(found, on).select(*dates.columns, "session")


def rebalance_dates(spark: SparkSession, start: str, end: str, freq: str = "M", holidays: DataFrame | None = None) -> DataFrame:
    """session: the period ends (M, Q, or W for Sundays) in the range, moved on to a trading day, each once."""
    anchors = period_ends(days(spark, start, end), freq)
    return next_trading_day(anchors, trading_days(spark, start, end, holidays, beyond=15)).select("session").distinct()


def align_to_sessions(filings: DataFrame, sessions: DataFrame, values: list[str], key: str = "symbol") -> DataFrame:
    """Each symbol on each session with the latest values filed by then."""
    from quantloom.operators.frames import asof

    grid = filings.select(key).distinct().join(F.broadcast(sessions.select(F.col("session").alias("date"))))
    return asof(grid, filings, by=key, values=values)


def periods_per_year(df: DataFrame, on: str = "date") -> DataFrame:
    """One row: 252 if the median spacing is half a day or more, else 365 days over it, from 52 to 8760."""
    gap = F.unix_seconds(F.col(on).cast("timestamp")) - F.lag(F.unix_seconds(F.col(on).cast("timestamp"))).over(W.orderBy(on))
    median = df.select(on).distinct().select(gap.alias("gap")).agg(F.percentile("gap", 0.5).alias("s"), F.count("gap").alias("n"))
    per = F.greatest(F.lit(52), F.least(F.lit(8760), F.round(F.lit(365.0 * 86400) / F.col("s")).cast("long")))
    return median.select(F.when((F.col("n") < 2) | (F.col("s") >= 43200), F.lit(252)).otherwise(per).cast("long").alias("periods_per_year"))
