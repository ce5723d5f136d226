"""Trading calendars: one row per day, so their size is bounded by the span in days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Exchange holidays, 2025 and 2026.
HOLIDAYS = [
    "2025-01-26", "2025-02-26", "2025-03-14", "2025-04-10", "2025-04-14", "2025-04-18", "2025-05-01",
    "2025-08-15", "2025-10-02", "2025-10-20", "2025-10-21", "2025-11-05", "2025-12-25",
    "2026-01-26", "2026-02-19", "2026-03-25", "2026-04-03", "2026-04-14", "2026-05-01", "2026-08-15",
    "2026-10-02", "2026-10-09", "2026-11-24", "2026-12-25",
]


def holiday_table(spark: SparkSession, days: list[str] | None = None) -> DataFrame:
    days = HOLIDAYS if days is None else days
    return spark.createDataFrame([(d,) for d in days], "day string").select(
        F.to_date("day").alias("date"))


def trading_flags(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """``days(date)`` with ``is_trading``: Monday to Friday and no holiday."""
    closed = F.broadcast(holidays.select("date").distinct().withColumn("closed", F.lit(True)))
    return (days.join(closed, "date", "left")
            .withColumn("is_trading", (F.weekday("date") < 5) & F.col("closed").isNull())
            .drop("closed"))


def trading_calendar(spark: SparkSession, first: Column | date, last: Column | date,
                     holidays: DataFrame, margin: int = 31) -> DataFrame:
    """Every day of the span with its flag and the next trading day strictly after it.

    ``margin`` days are added so that the last days still find their next trading day. The
    one ordered window runs over calendar days only (366 rows a year).
    """
    first, last = (d if isinstance(d, Column) else F.lit(d) for d in (first, last))
    days = spark.range(1).select(
        F.explode(F.sequence(first, F.date_add(last, margin))).alias("date"))
    ahead = W.orderBy("date").rowsBetween(1, W.unboundedFollowing)
    flagged = trading_flags(days, holidays)
    return (flagged.withColumn("next_trading_day",
                               F.min(F.when(F.col("is_trading"), F.col("date"))).over(ahead))
            .filter(F.col("date") <= last))


def next_trading_day(df: DataFrame, calendar: DataFrame, column: str = "date") -> DataFrame:
    nxt = F.broadcast(calendar.select(F.col("date").alias(column), "next_trading_day"))
    return df.join(nxt, column, "left")


def weekdays_ahead(day: Column, n: Column | int) -> Column:
    """The n-th Monday-to-Friday after ``day``, by arithmetic (no holidays)."""
    n = n if isinstance(n, Column) else F.lit(n)
    wd = F.weekday(day)
    over = F.greatest(wd - 4, F.lit(0))          # Saturday and Sunday count from Friday
    ahead = n + 2 * F.floor((F.least(wd, F.lit(4)) + n) / 5).cast("int") - over
    return F.when(n > 0, F.date_add(day, ahead.cast("int"))).otherwise(day)


def traded_days(panel: DataFrame) -> DataFrame:
    """The distinct dates of a panel: one row per calendar day, so safe to broadcast.

    The functions below take a panel or, to scan it only once, a staged table of its days.
    """
    return panel.select("date").distinct()


def positions(days: DataFrame) -> DataFrame:
    """(date, pos): rank of every date."""
    return traded_days(days).withColumn("pos", F.row_number().over(W.orderBy("date")))


def _periods(firsts: DataFrame) -> DataFrame:
    order = W.orderBy("reb_date")                # at most one row per calendar day
    return firsts.select(F.row_number().over(order).alias("period"), "reb_date",
                         F.lead("reb_date").over(order).alias("next_date"))


def month_starts(days: DataFrame, start: date | None = None) -> DataFrame:
    """(period, reb_date, next_date): first traded day of every month and the following one."""
    since = days if start is None else days.filter(F.col("date") >= F.lit(start))
    return _periods(since.groupBy(F.trunc("date", "month").alias("month"))
                    .agg(F.min("date").alias("reb_date")))


def day_starts(days: DataFrame, start: date | None = None) -> DataFrame:
    """Daily rebalancing: every traded day opens a period."""
    since = days if start is None else days.filter(F.col("date") >= F.lit(start))
    return _periods(traded_days(since).withColumnRenamed("date", "reb_date"))


def period_of_days(days: DataFrame, periods: DataFrame) -> DataFrame:
    """(date, known_at, held_in) for every date.

    ``known_at`` is the first rebalance on or after the date (the earliest score that may use
    the day). ``held_in`` is the period whose holding window ``(reb, next]`` contains it. Both
    come from one pass over calendar days instead of a range join.
    """
    marks = periods.select(F.col("reb_date").alias("date"), "period")
    marked = traded_days(days).join(F.broadcast(marks), "date", "left")
    ahead = W.orderBy("date").rowsBetween(0, W.unboundedFollowing)
    behind = W.orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    last = periods.select(F.max("period")).scalar()
    held = F.last("period", ignorenulls=True).over(behind)
    return (marked.withColumn("known_at", F.first("period", ignorenulls=True).over(ahead))
            .withColumn("held_in", held)
            .withColumn("held_in", F.when(F.col("held_in") < last, F.col("held_in")))
            .drop("period"))
