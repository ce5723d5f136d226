"""Trading calendars over the days the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.calendar import (next_trading_day, trading_calendar, trading_flags, weekdays_ahead)
from tickloom.queries.data import table
from tickloom.queries.registry import query

# Month and day of the yearly holidays used on the tables' dates.
YEARLY = ["01-26", "05-01", "08-15", "10-02", "12-25"]

HOLIDAY_SQL = f"""
WITH orders_days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
open_days AS (
  SELECT CAST(d AS DATE) AS date,
         isodow(d) <= 5 AND strftime(d, '%m-%d') NOT IN ({', '.join(repr(d) for d in YEARLY)}) AS is_trading
  FROM (SELECT unnest(generate_series((SELECT min(date) FROM orders_days)::TIMESTAMP,
                                      (SELECT max(date) + 31 FROM orders_days)::TIMESTAMP, INTERVAL 1 DAY)) AS d))
"""


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))


def holidays(spark: SparkSession, sf: str) -> DataFrame:
    return order_days(spark, sf).distinct().filter(F.date_format("date", "MM-dd").isin(YEARLY))


@query("trading_day_flags", HOLIDAY_SQL + "SELECT o.date, d.is_trading FROM orders_days o JOIN open_days d USING (date)")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    return trading_flags(order_days(spark, sf).distinct(), holidays(spark, sf))


@query("next_trading_day", HOLIDAY_SQL + """
SELECT o.o_orderkey, (SELECT min(d.date) FROM open_days d WHERE d.is_trading AND d.date > CAST(o.o_orderdate AS DATE)
       AND d.date < CAST(o.o_orderdate AS DATE) + 20) AS next_trading_day FROM orders o""")
def following_day(spark: SparkSession, sf: str) -> DataFrame:
    days = order_days(spark, sf)
    calendar = trading_calendar(spark, days.select(F.min("date")).scalar(),
                                days.select(F.max("date")).scalar(), yearly_holidays(spark, days))
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return next_trading_day(orders, calendar).select("o_orderkey", "next_trading_day")


def yearly_holidays(spark: SparkSession, days: DataFrame) -> DataFrame:
    """The yearly holidays of every year of the span and of the one after it."""
    span = days.agg(F.year(F.min("date")).alias("a"), (F.year(F.max("date")) + 1).alias("b"))
    years = span.select(F.explode(F.sequence("a", "b")).alias("y"))
    return years.select(F.explode(F.array(*[F.lit(d) for d in YEARLY])).alias("d"), "y").select(
        F.to_date(F.concat_ws("-", "y", "d")).alias("date"))


@query("weekdays_ahead", """
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
ahead AS (SELECT d.date, n.n, k, row_number() OVER (PARTITION BY d.date, n.n ORDER BY k) AS i
          FROM days d, (SELECT unnest([1, 5, 20]) AS n) n, (SELECT unnest(generate_series(1, 40)) AS k) g
          WHERE isodow(d.date + CAST(k AS INTEGER)) <= 5)
SELECT date, CAST(n AS INTEGER) AS n, date + CAST(k AS INTEGER) AS then_date FROM ahead WHERE i = n""")
def nth_weekday(spark: SparkSession, sf: str) -> DataFrame:
    asked = (order_days(spark, sf).distinct()
             .withColumn("n", F.explode(F.array(*[F.lit(n) for n in (1, 5, 20)]))))
    return asked.withColumn("then_date", weekdays_ahead(F.col("date"), F.col("n")))
