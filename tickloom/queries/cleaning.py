"""Filters, casts, clipping, rounding and profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.scalar import half_even
from tickloom.operators.clean import (absent_instruments, between_dates, canonical, clip_column, coerce,
                                      count_outside, data_lag, drop_empty, known_only, look_back,
                                      profile, to_day)
from tickloom.operators.panel import with_return
from tickloom.queries.data import BARS_SQL, PANEL_SQL, bars, panel, table
from tickloom.queries.registry import query, rounded


@query("coercing_cast", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS quantity FROM lineitem""")
def coercing_cast(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("l_returnflag") == "A", "n/a").when(
        F.col("l_quantity").isNotNull(), F.col("l_quantity").cast("string"))
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                text.alias("quantity"))
    return coerce(items, ["quantity"])


@query("drop_empty_rows", """
WITH t AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_tax END AS a,
                  CASE WHEN l_linestatus = 'O' THEN l_discount END AS b FROM lineitem)
SELECT 'all' AS how, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM t WHERE a IS NOT NULL OR b IS NOT NULL
UNION ALL
SELECT 'any', count(*), sum(l_orderkey)::BIGINT FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def drop_empty_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("a"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("b"))
    out = [drop_empty(t, ["a", "b"], how).agg(F.lit(how).alias("how"), F.count("*").alias("n"),
                                              F.sum("l_orderkey").alias("keys"))
           for how in ("all", "any")]
    return out[0].unionByName(out[1])


@query("timestamp_to_day", """
SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1""")
def timestamp_to_day(spark: SparkSession, sf: str) -> DataFrame:
    return to_day(table(spark, sf, "events"), "ts").groupBy("date").agg(F.count("*").alias("n"))


RAW_RETURN_SQL = """
WITH ticks AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date,
         max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY ALL),
raw AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS r FROM ticks)
"""


def raw_returns(spark: SparkSession, sf: str) -> DataFrame:
    closes = (table(spark, sf, "lineitem")
              .groupBy(F.col("l_suppkey").cast("string").alias("stock"), F.to_date("l_shipdate").alias("date"))
              .agg(F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("close")))
    return with_return(closes, ["stock"], clip=False, into="r")


@query("winsorise", RAW_RETURN_SQL + """
SELECT stock, date, round(CASE WHEN r IS NOT NULL THEN greatest(-1, least(1, r)) END, 6) + 0.0 AS r FROM raw""")
def winsorise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clip_column(raw_returns(spark, sf), "r").select("stock", "date", "r"), "r")


@query("count_outliers", RAW_RETURN_SQL + """
SELECT stock, count(*) FILTER (WHERE abs(r) > 1) AS n_outside FROM raw GROUP BY stock""")
def count_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return count_outside(raw_returns(spark, sf), "r", by=["stock"])


def _even(c: str, places: int) -> str:
    return f"round_even({c} * 1e{places}, 0) / 1e{places} + 0.0 AS {c}"


@query("canonical_rounding", PANEL_SQL + f"""
SELECT date, stock, {', '.join(_even(c, 4) for c in ('open', 'high', 'low', 'close'))},
       CAST(trunc(coalesce(volume, 0)) AS BIGINT) AS volume, {_even('return_1d', 6)} FROM panel""")
def canonical_rounding(spark: SparkSession, sf: str) -> DataFrame:
    return canonical(panel(spark, sf))


@query("date_restriction", BARS_SQL + """
SELECT 'window' AS kind, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars
WHERE date >= DATE '1998-01-01' AND date < DATE '2000-01-01'
UNION ALL SELECT 'after', count(*), min(date), max(date) FROM bars WHERE date > DATE '2001-01-31'
UNION ALL SELECT 'look_back', count(*), min(date), max(date) FROM bars
WHERE date BETWEEN DATE '2001-01-01' - 365 * 2 AND DATE '2001-01-01'""")
def date_restriction(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    cuts = {"window": between_dates(b, since=date(1998, 1, 1), before=date(2000, 1, 1)),
            "after": between_dates(b, after=date(2001, 1, 31)),
            "look_back": look_back(b, date(2001, 1, 1), years=2)}
    out = None
    for kind, rows in cuts.items():
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"),
                       F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        out = one if out is None else out.unionByName(one)
    return out


@query("known_stocks_only", """
SELECT CAST(l_suppkey AS VARCHAR) AS stock, count(*) AS n FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def known_stocks_only(spark: SparkSession, sf: str) -> DataFrame:
    known = (table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0)
             .select(F.col("s_suppkey").alias("l_suppkey")))
    return (known_only(table(spark, sf, "lineitem"), known, "l_suppkey")
            .groupBy(F.col("l_suppkey").cast("string").alias("stock")).agg(F.count("*").alias("n")))


@query("absent_instruments", """
SELECT CAST(s_suppkey AS VARCHAR) AS stock FROM supplier
WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-20')""")
def absent(spark: SparkSession, sf: str) -> DataFrame:
    late = bars(spark, sf).filter(F.col("date") >= F.to_date(F.lit("2001-10-20"))).select("stock")
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("stock"))
    return absent_instruments(names, late)


@query("panel_profile", PANEL_SQL + """
SELECT count(*) AS n_rows, count(DISTINCT stock) AS n_stocks, count(DISTINCT date) AS n_dates,
       min(date) AS first_date, max(date) AS last_date, count(return_1d) AS n_filled,
       round(1 - count(return_1d) / (count(DISTINCT stock) * count(DISTINCT date)), 6) + 0.0 AS null_fraction
FROM panel""")
def panel_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile(panel(spark, sf)), "null_fraction")


@query("data_lag", """
SELECT max(CAST(l_shipdate AS DATE)) AS last_date,
       CAST((SELECT max(CAST(o_orderdate AS DATE)) + 90 FROM orders) - max(CAST(l_shipdate AS DATE)) AS INTEGER) AS lag_days,
       (SELECT max(CAST(o_orderdate AS DATE)) + 90 FROM orders) - max(CAST(l_shipdate AS DATE)) > 3 AS stale
FROM lineitem""")
def lag(spark: SparkSession, sf: str) -> DataFrame:
    today = table(spark, sf, "orders").select(
        F.date_add(F.max(F.to_date("o_orderdate")), 90)).scalar()
    return data_lag(table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")), today)


@query("half_even_prices", """
SELECT p_partkey, round_even(p_retailprice / 8 * 1e2, 0) / 1e2 + 0.0 AS eighth FROM part""")
def half_even_prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", half_even(F.col("p_retailprice") / 8, 2).alias("eighth"))
