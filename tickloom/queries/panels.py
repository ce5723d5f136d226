"""Panel construction, joins and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.calendar import positions
from tickloom.operators.panel import (calendar_returns, choose_source, fresh_rows, gap_filled,
                                      long_enough, merge_sources, one_row_per_day, stack_wide, to_wide,
                                      too_short, upsert, with_return)
from tickloom.operators.stats import market_series, realised_everywhere
from tickloom.plans.backtest import staged_calendar
from tickloom.queries.data import (BARS_SQL, BRAND_PANEL_SQL, CALENDAR_SQL, MARKET_SQL, PANEL_SQL, PERIODS_SQL, START,
                                   bars, brand_panel, panel, staged_panel, table, ticks)
from tickloom.queries.sources import BRANDS, KIND_SQL, file_kinds
from tickloom.queries.registry import query, r6, rounded
from tickloom.schema import PANEL_COLUMNS
from tickloom.staging import stage


@query("bars_from_ticks", BARS_SQL + "SELECT * FROM bars")
def tick_bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf)


@query("padded_returns", BARS_SQL + """,
holes AS (SELECT stock, date, CASE WHEN volume < 45 THEN close END AS close FROM bars),
padded AS (
  SELECT stock, date, close,
         last_value(close IGNORE NULLS) OVER (PARTITION BY stock ORDER BY date) AS now,
         last_value(close IGNORE NULLS) OVER (PARTITION BY stock ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         lag(close) OVER (PARTITION BY stock ORDER BY date) AS prev
  FROM holes)
SELECT stock, date, round(now / before - 1, 6) + 0.0 AS pad, round(close / prev - 1, 6) + 0.0 AS plain
FROM padded""")
def padded_returns(spark: SparkSession, sf: str) -> DataFrame:
    holes = bars(spark, sf).select("stock", "date", F.when(
        F.col("volume") < 45, F.col("close")).alias("close"))
    both = with_return(with_return(holes, ["stock"], "pad", into="pad"), ["stock"], "none", into="plain")
    return rounded(both.select("stock", "date", "pad", "plain"), "pad", "plain")


@query("one_row_per_day", """
SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date,
       arg_min(1000 + l_extendedprice / 1000,
               row(l_orderkey, l_linenumber, 1000 + l_extendedprice / 1000, l_quantity, l_partkey)) AS price
FROM lineitem GROUP BY ALL""")
def first_per_day(spark: SparkSession, sf: str) -> DataFrame:
    rows = ticks(spark, sf).select("stock", "date", "l_orderkey", "l_linenumber", "price",
                                   "quantity", "l_partkey")
    return one_row_per_day(rows, ["stock", "date"], []).select("stock", "date", "price")


def _canonical_sql(name: str) -> str:
    even = ", ".join(f"round_even({c} * 1e4, 0) / 1e4 + 0.0 AS {c}" for c in ("open", "high", "low", "close"))
    return (f"SELECT date, stock, {even}, CAST(trunc(coalesce(volume, 0)) AS BIGINT) AS volume, "
            f"round_even(return_1d * 1e6, 0) / 1e6 + 0.0 AS return_1d FROM {name}")


@query("merge_two_sources", BARS_SQL + """,
older AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM bars),
shifted AS (SELECT stock, date, open, high, low, close * 1.01 AS close, volume FROM bars
            WHERE date >= DATE '1997-07-01'),
newer AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM shifted),
stacked AS (SELECT 0 AS priority, * FROM older WHERE date < DATE '1998-01-01'
         UNION ALL SELECT 1, * FROM newer),
single AS (SELECT * FROM stacked QUALIFY row_number() OVER (PARTITION BY stock, date ORDER BY priority) = 1),
kept AS (SELECT * FROM single WHERE return_1d IS NOT NULL
         QUALIFY count(*) OVER (PARTITION BY stock) >= 50)
""" + _canonical_sql("kept"))
def merge_two(spark: SparkSession, sf: str) -> DataFrame:
    b = stage(bars(spark, sf), "bars")
    newer = b.filter(F.col("date") >= F.to_date(F.lit("1997-07-01"))).withColumn("close", F.col("close") * 1.01)
    return merge_sources(b, newer, date(1998, 1, 1))


@query("gap_filled_grid", CALENDAR_SQL + """,
grid AS (SELECT s.stock, c.pos, b.close FROM (SELECT DISTINCT stock FROM bars) s, calendar c
         LEFT JOIN bars b ON b.stock = s.stock AND b.date = c.date),
filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY stock ORDER BY pos) AS padded FROM grid)
SELECT stock, count(*) AS n_cells, count(close) AS n_observed, count(padded) AS n_padded,
       round(sum(padded), 6) + 0.0 AS sum_padded, round(sum(close * pos) / 1e6, 6) + 0.0 AS moment
FROM filled GROUP BY stock""")
def gap_filled_grid(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    grid = gap_filled(p, positions(p))
    return grid.groupBy("stock").agg(
        F.count("*").alias("n_cells"), F.count_if("observed").alias("n_observed"),
        F.count("padded").alias("n_padded"), r6(F.sum("padded"), "sum_padded"),
        r6(F.sum(F.col("close") * F.col("pos")) / 1e6, "moment"))


@query("calendar_returns", CALENDAR_SQL + """,
grid AS (SELECT s.stock, c.pos, c.date, b.close FROM (SELECT DISTINCT stock FROM bars) s, calendar c
         LEFT JOIN bars b ON b.stock = s.stock AND b.date = c.date),
filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY stock ORDER BY pos) AS padded FROM grid),
moved AS (SELECT *, padded / lag(padded) OVER (PARTITION BY stock ORDER BY pos) - 1 AS r FROM filled)
SELECT date, count(*) AS n_cells, count(r) AS n_known, count(*) FILTER (WHERE r = 0) AS n_still,
       round(sum(r), 6) + 0.0 AS total, round(max(r), 6) + 0.0 AS best
FROM moved WHERE pos > 1 GROUP BY date""")
def wide_calendar_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    r = F.col("return_1d")
    return calendar_returns(p, positions(p)).groupBy("date").agg(
        F.count("*").alias("n_cells"), F.count(r).alias("n_known"), F.count_if(r == 0).alias("n_still"),
        r6(F.sum(r), "total"), r6(F.max(r), "best"))


WIDE_COLUMNS = {b: "b" + b.removeprefix("Brand#") for b in BRANDS}


@query("pivot_returns", BRAND_PANEL_SQL + "SELECT date, " + ", ".join(
    f"round(max(CASE WHEN stock = '{b}' THEN return_1d END), 6) + 0.0 AS {c}" for b, c in WIDE_COLUMNS.items())
    + " FROM panel GROUP BY date")
def pivot_returns(spark: SparkSession, sf: str) -> DataFrame:
    wide = to_wide(brand_panel(spark, sf), BRANDS)
    return wide.select("date", *[r6(F.col(f"`{b}`"), c) for b, c in WIDE_COLUMNS.items()])


@query("stack_wide_tables", BRAND_PANEL_SQL + "SELECT date, " + ", ".join(
    f"round(max(CASE WHEN stock = '{b}'{'' if i < 20 else ' AND date >= DATE ' + repr('1999-01-01')} THEN return_1d END), 6) + 0.0 AS {c}"
    for i, (b, c) in enumerate(WIDE_COLUMNS.items())) + " FROM panel GROUP BY date")
def stack_wide_tables(spark: SparkSession, sf: str) -> DataFrame:
    """An old table of twenty stocks above a new one of twenty-five."""
    p = stage(brand_panel(spark, sf), "panel")
    seam = F.to_date(F.lit("1999-01-01"))
    old = p.filter(F.col("date") < seam)
    # the old table has a row for every day before the seam, also where none of its twenty traded
    days = old.select("date").distinct()
    older = days.join(to_wide(old.filter(F.col("stock").isin(BRANDS[:20])), BRANDS[:20]), "date", "left")
    both = stack_wide(older, to_wide(p.filter(F.col("date") >= seam), BRANDS))
    return both.select("date", *[r6(F.col(f"`{b}`"), c) for b, c in WIDE_COLUMNS.items()])


@query("min_observations", PANEL_SQL + """
SELECT stock, count(*) AS n FROM panel GROUP BY stock HAVING count(*) >= 530""")
def min_observations(spark: SparkSession, sf: str) -> DataFrame:
    return long_enough(panel(spark, sf), 530).groupBy("stock").agg(F.count("*").alias("n"))


@query("skipped_stocks", BARS_SQL + """
SELECT stock, count(*) AS n_obs FROM bars GROUP BY stock HAVING count(*) < 530""")
def skipped_stocks(spark: SparkSession, sf: str) -> DataFrame:
    return too_short(bars(spark, sf), 530)


UPSERT_SQL = BARS_SQL + """,
base AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM bars
         WHERE date < DATE '2001-06-01'),
landed AS (SELECT stock, date, open, high, low, close * 1.02 AS close, volume FROM bars
           WHERE date >= DATE '2001-01-01'),
overlap AS (SELECT * FROM landed WHERE date >= (SELECT max(date) FROM base) - 7),
returned AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM overlap),
news AS (SELECT * FROM returned WHERE date > (SELECT max(date) FROM base) AND return_1d IS NOT NULL)
"""


def _base_and_landed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = stage(bars(spark, sf), "bars")
    base = with_return(b.filter(F.col("date") < F.to_date(F.lit("2001-06-01"))), ["stock"])
    landed = (b.filter(F.col("date") >= F.to_date(F.lit("2001-01-01")))
              .withColumn("close", F.col("close") * 1.02))
    return stage(base.select(PANEL_COLUMNS), "base"), landed


@query("fresh_rows", UPSERT_SQL + _canonical_sql("news"))
def fresh(spark: SparkSession, sf: str) -> DataFrame:
    base, landed = _base_and_landed(spark, sf)
    return fresh_rows(landed, base).withColumns({c: F.col(c) + 0.0 for c in ("close", "return_1d")})


@query("fresh_rows_per_stock", UPSERT_SQL + """,
seen AS (SELECT l.*, s.seen FROM landed l JOIN (SELECT stock, max(date) AS seen FROM base GROUP BY stock) s USING (stock)
         WHERE l.date >= s.seen - 7),
own AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM seen),
own_news AS (SELECT * FROM own WHERE date > seen AND return_1d IS NOT NULL)
""" + _canonical_sql("own_news"))
def fresh_per_stock(spark: SparkSession, sf: str) -> DataFrame:
    base, landed = _base_and_landed(spark, sf)
    return fresh_rows(landed, base, watermark="per_stock")


@query("keep_last_upsert", UPSERT_SQL + """,
stored AS (SELECT date, stock, round_even(close * 1e4, 0) / 1e4 AS close,
                  round_even(return_1d * 1e6, 0) / 1e6 AS return_1d FROM news),
stacked AS (
  SELECT 0 AS seq, date, stock, close, return_1d FROM base
  UNION ALL SELECT 1, date, stock, close, return_1d FROM stored
  UNION ALL SELECT 2, date, stock, close + 1, return_1d FROM stored WHERE date >= DATE '2001-07-01')
SELECT date, stock, round(close, 6) + 0.0 AS close, round(return_1d, 6) + 0.0 AS return_1d FROM stacked
QUALIFY row_number() OVER (PARTITION BY stock, date ORDER BY seq DESC) = 1""")
def keep_last_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base, landed = _base_and_landed(spark, sf)
    news = stage(fresh_rows(landed, base), "news")
    again = (news.filter(F.col("date") >= F.to_date(F.lit("2001-07-01")))
             .withColumn("close", F.col("close") + 1))
    return rounded(upsert(base, news, again).select("date", "stock", "close", "return_1d"),
                   "close", "return_1d")


@query("source_fallback", BARS_SQL + "," + KIND_SQL + """
SELECT stock, date, close FROM bars JOIN kinds USING (stock) WHERE kind <> 2 OR date >= DATE '1996-01-01'""")
def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The first source lacks some stocks; the second has all of them, but starts later."""
    b = stage(bars(spark, sf).select("stock", "date", "close"), "bars")
    lacking = file_kinds(spark, sf).filter(F.col("kind") == 2)
    second = b.filter(F.col("date") >= F.to_date(F.lit("1996-01-01")))
    return choose_source(b.join(lacking, "stock", "left_anti"), second)


# ---- joins ------------------------------------------------------------------------------------

@query("common_stocks", """
SELECT s.stock, s.n AS n_signal, r.n AS n_realised
FROM (SELECT CAST(l_suppkey AS VARCHAR) AS stock, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) s
JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS stock, count(*) AS n FROM supplier WHERE s_acctbal > 1000 GROUP BY 1) r
  USING (stock)""")
def common_stocks(spark: SparkSession, sf: str) -> DataFrame:
    signal = (table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "A")
              .groupBy(F.col("l_suppkey").cast("string").alias("stock")).agg(F.count("*").alias("n_signal")))
    real = (table(spark, sf, "supplier").filter(F.col("s_acctbal") > 1000)
            .groupBy(F.col("s_suppkey").cast("string").alias("stock")).agg(F.count("*").alias("n_realised")))
    return signal.join(real, "stock")


@query("outer_alignment", """
WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close_a
           FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
r AS (SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS close_r
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(a.stock, r.stock) AS stock, coalesce(a.date, r.date) AS date, close_a, close_r
FROM a FULL JOIN r ON a.stock = r.stock AND a.date = r.date""")
def outer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Two series per stock on the union of their dates."""
    def side(flag: str) -> DataFrame:
        return (table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag)
                .groupBy(F.col("l_suppkey").cast("string").alias("stock"), F.to_date("l_shipdate").alias("date"))
                .agg(F.max("l_extendedprice").alias(f"close_{flag.lower()}")))
    return side("A").join(side("R"), ["stock", "date"], "full")


@query("market_beside_stocks", PANEL_SQL + MARKET_SQL + """
SELECT p.date, p.stock, round(p.return_1d - m.market, 6) + 0.0 AS excess
FROM panel p JOIN market m USING (date)""")
def market_beside_stocks(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    # one row per calendar day
    return (p.join(F.broadcast(market_series(p)), "date")
            .select("date", "stock", r6(F.col("return_1d") - F.col("market"), "excess")))


@query("holding_windows", PANEL_SQL + PERIODS_SQL + """
SELECT date, coalesce(known_at, 0) AS known_at, coalesce(held_in, 0) AS held_in FROM days""")
def holding_windows(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return staged_calendar(p, START)[2].select("date", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("known_at", "held_in")])


@query("realised_everywhere", PANEL_SQL + PERIODS_SQL + """
SELECT s.stock, k.period, round(coalesce(sum(p.return_1d), 0), 6) + 0.0 AS realised
FROM (SELECT DISTINCT stock FROM panel) s CROSS JOIN (SELECT DISTINCT held_in AS period FROM days WHERE held_in IS NOT NULL) k
LEFT JOIN days d ON d.held_in = k.period LEFT JOIN panel p ON p.date = d.date AND p.stock = s.stock
GROUP BY ALL""")
def realised_all(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return rounded(realised_everywhere(p, staged_calendar(p, START)[2]), "realised")


# ---- set operations ---------------------------------------------------------------------------

@query("union_all_sources", BARS_SQL + """
SELECT src, count(*) AS n, round(sum(close), 2) + 0.0 AS total FROM (
  SELECT 'a' AS src, close FROM bars WHERE date < DATE '1999-01-01'
  UNION ALL SELECT 'b', close FROM bars WHERE date >= DATE '1998-01-01') GROUP BY src""")
def union_all_sources(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    early = b.filter(F.col("date") < F.to_date(F.lit("1999-01-01"))).withColumn("src", F.lit("a"))
    late = b.filter(F.col("date") >= F.to_date(F.lit("1998-01-01"))).withColumn("src", F.lit("b"))
    return (early.unionByName(late).groupBy("src")
            .agg(F.count("*").alias("n"), (F.round(F.sum("close"), 2) + 0.0).alias("total")))


@query("common_keys", """
SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'
INTERSECT SELECT s_suppkey FROM supplier WHERE s_nationkey < 12""")
def common_keys(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_suppkey").alias("k"))
    right = table(spark, sf, "supplier").filter(F.col("s_nationkey") < 12).select(F.col("s_suppkey").alias("k"))
    return left.intersect(right)


@query("distinct_days", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem")
def distinct_days(spark: SparkSession, sf: str) -> DataFrame:
    return ticks(spark, sf).select("date").distinct()
