"""Inputs derived from the given tables, and the same derivations as SQL.

A supplier stands for a stock; its line items are trades. Every SQL constant is a chain of
common table expressions that a query's own SELECT follows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.panel import bars_from_ticks, with_return
from tickloom.staging import stage

TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "price"]
START = date(1998, 1, 1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("stock"), F.to_date("l_shipdate").alias("date"),
        (1000 + F.col("l_extendedprice") / 1000).alias("price"),
        F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber", "l_partkey")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier has about one line item a day, so there is next to nothing to combine before the shuffle."""
    return bars_from_ticks(ticks(spark, sf), TICK_ORDER, combine=False)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return with_return(bars(spark, sf), ["stock"])


_WRITTEN: dict[tuple[str, str, int], DataFrame] = {}


def _changed(spark: SparkSession, path: str) -> int:
    """When a file or folder was written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()


def staged_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a table, written once for an application's queries over the same trades; again when they change."""
    key = (spark.sparkContext.applicationId, sf, _changed(spark, f"{sf}/lineitem.parquet"))
    if key not in _WRITTEN:
        _WRITTEN[key] = stage(panel(spark, sf), "panel")
    return _WRITTEN[key]


def brand_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with a part's brand as the stock: 25 names at any scale."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    branded = (ticks(spark, sf).drop("stock").join(parts, "l_partkey")
               .withColumnRenamed("p_brand", "stock"))
    return with_return(bars_from_ticks(branded, TICK_ORDER), ["stock"])


BARS_SQL = """
WITH ticks AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date,
         1000 + l_extendedprice / 1000 AS price, l_quantity AS quantity,
         l_orderkey, l_linenumber, l_partkey
  FROM lineitem),
bars AS (
  SELECT stock, date,
         arg_min(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, row(l_orderkey, l_linenumber, l_partkey, price)) AS close,
         sum(quantity) AS volume
  FROM ticks GROUP BY stock, date)
"""

PANEL_SQL = BARS_SQL + """,
panel AS (
  SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM bars)
"""

BRAND_PANEL_SQL = BARS_SQL.replace(
    "CAST(l_suppkey AS VARCHAR) AS stock", "p_brand AS stock").replace(
    "FROM lineitem", "FROM lineitem JOIN part ON p_partkey = l_partkey") + """,
panel AS (
  SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM bars)
"""

CALENDAR_SQL = PANEL_SQL + """,
calendar AS (
  SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel))
"""

TOKENS_SQL = PANEL_SQL + """,
guessed AS (
  SELECT stock, date, x, CAST(floor((x + 1) * 200) + 1 AS INTEGER) AS b FROM (
    SELECT stock, date, greatest(-(1.0::DOUBLE - 1e-9), least(1.0::DOUBLE - 1e-9, return_1d)) AS x
    FROM panel WHERE return_1d IS NOT NULL)),
tokens AS (
  SELECT stock, date,
         CASE WHEN x < (b - 1) * 0.005::DOUBLE - 1.0 THEN b - 1
              WHEN x >= b * 0.005::DOUBLE - 1.0 THEN b + 1 ELSE b END AS token
  FROM guessed)
"""

CENTRE_SQL = """CASE WHEN {t} <= 0 THEN -1.0::DOUBLE WHEN {t} > 400 THEN 1.0::DOUBLE
  ELSE ((({t} - 1) * 0.005::DOUBLE - 1.0) + ({t} * 0.005::DOUBLE - 1.0)) / 2 END"""

PERIODS_SQL = """,
periods AS (
  SELECT CAST(row_number() OVER (ORDER BY reb_date) AS INTEGER) AS period, reb_date,
         lead(reb_date) OVER (ORDER BY reb_date) AS next_date
  FROM (SELECT min(date) AS reb_date FROM panel WHERE date >= DATE '1998-01-01'
        GROUP BY date_trunc('month', date))),
days AS (
  SELECT d.date, min(k.period) AS known_at, max(h.period) AS held_in
  FROM (SELECT DISTINCT date FROM panel) d
  LEFT JOIN periods k ON k.reb_date >= d.date
  LEFT JOIN periods h ON h.reb_date < d.date AND d.date <= h.next_date
  GROUP BY d.date)
"""


def growth_steps_sql(steps: int, by: str) -> str:
    """The recursion over horizons, one table per step, over ``linked(by, prev, state, gain)``."""
    key = f"l.{by}, " if by else ""
    using = f"({by}, state)" if by else "(state)"
    out = f", e1 AS (SELECT {key}l.prev AS state, sum(gain) AS g FROM linked l GROUP BY {key}l.prev)"
    for h in range(2, steps + 1):
        out += (f", e{h} AS (SELECT {key}l.prev AS state, sum(l.gain * e.g) AS g FROM linked l"
                f" JOIN e{h - 1} e USING {using} GROUP BY {key}l.prev)")
    return out


WALK_SQL = TOKENS_SQL + PERIODS_SQL + """,
pairs AS (
  SELECT * FROM (SELECT stock, date, lag(token) OVER (PARTITION BY stock ORDER BY date) AS prev,
                        token AS next FROM tokens) WHERE prev IS NOT NULL),
fresh AS (
  SELECT known_at AS period, prev, next, count(*) AS n FROM pairs JOIN days USING (date)
  WHERE known_at IS NOT NULL GROUP BY ALL),
cumulated AS (
  SELECT p.period, f.prev, f.next, CAST(sum(f.n) AS BIGINT) AS n
  FROM fresh f JOIN periods p ON p.period >= f.period GROUP BY ALL),
counted AS (
  SELECT * FROM cumulated
  UNION ALL SELECT period, -1, next, CAST(sum(n) AS BIGINT) FROM cumulated GROUP BY period, next),
weighted AS (
  SELECT *, pow(n / sum(n) OVER (PARTITION BY period, prev), 1.25) AS w FROM counted),
prob AS (SELECT period, prev, next, w / sum(w) OVER (PARTITION BY period, prev) AS p FROM weighted),
linked AS (
  SELECT a.period, a.prev, CASE WHEN s.prev IS NULL THEN -1 ELSE a.next END AS state,
         a.p * (1 + greatest(""" + CENTRE_SQL.format(t="a.next") + """, -0.9999)) AS gain
  FROM prob a LEFT JOIN (SELECT DISTINCT period, prev FROM prob) s
    ON s.period = a.period AND s.prev = a.next)
""" + growth_steps_sql(5, "period") + """,
open_periods AS (
  SELECT period, reb_date, next_date, CAST(least(count(*), 5) AS INTEGER) AS horizon
  FROM periods JOIN days ON held_in = period WHERE next_date IS NOT NULL GROUP BY ALL),
growth AS (
  SELECT period, 1 AS horizon, state, g FROM e1
  UNION ALL SELECT period, 2, state, g FROM e2 UNION ALL SELECT period, 3, state, g FROM e3
  UNION ALL SELECT period, 4, state, g FROM e4 UNION ALL SELECT period, 5, state, g FROM e5),
states AS (
  SELECT o.period, o.horizon, t.stock, count(*) AS n_tokens, arg_max(token, date) AS token
  FROM open_periods o JOIN tokens t ON t.date <= o.reb_date GROUP BY ALL HAVING count(*) >= 100),
all_scores AS (
  SELECT s.period, s.stock, s.token, coalesce(g.g, u.g) - 1 AS score
  FROM states s
  LEFT JOIN growth g ON g.period = s.period AND g.horizon = s.horizon AND g.state = s.token
  LEFT JOIN growth u ON u.period = s.period AND u.horizon = s.horizon AND u.state = -1),
scores AS (
  SELECT * FROM all_scores
  WHERE period IN (SELECT period FROM all_scores GROUP BY period HAVING count(*) >= 20))
"""

LEGS_SQL = """,
placed AS (
  SELECT *, rank() OVER (PARTITION BY period ORDER BY score DESC)
            + (count(*) OVER (PARTITION BY period, score) - 1) / 2.0 AS place,
         count(*) OVER (PARTITION BY period) AS n
  FROM scores),
sized AS (SELECT *, greatest(1, floor(n * 10 / 100.0)) AS k FROM placed),
legs AS (
  SELECT period, stock, 'long' AS leg FROM sized WHERE place <= k
  UNION ALL SELECT period, stock, 'short' FROM sized WHERE place > n - k)
"""

RESULTS_SQL = LEGS_SQL + """,
leg_days AS (
  SELECT l.period, l.leg, p.date, avg(p.return_1d) AS r
  FROM panel p JOIN days d USING (date) JOIN legs l ON l.period = d.held_in AND l.stock = p.stock
  GROUP BY ALL),
leg_returns AS (SELECT period, leg, avg(r) - 0.001 AS ret FROM leg_days GROUP BY ALL),
results AS (
  SELECT o.reb_date AS date, max(CASE WHEN leg = 'long' THEN ret END) AS long_ret,
         max(CASE WHEN leg = 'short' THEN ret END) AS short_ret,
         max(CASE WHEN leg = 'long' THEN ret END) - max(CASE WHEN leg = 'short' THEN ret END) AS ls_ret
  FROM (SELECT DISTINCT period FROM scores) s JOIN open_periods o USING (period)
  LEFT JOIN leg_returns r USING (period) GROUP BY o.reb_date)
"""

SERIES_SQL = """,
series AS (
  SELECT 'Long-Short Portfolio' AS label, date, ls_ret AS ret FROM results
  UNION ALL SELECT 'Long-Only Portfolio', date, long_ret FROM results
  UNION ALL SELECT 'Short-Only Portfolio', date, -short_ret FROM results)
"""

REALISED_SQL = """,
realised AS (
  SELECT d.held_in AS period, p.stock, coalesce(sum(p.return_1d), 0) AS realised
  FROM panel p JOIN days d USING (date) WHERE d.held_in IS NOT NULL GROUP BY ALL),
scored AS (
  SELECT s.period, s.stock, s.score, coalesce(r.realised, 0) AS realised
  FROM scores s LEFT JOIN realised r USING (period, stock))
"""

MARKET_SQL = """,
members AS (
  SELECT stock FROM panel GROUP BY stock ORDER BY count(return_1d) DESC, stock LIMIT 100),
market AS (
  SELECT date, median(return_1d) AS market FROM panel SEMI JOIN members USING (stock) GROUP BY date)
"""

VOL_SQL = """,
aged AS (
  SELECT stock, date, return_1d,
         row_number() OVER (PARTITION BY stock ORDER BY (return_1d IS NULL), date DESC) AS age
  FROM {source}),
vol AS (
  SELECT stock, count(return_1d) AS n_returns,
         CASE WHEN count(return_1d) < 30 THEN 1.0::DOUBLE WHEN stddev_pop(return_1d) < 1e-8 THEN 1.0
              ELSE greatest(0.3::DOUBLE, least(4.0::DOUBLE,
                   stddev_pop(CASE WHEN age <= 20 THEN return_1d END) / stddev_pop(return_1d)))
         END AS vol_ratio
  FROM aged GROUP BY stock)
"""

BETA_SQL = """,
recent AS (
  SELECT c.date, m.market FROM calendar c LEFT JOIN market m USING (date)
  WHERE pos > (SELECT max(pos) FROM calendar) - 60),
both_known AS (
  SELECT p.stock, CASE WHEN r.market IS NOT NULL THEN p.return_1d END AS s,
         CASE WHEN p.return_1d IS NOT NULL THEN r.market END AS m
  FROM panel p LEFT JOIN recent r USING (date)),
betas AS (
  SELECT stock, CASE WHEN count(m) < 20 THEN 1.0::DOUBLE WHEN var_pop(m) < 1e-10 THEN 1.0
                     ELSE covar_samp(s, m) / var_pop(m) END AS beta
  FROM both_known GROUP BY stock)
"""
