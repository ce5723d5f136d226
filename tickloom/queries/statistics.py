"""Windows, ranks and per-stock statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tickloom.operators.calendar import month_starts, positions
from tickloom.operators.performance import mean_probability
from tickloom.operators.ranks import average_tie_rank, display, top_n
from tickloom.operators.stats import (beta, completeness, daily_profile, expected_return, factors,
                                      factors_at, horizon_metrics, market_series, most_complete,
                                      realised, volatility_ratio)
from tickloom.operators.tokens import tokenise
from tickloom.operators.windows import chart_rows, equity_curve, last_rows, running_growth
from tickloom.plans.backtest import staged_calendar, states_at
from tickloom.queries.data import (BARS_SQL, BETA_SQL, BRAND_PANEL_SQL, CALENDAR_SQL, MARKET_SQL, PANEL_SQL, PERIODS_SQL,
                                   START, VOL_SQL, bars, brand_panel, panel, staged_panel, table)
from tickloom.queries.registry import query, rounded
from tickloom.sources.bystock import read_by_stock, write_by_stock
from tickloom.staging import new_folder, stage

@query("momentum_leaders", BRAND_PANEL_SQL + """,
calendar AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)),
momentum AS (
  SELECT stock, coalesce(sum(CASE WHEN pos > (SELECT max(pos) FROM calendar) - 20
                                  THEN greatest(-1, least(1, return_1d)) END), 0) AS momentum
  FROM panel JOIN calendar USING (date) GROUP BY stock)
SELECT stock, round(momentum, 6) + 0.0 AS momentum,
       CAST(floor(rank() OVER (ORDER BY momentum DESC) + (count(*) OVER (PARTITION BY momentum) - 1) / 2.0) AS INTEGER) AS place
FROM momentum ORDER BY place, stock LIMIT 10""")
def momentum_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """Trades to bars to returns to momentum to ranks to the ten leaders."""
    p = stage(brand_panel(spark, sf), "panel")
    found = factors(p, positions(p)).select("stock", "momentum")
    ranked = average_tie_rank(found, [], "momentum", "place", truncate=True)
    return rounded(top_n(ranked, 10, "place").select("stock", "momentum", "place"), "momentum")


# ---- windows ------------------------------------------------------------------------------------

@query("previous_close", BARS_SQL + """
SELECT stock, date, lag(close) OVER (PARTITION BY stock ORDER BY date) AS prev_close FROM bars""")
def previous_close(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("close").over(W.partitionBy("stock").orderBy("date"))
    return bars(spark, sf).select("stock", "date", before.alias("prev_close"))


@query("simple_returns", PANEL_SQL + """
SELECT stock, date, round(return_1d, 6) + 0.0 AS return_1d FROM panel""")
def simple_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf).select("stock", "date", "return_1d"), "return_1d")


CHART_SQL = PANEL_SQL + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY stock ORDER BY date DESC) AS age,
                    count(*) OVER (PARTITION BY stock) AS n_rows FROM panel),
tail AS (SELECT * FROM numbered WHERE age <= 180 AND n_rows > 30)
"""


@query("moving_average", CHART_SQL + """
SELECT stock, date, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 8) END AS ma
FROM tail WINDOW w AS (PARTITION BY stock ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return chart_rows(staged_panel(spark, sf)).select("stock", "date", F.round("ma", 8).alias("ma"))


@query("return_bars", CHART_SQL + """
SELECT stock, date, round(return_1d * 100, 6) + 0.0 AS bar_pct,
       CASE WHEN return_1d >= 0 THEN 'up' ELSE 'down' END AS bar_side,
       CASE WHEN close >= open THEN 'up' ELSE 'down' END AS candle FROM tail""")
def return_bars(spark: SparkSession, sf: str) -> DataFrame:
    rows = chart_rows(staged_panel(spark, sf)).select("stock", "date", "bar_pct", "bar_side", "candle")
    return rounded(rows, "bar_pct")


@query("average_tie_ranks", """
WITH t AS (SELECT l_suppkey AS stock, date_trunc('month', l_shipdate)::DATE AS month, count(*) AS score
           FROM lineitem GROUP BY ALL)
SELECT stock, month, score,
       CAST(floor(rank() OVER (PARTITION BY month ORDER BY score DESC)
                  + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0) AS INTEGER) AS place,
       rank() OVER (PARTITION BY month ORDER BY score DESC)
                  + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0::DOUBLE AS exact_place
FROM t""")
def average_tie_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Trade counts per month have many ties; both the truncated and the fractional rank."""
    t = (table(spark, sf, "lineitem")
         .groupBy(F.col("l_suppkey").alias("stock"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"))
         .agg(F.count("*").alias("score")))
    exact = average_tie_rank(t, ["month"], "score", "exact_place")
    return average_tie_rank(exact, ["month"], "score", "place", truncate=True)


@query("score_ranks", PANEL_SQL + """
SELECT stock, date, round(rank() OVER (PARTITION BY date ORDER BY return_1d DESC)
       + (count(*) OVER (PARTITION BY date, return_1d) - 1) / 2.0, 1) + 0.0 AS place
FROM panel WHERE return_1d IS NOT NULL""")
def score_ranks(spark: SparkSession, sf: str) -> DataFrame:
    known = (staged_panel(spark, sf).filter(F.col("return_1d").isNotNull())
             .select("stock", "date", "return_1d"))
    return average_tie_rank(known, ["date"], "return_1d", "place").select("stock", "date", "place")


DAILY_SQL = PANEL_SQL + MARKET_SQL + """,
curve AS (
  SELECT date, exp(sum(ln(1 + market)) OVER (ORDER BY date)) AS growth FROM market WHERE market IS NOT NULL),
peaked AS (SELECT *, max(growth) OVER (ORDER BY date) AS peak FROM curve)
"""


@query("equity_curve", DAILY_SQL + """
SELECT date, round(growth, 6) + 0.0 AS growth, round(peak, 6) + 0.0 AS peak,
       round((growth - peak) / peak, 6) + 0.0 AS drawdown FROM peaked""")
def market_equity(spark: SparkSession, sf: str) -> DataFrame:
    m = market_series(staged_panel(spark, sf)).select(F.lit("market").alias("label"), "date", F.col("market").alias("ret"))
    return rounded(equity_curve(m), "growth", "peak", "drawdown").select("date", "growth", "peak", "drawdown")


@query("running_log_growth", PANEL_SQL + """
SELECT stock, date, round(exp(sum(ln(1 + greatest(return_1d, -0.9999))) OVER (PARTITION BY stock ORDER BY date)) - 1, 6) + 0.0 AS growth
FROM panel WHERE return_1d IS NOT NULL""")
def running_log_growth(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf).filter(F.col("return_1d").isNotNull())
    return rounded(running_growth(p, ["stock"], "date", "return_1d", "growth"), "growth").select("stock", "date", "growth")


@query("month_starts", PANEL_SQL + PERIODS_SQL + """
SELECT period, reb_date, coalesce(next_date, DATE '9999-12-31') AS next_date FROM periods""")
def rebalance_calendar(spark: SparkSession, sf: str) -> DataFrame:
    last = F.to_date(F.lit("9999-12-31"))
    return (month_starts(staged_panel(spark, sf), START)
            .withColumn("next_date", F.coalesce("next_date", last)))


@query("last_rows", BARS_SQL + """
SELECT stock, date, close FROM bars
QUALIFY row_number() OVER (PARTITION BY stock ORDER BY date DESC) <= 20""")
def tails(spark: SparkSession, sf: str) -> DataFrame:
    return last_rows(bars(spark, sf), 20).select("stock", "date", "close")


@query("running_history", PANEL_SQL + PERIODS_SQL + """
SELECT p.period, t.stock, count(*) AS n_tokens
FROM periods p JOIN panel t ON t.date <= p.reb_date AND t.return_1d IS NOT NULL
GROUP BY ALL HAVING count(*) >= 100""")
def running_history(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    _, periods, days = staged_calendar(p, START)
    return states_at(tokenise(p), days, periods).select("period", "stock", "n_tokens")


# ---- statistics -----------------------------------------------------------------------------------

@query("completeness", PANEL_SQL + "SELECT stock, count(return_1d) AS n_filled FROM panel GROUP BY stock")
def filled(spark: SparkSession, sf: str) -> DataFrame:
    return completeness(staged_panel(spark, sf))


@query("most_complete_stocks", PANEL_SQL + """
SELECT stock, count(return_1d) AS n_filled FROM panel GROUP BY stock ORDER BY 2 DESC, 1 LIMIT 40""")
def top_complete(spark: SparkSession, sf: str) -> DataFrame:
    return most_complete(staged_panel(spark, sf), 40)


@query("market_series", PANEL_SQL + MARKET_SQL + """
SELECT date, round(market, 6) + 0.0 AS market FROM market""")
def market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market_series(staged_panel(spark, sf)), "market")


@query("volatility_ratio", PANEL_SQL + VOL_SQL.format(source="panel") + """
SELECT stock, n_returns, round(vol_ratio, 6) + 0.0 AS vol_ratio FROM vol""")
def vol_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(volatility_ratio(staged_panel(spark, sf)), "vol_ratio")


@query("bucketed_volatility", PANEL_SQL + VOL_SQL.format(source="panel") + """
SELECT stock, n_returns, round(vol_ratio, 6) + 0.0 AS vol_ratio FROM vol""")
def bucketed_vol_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """From the panel clustered by stock: no shuffle after the table is written."""
    folder = new_folder(spark, "by-stock")
    write_by_stock(staged_panel(spark, sf), folder, buckets=16)
    return rounded(volatility_ratio(read_by_stock(spark, folder)), "vol_ratio")


@query("market_beta", CALENDAR_SQL + MARKET_SQL + BETA_SQL + """
SELECT stock, round(beta, 6) + 0.0 AS beta FROM betas""")
def market_beta(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return rounded(beta(p, market_series(p), positions(p)), "beta")


@query("market_beta_full_history", CALENDAR_SQL + MARKET_SQL + """,
pairs AS (SELECT p.stock, CASE WHEN m.market IS NOT NULL THEN return_1d END AS s,
                 CASE WHEN return_1d IS NOT NULL THEN m.market END AS m
          FROM panel p LEFT JOIN market m USING (date))
SELECT stock, round(CASE WHEN count(m) < 20 THEN 1.0 WHEN var_pop(m) < 1e-10 THEN 1.0
       ELSE covar_samp(s, m) / var_samp(m) END, 6) + 0.0 AS beta FROM pairs GROUP BY stock""")
def market_beta_full(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return rounded(beta(p, market_series(p), positions(p), lookback=1_000_000, unbiased=True), "beta")


FACTORS_SQL = CALENDAR_SQL + """,
factors AS (
  SELECT stock, coalesce(sum(CASE WHEN age < 20 THEN return_1d END), 0) AS momentum,
         -coalesce(sum(CASE WHEN age < 5 THEN return_1d END), 0) AS reversal,
         stddev_samp(CASE WHEN age < 20 THEN return_1d END) AS volatility
  FROM (SELECT p.*, (SELECT max(pos) FROM calendar) - pos AS age FROM panel p JOIN calendar USING (date))
  GROUP BY stock)
"""


@query("cross_section_factors", FACTORS_SQL + """
SELECT stock, round(momentum, 6) + 0.0 AS momentum, round(reversal, 6) + 0.0 AS reversal,
       round(volatility, 6) + 0.0 AS volatility FROM factors""")
def factor_values(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return rounded(factors(p, positions(p)), "momentum", "reversal", "volatility")


@query("factors_at_rebalance", CALENDAR_SQL + PERIODS_SQL + """,
aged AS (SELECT k.period, p.stock, p.return_1d, r.pos - c.pos AS age
         FROM periods k JOIN calendar r ON r.date = k.reb_date
         JOIN calendar c ON c.pos > r.pos - 20 AND c.pos <= r.pos JOIN panel p ON p.date = c.date)
SELECT period, stock, round(coalesce(sum(return_1d), 0), 6) + 0.0 AS momentum,
       round(-coalesce(sum(CASE WHEN age < 5 THEN return_1d END), 0), 6) + 0.0 AS reversal,
       round(stddev_samp(return_1d), 6) + 0.0 AS volatility
FROM aged GROUP BY ALL""")
def factor_values_at(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return rounded(factors_at(p, positions(p), month_starts(p, START)), "momentum", "reversal", "volatility")


@query("realised_returns", PANEL_SQL + PERIODS_SQL + """
SELECT d.held_in AS period, p.stock, round(coalesce(sum(p.return_1d), 0), 6) + 0.0 AS realised
FROM panel p JOIN days d USING (date) WHERE d.held_in IS NOT NULL GROUP BY ALL""")
def realised_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    return rounded(realised(p, staged_calendar(p, START)[2]), "realised")


# ---- past blocks of twenty days stand for sampled paths --------------------------------------------

def block_paths(series: DataFrame, days: int = 20) -> DataFrame:
    """Each stock's past returns cut into blocks, one block per path; the last one may be shorter."""
    at = F.row_number().over(W.partitionBy("stock").orderBy("date")) - 1
    cells = (series.filter(F.col("return_1d").isNotNull()).withColumn("at", at)
             .select("stock", F.floor(F.col("at") / days).cast("int").alias("path"), "at", "return_1d"))
    return (cells.groupBy("stock", "path")
            .agg(F.sort_array(F.collect_list(F.struct("at", "return_1d"))).alias("cells"))
            .select("stock", "path", F.col("cells.return_1d").alias("rets")))


def blocks_sql(source: str, scale: str = "1.0") -> str:
    return f""",
cells AS (
  SELECT stock, return_1d * {scale} AS ret, row_number() OVER (PARTITION BY stock ORDER BY date) - 1 AS i
  FROM {source} WHERE return_1d IS NOT NULL),
blocks AS (SELECT stock, i // 20 AS path, i % 20 + 1 AS day, ret,
                  count(*) OVER (PARTITION BY stock, i // 20) AS n FROM cells),
cums AS (
  SELECT stock, path, h AS horizon, exp(sum(ln(1 + greatest(ret, -0.9999)))) - 1 AS cum
  FROM blocks JOIN (SELECT unnest([1, 5, 20]) AS h) ON day <= h WHERE n >= h GROUP BY ALL)
"""


METRICS_SQL = """
SELECT stock, horizon, round(avg(cum) * 100, 6) + 0.0 AS mean_pct,
       round(quantile_cont(cum, 0.5) * 100, 6) + 0.0 AS median_pct,
       round(stddev_pop(cum) * 100, 6) + 0.0 AS std_pct,
       round(quantile_cont(cum, 0.1) * 100, 6) + 0.0 AS p10_pct,
       round(quantile_cont(cum, 0.9) * 100, 6) + 0.0 AS p90_pct,
       round(avg(CASE WHEN cum > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS prob_up_pct
FROM cums GROUP BY ALL"""


@query("horizon_metrics", PANEL_SQL + blocks_sql("panel") + METRICS_SQL)
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = horizon_metrics(block_paths(staged_panel(spark, sf)), [1, 5, 20, 60], rounded=False)
    return rounded(m, *[c for c in m.columns if c.endswith("_pct")])


@query("daily_path_profile", PANEL_SQL + blocks_sql("panel") + """,
med AS (SELECT stock, day, median(ret) AS m, quantile_cont(ret, 0.25) AS lo, quantile_cont(ret, 0.75) AS hi
        FROM blocks GROUP BY ALL)
SELECT stock, CAST(day AS INTEGER) AS day, round(m * 100, 6) + 0.0 AS daily_median,
       round(lo * 100, 6) + 0.0 AS daily_p25, round(hi * 100, 6) + 0.0 AS daily_p75,
       round((exp(sum(ln(1 + greatest(m, -0.9999))) OVER (PARTITION BY stock ORDER BY day)) - 1) * 100, 6) + 0.0 AS cum_return_pct
FROM med""")
def path_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(daily_profile(block_paths(staged_panel(spark, sf))),
                   "daily_median", "daily_p25", "daily_p75", "cum_return_pct")


@query("expected_path_return", PANEL_SQL + blocks_sql("panel") + """
SELECT stock, round(avg(cum), 6) + 0.0 AS score FROM cums WHERE horizon = 5 GROUP BY stock""")
def expected_path_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(expected_return(block_paths(staged_panel(spark, sf)), 5), "score")


# ---- top-k -----------------------------------------------------------------------------------------

LEADER_SQL = """
WITH ranked AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS stock,
         CAST(floor(rank() OVER (ORDER BY count(*) DESC)
              + (count(*) OVER (PARTITION BY count(*)) - 1) / 2.0) AS INTEGER) AS composite_rank,
         100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS prob_up_1d
  FROM lineitem GROUP BY l_suppkey)
"""


def leaders(spark: SparkSession, sf: str) -> DataFrame:
    counts = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("stock"))
              .agg(F.count("*").alias("n"),
                   (100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("prob_up_1d")))
    return average_tie_rank(counts, [], "n", "composite_rank", truncate=True).drop("n")


@query("top_and_bottom", LEADER_SQL + """
(SELECT 'top' AS side, stock, composite_rank FROM ranked ORDER BY composite_rank, stock LIMIT 15)
UNION ALL (SELECT 'bottom', stock, composite_rank FROM ranked ORDER BY composite_rank DESC, stock LIMIT 15)""")
def top_and_bottom(spark: SparkSession, sf: str) -> DataFrame:
    r = leaders(spark, sf)
    cols = ["stock", "composite_rank", "not_there"]
    top = display(r, 15, cols).select(F.lit("top").alias("side"), "stock", "composite_rank")
    bottom = display(r, 15, cols, worst=True).select(F.lit("bottom").alias("side"), "stock", "composite_rank")
    return top.unionByName(bottom)


@query("selection_probability", LEADER_SQL + """
SELECT round(avg(prob_up_1d), 6) + 0.0 AS avg_prob FROM
  (SELECT * FROM ranked ORDER BY composite_rank DESC, stock LIMIT 10)""")
def selection_probability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mean_probability(top_n(leaders(spark, sf), 10, worst=True)), "avg_prob")


@query("sorted_panel", BARS_SQL + "SELECT date, stock, close FROM bars ORDER BY date, stock")
def sorted_panel(spark: SparkSession, sf: str) -> DataFrame:
    return bars(spark, sf).select("date", "stock", "close").orderBy("date", "stock")


@query("distinct_counts", PANEL_SQL + """
SELECT year(date)::INTEGER AS year, count(DISTINCT stock) AS n_stocks, count(DISTINCT date) AS n_dates FROM panel GROUP BY 1""")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return staged_panel(spark, sf).groupBy(F.year("date").alias("year")).agg(
        F.countDistinct("stock").alias("n_stocks"), F.countDistinct("date").alias("n_dates"))
