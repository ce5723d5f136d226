"""Forecast tables. Past blocks of twenty days, scaled by volatility, stand for sampled paths where
an SQL twin is wanted; the built-in sampler is run as well."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.calendar import positions
from tickloom.operators.stats import beta, horizon_metrics, market_series, volatility_ratio
from tickloom.functions.scalar import centre_of
from tickloom.operators.paths import sample_paths
from tickloom.operators.tokens import tokenise
from tickloom.plans.forecast import (HORIZONS, MARKET, as_series, deep_forecast_from_paths, forecast_from_paths,
                                     market_adjusted, path_states, token_model)
from tickloom.plans.routing import statements
from tickloom.queries.data import BETA_SQL, CALENDAR_SQL, MARKET_SQL, PANEL_SQL, VOL_SQL, staged_panel
from tickloom.queries.registry import query, rounded
from tickloom.queries.statistics import block_paths, blocks_sql
from tickloom.staging import stage

FRIDAY, TUESDAY = date(2001, 11, 2), date(2001, 11, 6)


def scaled_blocks(p: DataFrame, m: DataFrame) -> DataFrame:
    """Block paths of every stock and of the market, times the volatility ratio."""
    series = stage(p.select("stock", "date", "return_1d").unionByName(as_series(m)), "series")
    ratio = volatility_ratio(series).select("stock", "vol_ratio")
    return (block_paths(series).join(ratio, "stock")
            .withColumn("rets", F.transform("rets", lambda r: r * F.col("vol_ratio")))
            .select("stock", "path", "rets"))


SERIES_SQL = CALENDAR_SQL + MARKET_SQL + f""",
both_series AS (SELECT stock, date, return_1d FROM panel
                UNION ALL SELECT '{MARKET}', date, market FROM market)
""" + VOL_SQL.format(source="both_series") + """,
scaled AS (SELECT s.stock, s.date, s.return_1d * v.vol_ratio AS return_1d
           FROM both_series s JOIN vol v USING (stock))
""" + blocks_sql("scaled") + """,
metrics AS (
  SELECT stock, horizon,
         round_even(avg(cum) * 100 * 1e3, 0) / 1e3 + 0.0 AS mean_pct,
         round_even(quantile_cont(cum, 0.5) * 100 * 1e3, 0) / 1e3 + 0.0 AS median_pct,
         round_even(stddev_pop(cum) * 100 * 1e3, 0) / 1e3 + 0.0 AS std_pct,
         round_even(quantile_cont(cum, 0.1) * 100 * 1e3, 0) / 1e3 + 0.0 AS p10_pct,
         round_even(quantile_cont(cum, 0.9) * 100 * 1e3, 0) / 1e3 + 0.0 AS p90_pct,
         round_even(avg(CASE WHEN cum > 0 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 * 1e1, 0) / 1e1 + 0.0 AS prob_up_pct
  FROM cums GROUP BY ALL)
""" + BETA_SQL + f""",
adjusted AS (
  SELECT m.*, b.beta, coalesce(k.mean_pct, 0.0) AS mkt_exp_pct,
         round_even((m.mean_pct + b.beta * coalesce(k.mean_pct, 0.0) * 0.5) * 1e3, 0) / 1e3 + 0.0 AS adj_ret
  FROM metrics m JOIN betas b USING (stock)
  LEFT JOIN metrics k ON k.stock = '{MARKET}' AND k.horizon = m.horizon
  WHERE m.stock <> '{MARKET}')
"""


@query("market_adjusted_returns", SERIES_SQL + """
SELECT stock, horizon, mean_pct, mkt_exp_pct, adj_ret, prob_up_pct FROM adjusted""")
def adjusted_returns(spark: SparkSession, sf: str) -> DataFrame:
    p = staged_panel(spark, sf)
    m = stage(market_series(p), "market")
    got = stage(horizon_metrics(scaled_blocks(p, m), HORIZONS), "metrics")
    return market_adjusted(got, beta(p, m, positions(p))).select(
        "stock", "horizon", "mean_pct", "mkt_exp_pct", "adj_ret", "prob_up_pct")


def _rank_sql(column: str, name: str) -> str:
    return (f"CAST(floor(rank() OVER (ORDER BY {column} DESC)"
            f" + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) AS INTEGER) AS {name}")


FORECAST_SQL = SERIES_SQL + """,
rows AS (
  SELECT a.stock, """ + ", ".join(
    f"max(CASE WHEN horizon = {h} THEN {c} END) AS {n}_{h}d" for h in HORIZONS
    for n, c in (("raw_ret", "mean_pct"), ("adj_ret", "adj_ret"), ("prob_up", "prob_up_pct"),
                 ("p10", "p10_pct"), ("p90", "p90_pct"))) + """,
         round_even(any_value(beta) * 100, 0) / 100 + 0.0 AS beta,
         round_even(any_value(v.vol_ratio) * 100, 0) / 100 + 0.0 AS vol_ratio
  FROM adjusted a JOIN vol v USING (stock) GROUP BY a.stock),
composed AS (SELECT *, (adj_ret_1d + adj_ret_5d + adj_ret_20d) / 3 AS composite_score FROM rows{gate}),
ranked AS (
  SELECT * EXCLUDE (composite_score), round(composite_score, 6) + 0.0 AS composite_score,
         """ + _rank_sql("composite_score", "composite_rank") + ", " + ", ".join(
    _rank_sql(f"adj_ret_{h}d", f"rank_{h}d") for h in HORIZONS) + f""",
         (SELECT prob_up_pct FROM metrics WHERE stock = '{MARKET}' AND horizon = 1) AS market_prob_up_1d
  FROM composed),
forecast AS (
  SELECT *, CASE WHEN market_prob_up_1d >= 55 THEN 'bull' WHEN market_prob_up_1d <= 42 THEN 'bear'
                 ELSE 'neutral' END AS regime FROM ranked)
"""


def block_forecast(spark: SparkSession, sf: str, as_of: date) -> DataFrame:
    p = staged_panel(spark, sf)
    m = stage(market_series(p), "market")
    return forecast_from_paths(p, m, scaled_blocks(p, m), as_of)


@query("forecast_table", FORECAST_SQL.replace("{gate}", "") + "SELECT * FROM forecast")
def forecast_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(block_forecast(spark, sf, TUESDAY), "composite_score")


@query("forecast_before_monday", FORECAST_SQL.replace("{gate}", " WHERE vol_ratio <= 1.5") + """
SELECT stock, composite_rank, rank_1d, rank_5d, rank_20d, vol_ratio, regime FROM forecast""")
def forecast_before_monday(spark: SparkSession, sf: str) -> DataFrame:
    return block_forecast(spark, sf, FRIDAY).select(
        "stock", "composite_rank", "rank_1d", "rank_5d", "rank_20d", "vol_ratio", "regime")


@query("signal_statements", FORECAST_SQL.replace("{gate}", "") + """,
placed AS (SELECT *, composite_rank / count(*) OVER () * 100 AS pct,
                  CAST(round_even((1 - composite_rank / count(*) OVER ()) * 100, 0) AS INTEGER) AS better FROM forecast)
SELECT stock, composite_rank, (SELECT count(*) FROM forecast) AS total, prob_up_1d, prob_up_20d,
       CASE WHEN pct <= 5 THEN 'STRONG BUY' WHEN pct <= 20 THEN 'BUY' WHEN pct >= 95 THEN 'STRONG AVOID'
            WHEN pct >= 80 THEN 'AVOID' ELSE 'NEUTRAL' END AS signal,
       better AS better_than_pct, 100 - better AS top_pct,
       CASE WHEN vol_ratio > 1.3 THEN 'more jumpy than usual' WHEN vol_ratio < 0.7 THEN 'calmer than usual'
            ELSE 'normal' END AS volatility,
       CASE WHEN better >= 95 THEN 'strong' WHEN better <= 20 THEN 'weak' ELSE 'moderate' END AS strength
FROM placed""")
def signal_statements(spark: SparkSession, sf: str) -> DataFrame:
    ranked = stage(block_forecast(spark, sf, TUESDAY), "forecast")
    return statements(ranked, ranked.select(F.count("*")).scalar())


@query("sampled_forecast", PANEL_SQL + """
SELECT stock, CAST(200 AS BIGINT) AS n_paths, true AS same_again, true AS on_the_grid FROM panel
WHERE return_1d IS NOT NULL GROUP BY stock HAVING count(*) >= 50""")
def sampled_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast's 200 sampled paths per stock: drawn again from states dealt out otherwise they are the
    same, and each step is a token's centre times the stock's volatility ratio."""
    p = staged_panel(spark, sf)
    m = stage(market_series(p), "market")
    probs = token_model(tokenise(p))
    states = stage(path_states(p, m), "states")
    steps = probs.select(F.round(centre_of(F.col("next")), 9).alias("c")).distinct()
    grid = steps.agg(F.collect_set("c").alias("grid")).select("grid").scalar()       # at most one value a token
    one, two = (sample_paths(s, probs, max(HORIZONS), 200, 3) for s in (states, states.repartition(3).sortWithinPartitions(F.desc("token"))))
    # by shuffle: the planner takes the paths to be as small as the states that they are drawn from, and would collect them
    again = two.select("stock", "path", F.col("rets").alias("again")).hint("merge")
    same = (one.join(again, ["stock", "path"])
            .join(states.select("stock", "vol_ratio"), "stock").withColumn("grid", grid))
    known = F.forall("rets", lambda r: F.array_contains("grid", F.round(r / F.col("vol_ratio"), 9) + 0.0))
    return (same.filter(F.col("stock") != MARKET).groupBy("stock").agg(
        F.count("*").alias("n_paths"), F.every(F.col("rets") == F.col("again")).alias("same_again"),
        F.every(known).alias("on_the_grid")))


ONE = "7"
DEEP_SQL = SERIES_SQL + f""",
weekdays AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (
  SELECT CAST(DATE '{TUESDAY}' + CAST(i AS INTEGER) AS DATE) AS d FROM range(1, 60) t(i)) WHERE isodow(d) <= 5)
"""


def _deep(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = staged_panel(spark, sf)
    m = stage(market_series(p), "market")
    return deep_forecast_from_paths(p, m, scaled_blocks(p, m), ONE, TUESDAY)


@query("deep_forecast", DEEP_SQL + f"""
SELECT a.stock, horizon AS horizon_days, w.d AS approx_date, mean_pct AS raw_mean_pct, adj_ret AS market_adj_pct,
       median_pct, std_pct, p10_pct, p90_pct, prob_up_pct, round_even(v.vol_ratio * 100, 0) / 100 + 0.0 AS vol_ratio,
       round_even(beta * 100, 0) / 100 + 0.0 AS beta, mkt_exp_pct
FROM adjusted a JOIN vol v USING (stock) JOIN weekdays w ON w.n = horizon WHERE a.stock = '{ONE}'""")
def one_stock_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _deep(spark, sf)[0]


@query("deep_forecast_path", DEEP_SQL + f""",
med AS (SELECT day, median(ret) AS m, quantile_cont(ret, 0.25) AS lo, quantile_cont(ret, 0.75) AS hi
        FROM blocks WHERE stock = '{ONE}' GROUP BY day)
SELECT '{ONE}' AS stock, CAST(day AS INTEGER) AS day, w.d AS approx_date,
       round_even(m * 100 * 1e3, 0) / 1e3 + 0.0 AS daily_median, round_even(lo * 100 * 1e3, 0) / 1e3 + 0.0 AS daily_p25,
       round_even(hi * 100 * 1e3, 0) / 1e3 + 0.0 AS daily_p75,
       round_even((exp(sum(ln(1 + greatest(m, -0.9999))) OVER (ORDER BY day)) - 1) * 100 * 1e3, 0) / 1e3 + 0.0 AS cum_return_pct
FROM med JOIN weekdays w ON w.n = day""")
def one_stock_path(spark: SparkSession, sf: str) -> DataFrame:
    return _deep(spark, sf)[1]
