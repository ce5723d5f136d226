"""Forecast of the whole cross-section: paths to horizon metrics, ranks and regime."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.scalar import half_even, regime_label
from tickloom.operators.calendar import positions, weekdays_ahead
from tickloom.operators.paths import sample_paths
from tickloom.operators.ranks import average_tie_rank
from tickloom.operators.stats import (beta, daily_profile, horizon_metrics, market_series,
                                      volatility_ratio)
from tickloom.operators.tokens import tokenise
from tickloom.operators.transitions import pair_counts, probabilities, token_pairs, with_unseen
from tickloom.staging import stage

MARKET = "#market"
HORIZONS = [1, 5, 20]


def as_series(market: DataFrame) -> DataFrame:
    return market.select(F.lit(MARKET).alias("stock"), "date", F.col("market").alias("return_1d"))


def token_model(tokens: DataFrame, temperature: float = 0.8) -> DataFrame:
    """Transition probabilities over all of history, staged: at most 403 x 402 rows."""
    counts = with_unseen(pair_counts(token_pairs(tokens)))
    return stage(probabilities(counts, temperature=temperature), "probabilities")


def path_states(panel: DataFrame, market: DataFrame, min_tokens: int = 50) -> DataFrame:
    """(stock, token, vol_ratio) of every stock with enough history, and of the market."""
    both = panel.select("stock", "date", "return_1d").unionByName(as_series(market))
    last = (tokenise(both).groupBy("stock")
            .agg(F.max_by("token", "date").alias("token"), F.count("*").alias("n_tokens")))
    enough = (F.col("n_tokens") >= min_tokens) | (F.col("stock") == MARKET)
    return (last.filter(enough).join(volatility_ratio(both), "stock")
            .select("stock", "token", "vol_ratio"))


def market_adjusted(metrics: DataFrame, betas: DataFrame, weight: float = 0.5,
                    rounded: bool = True) -> DataFrame:
    """Adds ``mkt_exp_pct`` and ``adj_ret``: mean + weight * beta * market mean of the horizon.

    The market has one row per horizon; a horizon it lacks counts as 0.
    """
    market = metrics.filter(F.col("stock") == MARKET).select(
        "horizon", F.col("mean_pct").alias("mkt_exp_pct"))
    adj = F.col("mean_pct") + F.col("beta") * F.col("mkt_exp_pct") * weight
    return (metrics.filter(F.col("stock") != MARKET).join(betas, "stock")
            .join(F.broadcast(market), "horizon", "left")
            .withColumn("mkt_exp_pct", F.coalesce("mkt_exp_pct", F.lit(0.0)))
            .withColumn("adj_ret", half_even(adj, 3) if rounded else adj))


def weekend_filter(rows: DataFrame, as_of: date | Column, max_ratio: float = 1.5) -> DataFrame:
    """Drop volatile stocks where the next weekday after ``as_of`` is a Monday."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    monday = F.weekday(weekdays_ahead(day, 1)) == 0
    return rows.filter(~monday | (F.col("vol_ratio") <= max_ratio))


def wide_rows(adjusted: DataFrame, vol: DataFrame, horizons: list[int]) -> DataFrame:
    """One row per stock with five columns per horizon."""
    shown = {"raw_ret": "mean_pct", "adj_ret": "adj_ret", "prob_up": "prob_up_pct",
             "p10": "p10_pct", "p90": "p90_pct"}
    cells = [F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{name}_{h}d")
             for h in horizons for name, c in shown.items()]
    rows = adjusted.groupBy("stock").agg(F.first("beta").alias("beta"), *cells)
    return (rows.join(vol, "stock")
            .withColumns({"vol_ratio": half_even(F.col("vol_ratio"), 2),
                          "beta": half_even(F.col("beta"), 2)}))


def composite(rows: DataFrame, horizons: list[int]) -> DataFrame:
    """Mean of the adjusted columns that are known."""
    cols = [F.col(f"adj_ret_{h}d") for h in horizons]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return rows.withColumn("composite_score", F.try_divide(total, n))


def ranked(rows: DataFrame, horizons: list[int]) -> DataFrame:
    """Composite and per-horizon ranks over the whole cross-section, one row per stock.

    All scores are ranked in one pass, with the score's name as key, however many horizons there are.
    """
    names = {"composite_score": "composite_rank"} | {f"adj_ret_{h}d": f"rank_{h}d" for h in horizons}
    long = rows.unpivot(["stock"], [*names], "name", "score")
    places = average_tie_rank(long, ["name"], "score", "place", truncate=True)
    wide = places.groupBy("stock").agg(*[F.max(F.when(F.col("name") == n, F.col("place"))).alias(into)
                                         for n, into in names.items()])
    return rows.join(wide, "stock")


def with_regime(rows: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds the market's one-day chance to rise and the regime it means."""
    one_day = metrics.filter((F.col("stock") == MARKET) & (F.col("horizon") == 1))
    p = one_day.select(F.max("prob_up_pct")).scalar()
    return (rows.withColumn("market_prob_up_1d", p)
            .withColumn("regime", regime_label(F.col("market_prob_up_1d"))))


def candidates_shown(regime: Column) -> tuple[Column, Column]:
    """(longs shown, shorts shown): a bull day hides the shorts, a bear day the longs."""
    return regime != "bear", regime != "bull"


def forecast_from_paths(panel: DataFrame, market: DataFrame, paths: DataFrame, as_of: date | Column,
                        horizons: list[int] | None = None) -> DataFrame:
    """Ranked forecast table from any scorer's ``paths(stock, path, rets)``, market included."""
    horizons = sorted(horizons or HORIZONS)
    if 1 not in horizons:
        raise ValueError("the regime needs horizon 1")
    metrics = stage(horizon_metrics(paths, horizons), "metrics")
    adjusted = market_adjusted(metrics, beta(panel, market, stage(positions(panel), "calendar")))
    vol = volatility_ratio(panel).select("stock", "vol_ratio")
    rows = composite(weekend_filter(wide_rows(adjusted, vol, horizons), as_of), horizons)
    return with_regime(ranked(stage(rows, "rows"), horizons), metrics)


def forecast(panel: DataFrame, as_of: date | Column, horizons: list[int] | None = None,
             n_paths: int = 200, temperature: float = 0.8, seed: int = 0) -> DataFrame:
    """Ranked forecast with the built-in scorer, a first-order chain over return tokens."""
    horizons = sorted(horizons or HORIZONS)
    market = stage(market_series(panel), "market")
    probs = token_model(tokenise(panel), temperature)
    paths = sample_paths(path_states(panel, market), probs, max(horizons), n_paths, seed)
    return forecast_from_paths(panel, market, paths, as_of, horizons)


def deep_forecast(panel: DataFrame, stock: str, as_of: date | Column,
                  horizons: list[int] | None = None, n_paths: int = 200,
                  temperature: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(metrics per horizon, daily path profile) of one stock; both empty for an unknown one."""
    horizons = sorted(horizons or HORIZONS)
    market = stage(market_series(panel), "market")
    probs = token_model(tokenise(panel), temperature)
    states = path_states(panel.filter(F.col("stock") == stock.upper()), market, min_tokens=1)
    paths = sample_paths(states, probs, max(horizons), n_paths, seed)
    return deep_forecast_from_paths(panel, market, paths, stock, as_of, horizons)


def deep_forecast_from_paths(panel: DataFrame, market: DataFrame, paths: DataFrame, stock: str, as_of: date | Column,
                             horizons: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The two tables of ``deep_forecast`` from any scorer's paths of the stock and the market."""
    horizons = sorted(horizons or HORIZONS)
    name = stock.upper()
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    one = panel.filter(F.col("stock") == name)
    own = beta(one, market, positions(panel))
    adjusted = market_adjusted(horizon_metrics(paths, horizons), own).join(
        volatility_ratio(one).select("stock", "vol_ratio"), "stock")
    metrics = adjusted.select(
        "stock", F.col("horizon").alias("horizon_days"),
        weekdays_ahead(day, F.col("horizon")).alias("approx_date"),
        F.col("mean_pct").alias("raw_mean_pct"), F.col("adj_ret").alias("market_adj_pct"),
        "median_pct", "std_pct", "p10_pct", "p90_pct", "prob_up_pct",
        half_even(F.col("vol_ratio"), 2).alias("vol_ratio"),
        half_even(F.col("beta"), 2).alias("beta"), "mkt_exp_pct")
    profile = daily_profile(paths.filter(F.col("stock") == name))
    shown = profile.select(
        "stock", "day", weekdays_ahead(day, F.col("day")).alias("approx_date"),
        *[half_even(F.col(c), 3).alias(c)
          for c in ("daily_median", "daily_p25", "daily_p75", "cum_return_pct")])
    return metrics, shown
