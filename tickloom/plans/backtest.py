"""Walk-forward evaluation of scores. The period is a grouping key: no loop over dates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.scalar import LOG_FLOOR
from tickloom.operators.calendar import day_starts, month_starts, period_of_days, positions
from tickloom.operators.performance import performance
from tickloom.operators.ranks import legs
from tickloom.operators.regress import (coefficient_summary, fama_macbeth, period_factor_regression,
                                        period_regression)
from tickloom.operators.stats import factors, factors_at, realised
from tickloom.operators.tokens import tokenise
from tickloom.operators.transitions import (cumulative_counts, expected_growth, probabilities,
                                            score_states, token_pairs, with_unseen)
from tickloom.staging import stage

FACTORS = ["score", "momentum", "reversal", "volatility"]
LEGS = ["long", "short"]


def scored_periods(days: DataFrame, periods: DataFrame, horizon: int) -> DataFrame:
    """Periods that hold at least one day, with the horizon their scores look ahead."""
    held = (days.filter(F.col("held_in").isNotNull()).groupBy(F.col("held_in").alias("period"))
            .agg(F.count("*").alias("n_days")))
    return (periods.filter(F.col("next_date").isNotNull()).join(held, "period")
            .withColumn("horizon", F.least(F.col("n_days"), F.lit(horizon)).cast("int")))


def states_at(tokens: DataFrame, days: DataFrame, periods: DataFrame, min_tokens: int = 100) -> DataFrame:
    """(period, stock, n_tokens, token): history length and last token on each rebalance date.

    Tokens are reduced to one row per stock and period first; a stock without news keeps its
    last state.
    """
    known = days.filter(F.col("known_at").isNotNull()).select("date", F.col("known_at").alias("period"))
    news = (tokens.join(F.broadcast(known), "date").groupBy("stock", "period")
            .agg(F.count("*").alias("n"), F.max_by("token", "date").alias("token")))
    along = W.partitionBy("stock").orderBy("period")
    last = periods.select(F.max("period")).scalar()
    return (news.withColumn("n_tokens", F.sum("n").over(along.rowsBetween(W.unboundedPreceding, 0)))
            .filter(F.col("n_tokens") >= min_tokens)
            .withColumn("until", F.coalesce(F.lead("period").over(along) - 1, last))
            .select(F.explode(F.sequence("period", "until")).alias("period"), "stock", "n_tokens", "token"))


def walk_forward_scores(panel: DataFrame, periods: DataFrame, days: DataFrame, horizon: int = 5,
                        temperature: float = 0.8, min_tokens: int = 100, min_scores: int = 20) -> DataFrame:
    """(period, stock, token, score) from what each rebalance date could know, all periods at once."""
    tokens = tokenise(panel)
    # at most 402 x 402 rows a period; staged because probabilities, marginals and states all read it
    counts = stage(cumulative_counts(token_pairs(tokens), days, periods), "counts")
    probs = probabilities(with_unseen(counts, ["period"]), ["period"], temperature)
    open_periods = scored_periods(days, periods, horizon).select("period", "horizon")
    growth = stage(expected_growth(probs, horizon, ["period"], open_periods), "growth")
    states = states_at(tokens, days, periods, min_tokens).join(
        F.broadcast(open_periods.select("period")), "period", "left_semi")
    scored = score_states(states, growth, ["period"]).filter(F.col("score").isNotNull())
    scores = stage(scored.select("period", "stock", "token", "score"), "scores")
    wide_enough = (scores.groupBy("period").agg(F.count("*").alias("n"))
                   .filter(F.col("n") >= min_scores).select("period"))
    return scores.join(F.broadcast(wide_enough), "period", "left_semi")


def portfolio_returns(scores: DataFrame, panel: DataFrame, days: DataFrame, periods: DataFrame,
                      top_pct: float = 10, cost: float = 0.001, holding: str = "mean_daily",
                      cost_model: str = "per_leg") -> DataFrame:
    """(date, long_ret, short_ret, ls_ret) per scored period.

    A leg earns its equal-weighted daily mean, averaged over the days of the period
    (``holding='mean_daily'``) or compounded. With ``cost_model='per_leg'`` the cost is taken
    from both legs, so it cancels in the difference; ``'spread'`` charges both to the spread.
    """
    members = legs(scores, "period", "score", top_pct).select("period", "stock", "leg")
    held = (panel.select("stock", "date", "return_1d")
            .join(F.broadcast(days.filter(F.col("held_in").isNotNull())
                              .select("date", F.col("held_in").alias("period"))), "date"))
    daily = (held.join(members, ["period", "stock"]).groupBy("period", "leg", "date")
             .agg(F.avg("return_1d").alias("r")))
    if holding == "mean_daily":
        earned = F.avg("r")
    elif holding == "compound":
        earned = F.expm1(F.sum(F.log1p(F.greatest("r", F.lit(LOG_FLOOR)))))
    else:
        raise ValueError("holding is 'mean_daily' or 'compound'")
    charged = cost if cost_model == "per_leg" else 0.0
    per_leg = daily.groupBy("period", "leg").agg((earned - charged).alias("ret"))
    wide = per_leg.groupBy("period").agg(
        *[F.max(F.when(F.col("leg") == leg, F.col("ret"))).alias(f"{leg}_ret") for leg in LEGS])
    spread_cost = 2 * cost if cost_model == "spread" else 0.0
    return (scores.select("period").distinct().join(wide, "period", "left")
            .join(F.broadcast(periods), "period")
            .select(F.col("reb_date").alias("date"), "long_ret", "short_ret",
                    (F.col("long_ret") - F.col("short_ret") - spread_cost).alias("ls_ret")))


def leg_series(results: DataFrame) -> DataFrame:
    """(label, date, ret) of the three evaluated series; short-only is the negated short leg."""
    return (results.select("date", F.col("ls_ret").alias("Long-Short Portfolio"),
                           F.col("long_ret").alias("Long-Only Portfolio"),
                           (-F.col("short_ret")).alias("Short-Only Portfolio"))
            .unpivot("date", ["Long-Short Portfolio", "Long-Only Portfolio", "Short-Only Portfolio"],
                     "label", "ret"))


def with_realised(scores: DataFrame, panel: DataFrame, days: DataFrame) -> DataFrame:
    """Adds each scored stock's return over the holding window, 0 where it did not trade."""
    return (scores.join(realised(panel, days), ["period", "stock"], "left")
            .withColumn("realised", F.coalesce("realised", F.lit(0.0))))


def factor_table(scored: DataFrame, panel: DataFrame, calendar: DataFrame, periods: DataFrame,
                 as_of: str = "full") -> DataFrame:
    """Adds the factors: those at the panel's end for every period, or as known at each rebalance."""
    if as_of == "full":
        return scored.join(factors(panel, calendar), "stock")
    if as_of != "rebalance":
        raise ValueError("as_of is 'full' or 'rebalance'")
    own = factors_at(panel, calendar, periods)
    return (scored.join(own, ["period", "stock"], "left")
            .withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("momentum", "reversal")}))


def staged_calendar(panel: DataFrame, start: date, rebalance: str = "monthly"
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(positions, periods, period of each day) from one scan of the panel's dates."""
    calendar = stage(positions(panel), "calendar")
    periods = stage((month_starts if rebalance == "monthly" else day_starts)(calendar, start), "periods")
    return calendar, periods, stage(period_of_days(calendar, periods), "days")


@dataclass
class Backtest:
    scores: DataFrame
    results: DataFrame
    summary: DataFrame
    fama_macbeth: DataFrame
    factor_coefficients: DataFrame
    factor_summary: DataFrame


def backtest(panel: DataFrame, start: date, horizon: int = 5, top_pct: float = 10, cost: float = 0.001,
             temperature: float = 0.8, rebalance: str = "monthly", holding: str = "mean_daily",
             factors_as_of: str = "full", freq: str = "monthly") -> Backtest:
    """The whole evaluation. ``panel`` should be a table, since several steps scan it."""
    calendar, periods, days = staged_calendar(panel, start, rebalance)
    scores = walk_forward_scores(panel, periods, days, horizon, temperature)
    results = stage(portfolio_returns(scores, panel, days, periods, top_pct, cost, holding), "results")
    scored = stage(with_realised(scores, panel, days), "scored")
    coefs = stage(period_factor_regression(
        factor_table(scored, panel, calendar, periods, factors_as_of), FACTORS), "coefficients")
    return Backtest(scores, results, performance(leg_series(results), freq),
                    fama_macbeth(period_regression(scored)), coefs,
                    coefficient_summary(coefs, FACTORS))
