"""Performance of return series and counts over a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scalar import half_even
from tickloom.operators.windows import equity_curve

PERIODS_A_YEAR = {"monthly": 12, "daily": 252}


def performance(returns: DataFrame, freq: str = "monthly", rounded: bool = True) -> DataFrame:
    """Per label of ``returns(label, date, ret)``: growth, Sharpe, drawdown, win rate."""
    f = PERIODS_A_YEAR[freq]
    r = F.col("ret")
    s = equity_curve(returns).groupBy("label").agg(
        F.product(1 + r).alias("growth"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"),
        F.min("drawdown").alias("max_dd"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("wins"),
        F.count(r).alias("n_periods"))
    years = F.greatest(F.col("n_periods") / f, F.lit(0.01))
    sharpe = F.when(F.col("sd") > 0, F.try_divide(F.col("mean"), F.col("sd")) * (f ** 0.5)).otherwise(0.0)
    values = {"cagr_pct": ((F.pow("growth", 1 / years) - 1) * 100, 2), "sharpe": (sharpe, 3),
              "max_dd_pct": (F.col("max_dd") * 100, 2), "win_rate_pct": (F.col("wins") * 100, 1),
              "total_ret_pct": ((F.col("growth") - 1) * 100, 2)}
    return s.select("label", *[(half_even(c, p) if rounded else c).alias(k)
                               for k, (c, p) in values.items()],
                    F.col("n_periods").cast("int").alias("n_periods"))


def overview(ranked: DataFrame, rank: str = "composite_rank", share: float = 0.10) -> DataFrame:
    """One row: total, strong buys (rank <= k), avoids (rank >= total - k), the rest neutral."""
    total = ranked.select(F.count("*")).scalar()
    k = F.floor(total * share)
    return (ranked.agg(F.count("*").alias("total"),
                       F.count_if(F.col(rank) <= k).alias("strong_buy"),
                       F.count_if(F.col(rank) >= total - k).alias("avoid"))
            .withColumn("neutral", F.col("total") - F.col("strong_buy") - F.col("avoid")))


def mean_probability(selection: DataFrame, column: str = "prob_up_1d") -> DataFrame:
    return selection.agg(F.avg(column).alias("avg_prob"))
