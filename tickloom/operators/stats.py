"""Statistics per stock and per path set: market series, volatility, beta, factors, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scalar import half_even, log_growth


def completeness(panel: DataFrame) -> DataFrame:
    return panel.groupBy("stock").agg(F.count("return_1d").alias("n_filled"))


def most_complete(panel: DataFrame, n: int = 100) -> DataFrame:
    return completeness(panel).orderBy(F.desc("n_filled"), "stock").limit(n)


def market_series(panel: DataFrame, n: int = 100) -> DataFrame:
    """(date, market): median return of the n most complete stocks (at most n values a date)."""
    members = F.broadcast(most_complete(panel, n).select("stock"))
    return (panel.join(members, "stock", "left_semi").groupBy("date")
            .agg(F.median("return_1d").alias("market")))


def volatility_ratio(panel: DataFrame, lookback: int = 20, low: float = 0.3, high: float = 4.0,
                     value: str = "return_1d") -> DataFrame:
    """Population deviation of the last ``lookback`` returns over that of all, clipped."""
    newest = W.partitionBy("stock").orderBy(F.desc(F.col(value).isNotNull()), F.desc("date"))
    recent = F.when(F.col("age") <= lookback, F.col(value))
    sd = (panel.select("stock", "date", value).withColumn("age", F.row_number().over(newest))
          .groupBy("stock").agg(F.count(value).alias("n_returns"),
                                F.stddev_pop(value).alias("sd_all"),
                                F.stddev_pop(recent).alias("sd_recent")))
    ratio = (F.when(F.col("n_returns") < lookback + 10, 1.0).when(F.col("sd_all") < 1e-8, 1.0)
             .otherwise(F.greatest(F.lit(low), F.least(
                 F.lit(high), F.try_divide(F.col("sd_recent"), F.col("sd_all"))))))
    return sd.select("stock", "n_returns", ratio.alias("vol_ratio"))


def beta(panel: DataFrame, market: DataFrame, calendar: DataFrame, lookback: int = 60,
         unbiased: bool = False) -> DataFrame:
    """Slope on the market over the last ``lookback`` calendar positions.

    By default sample covariance over population variance. Fewer than 20 common days or a flat
    market give 1. The recent market is at most ``lookback`` rows, so it is broadcast.
    """
    end = calendar.select(F.max("pos")).scalar()
    recent = (calendar.filter(F.col("pos") > end - lookback).join(market, "date", "left")
              .select("date", "market"))
    r, m = F.col("return_1d"), F.when(F.col("return_1d").isNotNull(), F.col("market"))
    var = F.var_samp(m) if unbiased else F.var_pop(m)
    sums = (panel.select("stock", "date", "return_1d").join(F.broadcast(recent), "date", "left")
            .groupBy("stock").agg(F.count(m).alias("n"), F.covar_samp(r, m).alias("cov"),
                                  F.var_pop(m).alias("flat"), var.alias("var")))
    b = (F.when(F.col("n") < 20, 1.0).when(F.col("flat") < 1e-10, 1.0)
         .otherwise(F.try_divide(F.col("cov"), F.col("var"))))
    return sums.select("stock", b.alias("beta"))


def _factor_columns(age: Column, momentum: int, reversal: int, volatility: int) -> list[Column]:
    r = F.col("return_1d")
    return [F.coalesce(F.sum(F.when(age < momentum, r)), F.lit(0.0)).alias("momentum"),
            (-F.coalesce(F.sum(F.when(age < reversal, r)), F.lit(0.0)) + F.lit(0.0)).alias("reversal"),
            F.stddev_samp(F.when(age < volatility, r)).alias("volatility")]


def factors(panel: DataFrame, calendar: DataFrame, momentum: int = 20, reversal: int = 5,
            volatility: int = 20) -> DataFrame:
    """Momentum, reversal and volatility of every stock at the end of the panel.

    The look-backs count calendar positions, not the stock's own rows.
    """
    end = calendar.select(F.max("pos")).scalar()
    aged = (panel.select("stock", "date", "return_1d").join(F.broadcast(calendar), "date")
            .withColumn("age", end - F.col("pos")))
    return aged.groupBy("stock").agg(*_factor_columns(F.col("age"), momentum, reversal, volatility))


def factors_at(panel: DataFrame, calendar: DataFrame, periods: DataFrame, momentum: int = 20,
               reversal: int = 5, volatility: int = 20) -> DataFrame:
    """The same factors as known on each rebalance date; stocks without a recent bar are absent."""
    longest = max(momentum, reversal, volatility)
    at = periods.join(calendar.withColumnRenamed("date", "reb_date"), "reb_date")
    reach = (at.select("period", "pos", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("age"))
             .withColumn("pos", F.col("pos") - F.col("age")).join(calendar, "pos")
             .select("period", "date", "age"))   # periods x look-back rows
    return (panel.select("stock", "date", "return_1d").join(F.broadcast(reach), "date")
            .groupBy("period", "stock")
            .agg(*_factor_columns(F.col("age"), momentum, reversal, volatility)))


def realised(panel: DataFrame, days: DataFrame) -> DataFrame:
    """(period, stock, realised): sum of daily returns over each holding window."""
    held = panel.select("stock", "date", "return_1d").join(
        F.broadcast(days.filter(F.col("held_in").isNotNull())), "date")
    return (held.groupBy(F.col("held_in").alias("period"), "stock")
            .agg(F.coalesce(F.sum("return_1d"), F.lit(0.0)).alias("realised")))


def realised_everywhere(panel: DataFrame, days: DataFrame) -> DataFrame:
    """As ``realised`` for every stock of the panel in every period, 0 where it did not trade."""
    last = days.select(F.max("held_in")).scalar()
    frame = (panel.select("stock").distinct()
             .withColumn("period", F.explode(F.sequence(F.lit(1), last))))
    return (frame.join(realised(panel, days), ["period", "stock"], "left")
            .withColumn("realised", F.coalesce("realised", F.lit(0.0))))


# ---- sampled paths: (stock, path, rets ARRAY<DOUBLE>) ------------------------------------------

def compounded(rets: Column, horizon: int) -> Column:
    """Return over the first ``horizon`` days of a path."""
    logs = F.aggregate(F.slice(rets, 1, horizon), F.lit(0.0), lambda a, r: a + log_growth(r))
    return F.expm1(logs)


def horizon_metrics(paths: DataFrame, horizons: list[int], by: list[str] | None = None,
                    rounded: bool = True) -> DataFrame:
    """Per stock and horizon: mean, median, deviation, 10th and 90th percentile, share above 0.

    Horizons longer than the paths are left out. The exact percentiles hold one value per path.
    """
    by = by or ["stock"]
    at = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"),
                 F.when(F.size("rets") >= h, compounded(F.col("rets"), h)).alias("cum"))
        for h in sorted(horizons)])).alias("at")
    cums = paths.select(*by, at).select(*by, "at.horizon", "at.cum").filter(F.col("cum").isNotNull())
    q = F.percentile("cum", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    m = cums.groupBy(*by, "horizon").agg(
        F.avg("cum").alias("mean"), F.stddev_pop("cum").alias("std"), q.alias("q"),
        F.avg(F.when(F.col("cum") > 0, 1.0).otherwise(0.0)).alias("up"))

    def pct(c: Column, places: int) -> Column:
        return half_even(c * 100, places) if rounded else c * 100
    return m.select(*by, "horizon", pct(F.col("mean"), 3).alias("mean_pct"),
                    pct(F.col("q")[1], 3).alias("median_pct"), pct(F.col("std"), 3).alias("std_pct"),
                    pct(F.col("q")[0], 3).alias("p10_pct"), pct(F.col("q")[2], 3).alias("p90_pct"),
                    pct(F.col("up"), 1).alias("prob_up_pct"))


def daily_profile(paths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per day over all paths: median and quartiles, and the compounded median so far."""
    by = by or ["stock"]
    long = paths.select(*by, F.posexplode("rets").alias("day", "ret"))
    q = F.percentile("ret", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    days = long.groupBy(*by, (F.col("day") + 1).alias("day")).agg(q.alias("q"))
    so_far = W.partitionBy(*by).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    med = F.col("q")[1]
    return days.select(*by, "day", (med * 100).alias("daily_median"),
                       (F.col("q")[0] * 100).alias("daily_p25"),
                       (F.col("q")[2] * 100).alias("daily_p75"),
                       (F.expm1(F.sum(log_growth(med)).over(so_far)) * 100).alias("cum_return_pct"))


def expected_return(paths: DataFrame, horizon: int) -> DataFrame:
    """Mean return over the horizon of the paths that are long enough."""
    return (paths.filter(F.size("rets") >= horizon).groupBy("stock")
            .agg(F.avg(compounded(F.col("rets"), horizon)).alias("score")))
