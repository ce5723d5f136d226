"""Per-stock windows. (stock, date) is unique here, so a partition is at most one row a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.scalar import log_growth, ratio_return


def last_rows(df: DataFrame, n: int, by: str = "stock", order: str = "date") -> DataFrame:
    """The last n rows per key. Spark keeps only n per key and task before it shuffles."""
    newest = W.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)


def chart_rows(panel: DataFrame, tail: int = 180, window: int = 20, min_rows: int = 30) -> DataFrame:
    """Price chart rows: tail of each stock with a moving average and signed return bars.

    The average is empty until ``window`` rows of the tail are there. Stocks with ``min_rows``
    rows or fewer have no chart.
    """
    by_date = W.partitionBy("stock").orderBy("date")
    newest = W.partitionBy("stock").orderBy(F.desc("date"))
    cut = (panel.withColumn("age", F.row_number().over(newest))
           .withColumn("n_rows", F.count("*").over(W.partitionBy("stock")))
           .filter((F.col("age") <= tail) & (F.col("n_rows") > min_rows)))
    rolling = by_date.rowsBetween(1 - window, 0)
    shown = F.coalesce(F.col("return_1d"), ratio_return(F.col("close"), F.lag("close").over(by_date)))
    return cut.select(
        "stock", "date", "open", "high", "low", "close",
        F.when(F.count("close").over(rolling) == window, F.avg("close").over(rolling)).alias("ma"),
        (shown * 100).alias("bar_pct"),
        F.when(shown >= 0, "up").otherwise("down").alias("bar_side"),
        F.when(F.col("close") >= F.col("open"), "up").otherwise("down").alias("candle"))


def equity_curve(returns: DataFrame, by: str = "label", order: str = "date",
                 value: str = "ret") -> DataFrame:
    """Running growth, its running peak (from the first value on) and the drawdown.

    One row per period of a label, so partitions are bounded by the number of periods.
    """
    so_far = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (returns.filter(F.col(value).isNotNull())
            .withColumn("growth", F.product(1 + F.col(value)).over(so_far))
            .withColumn("peak", F.max("growth").over(so_far))
            .withColumn("drawdown", (F.col("growth") - F.col("peak")) / F.col("peak")))


def running_growth(df: DataFrame, by: list[str], order: str, value: str, into: str) -> DataFrame:
    so_far = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(into, F.expm1(F.sum(log_growth(F.col(value))).over(so_far)))
