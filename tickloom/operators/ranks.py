"""Cross-sectional ranks and top-N, without one task per cross-section.

A cross-section (all stocks of one date) grows with the table and many stocks may share one
score, so ranks are not taken with a window over the rows. Rows are first counted per distinct
score (combined on the map side). The distinct scores are sorted once, into ranges of at most
``PER_TASK`` of them, so the number of tasks grows with the scores; a score's place is the count
of the ranges above it and of the scores above it in its own range. Ranges never cut a score, so
ties are exact across their borders.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.staging import stage

PER_TASK = 200_000              # distinct scores a range
SENT = 1_000_000                # scores that are sent to every executor; more are joined by shuffle,
HOT = 100_000                   # but for those that so many rows share


def average_tie_rank(df: DataFrame, by: list[str], score: str, into: str = "rank",
                     truncate: bool = False, per_task: int = PER_TASK, sent: int = SENT) -> DataFrame:
    """Descending rank where equal scores share their mean rank; NULL scores have none.

    ``truncate`` drops the half that an even number of ties leaves.
    """
    on = [*by, score]
    values = df.filter(F.col(score).isNotNull()).groupBy(*on).agg(F.count("*").alias("_ties"))
    values = stage(values, "scores")
    n = values.count()
    if n > per_task:
        ranged = stage(values.repartitionByRange(ceil(n / per_task), *by, F.desc(score))
                       .withColumn("_range", F.spark_partition_id()), "ranged-scores")
    else:
        ranged = values.withColumn("_range", F.lit(0))
    inside = W.partitionBy(*by, "_range").orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    places = ranged.withColumn("_above", F.coalesce(F.sum("_ties").over(inside), F.lit(0)))
    if n > per_task:
        # one row a range, and one more for each cross-section that ends in it
        earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        offsets = (ranged.groupBy(*by, "_range").agg(F.sum("_ties").alias("_total"))
                   .select(*by, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")))
        places = (places.join(stage(offsets, "range-offsets"), [*by, "_range"])
                  .withColumn("_above", F.col("_above") + F.col("_before")))
    rank = F.col("_above") + (F.col("_ties") + 1) / 2
    rank = F.floor(rank).cast("int") if truncate else rank.cast("double")
    places = places.select(*on, "_ties", rank.alias(into))
    if n <= sent:
        return df.join(F.broadcast(places.drop("_ties")), on, "left").select(*df.columns, into)
    places = stage(places, "places")
    hot = F.broadcast(places.filter(F.col("_ties") >= HOT).drop("_ties"))       # at most rows / HOT
    rest = df.join(hot, on, "left_anti").join(places.filter(F.col("_ties") < HOT).drop("_ties"), on, "left")
    return df.join(hot, on).select(*df.columns, into).unionByName(rest.select(*df.columns, into))


def legs(scores: DataFrame, by: str = "period", score: str = "score", top_pct: float = 10) -> DataFrame:
    """Members of the long and the short leg of every period.

    Each leg aims at k = max(1, floor(n * pct / 100)) stocks; ties at the border make it larger
    or smaller.
    """
    sizes = scores.groupBy(by).agg(F.count("*").alias("n"))          # one row a period
    ranked = average_tie_rank(scores, [by], score, "place").join(F.broadcast(sizes), by)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * top_pct / 100))
    leg = F.array_compact(F.array(
        F.when(F.col("place") <= k, F.lit("long")),
        F.when(F.col("place") > F.col("n") - k, F.lit("short"))))
    return ranked.select(by, "stock", score, F.explode(leg).alias("leg"))


def top_n(ranked: DataFrame, n: int, rank: str = "composite_rank", worst: bool = False) -> DataFrame:
    """Best (or worst) n rows; equal ranks in stock order. A distributed top-k, no full sort."""
    first = F.desc(rank) if worst else F.asc(rank)
    return ranked.filter(F.col(rank).isNotNull()).orderBy(first, "stock").limit(n)


def display(ranked: DataFrame, n: int, columns: list[str], worst: bool = False) -> DataFrame:
    """Top or bottom candidates with those of the display columns that exist."""
    return top_n(ranked, n, worst=worst).select(*[c for c in columns if c in ranked.columns])
