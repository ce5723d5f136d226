"""As-of join: every row of one table beside the last row of another before it.

Both tables are put in one order of (key, time) and the last state is carried on. The order is cut into ranges, so a
key with a third of all rows is spread over tasks like any other; a range hands its last state of a key to the ranges
behind it through a small table with one row a range and key that ends in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.staging import stage


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, strict: bool = False,
              right_at: str | None = None, prefix: str = "", tasks: int | None = None) -> DataFrame:
    """``left`` with the columns of the last ``right`` row of its key at or before its time (before it, if ``strict``).

    ``right`` is ordered by ``right_at``; its columns but the key get ``prefix``. Of several right rows of one time the
    greatest counts. A left row with a null key or time, or without a row before it, stays with nulls; right rows
    without them are left out. No column of one table may be called like one of the other.
    """
    right_at = right_at or at
    others = [c for c in right.columns if c != key]
    shown = [prefix + c for c in others]
    clash = set(shown) & set(left.columns)
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}: give a prefix")
    # at one time a state comes before the rows that it counts for
    rows = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"),
                       F.struct(*left.columns).alias("_row"))
    states = (right.filter(F.col(key).isNotNull() & F.col(right_at).isNotNull())
              .select(F.col(key).alias("_key"), F.col(right_at).alias("_at"), F.lit(2 if strict else 0).alias("_kind"),
                      F.struct(*[F.col(c).alias(p) for c, p in zip(others, shown)]).alias("_state")))
    both = rows.unionByName(states, allowMissingColumns=True)
    order = ["_key", "_at", "_kind", "_state"]
    spread = both.repartitionByRange(tasks, *order) if tasks else both.repartitionByRange(*order)
    spread = stage(spread.withColumn("_range", F.spark_partition_id()), "asof-order")
    # one row a range and key
    ends = spread.groupBy("_key", "_range").agg(F.max_by("_state", F.when(
        F.col("_state").isNotNull(), F.struct("_at", "_state"))).alias("_end"))
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    handed = stage(ends.select("_key", "_range", F.last("_end", ignorenulls=True).over(before).alias("_handed")), "asof-ends")
    inside = W.partitionBy("_key", "_range").orderBy("_at", "_kind", "_state").rowsBetween(W.unboundedPreceding, 0)
    carried = (spread.withColumn("_last", F.last("_state", ignorenulls=True).over(inside)).filter(F.col("_row").isNotNull())
               .join(handed, ["_key", "_range"], "left"))
    known = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_handed"))
    return carried.withColumn("_state", known).select("_row.*", *[F.col("_state")[c].alias(c) for c in shown])
