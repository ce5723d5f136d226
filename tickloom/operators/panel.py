"""Panel construction: returns, de-duplication, unions, gap filling, upserts.

After ``one_row_per_day`` a (stock, date) pair is unique, so a window partitioned by stock
holds at most one row per calendar day however large the table is. Everything that may meet
many copies of one pair (``one_row_per_day``, ``bars_from_ticks``, ``upsert``) is an
aggregation instead, which combines copies on the map side before any shuffle.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scalar import ratio_return, winsorise
from tickloom.operators.clean import canonical
from tickloom.schema import PANEL_COLUMNS


def bars_from_ticks(ticks: DataFrame, order_by: list[str], price: str = "price",
                    volume: str = "quantity", combine: bool = True) -> DataFrame:
    """Daily open/high/low/close/volume per (stock, date) from single trades.

    ``combine=False`` is for trades of which few share a (stock, date). To combine them first would sort each task's
    whole input and send more than it saves; they are sent as they are instead, spread by (stock, date).
    """
    at = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    if not combine:
        ticks = ticks.select("stock", "date", *dict.fromkeys([price, volume, *order_by])).repartition("stock", "date")
    return ticks.groupBy("stock", "date").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        F.sum(volume).alias("volume"))


def one_row_per_day(df: DataFrame, keys: list[str], prefer: list[Column]) -> DataFrame:
    """Keep, for every key, the row that sorts first by ``prefer`` and then by all its values."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[p.alias(f"_prefer_{i}") for i, p in enumerate(prefer)], *rest)
    picked = df.groupBy(*keys).agg(F.min(row).alias("kept"))       # one struct is order and row
    return picked.select(*keys, *[F.col("kept")[c].alias(c) for c in rest]).select(*df.columns)


def with_return(df: DataFrame, series: list[str], fill: str = "pad", clip: bool = True,
                price: str = "close", into: str = "return_1d") -> DataFrame:
    """Simple return to the previous row of the series; the first row has none.

    ``fill='pad'`` carries the last known price over missing ones, ``'none'`` does not.
    """
    by_date = W.partitionBy(*series).orderBy("date")
    if fill == "pad":
        before = F.last(price, ignorenulls=True).over(by_date.rowsBetween(W.unboundedPreceding, -1))
        now = F.coalesce(F.col(price), before)
    elif fill == "none":
        before, now = F.lag(price).over(by_date), F.col(price)
    else:
        raise ValueError("fill is 'pad' or 'none'")
    r = ratio_return(now, before)
    return df.withColumn(into, winsorise(r) if clip else r)


def long_enough(df: DataFrame, min_obs: int, by: list[str] | None = None,
                value: str | None = None) -> DataFrame:
    """Rows of the series that have at least ``min_obs`` rows (or non-null values)."""
    by = by or ["stock"]
    n = F.count(F.col(value) if value else F.lit(1)).over(W.partitionBy(*by))
    return df.withColumn("n_obs", n).filter(F.col("n_obs") >= min_obs).drop("n_obs")


def too_short(df: DataFrame, min_obs: int) -> DataFrame:
    return df.groupBy("stock").agg(F.count("*").alias("n_obs")).filter(F.col("n_obs") < min_obs)


def merge_sources(older: DataFrame, newer: DataFrame, cutoff: date, min_obs: int = 50,
                  fill: str = "pad") -> DataFrame:
    """One panel from two bar tables ``(date, stock, open, high, low, close, volume)``.

    Returns are taken inside each source, so none spans the seam. The older source is cut at
    ``cutoff`` only after its returns are known, and wins where both have a day.
    """
    both = (older.withColumn("priority", F.lit(0))
            .unionByName(newer.withColumn("priority", F.lit(1))))
    single = one_row_per_day(both, ["priority", "stock", "date"], [])
    # unique per day from here on, so one partitioning by stock serves all that follows
    returned = with_return(single.repartition("stock"), ["priority", "stock"], fill)
    usable = returned.filter((F.col("priority") == 1) | (F.col("date") < F.lit(cutoff)))
    joined = one_row_per_day(usable, ["stock", "date"], [F.col("priority")])
    kept = long_enough(joined.na.drop(subset=["return_1d"]), min_obs)
    return canonical(kept).select(PANEL_COLUMNS)


def choose_source(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """All of ``primary``, and ``fallback`` only for stocks on which primary gave nothing."""
    answered = primary.select("stock").distinct()
    return primary.unionByName(fallback.join(answered, "stock", "left_anti"))


def fresh_rows(batch: DataFrame, panel: DataFrame, watermark: str = "global",
               overlap_days: int = 7, fill: str = "pad", known_only: bool = True) -> DataFrame:
    """Bars of a batch that are news to the panel, with their returns.

    Rows back to ``overlap_days`` before the watermark only seed the first return. The watermark
    is the latest date of the whole panel, or of each stock. Stocks that the panel does not know
    are left out, or with ``known_only=False`` let in: after the panel's date, or from their first.
    """
    last = panel.groupBy("stock").agg(F.max("date").alias("seen"))
    if watermark == "global":
        seen = batch.join(last, "stock", "left_semi") if known_only else batch
        seen = seen.withColumn("seen", panel.select(F.max("date")).scalar())
    elif watermark == "per_stock":
        seen = batch.join(last, "stock", "inner" if known_only else "left")
        seen = seen.withColumn("seen", F.coalesce("seen", F.lit("0001-01-01").cast("date")))
    else:
        raise ValueError("watermark is 'global' or 'per_stock'")
    window = seen.filter(F.col("date") >= F.date_sub("seen", overlap_days))
    single = one_row_per_day(window, ["stock", "date"], [])
    returned = with_return(single, ["stock"], fill)
    news = returned.filter((F.col("date") > F.col("seen")) & F.col("return_1d").isNotNull())
    return canonical(news).select(PANEL_COLUMNS)


def upsert(panel: DataFrame, *batches: DataFrame, arrival: str | None = None) -> DataFrame:
    """Union keyed by (stock, date); a later batch replaces earlier rows. Idempotent.

    Inside a batch the greatest ``arrival`` wins, a number that the batches carry; without it, or
    between equal ones, the least values.
    """
    stacked = panel.withColumn("batch_seq", F.lit(0))
    if arrival:
        stacked = stacked.withColumn(arrival, F.lit(None).cast(batches[0].schema[arrival].dataType))
    for i, b in enumerate(batches, 1):
        stacked = stacked.unionByName(b.withColumn("batch_seq", F.lit(i)))
    latest = [-F.col("batch_seq")] + ([-F.col(arrival)] if arrival else [])
    newest = one_row_per_day(stacked, ["stock", "date"], latest)
    return newest.drop("batch_seq", *([arrival] if arrival else []))


def _filled(panel: DataFrame, calendar: DataFrame, price: str) -> DataFrame:
    """``gap_filled`` with ``before`` and ``padded_before``, the two prices one position earlier.

    They are known where a row is repeated: inside its span the price before is its own, at the span's start that of the
    row before. So the repeated rows, many times the table, need not be ordered again.
    """
    at = panel.join(F.broadcast(calendar), "date").select("stock", "pos", price)
    by_pos = W.partitionBy("stock").orderBy("pos")
    end = calendar.select(F.max("pos")).scalar()
    first = F.row_number().over(by_pos) == 1
    upto = F.last(price, ignorenulls=True).over(by_pos.rowsBetween(W.unboundedPreceding, 0))
    spans = at.select(
        "stock", F.col("pos").alias("row_pos"), price, upto.alias("known"),
        F.last(price, ignorenulls=True).over(by_pos.rowsBetween(W.unboundedPreceding, -1)).alias("known_before"),
        F.when(F.lag("pos").over(by_pos) == F.col("pos") - 1, F.lag(price).over(by_pos)).alias("next_to"),
        F.sequence(F.when(first, F.lit(1)).otherwise(F.col("pos")),
                   F.coalesce(F.lead("pos").over(by_pos) - 1, end)).alias("covers"))
    filled = spans.select("*", F.explode("covers").alias("pos"))
    here, later = F.col("pos") == F.col("row_pos"), F.col("pos") > F.col("row_pos")
    return filled.select(
        "stock", "pos", here.alias("observed"),
        F.when(here, F.col(price)).alias(price),
        F.when(here | later, F.col("known")).alias("padded"),
        F.when(here, F.col("next_to")).when(F.col("pos") == F.col("row_pos") + 1, F.col(price)).alias("before"),
        F.when(here, F.col("known_before")).when(later, F.col("known")).alias("padded_before"))


def gap_filled(panel: DataFrame, calendar: DataFrame, price: str = "close") -> DataFrame:
    """(stock, pos, observed, price) for every stock on every calendar position.

    The dense matrix without a cross product: each row is repeated up to the position before the
    stock's next row, and the first row also covers the empty positions that lead up to it.
    ``price`` keeps only what was observed on the day; ``padded`` carries the last one on.
    """
    return _filled(panel, calendar, price).select("stock", "pos", "observed", price, "padded")


def calendar_returns(panel: DataFrame, calendar: DataFrame, fill: str = "pad") -> DataFrame:
    """Return matrix on the common calendar in long form, first date dropped.

    Every stock has a value on every later date: 0 on padded days, NULL before its first bar.
    """
    grid = _filled(panel, calendar, "close")
    now, before = ("padded", "padded_before") if fill == "pad" else ("close", "before")
    r = ratio_return(F.col(now), F.col(before))
    return (grid.withColumn("return_1d", r).filter(F.col("pos") > 1)
            .join(F.broadcast(calendar), "pos").select("date", "stock", "return_1d"))


def to_wide(panel: DataFrame, stocks: list[str], value: str = "return_1d") -> DataFrame:
    """One column per named stock. For a short list only; the engine itself stays long.

    A stock that the list lacks raises an error, so that no column is left out unnoticed.
    """
    known = F.when(F.col("stock").isNull() | F.col("stock").isin(stocks), F.col("stock")).otherwise(
        F.raise_error(F.concat(F.lit("no column for stock "), F.col("stock"))).cast("string"))
    return panel.withColumn("stock", known).groupBy("date").pivot("stock", stocks).agg(F.first(value, ignorenulls=True))


def to_long(wide: DataFrame, value: str = "return_1d") -> DataFrame:
    stocks = [c for c in wide.columns if c != "date"]
    return wide.unpivot("date", stocks, "stock", value).filter(F.col(value).isNotNull())


def stack_wide(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Rows of two wide tables; a stock that only one of them has is NULL in the other's rows."""
    return older.unionByName(newer, allowMissingColumns=True)
