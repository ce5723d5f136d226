"""Filters, casts and profiles over instrument and bar tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.scalar import half_even, null_if_nan, whole_volume, winsorise
from tickloom.schema import PRICES


def listed_instruments(master: DataFrame, exchange: str = "NSE", suffix: str = "-EQ") -> DataFrame:
    """Cash-equity rows of an instrument master, with the suffix removed wherever it occurs."""
    keep = ((F.col("exch_seg") == exchange) & (F.col("instrumenttype") == "")
            & F.col("symbol").endswith(suffix))
    return (master.filter(keep)
            .select("token", "symbol", "name", "exch_seg")
            .withColumn("clean_symbol", F.replace("symbol", F.lit(suffix), F.lit(""))))


def coerce(df: DataFrame, columns: list[str], to: str = "double") -> DataFrame:
    """Unparsable text becomes NULL; so does a parsed NaN."""
    value = {c: F.col(c).try_cast(to) for c in columns}
    if to in ("double", "float"):
        value = {c: null_if_nan(v) for c, v in value.items()}
    return df.withColumns(value)


def drop_empty(df: DataFrame, columns: list[str], how: str = "all") -> DataFrame:
    return df.na.drop(how, subset=columns)


def to_day(df: DataFrame, column: str, into: str = "date") -> DataFrame:
    return df.withColumn(into, F.to_date(column))


def clip_column(df: DataFrame, column: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    return df.withColumn(column, winsorise(F.col(column), low, high))


def count_outside(df: DataFrame, column: str, bound: float = 1.0, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count_if(F.abs(column) > bound).alias("n_outside"))


def canonical(panel: DataFrame, price_places: int = 4, return_places: int = 6) -> DataFrame:
    """Stored form of the panel: half-even rounding, missing volume as 0, whole volume."""
    return panel.withColumns({
        **{c: half_even(F.col(c), price_places) for c in PRICES},
        "return_1d": half_even(F.col("return_1d"), return_places),
        "volume": whole_volume(F.col("volume")),
    })


def between_dates(df: DataFrame, since: date | Column | None = None, before: date | Column | None = None,
                  after: date | Column | None = None, column: str = "date") -> DataFrame:
    """Restrict to ``since <= column``, ``column < before`` and ``column > after``."""
    if since is not None:
        df = df.filter(F.col(column) >= since)
    if after is not None:
        df = df.filter(F.col(column) > after)
    if before is not None:
        df = df.filter(F.col(column) < before)
    return df


def look_back(df: DataFrame, as_of: date | Column, years: int = 5, column: str = "date") -> DataFrame:
    """The last ``365 * years`` days up to ``as_of``."""
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.filter((F.col(column) >= F.date_sub(end, 365 * years)) & (F.col(column) <= end))


def known_only(df: DataFrame, known: DataFrame, on: str | list[str] = "stock") -> DataFrame:
    return df.join(known, on, "left_semi")


def exchange_ticker(df: DataFrame, column: str = "stock", suffix: str = ".NS") -> DataFrame:
    return df.withColumn("ticker", F.concat(F.col(column), F.lit(suffix)))


def profile(panel: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: size, extent and the missing share of the stocks x dates matrix.

    ``approximate`` counts distinct stocks and dates with a sketch, in one pass without a shuffle
    of the keys.

    The mean of per-stock missing shares equals one minus filled cells over all cells, because
    every stock spans the same dates; so no dense matrix is needed.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    cells = F.col("n_stocks") * F.col("n_dates")
    return (panel.agg(F.count("*").alias("n_rows"),
                      distinct("stock").alias("n_stocks"),
                      distinct("date").alias("n_dates"),
                      F.min("date").alias("first_date"),
                      F.max("date").alias("last_date"),
                      F.count("return_1d").alias("n_filled"))
            .withColumn("null_fraction", 1 - F.try_divide(F.col("n_filled"), cells)))


def data_lag(panel: DataFrame, today: date | Column, warn_after: int = 3) -> DataFrame:
    end = today if isinstance(today, Column) else F.lit(today)
    return (panel.agg(F.max("date").alias("last_date"))
            .withColumn("lag_days", F.datediff(end, F.col("last_date")))
            .withColumn("stale", F.col("lag_days") > warn_after))


def absent_instruments(instruments: DataFrame, landed: DataFrame, on: str = "stock") -> DataFrame:
    """Instruments that no landed row covers (the failed list of an ingest)."""
    return instruments.join(landed, on, "left_anti")
