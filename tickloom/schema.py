"""Table layouts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]
PANEL_COLUMNS = ["date", "stock", *PRICES, "volume", "return_1d"]

PANEL = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("stock", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in PRICES],
    T.StructField("volume", T.LongType()),
    T.StructField("return_1d", T.DoubleType()),
])

INSTRUMENT = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("token", "symbol", "name", "exch_seg", "instrumenttype")
])

BAR_FILE = T.StructType([
    T.StructField("datetime", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in PRICES],
    T.StructField("volume", T.DoubleType()),
    T.StructField("symbol", T.StringType()),
])
