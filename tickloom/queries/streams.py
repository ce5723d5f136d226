"""Streams over the events: users stand for stocks, event values for prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.queries.data import table
from tickloom.queries.registry import query, rounded
from tickloom.sources.tables import read_panel, write_panel
from tickloom.staging import new_folder, stage
from tickloom.streaming.bars import (ROCKSDB, daily_bars, run_to_end, stateful_returns, tick_stream,
                                     upsert_batch)

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ORDER = ["ts", "event_id"]

EVENT_BARS_SQL = """
WITH bars AS (
  SELECT CAST(user_id AS VARCHAR) AS stock, CAST(ts AS DATE) AS date,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY ALL)
"""


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return tick_stream(spark, sf, schema, F.col("user_id"), F.col("ts"), F.col("value"),
                       F.lit(1).cast("bigint"), ORDER, name_glob="events.parquet")


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    ticks = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("stock"), F.to_date("ts").cast("timestamp").alias("day"),
        F.col("value").alias("price"), F.lit(1).cast("bigint").alias("quantity"), *ORDER)
    return daily_bars(ticks, ORDER).withColumn("date", F.to_date("day")).drop("day")


@query("stream_daily_bars", EVENT_BARS_SQL + "SELECT * FROM bars")
def stream_daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks to daily bars as a stream; open days reach the table by idempotent upserts."""
    folder = new_folder(spark, "bars")
    stream = (daily_bars(event_ticks(spark, sf), ORDER)
              .withColumn("date", F.to_date("day")).drop("day"))
    run_to_end(stream, folder, "update", upsert_batch(spark, folder))
    return read_panel(spark, folder)


@query("stream_close_returns", EVENT_BARS_SQL + """
SELECT stock, date, close, round(greatest(-1, least(1, CASE
         WHEN lag(close) OVER w = 0 THEN CASE WHEN close > 0 THEN 1.0 WHEN close < 0 THEN -1.0 END
         ELSE close / lag(close) OVER w - 1 END)), 6) + 0.0 AS return_1d
FROM bars WINDOW w AS (PARTITION BY stock ORDER BY date)""".replace(
    "round(greatest(-1, least(1, CASE", "round(CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(-1, least(1, CASE").replace(
    "- 1 END)), 6)", "- 1 END)) END, 6)"))
def stream_close_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Bars land in three parts; the last close of every stock is carried from batch to batch."""
    landing, out = new_folder(spark, "landing"), new_folder(spark, "returns")
    bars = stage(event_bars(spark, sf).select("stock", "date", "close"), "bars")
    cuts = ["0001-01-01", "2024-01-11", "2024-01-21", "9999-12-31"]
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    checkpoint = new_folder(spark, "stream")
    try:
        for lo, hi in zip(cuts, cuts[1:]):
            part = bars.filter((F.col("date") >= F.lit(lo).cast("date")) & (F.col("date") < F.lit(hi).cast("date")))
            part.repartition("stock").write.mode("append").parquet(landing)
            arrived = spark.readStream.schema(bars.schema).parquet(landing)
            run_to_end(stateful_returns(arrived), out, checkpoint=checkpoint)
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return rounded(spark.read.parquet(out), "return_1d")


@query("stream_keep_last", EVENT_BARS_SQL + """,
stacked AS (
  SELECT 0 AS seq, stock, date, close FROM bars WHERE date < DATE '2024-01-20'
  UNION ALL SELECT 1, stock, date, close + 1 FROM bars WHERE date >= DATE '2024-01-13')
SELECT stock, date, close FROM stacked QUALIFY row_number() OVER (PARTITION BY stock, date ORDER BY seq DESC) = 1""")
def stream_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """A stored panel, then a stream that repeats its last week with other prices."""
    folder, landing = new_folder(spark, "panel"), new_folder(spark, "landing")
    bars = stage(event_bars(spark, sf).select("stock", "date", "close"), "bars")
    write_panel(bars.filter(F.col("date") < F.to_date(F.lit("2024-01-20"))), folder)
    late = bars.filter(F.col("date") >= F.to_date(F.lit("2024-01-13")))
    late.withColumn("close", F.col("close") + 1).write.parquet(landing)
    arrived = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    run_to_end(arrived, folder, "append", upsert_batch(spark, folder, sink="late-bars"))
    return read_panel(spark, folder).select("stock", "date", "close")
