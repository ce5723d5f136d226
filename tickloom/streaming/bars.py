"""Streams of trades and bars: daily bars, stateful returns, keep-last upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tickloom.operators.panel import one_row_per_day
from tickloom.sources.tables import KEEP, PanelTable, in_months
from tickloom.staging import new_folder


def tick_stream(spark: SparkSession, path: str, schema: T.StructType, stock: Column, at: Column,
                price: Column, volume: Column, order_by: list[str],
                name_glob: str | None = None) -> DataFrame:
    """(stock, day, price, quantity, order...) from files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    # midnight of the local day as an instant, so that the day itself is the event time
    day = F.to_date(at).cast("timestamp")
    return reader.parquet(path).select(stock.cast("string").alias("stock"), day.alias("day"),
                                       price.alias("price"), volume.alias("quantity"), *order_by)


def daily_bars(ticks: DataFrame, order_by: list[str], late_by: str = "7 days") -> DataFrame:
    """Tumbling one-day bars; a trade may be late by the overlap of a refresh.

    The day is the grouping key and the event time, so closed days leave the state. Trades are
    combined on the map side, and the state holds one row per stock and open day.
    """
    at = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    source = ticks.withWatermark("day", late_by) if ticks.isStreaming else ticks
    return source.groupBy("stock", "day").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"))


class LastClose(StatefulProcessor):
    """Carries (date, close) per stock; a bar on or before the carried date is ignored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "date date, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # copies of a day are dropped row by row, so at most one row per calendar day is held; there are many stocks
        # of few rows, so nothing but plain lists is made for each
        bars: dict = {}
        for chunk in rows:
            for date, close in zip(chunk["date"].tolist(), chunk["close"].tolist()):
                bars.setdefault(date, close)
        known = self._last.get()            # None where there is no state yet
        days, closes, returns = [], [], []
        for date, close in sorted(bars.items()):
            if known is not None and date <= known[0]:
                continue
            if pd.isna(close):
                r = 0.0 if known is not None else None
                close = known[1] if known is not None else None
            else:
                r = _clipped_return(close, known[1] if known is not None else None)
            days.append(date)
            closes.append(close)
            returns.append(r)
            if close is not None:
                known = (date, close)
        if known is not None:
            self._last.update(known)
        if days:
            yield pd.DataFrame({"stock": [key[0]] * len(days), "date": days, "close": np.array(closes, float),
                                "return_1d": np.array(returns, float)})

    def close(self) -> None:
        pass


def _clipped_return(now: float, before: float | None) -> float | None:
    if before is None:
        return None
    if before == 0:
        return None if now == 0 else (1.0 if now > 0 else -1.0)
    return min(1.0, max(-1.0, now / before - 1))


def stateful_returns(bars: DataFrame) -> DataFrame:
    """(stock, date, close, return_1d) of a bar stream; needs the RocksDB state store.

    Input is one bar per stock and day, so a stock's share of a batch is bounded by its days even
    where it has most of the trades.
    """
    return bars.select("stock", "date", "close").groupBy("stock").transformWithStateInPandas(
        statefulProcessor=LastClose(),
        outputStructType="stock string, date date, close double, return_1d double",
        outputMode="Append", timeMode="None")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def upsert_batch(spark: SparkSession, path: str, arrival: str | None = None, sink: str | None = None,
                 keep: int = KEEP) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: keep-last upsert of a panel table, touching only the batch's months.

    All months of a batch change by one commit, so readers see the panel before the batch or after it, also where
    the write dies between two months. Replaying a batch changes nothing, because rows are keyed by (stock, date);
    with ``sink``, the stream's name, the table's ledger also knows the last batch and passes over what it has.
    Copies inside a batch are settled by the greatest ``arrival``, a number that the batch carries, else by value.
    Every batch is staged over the one before it; of the table the last ``keep`` versions stay.
    """
    batch_folder = new_folder(spark, "sink-batch")
    extra = [arrival] if arrival else []

    def staged(df: DataFrame, folder: str) -> DataFrame:
        df.write.mode("overwrite").parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        table = PanelTable(spark, path)
        begun, state = table.log.state()
        if sink is not None and state.get("batches", {}).get(sink, -1) >= batch_id:
            return
        news = staged(batch, batch_folder)
        month = (F.year("date") * 100 + F.month("date")).alias("month")
        months = [r[0] for r in news.select(month).distinct().collect()]     # calendar months
        if not months:
            return
        first = [-F.col(c) for c in extra]
        merged = one_row_per_day(news, ["stock", "date"], first).drop(*extra).withColumn("newness", F.lit(0))
        stored = table.read(begun) if begun else None
        if stored is not None:
            old = in_months(stored, months).select(*[c for c in news.columns if c not in extra])
            merged = merged.unionByName(old.withColumn("newness", F.lit(1)))
        kept = one_row_per_day(merged, ["stock", "date"], [F.col("newness")]).drop("newness")
        table.replace(kept, begun, (sink, batch_id) if sink is not None else None)
        table.vacuum(keep)
    return write


def run_to_end(stream: DataFrame, out: str, mode: str = "append",
               each_batch: Callable[[DataFrame, int], None] | None = None,
               checkpoint: str | None = None) -> StreamingQuery:
    """Process everything that has landed and stop; progress is kept in the checkpoint folder."""
    checkpoint = checkpoint or new_folder(stream.sparkSession, "stream")
    writer = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
              .option("checkpointLocation", checkpoint))
    if each_batch is not None:
        query = writer.foreachBatch(each_batch).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return query
