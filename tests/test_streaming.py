from __future__ import annotations

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.sources.tables import read_panel
from tickloom.staging import new_folder
from tickloom.streaming.bars import ROCKSDB, LastClose, daily_bars, run_to_end, stateful_returns, upsert_batch

D0 = date(2024, 1, 1)
BAR = "stock string, date date, close double"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def land(spark, folder, rows):
    df = spark.createDataFrame([(s, D0 + timedelta(days=i), c) for s, i, c in rows], BAR)
    df.coalesce(1).write.mode("append").parquet(folder)


def test_last_close_is_carried_and_late_rows_are_ignored(spark, rocksdb):
    landing, out, checkpoint = (new_folder(spark, n) for n in ("land", "out", "cp"))
    batches = [[("a", 0, 10.0), ("b", 0, 0.0), ("a", 1, 11.0), ("a", 1, 11.0)],
               [("a", 1, 99.0), ("a", 0, 99.0), ("a", 3, 22.0), ("b", 1, 5.0)],
               [("b", 2, 0.0), ("b", 3, 0.0), ("a", 4, None), ("a", 5, 88.0)]]
    for rows in batches:
        land(spark, landing, rows)
        run_to_end(stateful_returns(spark.readStream.schema(BAR).parquet(landing)), out, checkpoint=checkpoint)
    got = {(r.stock, (r.date - D0).days): r.return_1d for r in spark.read.parquet(out).collect()}
    assert got == {("a", 0): None, ("a", 1): pytest.approx(0.1), ("a", 3): pytest.approx(1.0), ("a", 4): 0.0,
                   ("a", 5): pytest.approx(1.0), ("b", 0): None, ("b", 1): 1.0, ("b", 2): -1.0, ("b", 3): None}


def test_upsert_stream_can_be_replayed(spark):
    landing, table = new_folder(spark, "land"), new_folder(spark, "table")
    land(spark, landing, [("a", 0, 1.0), ("a", 40, 2.0)])
    stream = spark.readStream.schema(BAR).parquet(landing)
    checkpoint = new_folder(spark, "cp")
    run_to_end(stream, table, each_batch=upsert_batch(spark, table), checkpoint=checkpoint)
    land(spark, landing, [("a", 40, 3.0), ("b", 40, 4.0)])
    run_to_end(stream, table, each_batch=upsert_batch(spark, table), checkpoint=checkpoint)
    want = [("a", 0, 1.0), ("a", 40, 3.0), ("b", 40, 4.0)]
    def stored():
        return sorted((r.stock, (r.date - D0).days, r.close) for r in read_panel(spark, table).collect())
    assert stored() == want
    upsert_batch(spark, table)(spark.createDataFrame([("a", D0 + timedelta(days=40), 3.0)], BAR), 1)
    assert stored() == want


def test_batches_leave_nothing_staged_behind(spark, tmp_path, monkeypatch):
    from tickloom.streaming import bars as module
    monkeypatch.setattr(module, "new_folder", lambda _, label: str(tmp_path / label))
    table = str(tmp_path / "table")
    write = upsert_batch(spark, table, arrival="at")
    for n in range(4):
        rows = [("a", D0 + timedelta(days=n), float(k), k) for k in (2, 3, 1)]
        write(spark.createDataFrame(rows, BAR + ", at int"), n)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sink-batch", "table"]
    assert [r.close for r in read_panel(spark, table).orderBy("date").collect()] == [3.0] * 4


def test_closed_days_are_emitted_once_in_append_mode(spark):
    landing, out, checkpoint = (new_folder(spark, n) for n in ("land", "out", "cp"))
    schema = "stock string, day timestamp, price double, quantity bigint, seq int"
    def tick(rows):
        df = spark.createDataFrame([(s, i, p, 1, q) for s, i, p, q in rows], "stock string, i int, price double, quantity bigint, seq int")
        (df.withColumn("day", F.date_add(F.lit(D0), F.col("i")).cast("timestamp"))
         .select("stock", "day", "price", "quantity", "seq").coalesce(1).write.mode("append").parquet(landing))
    for rows in ([("a", 0, 5.0, 2), ("a", 0, 4.0, 1), ("a", 0, 9.0, 3)], [("a", 20, 1.0, 4)], [("a", 0, 100.0, 5), ("a", 21, 1.0, 6)]):
        tick(rows)
        run_to_end(daily_bars(spark.readStream.schema(schema).parquet(landing), ["seq"]), out, checkpoint=checkpoint)
    got = [tuple(r) for r in spark.read.parquet(out).select("stock", F.to_date("day"), "open", "high", "low", "close", "volume").collect()]
    assert got == [("a", D0, 4.0, 9.0, 4.0, 9.0, 3)]       # the trade 20 days late is dropped


def test_last_close_without_a_frame_for_nothing():
    """One state read a stock, no frame where nothing is new, and the first of a day's copies."""
    class Value:
        def __init__(self, known):
            self.known, self.reads = known, 0

        def get(self):
            self.reads += 1
            return self.known

        def exists(self):
            raise AssertionError("a second read of the state")

        def update(self, known):
            self.known = known

    first, second = date(2024, 1, 1), date(2024, 1, 2)
    keeper = LastClose()
    keeper._last = Value(None)
    chunks = [pd.DataFrame({"date": [second, first], "close": [3.0, 2.0]}), pd.DataFrame({"date": [second], "close": [9.0]})]
    got = pd.concat(keeper.handleInputRows(("a",), iter(chunks), None))
    assert got["close"].tolist() == [2.0, 3.0] and got["return_1d"].tolist()[1] == 0.5 and got["return_1d"].isna()[0]
    assert keeper._last.known == (second, 3.0) and keeper._last.reads == 1
    assert list(keeper.handleInputRows(("a",), iter(chunks), None)) == []
