from __future__ import annotations

import threading
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.plans import refresh as refresh_module
from tickloom.plans.refresh import ingest
from tickloom.sources.commits import CommitConflict, CommitLog
from tickloom.sources.tables import PanelTable, read_panel, stored_panel, write_panel
from tickloom.staging import new_folder
from tickloom.streaming.bars import upsert_batch

D0 = date(2024, 1, 1)
BAR = "stock string, date date, close double"


def bars(spark, rows):
    return spark.createDataFrame([(s, D0 + timedelta(days=i), float(c)) for s, i, c in rows], BAR)


def content(df):
    return sorted((r.stock, (r.date - D0).days, r.close) for r in df.collect())


@pytest.fixture
def table(spark):
    path = new_folder(spark, "panel")
    write_panel(bars(spark, [("a", 0, 1), ("a", 40, 2), ("b", 80, 3)]), path)
    return path


OLD = [("a", 0, 1.0), ("a", 40, 2.0), ("b", 80, 3.0)]
NEW = [("a", 0, 5.0), ("a", 40, 6.0), ("b", 80, 3.0)]


def test_a_reader_during_an_upsert_sees_the_old_panel_whole(spark, table, monkeypatch):
    seen = []
    plain = CommitLog.commit

    def commit(self, after, state):
        seen.append(content(read_panel(spark, table)))
        early = read_panel(spark, table)
        done = plain(self, after, state)
        seen.append(content(read_panel(spark, table)))
        seen.append(content(early))         # planned before, read after
        return done
    monkeypatch.setattr(CommitLog, "commit", commit)
    upsert_batch(spark, table)(bars(spark, [("a", 0, 5), ("a", 40, 6)]), 0)
    assert seen == [OLD, NEW, OLD]
    assert content(read_panel(spark, table, version=1)) == OLD


def test_a_writer_that_dies_leaves_the_old_panel(spark, table, monkeypatch):
    def dies(self, after, state):
        raise OSError("gone")
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", dies)
        with pytest.raises(OSError):
            upsert_batch(spark, table, sink="s")(bars(spark, [("a", 0, 5), ("a", 40, 6)]), 0)
    assert content(read_panel(spark, table)) == OLD
    assert PanelTable(spark, table).batch_of("s") is None
    upsert_batch(spark, table, sink="s")(bars(spark, [("a", 0, 5), ("a", 40, 6)]), 0)
    assert content(read_panel(spark, table)) == NEW


def test_a_write_that_dies_between_two_months(spark, table):
    """A row whose month cannot be written, after one that can."""
    bad = bars(spark, [("a", 0, 5), ("a", 40, 6)]).withColumn(
        "close", F.when(F.month("date") == 2, F.raise_error(F.lit("disk full")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception):
        PanelTable(spark, table).replace(bad)
    assert content(read_panel(spark, table)) == OLD


def test_the_ledger_passes_over_batches_that_it_has(spark, table):
    write = upsert_batch(spark, table, sink="s")
    write(bars(spark, [("a", 0, 5)]), 7)
    write(bars(spark, [("a", 0, 99)]), 7)
    write(bars(spark, [("a", 0, 98)]), 6)
    assert content(read_panel(spark, table))[0] == ("a", 0, 5.0) and PanelTable(spark, table).batch_of("s") == 7
    upsert_batch(spark, table, sink="other")(bars(spark, [("a", 0, 97)]), 0)
    assert content(read_panel(spark, table))[0] == ("a", 0, 97.0) and PanelTable(spark, table).batch_of("s") == 7


def test_two_writers(spark, table):
    """From one version: other months are joined, the same month raises and loses nothing."""
    t = PanelTable(spark, table)
    begun, _ = t.log.state()
    t.replace(bars(spark, [("a", 0, 5)]), begun)
    t.replace(bars(spark, [("a", 40, 6)]), begun)
    assert content(read_panel(spark, table)) == NEW
    with pytest.raises(CommitConflict):
        t.replace(bars(spark, [("a", 0, 7)]), begun)
    assert content(read_panel(spark, table)) == NEW


def test_only_one_of_many_writers_gets_a_number(spark):
    log, won = CommitLog(spark, new_folder(spark, "log")), []

    def write(i):
        try:
            won.append(log.commit(0, {"writer": i}))
        except CommitConflict:
            pass
    writers = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert won and set(won) == {1} and log.versions() == [1] and log.state()[1]["writer"] in range(8)


def test_old_versions_go(spark, table):
    t = PanelTable(spark, table)
    write = upsert_batch(spark, table, keep=2)
    for i in range(5):
        write(bars(spark, [("a", 0, i)]), i)
    assert len(t.log.versions()) == 2
    assert content(t.read()) == [("a", 0, 4.0), *OLD[1:]] and content(t.read(t.log.versions()[0])) == [("a", 0, 3.0), *OLD[1:]]
    # the first version still holds two of the months
    assert len([n for n in t.log.names() if n.startswith("v=")]) == 3


def test_last_days(spark, table):
    t = PanelTable(spark, table)
    assert sorted(map(tuple, t.last_days().collect())) == [("a", D0 + timedelta(days=40)), ("b", D0 + timedelta(days=80))]
    t.replace(bars(spark, [("c", 41, 1)]))         # February without a: its last day is in January
    assert sorted(map(tuple, t.last_days().collect())) == [
        ("a", D0), ("b", D0 + timedelta(days=80)), ("c", D0 + timedelta(days=41))]


def test_an_empty_write(spark):
    path = new_folder(spark, "panel")
    write_panel(bars(spark, []), path)
    assert stored_panel(spark, path) is None
    with pytest.raises(FileNotFoundError):
        read_panel(spark, path)


def land(spark, folder, name, rows):
    (bars(spark, rows).select(F.col("date").cast("string").alias("datetime"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")],
                              F.lit(1.0).alias("volume"), F.col("stock").alias("symbol"))
     .coalesce(1).write.csv(f"{folder}/{name}", header=True))


def test_ingest_takes_every_file_once(spark, monkeypatch):
    landing, path = new_folder(spark, "landing"), new_folder(spark, "panel")
    land(spark, landing, "one", [("a", 0, 1), ("a", 40, 2)])
    assert ingest(spark, path, landing).count() == 1
    assert ingest(spark, path, landing).count() == 0
    land(spark, landing, "two", [("a", 40, 9), ("b", 3, 4)])
    land(spark, landing, "three", [("b", 4, 5)])
    want = [("a", 0, 1.0), ("a", 40, 2.0)]
    assert content(read_panel(spark, path)) == want

    def dies(self, after, state):
        raise OSError("gone")
    with monkeypatch.context() as m:        # rows and ledger are written, the commit is not
        m.setattr(CommitLog, "commit", dies)
        with pytest.raises(OSError):
            ingest(spark, path, landing)
    assert content(read_panel(spark, path)) == want
    assert PanelTable(spark, path).ingested().count() == 1
    assert ingest(spark, path, landing, most=1).count() == 1
    assert ingest(spark, path, landing).count() == 1
    assert ingest(spark, path, landing).count() == 0
    assert content(read_panel(spark, path)) == [("a", 0, 1.0), ("a", 40, 9.0), ("b", 3, 4.0), ("b", 4, 5.0)]
    assert PanelTable(spark, path).ingested().count() == 3


def test_two_ingests_at_once(spark, monkeypatch):
    """The one that commits second raises; its files are then known."""
    landing, path = new_folder(spark, "landing"), new_folder(spark, "panel")
    land(spark, landing, "one", [("a", 0, 1)])
    plain = refresh_module.one_row_per_day

    def overtaken(*args):
        monkeypatch.setattr(refresh_module, "one_row_per_day", plain)
        ingest(spark, path, landing)
        return plain(*args)
    monkeypatch.setattr(refresh_module, "one_row_per_day", overtaken)
    with pytest.raises(CommitConflict):
        ingest(spark, path, landing)
    assert ingest(spark, path, landing).count() == 0 and content(read_panel(spark, path)) == [("a", 0, 1.0)]
