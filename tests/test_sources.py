from __future__ import annotations

import json
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tickloom.operators.clean import listed_instruments
from tickloom.sources import landed as L, tables as T
from tickloom.staging import many_files

GOOD = "Date,Open,High,Low,Close,Volume\n2019-01-01,1,2,0.5,1.5,10\n2019-01-02 00:00:00+05:30,1,2,0.5,1.6,11\n"


def write(folder, name, text):
    (folder / name).write_text(text)


def test_dirty_files(spark, tmp_path):
    write(tmp_path, "PLAIN.csv", GOOD)
    write(tmp_path, "JUNK.csv", "Price,Close ,High,Low,Open,Volume\nTicker,J.NS,J.NS,J.NS,J.NS,J.NS\nDate,,,,,\n"
                                "2019-01-01,1.5,2,0.5,1,10\n2019-01-02,,,,,\n2019-01-03,oops,2,0.5,1,NaN\n")
    write(tmp_path, "BOTH.csv", "date,open,high,low,adj close,Close,volume\n2019-01-01,1,2,0.5,99,1.5,10\n")
    write(tmp_path, "ADJ.csv", "date,open,high,low,Adj Close,volume\r\n2019-01-01,1,2,0.5,7,10\r\n")
    write(tmp_path, "LACKS.csv", "Date,Open,High,Low,Close\n2019-01-01,1,2,0.5,1.5\n")
    rows = {(r.stock, r.date): r for r in L.read_dirty_bar_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {("PLAIN", date(2019, 1, 1)), ("PLAIN", date(2019, 1, 2)), ("JUNK", date(2019, 1, 1)),
                         ("JUNK", date(2019, 1, 3)), ("BOTH", date(2019, 1, 1)), ("ADJ", date(2019, 1, 1))}
    assert rows["BOTH", date(2019, 1, 1)].close == 1.5 and rows["ADJ", date(2019, 1, 1)].close == 7.0
    odd = rows["JUNK", date(2019, 1, 3)]
    assert odd.close is None and odd.volume is None and odd.open == 1.0


def test_dirty_files_of_one_name_keep_their_own_header_and_quoted_cells(spark, tmp_path):
    for folder, text in (("a", "Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,3,4,5\n"),
                         ("b", 'Date,Volume,Close,Low,High,Open\n2020-01-02,5,4,3,2,1\n2020-01-03,5,4,3,2,"1,000.5"\n'
                               '2020-01-04," 5 ","4",3,2,""\n')):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder, "X.csv", text)
    got = L.read_dirty_bar_files(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [
        (1, 2, 3, 4, 5), (1, 2, 3, 4, 5), (None, 2, 3, 4, 5), (None, 2, 3, 4, 5)]


def test_the_name_is_taken_once_a_file(spark, tmp_path, monkeypatch):
    """Not once a line: names come with the headers. Rows with letters and returns are read as before."""
    write(tmp_path, "A.csv", "Date,Open,High,Low,Close,Volume\r\n2020-01-01,1E3,2,3,4,5\r\n2020-01-02,none,2,3,4,5\n")
    staged = []
    monkeypatch.setattr(L, "stage", lambda df, label, write=L.stage: staged.append(df.columns) or write(df, label))
    got = L.read_dirty_bar_files(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.stock, r.open, r.volume) for r in got] == [("A", 1000.0, 5.0), ("A", None, 5.0)]
    assert [c[:2] for c in staged] == [["file", "stock"]]


def test_many_small_files_on_a_local_disk(spark, tmp_path):
    """A file a key and nothing beside it; every file that is made on a local disk starts a process."""
    folder = str(tmp_path / "out")
    rows = [(str(i % 5), f"line {i}") for i in range(20)]
    (spark.createDataFrame(rows, "stock string, value string").repartition("stock")
     .write.partitionBy("stock").options(**many_files(spark, folder)).text(folder))
    files = [f for f in (tmp_path / "out").rglob("*") if f.is_file() and f.parent != tmp_path / "out"]
    assert len(files) == 5 and all(f.name.endswith(".txt") for f in files)
    assert sorted((r.stock, r.value) for r in spark.read.schema("value string, stock string").text(folder).collect()) == sorted(rows)


def test_clean_files_in_another_order_fail(spark, tmp_path):
    write(tmp_path, "AAA.csv", "datetime,close,high,low,open,volume,symbol\n2021-02-03,1,2,3,4,5,A\n")
    with pytest.raises(Exception):
        L.read_bar_files(spark, str(tmp_path)).collect()


def test_clean_files_take_the_name_from_the_file(spark, tmp_path):
    write(tmp_path, "AAA.csv", "datetime,open,high,low,close,volume,symbol\n2021-02-03,1,1,1,NaN,5,\n")
    write(tmp_path, "BBB.csv", "datetime,open,high,low,close,volume,symbol\n2021-02-03T00:00:00,1,1,1,2,5,REAL\n")
    got = {r.stock: (r.date, r.close) for r in L.read_bar_files(spark, str(tmp_path)).collect()}
    assert got == {"AAA": (date(2021, 2, 3), None), "REAL": (date(2021, 2, 3), 2.0)}


def test_instrument_master(spark, tmp_path):
    base = {"name": "n", "exch_seg": "NSE", "instrumenttype": ""}
    records = [{"token": "1", "symbol": "X-EQ-EQ", **base}, {"token": "2", "symbol": "Y-BE", **base},
               {"token": "3", "symbol": "Z-EQ", **base, "exch_seg": "BSE"},
               {"token": "4", "symbol": "W-EQ", **base, "instrumenttype": "FUT"}]
    write(tmp_path, "master.json", json.dumps(records, indent=1))
    got = listed_instruments(L.read_instruments(spark, str(tmp_path / "master.json"))).collect()
    assert [(r.token, r.clean_symbol) for r in got] == [("1", "X")]


def test_layout_detection():
    assert L.is_long(["date", "Stock", "Return_1d"])
    assert not L.is_long(["date", "AAA", "BBB"])


def test_panel_table_replaces_only_its_months(spark, tmp_path, capsys):
    path = str(tmp_path / "panel")
    def rows(close, *days):
        return spark.createDataFrame([(d, "a", close) for d in days], "date date, stock string, close double")
    jan, feb = date(2020, 1, 5), date(2020, 2, 5)
    T.write_panel(rows(1.0, jan, feb), path)
    T.write_panel(rows(2.0, feb), path)
    assert sorted((r.date, r.close) for r in T.read_panel(spark, path).collect()) == [(jan, 1.0), (feb, 2.0)]
    late = T.read_panel(spark, path, since=date(2020, 2, 1))
    assert [r.date for r in late.collect()] == [feb]
    late.explain("formatted")
    assert re.search(r"PartitionFilters: \[.*year.*month", capsys.readouterr().out)
    T.stock_history(late, "a").explain("formatted")
    assert "EqualTo(stock,a)" in capsys.readouterr().out


def test_latest_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    for d, v in ((date(2020, 1, 1), 1), (date(2020, 1, 3), 2), (date(2020, 1, 3), 3)):
        T.write_snapshot(spark.createDataFrame([(v,)], "v int"), path, d)
    latest = T.latest_snapshot(spark, path)
    assert [(r.v, r.as_of) for r in latest.collect()] == [(3, date(2020, 1, 3))]
    assert spark.read.parquet(path).count() == 2
    assert {f.split("/")[-2] for f in latest.inputFiles()} == {"as_of=2020-01-03"}
    for folder in tmp_path.glob("snap/as_of=2020-01-01"):       # the other folder is not opened
        for f in folder.glob("*.parquet"):
            f.write_bytes(b"broken")
    assert T.latest_snapshot(spark, path).first().v == 3


def test_latest_of_numbered_snapshots(spark, tmp_path):
    path = str(tmp_path / "runs")
    for n in (9, 10):
        spark.createDataFrame([(n,)], "v int").write.parquet(f"{path}/run={n}")
    assert [tuple(r) for r in T.latest_snapshot(spark, path, "run").collect()] == [(10, 10)]


def test_no_snapshot_is_known(spark, tmp_path):
    path = str(tmp_path / "snap")
    T.write_snapshot(spark.createDataFrame([(1,)], "v int"), path, F.lit(None).cast("date"))
    assert T.latest_snapshot(spark, path).count() == 0


def test_resume(spark, tmp_path):
    for n in ("A", "B", "C"):
        write(tmp_path, f"{n}.csv", GOOD)
    files = L.landed_files(spark, str(tmp_path))
    ledger = files.filter(F.col("path").endswith("B.csv")).select("path")
    assert sorted(r.path[-5:] for r in L.not_ingested(files, ledger).collect()) == ["A.csv", "C.csv"]


def test_plain_lines_are_split_as_quoted_ones_are(spark):
    """The cells are the same; a line without a quote needs no pattern."""
    lines = ["", ",", "a", " a ,b,,", "2020-01-01,1,2", 'x,"a, ""b""",c', '"q"', "a\tb, c"]
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    got = df.select("line", L.cells_of("line").alias("one"), L._plain_or_quoted("line").alias("two")).collect()
    assert [r.one for r in got] == [r.two for r in got]
