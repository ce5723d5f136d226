"""The panel clustered by stock, and wide tables of many stocks."""

from __future__ import annotations

import re
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators.panel import with_return
from tickloom.operators.stats import volatility_ratio
from tickloom.operators.tokens import tokenise, training_windows
from tickloom.operators.transitions import token_pairs
from tickloom.operators.windows import last_rows
from tickloom.sources import wide
from tickloom.sources.bystock import read_by_stock, write_by_stock
from tickloom.sources.tables import stock_history
from tickloom.sources.wide import from_matrix, matrix_rows, read_wide_files, stock_numbers, write_wide_files
from tickloom.staging import new_folder

D0 = date(2020, 1, 1)


@pytest.fixture(scope="module")
def by_stock(spark):
    path = new_folder(spark, "by-stock")
    rows = spark.range(4000).selectExpr("date_add(DATE '2020-01-01', CAST(id DIV 40 AS INT)) AS date", "concat('s', id % 40) AS stock",
                                        "10.0D + id % 7 AS close", "CAST((id % 11) - 5 AS DOUBLE) / 100 AS return_1d")
    write_by_stock(rows, path, buckets=8)
    return path, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_by_stock_need_no_shuffle(spark, by_stock):
    path, rows = by_stock
    t = read_by_stock(spark, path)
    steps = {"returns": lambda p: with_return(p.drop("return_1d"), ["stock"]), "volatility": volatility_ratio, "last": lambda p: last_rows(p, 5),
             "windows": lambda p: training_windows(tokenise(p), 16), "pairs": lambda p: token_pairs(tokenise(p))}
    for name, step in steps.items():
        assert "Exchange" not in plan(step(t)), name
        assert sorted(map(str, step(t).collect())) == sorted(map(str, step(rows).collect())), name


def test_one_stock_is_read_from_one_bucket(spark, tmp_path):
    """The other buckets' files cannot even be opened."""
    rows = spark.range(400).selectExpr("date_add(DATE '2020-01-01', CAST(id DIV 40 AS INT)) AS date", "concat('s', id % 40) AS stock", "id AS close")
    write_by_stock(rows, str(tmp_path / "t"), buckets=8)
    bucket = spark.range(1).select(F.pmod(F.hash(F.lit("s7")), F.lit(8))).first()[0]
    files = [f for f in tmp_path.glob("t/by_stock_*/*.parquet")]
    assert len(files) == 8
    for f in files:
        if f"_{bucket:05}" not in f.name:
            f.write_bytes(b"broken")
    one = stock_history(read_by_stock(spark, str(tmp_path / "t")), "s7")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, rows.filter("stock = 's7'").collect()))


def test_another_session_opens_it_by_its_commits(spark, by_stock):
    path, rows = by_stock
    for t in spark.catalog.listTables():
        if t.name.startswith("by_stock_"):
            spark.sql(f"DROP TABLE {t.name}")           # external: the files stay
    t = read_by_stock(spark, path)
    assert t.count() == 4000 and t.schema == rows.schema and "Exchange" not in plan(volatility_ratio(t))
    with pytest.raises(FileNotFoundError):
        read_by_stock(spark, new_folder(spark, "nothing"))


def test_a_new_write_replaces_it_whole(spark):
    path = new_folder(spark, "by-stock")
    def rows(close):
        return spark.createDataFrame([(D0, "a", close)], "date date, stock string, close double")
    write_by_stock(rows(1.0), path, 2)
    before = read_by_stock(spark, path)
    write_by_stock(rows(2.0), path, 4)
    assert before.first().close == 1.0 and read_by_stock(spark, path).first().close == 2.0


def long_rows(spark, stocks, days, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(D0 + timedelta(days=d), f"S{i:05}", round(float(rng.normal()), 6)) for d in range(days) for i in range(stocks) if rng.random() < 0.7]
    return rows, spark.createDataFrame(rows, "date date, stock string, return_1d double")


def test_twenty_thousand_stocks_both_ways(spark):
    """Without a plan of 20,000 columns: to matrix rows, to files, and back."""
    rows = spark.range(60_000).selectExpr("date_add(DATE '2020-01-01', CAST(id DIV 20000 AS INT)) AS date",
                                          "concat('S', id % 20000) AS stock", "CAST(id % 997 AS DOUBLE) / 1000 AS return_1d")
    numbers = stock_numbers(rows)
    began = time.time()
    matrix = matrix_rows(rows, numbers).cache()
    assert [len(r["values"]) for r in matrix.collect()] == [20_000] * 3 and len(matrix.columns) == 2
    path = new_folder(spark, "wide")
    write_wide_files(matrix, numbers, path, files=2)
    back = read_wide_files(spark, path)
    assert len(back.columns) == 3 and "S19999#" not in plan(back)
    assert back.exceptAll(rows).count() == 0 and back.count() == 60_000
    assert from_matrix(matrix, numbers).exceptAll(rows).count() == 0
    assert time.time() - began < 200


def test_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'Date,"B, Inc",A,,A\r\n2020-01-01,1,2,3,4\r\n2020-01-02 00:00:00,,oops,9,5\r\nnonsense,1,2,3,4\r\n2020-01-03,"1",NaN,1\r\n')
    (tmp_path / "b.csv").write_text("datetime,A,500325\n2020-01-04,7,8\n\n2020-01-05\n,9,9\n,oops,9\n")
    (tmp_path / "empty.csv").write_text("")
    got = {(r.date.day, r.stock): r.return_1d for r in read_wide_files(spark, str(tmp_path)).collect()}
    assert got == {(1, "B, Inc"): 1.0, (1, "A"): 2.0, (3, "B, Inc"): 1.0, (4, "A"): 7.0, (4, "500325"): 8.0}


def test_matrix_of_sparse_rows(spark):
    rows, long = long_rows(spark, 30, 12)
    numbers = stock_numbers(long)
    want = {d: [None] * numbers.count() for d, _, _ in rows}
    no = {r.stock: r.no for r in numbers.collect()}
    for d, s, v in rows:
        want[d][no[s]] = v
    assert {r.date: list(r["values"]) for r in matrix_rows(long, numbers).collect()} == want
    assert sorted(map(tuple, from_matrix(matrix_rows(long, numbers), numbers).collect())) == sorted(rows)


def test_odd_matrix_rows(spark):
    long = spark.createDataFrame([(D0, "a", 2.0), (D0, "a", 1.0), (D0, "b", None), (D0, None, None)], "date date, stock string, return_1d double")
    numbers = stock_numbers(long)
    assert [(r.stock, r.no) for r in numbers.orderBy("no").collect()] == [("a", 0), ("b", 1)]
    assert matrix_rows(long, numbers).first()["values"] == [1.0, None]
    assert matrix_rows(long.limit(0), numbers).count() == 0
    with pytest.raises(Exception, match="no number for stock"):
        matrix_rows(long, numbers.filter("stock = 'b'")).collect()


def test_wide_files_of_many_stocks_are_split(spark, monkeypatch):
    """More files, each with the header and written by another task, not longer ones."""
    rows, long = long_rows(spark, 20, 40)
    numbers = stock_numbers(long)
    monkeypatch.setattr(wide, "STOCKS", 5)
    path = new_folder(spark, "wide")
    write_wide_files(matrix_rows(long, numbers), numbers, path, files=2)
    lines = spark.read.text(path).selectExpr("part", "value", "_metadata.file_path AS file")
    per_file = lines.groupBy("file").agg(F.count_if(~F.col("value").startswith("date,")).alias("n")).collect()
    assert len(per_file) > 2 and max(r.n for r in per_file) < 20 and sum(r.n for r in per_file) == 40
    assert {r.part for r in lines.select("part").distinct().collect()} == {0, 1}
    assert sorted(map(tuple, read_wide_files(spark, path).select("date", "stock", "return_1d").collect())) == sorted(rows)
