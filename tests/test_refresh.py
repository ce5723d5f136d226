from __future__ import annotations

import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators.clean import canonical
from tickloom.operators.panel import with_return
from tickloom.plans.refresh import build_panel, refresh
from tickloom.schema import PANEL_COLUMNS
from tickloom.sources.tables import in_months, read_panel, stored_panel, write_panel
from tickloom.staging import new_folder

D0 = date(2024, 1, 20)


def bars(spark, rows):
    return spark.createDataFrame([(D0 + timedelta(days=i), s, c, c, c, c, 10.0) for s, i, c in rows],
                                 "date date, stock string, open double, high double, low double, close double, volume double")


def test_refresh_and_its_replay(spark, capsys):
    path = new_folder(spark, "panel")
    old = bars(spark, [(s, i, 10.0 + i) for s in "ab" for i in range(20)])
    write_panel(canonical(with_return(old, ["stock"])).select(PANEL_COLUMNS), path)
    before = read_panel(spark, path).collect()
    primary = bars(spark, [(s, i, 20.0 + i) for s in ("a", "x") for i in range(15, 23)])
    fallback = bars(spark, [(s, i, 40.0 + i) for s in ("a", "b", "x") for i in range(15, 23)])
    for _ in range(2):
        news = refresh(spark, path, primary, fallback)
        after = {(r.stock, r.date): r.close for r in read_panel(spark, path).collect()}
        assert {(r.stock, r.date): r.close for r in before}.items() <= after.items()
        assert {k: v for k, v in after.items() if k[1] >= D0 + timedelta(days=20)} == {
            (s, D0 + timedelta(days=i)): base + i for s, base in (("a", 20.0), ("b", 40.0)) for i in range(20, 23)}
    assert news.count() == 0
    in_months(stored_panel(spark, path), [202402]).explain("formatted")
    assert re.search(r"PartitionFilters: \[.*year.*month", capsys.readouterr().out)


def test_no_table_yet(spark):
    assert stored_panel(spark, new_folder(spark, "nothing")) is None


def test_build(spark):
    path = new_folder(spark, "built")
    listed = spark.createDataFrame([("a",), ("few",), ("none",), ("a",)], "clean_symbol string")
    older = bars(spark, [("a", i, 10.0 + i) for i in range(10)] + [("other", i, 1.0) for i in range(30)])
    newer = bars(spark, [("a", i, 30.0 + i) for i in range(8, 16)] + [("few", i, 1.0 + i) for i in range(4)])
    skipped = build_panel(spark, listed, older, newer, path, D0 + timedelta(days=9), min_obs=5)
    assert {r.stock for r in skipped.collect()} == {"few", "none"}
    got = {(r.date - D0).days: r.close for r in read_panel(spark, path).collect()}
    assert got == {i: 10.0 + i for i in range(1, 9)} | {i: 30.0 + i for i in range(9, 16)}
    one_day = read_panel(spark, path).filter(F.col("date") == D0 + timedelta(days=9)).first()
    assert one_day.return_1d == pytest.approx(39 / 38 - 1, abs=1e-6)
