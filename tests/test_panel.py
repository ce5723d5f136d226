from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import panel as P
from tickloom.operators.calendar import (holiday_table, month_starts, period_of_days, positions,
                                         trading_calendar, weekdays_ahead)
from tickloom.operators.clean import canonical, profile

D0 = date(2020, 1, 1)
BAR = "date date, stock string, open double, high double, low double, close double, volume double"


def day(i: int) -> date:
    return D0 + timedelta(days=i)


def series(spark, rows):
    return spark.createDataFrame([(day(i), s, c) for i, s, c in rows], "date date, stock string, close double")


def bars(spark, rows):
    return spark.createDataFrame([(d, s, c, c, c, c, 1.0) for d, s, c in rows], BAR)


def returns(df, order="date"):
    return [r.return_1d for r in df.orderBy("stock", order).collect()]


def test_pad_and_none(spark):
    s = series(spark, [(0, "a", 10.0), (1, "a", None), (2, "a", 12.0)])
    assert returns(P.with_return(s, ["stock"])) == pytest.approx([None, 0.0, 0.2])
    assert returns(P.with_return(s, ["stock"], "none")) == [None, None, None]


def test_no_return_across_the_seam_and_first_row_lost(spark):
    older = bars(spark, [(day(i), "a", 100.0 + i) for i in range(6)])
    newer = bars(spark, [(day(i), "a", 200.0 + i) for i in range(3, 9)])
    merged = P.merge_sources(older, newer, day(5), min_obs=1).orderBy("date").collect()
    # older rows 1..4 (0 has no return, 5 is cut); newer rows 5..8 (3 has none and 4 belongs to the older)
    assert [r.date for r in merged] == [day(i) for i in (1, 2, 3, 4, 5, 6, 7, 8)]
    assert merged[3].close == 104.0 and merged[4].close == 205.0
    assert merged[4].return_1d == round(205 / 204 - 1, 6)


def test_min_observations_gate(spark):
    b = bars(spark, [(day(i), s, 100.0 + i) for s, n in (("a", 51), ("b", 50)) for i in range(n)])
    kept = P.merge_sources(b, b.limit(0), date(2030, 1, 1))
    assert {r.stock for r in kept.select("stock").distinct().collect()} == {"a"}
    assert P.too_short(b, 51).collect()[0].stock == "b"


def test_copies_of_one_day_are_combined(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("stock"), F.lit(D0).alias("date"),
                                     (F.col("id") % 977).alias("v"))
    kept = P.one_row_per_day(rows, ["stock", "date"], [F.col("v") % 10])
    assert [tuple(r) for r in kept.collect()] == [("hot", D0, 0)]


def test_upsert_is_idempotent_and_keeps_the_last(spark):
    base = canonical(P.with_return(bars(spark, [(day(i), "a", 10.0 + i) for i in range(4)]), ["stock"]))
    batch = base.filter(F.col("date") >= day(2)).withColumn("close", F.col("close") + 1)
    once = P.upsert(base, batch)
    twice = P.upsert(once, batch)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert [r.close for r in once.orderBy("date").collect()] == [10.0, 11.0, 13.0, 14.0]


def test_watermark_global_and_per_stock(spark):
    base = canonical(P.with_return(bars(spark, [(day(i), s, 10.0 + i) for s, n in (("a", 9), ("b", 4)) for i in range(n)]), ["stock"]))
    batch = bars(spark, [(day(i), s, 20.0 + i) for s in "ab" for i in range(11)])
    overall = P.fresh_rows(batch, base)
    assert {(r.stock, r.date) for r in overall.collect()} == {(s, day(i)) for s in "ab" for i in (9, 10)}
    own = P.fresh_rows(batch, base, "per_stock")
    assert {(r.stock, r.date) for r in own.collect() if r.stock == "b"} == {("b", day(i)) for i in range(4, 11)}
    with pytest.raises(ValueError):
        P.fresh_rows(batch, base, "other")


def test_unknown_stocks_are_treated_alike_by_both_watermarks(spark):
    base = canonical(P.with_return(bars(spark, [(day(i), "a", 10.0 + i) for i in range(9)]), ["stock"]))
    batch = bars(spark, [(day(i), s, 20.0 + i) for s in ("a", "new") for i in range(11)])
    for mode, first in (("global", 9), ("per_stock", 1)):
        assert {r.stock for r in P.fresh_rows(batch, base, mode).collect()} == {"a"}
        let_in = P.fresh_rows(batch, base, mode, known_only=False).collect()
        assert min(r.date for r in let_in if r.stock == "new") == day(first)


def test_upsert_settles_copies_by_arrival(spark):
    base = canonical(P.with_return(bars(spark, [(day(i), "a", 10.0 + i) for i in range(3)]), ["stock"]))
    late = base.filter(F.col("date") == day(2))
    batch = (late.withColumn("close", F.lit(1.0)).withColumn("at", F.lit(1)).unionByName(
        late.withColumn("close", F.lit(9.0)).withColumn("at", F.lit(2))))
    got = P.upsert(base, batch, arrival="at")
    assert got.columns == base.columns
    assert [r.close for r in got.orderBy("date").collect()] == [10.0, 11.0, 9.0]


def test_a_stock_without_a_column_is_an_error(spark):
    p = series(spark, [(0, "a", 1.0), (0, "z", 2.0)]).withColumn("return_1d", F.lit(0.0))
    with pytest.raises(Exception, match="no column for stock z"):
        P.to_wide(p, ["a", "b"]).collect()


def test_source_fallback(spark):
    a = series(spark, [(0, "a", 1.0)])
    b = series(spark, [(0, "a", 9.0), (0, "b", 2.0)])
    assert {(r.stock, r.close) for r in P.choose_source(a, b).collect()} == {("a", 1.0), ("b", 2.0)}


def test_gap_fill_and_calendar_returns(spark):
    s = series(spark, [(0, "a", 10.0), (2, "a", 12.0), (1, "b", 5.0), (3, "b", None), (4, "b", 6.0)])
    cal = positions(s)
    grid = {(r.stock, r.pos): (r.observed, r.close, r.padded) for r in P.gap_filled(s, cal).collect()}
    assert len(grid) == 2 * 5
    assert grid["a", 2] == (False, None, 10.0) and grid["a", 5] == (False, None, 12.0)
    assert grid["b", 1] == (False, None, None) and grid["b", 4] == (True, None, 5.0)
    got = {(r.stock, r.date): r.return_1d for r in P.calendar_returns(s, cal).collect()}
    assert len(got) == 2 * 4
    assert got["a", day(1)] == 0.0 and got["a", day(2)] == pytest.approx(0.2)
    assert got["b", day(1)] is None and got["b", day(4)] == pytest.approx(0.2)


def test_wide_and_long(spark):
    s = series(spark, [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)]).withColumnRenamed("close", "return_1d")
    wide = P.to_wide(s, ["a", "b"])
    assert wide.columns == ["date", "a", "b"]
    assert sorted(P.to_long(wide).collect()) == sorted(s.select("date", "stock", "return_1d").collect())
    later = wide.withColumn("date", F.date_add("date", 5)).drop("b").withColumn("c", F.lit(7.0))
    assert P.stack_wide(wide, later).columns == ["date", "a", "b", "c"]


def test_profile(spark):
    s = series(spark, [(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)]).withColumnRenamed("close", "return_1d")
    row = profile(s).collect()[0]
    assert (row.n_rows, row.n_stocks, row.n_dates, row.null_fraction) == (3, 2, 2, 0.25)


def test_calendar_of_periods(spark):
    days = [date(2020, 1, 30), date(2020, 1, 31), date(2020, 2, 3), date(2020, 2, 4), date(2020, 3, 2), date(2020, 3, 3)]
    p = spark.createDataFrame([(d,) for d in days], "date date")
    periods = month_starts(p)
    assert [tuple(r) for r in periods.orderBy("period").collect()] == [
        (1, date(2020, 1, 30), date(2020, 2, 3)), (2, date(2020, 2, 3), date(2020, 3, 2)), (3, date(2020, 3, 2), None)]
    got = {r.date: (r.known_at, r.held_in) for r in period_of_days(p, periods).collect()}
    assert got == {days[0]: (1, None), days[1]: (2, 1), days[2]: (2, 1), days[3]: (3, 2), days[4]: (3, 2), days[5]: (None, None)}


def test_trading_calendar(spark):
    cal = trading_calendar(spark, date(2026, 3, 30), date(2026, 4, 14), holiday_table(spark))
    nxt = {r.date: r.next_trading_day for r in cal.collect()}
    assert nxt[date(2026, 4, 10)] == date(2026, 4, 13)
    assert nxt[date(2026, 4, 2)] == date(2026, 4, 6)
    assert nxt[date(2026, 4, 13)] == date(2026, 4, 15)


def test_weekdays_ahead(spark):
    starts = [date(2026, 4, 6) + timedelta(days=i) for i in range(7)]
    df = spark.createDataFrame([(d, n) for d in starts for n in (0, 1, 4, 5, 6, 20, 83)], "d date, n int")
    for r in df.withColumn("then", weekdays_ahead(F.col("d"), F.col("n"))).collect():
        at, left = r.d, r.n
        while left:
            at += timedelta(days=1)
            left -= at.weekday() < 5
        assert r.then == at, (r.d, r.n)


def test_stacked_tables_keep_days_without_any_of_the_older_stocks(spark, sf):
    """At the smallest size some days have none of the older table's stocks."""
    from tickloom.queries.catalogue import QUERIES
    got = QUERIES["stack_wide_tables"](spark, sf)
    old = [c for c in got.columns if c != "date"][:20]
    empty = got.filter(" AND ".join(f"{c} IS NULL" for c in old))
    assert got.count() == got.select("date").distinct().count() and empty.count() > 0


def test_the_staged_panel_follows_its_table(spark, sf, tmp_path):
    import os
    import shutil
    from tickloom.queries.data import staged_panel
    shutil.copy(f"{sf}/lineitem.parquet", tmp_path / "lineitem.parquet")
    first = staged_panel(spark, str(tmp_path))
    assert staged_panel(spark, str(tmp_path)) is first
    os.utime(tmp_path / "lineitem.parquet", (1, 1))
    assert staged_panel(spark, str(tmp_path)) is not first


def test_bars_of_uncombined_ticks(spark):
    """The same bars, without a sort or an aggregation before the shuffle."""
    rows = [(s, day(i % 9), float((i * 37) % 101), i % 5, (i * 7) % 23, i) for i in range(400) for s in ("a", "b", None)]
    rows += [("a", None, 3.0, 1, 2, 3), ("a", None, None, None, 2, 3)]
    ticks = spark.createDataFrame(rows, "stock string, date date, price double, quantity int, k long, n long")
    one, two = (P.bars_from_ticks(ticks, ["k", "n", "price"], combine=c) for c in (True, False))
    above, *below = two._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert len(below) == 1 and "Aggregate" not in below[0] and "Sort" not in below[0] and "SortAggregate" in above
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.schema == two.schema


def test_the_panel_sorts_nothing_before_its_first_shuffle(spark, sf):
    from tickloom.queries.data import panel
    plan = panel(spark, sf)._jdf.queryExecution().executedPlan().toString()
    first = plan.rsplit("Exchange", 1)[1]
    assert "Aggregate" not in first and "Sort" not in first


@pytest.mark.parametrize("fill", ["pad", "none"])
def test_calendar_returns_order_the_rows_once(spark, fill):
    """Equal to a plain walk over all positions, and no sort of the repeated rows."""
    rng = random.Random(4)
    rows = [(i, s, rng.choice([None, 0.0, 1.0, 2.0, 5.0])) for s in "abcde" for i in range(30) if rng.random() < 0.4]
    rows += [(i, "whole", float(i % 4)) for i in range(30)]
    s = series(spark, rows)
    cal = spark.createDataFrame([(day(i), i + 1) for i in range(30)], "date date, pos int")
    got = P.calendar_returns(s, cal, fill)
    want = {}
    for name in {r[1] for r in rows}:
        own, last, before = {i: c for i, n, c in rows if n == name}, None, None
        for i in range(30):
            last = own[i] if own.get(i) is not None else last
            now = last if fill == "pad" else own.get(i)
            if i:
                zero = None if not now else 1.0
                want[name, day(i)] = None if now is None or before is None else zero if before == 0 else now / before - 1
            before = now
    assert {(r.stock, r.date): r.return_1d for r in got.collect()} == pytest.approx(want)
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
