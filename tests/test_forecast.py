from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.test_chain import random_panel
from tickloom.plans.forecast import (MARKET, composite, deep_forecast, forecast, forecast_from_paths, market_adjusted,
                                     ranked, weekend_filter, with_regime)
from tickloom.queries.catalogue import QUERIES

WEDNESDAY, FRIDAY = date(2020, 10, 7), date(2020, 10, 9)


@pytest.fixture(scope="module")
def panel(spark):
    p = random_panel(spark, stocks=12, days=200).cache()
    yield p
    p.unpersist()


def test_forecast_table(spark, panel):
    got = forecast(panel, WEDNESDAY, n_paths=50, seed=1).toPandas()
    assert len(got) == 12 and got["regime"].nunique() == 1
    for h in (1, 5, 20):
        assert got[f"rank_{h}d"].tolist() == got[f"adj_ret_{h}d"].rank(ascending=False).astype(int).tolist()
    mean = got[[f"adj_ret_{h}d" for h in (1, 5, 20)]].mean(axis=1)
    assert got["composite_score"].tolist() == pytest.approx(mean.tolist())
    again = forecast(panel.repartition(5), WEDNESDAY, n_paths=50, seed=1).toPandas()
    assert got.sort_values("stock").to_dict("list") == again.sort_values("stock")[got.columns].to_dict("list")


def test_horizon_one_is_needed(spark, panel):
    with pytest.raises(ValueError):
        forecast_from_paths(panel, panel, panel, WEDNESDAY, [5, 20])


def test_deep_forecast(spark, panel):
    metrics, path = deep_forecast(panel, "S03".lower(), WEDNESDAY, n_paths=20)
    assert metrics.count() == 0 and path.count() == 0        # names are upper-cased, and none is S03
    upper = panel.withColumn("stock", F.upper("stock"))
    metrics, path = deep_forecast(upper, "s03", WEDNESDAY, n_paths=20)
    rows = metrics.orderBy("horizon_days").collect()
    assert [(r.horizon_days, r.approx_date) for r in rows] == [
        (1, date(2020, 10, 8)), (5, date(2020, 10, 14)), (20, date(2020, 11, 4))]
    assert path.count() == 20


def test_market_adjustment_defaults_to_zero(spark):
    m = spark.createDataFrame([("a", 1, 2.0), ("a", 5, 3.0), (MARKET, 1, 1.0)], "stock string, horizon int, mean_pct double")
    b = spark.createDataFrame([("a", 1.5)], "stock string, beta double")
    got = {r.horizon: r.adj_ret for r in market_adjusted(m, b).collect()}
    assert got == {1: 2.75, 5: 3.0}


def test_weekend_filter(spark):
    rows = spark.createDataFrame([("a", 1.5), ("b", 1.51)], "stock string, vol_ratio double")
    assert weekend_filter(rows, FRIDAY).count() == 1 and weekend_filter(rows, WEDNESDAY).count() == 2


def test_composite_skips_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 5.0), ("c", None, None)], "stock string, adj_ret_1d double, adj_ret_5d double")
    got = {r.stock: (r.composite_score, r.composite_rank) for r in ranked(composite(df, [1, 5]), [1, 5]).collect()}
    assert got == {"a": (1.0, 2), "b": (4.0, 1), "c": (None, None)}


def test_regime(spark):
    rows = spark.createDataFrame([("a",)], "stock string")
    for p, want in ((55.0, "bull"), (42.0, "bear"), (50.0, "neutral")):
        m = spark.createDataFrame([(MARKET, 1, p), (MARKET, 5, 0.0), ("a", 1, 99.0)], "stock string, horizon int, prob_up_pct double")
        assert with_regime(rows, m).collect()[0].regime == want


def test_sampled_paths_meet_by_shuffle(spark, sf):
    """200 paths a stock are not taken for a small table and collected on the driver."""
    plan = QUERIES["sampled_forecast"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[stock#\d+, path#\d+\]", plan)
    assert not re.search(r"BroadcastHashJoin \[stock#\d+, path#\d+\]", plan)
