from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tickloom.operators.calendar import positions
from tickloom.operators.performance import overview, performance
from tickloom.operators import ranks as rank_module
from tickloom.operators.ranks import average_tie_rank, legs, top_n
from tickloom.staging import stage
from tickloom.operators.regress import (coefficient_summary, fama_macbeth, period_factor_regression,
                                        period_regression)
from tickloom.operators.stats import beta, daily_profile, factors, horizon_metrics, market_series, volatility_ratio
from tickloom.operators.windows import chart_rows, equity_curve
from tickloom.plans.forecast import ranked

D0 = date(2020, 1, 1)


def panel(spark, columns: dict[str, list]):
    rows = [(D0 + timedelta(days=i), s, None if x is None else float(x))
            for s, xs in columns.items() for i, x in enumerate(xs) if not (isinstance(x, str))]
    return spark.createDataFrame(rows, "date date, stock string, return_1d double")


def ranks(spark, xs, **options):
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    return [r["rank"] for r in average_tie_rank(df, [], "x", **options).orderBy("i").collect()]


def test_average_tie_rank(spark):
    assert ranks(spark, [5.0, 3.0, 3.0, 1.0], truncate=True) == [1, 2, 2, 4]
    assert ranks(spark, [5.0, 3.0, None, 3.0, 1.0]) == [1.0, 2.5, None, 2.5, 4.0]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -0.011, -0.01, 0.0, 0.004, 0.006, 0.5, 7.0]) | st.floats(-2, 2), min_size=1, max_size=60),
       st.sampled_from([1, 2, 64]), st.sampled_from([0, 1000]))
def test_ranks_do_not_depend_on_the_ranges(spark, xs, per_task, sent):
    want = pd.Series(xs).rank(ascending=False)
    assert ranks(spark, xs, per_task=per_task, sent=sent) == want.tolist()


@pytest.mark.parametrize("sent", [0, 10 ** 6])
def test_ranks_of_several_cross_sections_over_many_ranges(spark, sent, monkeypatch):
    """One cross-section in several ranges, several in one; a score that most rows share; unknown scores."""
    monkeypatch.setattr(rank_module, "HOT", 300)
    rng = np.random.default_rng(3)
    rows = [(g, int(i), None if x > 0.97 else 0.5 if x > 0.4 else round(float(x), 3)) for g, n in enumerate([900, 3, 1, 40, 700])
            for i, x in enumerate(rng.random(n))]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    got = average_tie_rank(df, ["g"], "x", per_task=50, sent=sent).toPandas().sort_values(["g", "i"])
    want = got.groupby("g")["x"].rank(ascending=False)
    assert len(got) == len(rows) and got["rank"].equals(want)


def test_tasks_grow_with_the_distinct_scores(spark, monkeypatch):
    staged = {}
    monkeypatch.setattr(rank_module, "stage", lambda df, label: staged.setdefault(label, stage(df, label)))
    for n in (1000, 8000):
        staged.clear()
        got = average_tie_rank(spark.range(n).select(F.col("id").cast("double").alias("x")), [], "x", per_task=500)
        assert got.agg(F.sum("rank")).first()[0] == n * (n + 1) / 2
        sizes = [r["count"] for r in staged["ranged-scores"].groupBy("_range").count().collect()]
        assert len(sizes) == n // 500 and max(sizes) < 2000


def test_rank_with_a_third_of_all_rows_on_one_score(spark):
    df = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(
        (F.col("id") % 1000) / 1000).cast("double").alias("x"))
    got = average_tie_rank(df, [], "x").toPandas().sort_values("id")
    assert np.array_equal(got["rank"], got["x"].rank(ascending=False))


def test_r_squared_of_a_flat_period_is_zero(spark):
    rows = [(1, float(i), 0.1) for i in range(30)] + [(2, float(i), 2.0 * i) for i in range(30)] + [(2, 5.0, None)]
    got = {r.period: r.r2 for r in period_regression(spark.createDataFrame(rows, "period int, score double, realised double")).collect()}
    assert got == {1: 0.0, 2: pytest.approx(1.0)}


def test_ranking_more_horizons_costs_no_more_shuffles(spark):
    def exchanges(n):
        rows = spark.range(50).select(F.col("id").cast("string").alias("stock"), F.rand(1).alias("composite_score"),
                                      *[F.rand(h).alias(f"adj_ret_{h}d") for h in range(n)])
        plan = ranked(rows, list(range(n)))._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange")
    assert exchanges(1) == exchanges(6)


def test_legs_and_ties(spark):
    scores = spark.createDataFrame([(1, f"s{i}", float(i)) for i in range(10)]
                                   + [(2, f"s{i}", 1.0) for i in range(10)], "period int, stock string, score double")
    got = {(r.period, r.leg): r.stock for r in legs(scores).collect()}
    assert got == {(1, "long"): "s9", (1, "short"): "s0"}          # period 2: all tied, both legs empty


def test_beta(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(0, 0.01, 80)
    few = [None if i >= 19 else x for i, x in enumerate(m[-60:])]
    p = panel(spark, {"m": m, "twice": 2 * m, "few": [None] * 20 + few, "flat": [0.0] * 80})
    market = p.filter("stock = 'm'").select("date", F.col("return_1d").alias("market"))
    got = {r.stock: r.beta for r in beta(p, market, positions(p)).collect()}
    assert got["twice"] == pytest.approx(2 * 60 / 59)
    assert got["few"] == 1.0 and got["flat"] == pytest.approx(0.0)
    exact = {r.stock: r.beta for r in beta(p, market, positions(p), unbiased=True).collect()}
    assert exact["twice"] == pytest.approx(2.0)


def test_volatility_ratio(spark):
    rng = np.random.default_rng(1)
    long = rng.normal(0, 0.01, 300)
    long[-20:] *= 30
    p = panel(spark, {"short": rng.normal(0, 1, 29), "flat": [0.01] * 50, "wild": long,
                      "calm": np.r_[rng.normal(0, 0.01, 300), rng.normal(0, 0.006, 20)]})
    got = {r.stock: r.vol_ratio for r in volatility_ratio(p).collect()}
    calm = p.filter("stock = 'calm'").orderBy("date").toPandas()["return_1d"].to_numpy()
    assert got["short"] == 1.0 and got["flat"] == 1.0 and got["wild"] == pytest.approx(np.std(long[-20:]) / np.std(long))
    assert got["calm"] == pytest.approx(np.std(calm[-20:]) / np.std(calm))


def test_market_is_the_median_of_the_most_complete(spark):
    p = panel(spark, {"c": [0.1, 0.2, 0.3], "a": [0.3, 0.4, None], "b": [0.5, 0.6, None], "d": [9.0, None, None]})
    got = [r.market for r in market_series(p, 2).orderBy("date").collect()]
    assert got == pytest.approx([0.2, 0.3, 0.3])                   # c, then a before b by name


def test_factors_count_calendar_rows(spark):
    p = panel(spark, {"a": [0.01] * 30, "gone": [0.02] * 5})
    got = {r.stock: r for r in factors(p, positions(p)).collect()}
    assert got["a"].momentum == pytest.approx(0.2) and got["a"].reversal == pytest.approx(-0.05)
    assert (got["gone"].momentum, got["gone"].reversal, got["gone"].volatility) == (0.0, 0.0, None)


def test_drawdown_starts_at_the_first_value(spark):
    r = spark.createDataFrame([("x", D0 + timedelta(days=i), v) for i, v in enumerate([-0.1, 0.2, -0.3])], "label string, date date, ret double")
    curve = equity_curve(r).orderBy("date").collect()
    assert [c.growth for c in curve] == pytest.approx([0.9, 1.08, 0.756])
    row = performance(r).collect()[0]
    assert row.max_dd_pct == -30.0 and row.total_ret_pct == -24.4 and row.n_periods == 3
    want = np.mean([-0.1, 0.2, -0.3]) / np.std([-0.1, 0.2, -0.3], ddof=1) * np.sqrt(12)
    assert row.sharpe == pytest.approx(want, abs=5e-4)
    assert row.win_rate_pct == 33.3


def test_period_regression(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 3.5), (1, 3.0, 5.1)], "period int, score double, realised double")
    row = period_regression(df, min_common=3, min_complete=3).collect()[0]
    assert row.slope == pytest.approx(1.55) and row.r2 == pytest.approx(0.99965, abs=1e-5)
    assert fama_macbeth(period_regression(df)).collect()[0].n_periods == 0


def test_fama_macbeth(spark):
    per = spark.createDataFrame([(i, s, 0.1) for i, s in enumerate([0.5, 0.7, 0.1, -0.2, 0.9])], "period int, slope double, r2 double")
    row = fama_macbeth(per).collect()[0]
    s = np.array([0.5, 0.7, 0.1, -0.2, 0.9])
    assert row.t_stat == pytest.approx(s.mean() / (s.std(ddof=1) / np.sqrt(5)), abs=5e-4)
    assert row.mean_coef == 0.4 and row.p_value == pytest.approx(0.1161, abs=2e-4)


@pytest.mark.parametrize("collinear", [False, True])
def test_factor_regression_is_least_squares(spark, collinear):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [1.0, 0.05, 0.02, 1e-5]
    if collinear:
        x[:, 2] = x[:, 1]
    y = x @ [0.3, -1.0, 2.0, 50.0] + 0.01 * rng.normal(size=60) + 0.7
    names = ["a", "b", "c", "d"]
    rows = [(1, *map(float, r), float(v)) for r, v in zip(x, y)] + [(2, 1.0, 1.0, 1.0, 1.0, 1.0)] * 29
    df = spark.createDataFrame(rows + [(1, None, 1.0, 1.0, 1.0, 1.0)], "period int, a double, b double, c double, d double, realised double")
    got = period_factor_regression(df, names).collect()
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert len(got) == 1 and got[0].n == 60
    assert [got[0][c] for c in ["intercept", *names]] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_coefficient_summary(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.5), (1.0, 3.0)], "a double, b double")
    got = {r.name: (r.t_stat, r["mark"]) for r in coefficient_summary(df, ["a", "b"]).collect()}
    assert got["a"] == (0.0, "") and got["b"][0] == pytest.approx(2.5 / (0.5 / np.sqrt(3))) and got["b"][1] == "p<0.01"


def test_horizon_metrics_match_numpy(spark):
    rng = np.random.default_rng(3)
    paths = rng.normal(0, 0.05, (50, 7))
    paths[0, 0] = -2.0
    df = spark.createDataFrame([("a", i, p.tolist()) for i, p in enumerate(paths)], "stock string, path int, rets array<double>")
    got = {r.horizon: r for r in horizon_metrics(df, [1, 5, 20]).collect()}
    assert set(got) == {1, 5}
    cum = np.expm1(np.log1p(np.clip(paths[:, :5], -0.9999, None)).sum(axis=1))
    r = got[5]
    assert [r.mean_pct, r.median_pct, r.std_pct, r.p10_pct, r.p90_pct, r.prob_up_pct] == pytest.approx(
        [np.mean(cum) * 100, np.median(cum) * 100, np.std(cum) * 100, np.percentile(cum, 10) * 100,
         np.percentile(cum, 90) * 100, np.mean(cum > 0) * 100], abs=5.1e-4)
    med = [x.daily_median for x in daily_profile(df).orderBy("day").collect()]
    assert med == pytest.approx(np.median(paths, axis=0) * 100)


def test_overview_counts(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "composite_rank")
    row = overview(df).collect()[0]
    assert (row.strong_buy, row.avoid, row.neutral) == (10, 11, 79)


def test_top_n_skips_unranked(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("c", None), ("d", 2)], "stock string, composite_rank int")
    assert [r.stock for r in top_n(df, 2).collect()] == ["b", "a"]
    assert [r.stock for r in top_n(df, 2, worst=True).collect()] == ["a", "d"]


def test_chart_rows(spark):
    rows = [(D0 + timedelta(days=i), s, 1.0, 1.0, 1.0, float(i), 0.01 * (-1) ** i) for s, n in (("a", 200), ("b", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "date date, stock string, open double, high double, low double, close double, return_1d double")
    got = chart_rows(df).orderBy("date").collect()
    assert len(got) == 180 and {r.stock for r in got} == {"a"}
    assert got[18].ma is None and got[19].ma == pytest.approx(np.mean(range(20, 40)))
    assert (got[0].bar_side, got[1].bar_side) == ("up", "down")


def test_scores_by_broadcast_or_shuffle(spark, monkeypatch):
    from tickloom.operators import transitions
    states = spark.createDataFrame([(p, f"s{i}", i % 3) for p in (1, 2) for i in range(30)], "period int, stock string, token int")
    growth = spark.createDataFrame([(p, t, 1 + p / 10 + t / 100) for p in (1, 2) for t in (0, 1, transitions.UNSEEN)], "period int, state int, growth double")
    want = sorted(map(tuple, transitions.score_states(states, growth, ["period"]).collect()))
    monkeypatch.setattr(transitions, "SENT", 0)
    assert sorted(map(tuple, transitions.score_states(states, growth, ["period"]).collect())) == want


def test_windows_without_replacement(spark):
    """Different windows, the same for a seed, each about as often as any other; all of them where a batch needs all."""
    from tickloom.operators.tokens import sample_windows
    tokens = spark.createDataFrame([(s, D0 + timedelta(days=i), i % 5) for s, n in (("a", 60), ("b", 15), ("c", 4)) for i in range(n)],
                                   "stock string, date date, token int")
    drawn = lambda batch, seed: [(r.stock, r.start) for r in sample_windows(tokens, batch, 4, seed, replacement=False).collect()]
    once = drawn(20, 1)
    assert len(set(once)) == 20 and sorted(once) == sorted(drawn(20, 1)) and sorted(once) != sorted(drawn(20, 2))
    assert len(set(drawn(67, 1))) == 67 and len(drawn(500, 1)) == 67
    share = np.mean([s == "b" for seed in range(8) for s, _ in drawn(30, seed)])
    assert abs(share - 11 / 67) < 0.1


def test_a_resource_profile_goes_to_the_scoring_stage(spark):
    from tickloom.operators.paths import score_with
    asked = []

    class Rows:         # stands for a DataFrame: a local session has no profiles
        def select(self, *columns):
            return self

        def repartition(self, column):
            asked.append("dealt")
            return self

        def mapInPandas(self, run, schema, profile=None):
            asked.append(profile)
            return self
    gpu = object()
    score_with(Rows(), lambda: None)
    score_with(Rows(), lambda: None, profile=gpu)
    assert asked == [None, "dealt", gpu]
    rows = spark.createDataFrame([(f"s{i}", [i, 1]) for i in range(5)], "stock string, x array<int>")
    assert {r.stock: r.score for r in score_with(rows, lambda: lambda x: x.sum(axis=1)).collect()} == {f"s{i}": i + 1.0 for i in range(5)}
