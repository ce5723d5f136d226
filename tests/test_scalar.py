from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tickloom.functions import scalar as S


def values(spark, kind, *items):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i")


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_half_even(spark):
    df = values(spark, "double", 0.125, 0.375, -0.0000001, 2.5, None)
    assert column(df, S.half_even(F.col("x"), 2)) == [0.12, 0.38, 0.0, 2.5, None]


def test_winsorise_keeps_null(spark):
    df = values(spark, "double", 2.5, -1.7, None, 0.5)
    assert column(df, S.winsorise(F.col("x"))) == [1.0, -1.0, None, 0.5]


def test_return_from_zero_close(spark):
    df = spark.createDataFrame([(0.0, 5.0), (0.0, 0.0), (0.0, -1.0), (2.0, 3.0), (None, 3.0)], "p double, c double")
    assert column(df, S.ratio_return(F.col("c"), F.col("p"))) == [1.0, None, -1.0, 0.5, None]


def test_tokens_equal_an_exact_edge_search(spark):
    edges = np.linspace(-1.0, 1.0, 401)
    x = np.concatenate([np.arange(-2000, 2001) * 0.0005, edges, np.nextafter(edges, -2), np.nextafter(edges, 2)])
    got = column(values(spark, "double", *map(float, x)), S.token_of(F.col("x")))
    want = np.digitize(np.clip(x, -1 + 1e-9, 1 - 1e-9), edges)
    assert got == want.tolist()
    assert min(got) == 1 and max(got) == 400


def test_token_centres(spark):
    edges = np.linspace(-1.0, 1.0, 401)
    want = np.concatenate([[-1.0], (edges[:-1] + edges[1:]) / 2, [1.0]])
    got = column(values(spark, "int", *range(402)), S.centre_of(F.col("x")))
    assert np.allclose(got, want, atol=1e-15)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=1, max_size=40))
def test_token_round_trip(spark, xs):
    got = column(values(spark, "double", *xs), S.centre_of(S.token_of(F.col("x"))))
    assert max(abs(a - b) for a, b in zip(got, xs)) <= 0.0025 + 1e-8


def test_two_sided_p(spark):
    df = spark.createDataFrame([(2.0, 10), (2.0, 9), (1.0, 1), (0.0, 5), (60.0, 40), (2.0, 2), (2.0, 3), (1.0, 0)], "t double, v int")
    got = column(df, S.two_sided_p(F.col("t"), F.col("v")))
    assert got[:6] == pytest.approx([0.07339, 0.07655, 0.5, 1.0, 0.0, 0.18350], abs=1e-5)
    assert got[6] == pytest.approx(0.13933, abs=1e-5)
    assert got[7] is None


def test_signal_bands(spark):
    df = values(spark, "int", 5, 6, 20, 21, 50, 79, 80, 94, 95, 100)
    assert column(df, S.signal_band(F.col("x"), F.lit(100))) == [
        "STRONG BUY", "BUY", "BUY", "NEUTRAL", "NEUTRAL", "NEUTRAL", "AVOID", "AVOID", "STRONG AVOID", "STRONG AVOID"]


def test_regime_and_wording(spark):
    df = values(spark, "double", 55.0, 42.0, 50.0)
    assert column(df, S.regime_label(F.col("x"))) == ["bull", "bear", "neutral"]
    df = values(spark, "double", 1.31, 0.69, 1.0)
    assert column(df, S.volatility_wording(F.col("x"))) == ["more jumpy than usual", "calmer than usual", "normal"]
    df = values(spark, "double", 0.0009, 0.005, 0.04, 0.05, None)
    assert column(df, S.p_wording(F.col("x"))) == ["p<0.001", "p<0.01", "p<0.05"] + ["not significant"] * 2


def test_asked_count(spark):
    df = values(spark, "string", "top 5 of 40", "top stocks", " 0 ideas", "5 then 12", "7x", "9" * 30, "")
    assert column(df, S.asked_count(F.col("x"))) == [30, 10, 0, 12, 10, 30, 10]
    zeros = values(spark, "string", *[f"top {'0' * n}5" for n in (1, 18, 19, 40)], "0" * 40, "0" * 5 + "9" * 19)
    assert column(zeros, S.asked_count(F.col("x"))) == [5, 5, 5, 5, 0, 30]
