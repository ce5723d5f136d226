from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.plans.routing import (answer_averages, answer_counts, answer_rows, named_stocks, routed, stock_cards)

ASKED = {
    "top 10 stocks to avoid": "avoid", "which stocks to buy and which to short?": "long_short",
    "top 10 stocks to buy": "buy", "nse market overview": "market", "show backtest results": "backtest",
    "next trading day forecast": "next_day", "can the model predict": "avoid", "nifty outlook": "index",
    "news of today": "news", "backtest news": "backtest", "pharma stocks": "sector", "is it safe": "safety",
    "how does it work": "how", "help": "help", "hm": "fallback", "Should I invest in ACME?": "stock",
    "go long or short": "long_short", "  HELP  ": "help",
}


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(f"S{i:03d}", i, 50.0 + i / 10, 1.0, "bull") for i in range(1, 99)]
    rows += [("ACME", 99, 40.0, 1.5, "bull"), ("M&M", 100, 41.0, 0.5, "bull")]
    df = spark.createDataFrame(rows, "stock string, composite_rank int, prob_up_1d double, vol_ratio double, regime string").cache()
    yield df
    df.unpersist()


def ask(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_routes(spark, ranked):
    got = {r.text: r.route for r in routed(ask(spark, ASKED), ["id"], ranked).collect()}
    assert got == ASKED


def test_word_boundary_option(spark, ranked):
    got = routed(ask(spark, ["can the model predict", "red or green"]), ["id"], ranked, word_boundary=True)
    assert [r.route for r in got.orderBy("id").collect()] == ["how", "avoid"]


def test_named_stocks(spark, ranked):
    texts = ["buy m&m now", "xm&m", "m&mx", "acmes", "(acme)", "acme-s050", "s050 s049 acme", "é_acme", "m & m", "", None, "S001"]
    got = {r.id: r.stock for r in named_stocks(ask(spark, texts), ["id"], ranked, "composite_rank").collect()}
    assert got == {0: "M&M", 4: "ACME", 5: "S050", 6: "S049", 11: "S001"}


def test_name_in_a_long_text_with_one_frequent_word(spark, ranked):
    q = spark.range(300).select("id", F.concat(F.repeat(F.lit("the word "), 3000), F.when(F.col("id") % 3 == 0, "acme").otherwise("none")).alias("text"))
    got = named_stocks(q, ["id"], ranked, "composite_rank")
    assert got.count() == 100 and got.select("stock").distinct().collect()[0].stock == "ACME"


def test_answers(spark, ranked):
    texts = ["top 3 stocks to avoid", "5 stocks to buy", "which stock, 2", "market mood", "next market day", "0 to buy", "acme"]
    r = routed(ask(spark, texts), ["id"], ranked).cache()
    rows = {}
    for a in answer_rows(r, ["id"], ranked).orderBy("id", "side", "place").collect():
        rows.setdefault((a.id, a.side), []).append(a.stock)
    assert rows[0, "short"] == ["M&M", "ACME", "S098"]
    assert rows[1, "long"] == [f"S{i:03d}" for i in range(1, 6)]
    assert rows[2, "long"] == ["S001", "S002"] and (2, "short") not in rows      # a bull day hides the shorts
    assert len(rows[3, "long"]) == 3 and len(rows[3, "short"]) == 3
    assert (5, "long") not in rows and (6, "long") not in rows
    bear = answer_rows(r, ["id"], ranked, F.lit("bear")).filter("id = 2").collect()
    assert {a.side for a in bear} == {"short"}
    counts = {c.id: (c.strong_buy, c.avoid, c.neutral) for c in answer_counts(r, ["id"], ranked).collect()}
    assert counts[3] == (10, 11, 79)
    avg = {(a.id, a.side): a.avg_prob for a in answer_averages(r, ["id"], ranked).collect()}
    assert avg[1, "long"] == pytest.approx(50.3) and avg[0, "short"] == pytest.approx((41 + 40 + 59.8) / 3)
    card = stock_cards(r, ["id"], ranked).collect()[0]
    assert (card.stock, card.signal, card.better_than_pct, card.volatility, card.strength) == (
        "ACME", "STRONG AVOID", 1, "more jumpy than usual", "weak")
