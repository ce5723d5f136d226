"""Bulk answering of short questions: which stock is meant, which rule applies, which rows answer.

All functions take ``questions(id..., text)`` and a ranked forecast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scalar import (asked_count, better_than_pct, signal_band,
                                       strength_wording, volatility_wording)
from tickloom.operators.performance import overview
from tickloom.operators.ranks import top_n
from tickloom.plans.forecast import candidates_shown

# The keywords of each rule. The first rule with a keyword inside the question wins.
RULES: dict[str, list[str]] = {
    "avoid": ["sell", "avoid", "bearish", "worst", "fall", "drop", "weak", "do not buy", "don't buy",
              "not buy", "loser", "decline", "underperform", "red", "negative", "danger",
              "risky stock", "going down", "lose money", "loss making"],
    "long_short": ["long short", "long-short", "buy and short", "buy and avoid", "top and bottom",
                   "best and worst", "long and short", "buy short", "long vs short", "hedge",
                   "market neutral", "both sides", "which stock", "portfolio"],
    "buy": ["buy", "top", "best", "invest", "long", "bullish", "recommend", "pick", "purchase",
            "gainer", "going up", "rise", "momentum", "strong stock", "winner", "upside", "positive",
            "ideas", "suggestion", "screen", "which stock to", "what to buy", "good stock",
            "high potential", "outperform", "rally", "breakout", "opportunity", "safe stock",
            "low risk", "defensive", "can i buy", "should i buy", "worth buying"],
    "index": ["nifty", "sensex", "index", "nse index", "bank nifty", "midcap", "smallcap index"],
    "news": ["news", "earnings", "quarterly results", "fundamentals", "pe ratio", "balance sheet",
             "revenue", "profit loss", "dividend", "eps", "roe", "roce"],
    "sector": ["sector", "banking stocks", "it stocks", "pharma stocks", "auto stocks", "fmcg",
               "realty", "infra", "energy stocks", "metal stocks", "nbfc"],
    "safety": ["can i make money", "how much can i earn", "how much money", "is it safe",
               "will i profit", "guaranteed", "sure shot", "loss", "risk free", "how much return",
               "can i trust", "reliable", "accurate"],
    "market": ["market", "overview", "summary", "nse market", "sentiment", "outlook", "broad market",
               "market signal", "how is market", "market today", "market condition", "market mood",
               "bullish or bearish"],
    "backtest": ["backtest", "performance", "accuracy", "sharpe", "cagr", "result", "history",
                 "track record", "alpha", "how good", "profit", "drawdown", "win rate", "statistics",
                 "significant", "factor", "fama", "t-stat", "t stat", "return",
                 "how much did it make", "how well", "how accurate", "tested", "validation",
                 "out of sample"],
    "how": ["how does", "explain", "how it work", "gpt", "transformer", "token", "architecture",
            "train", "neural", "machine learning", "deep learning", "predict", "ai model",
            "how are stocks ranked", "how does ranking", "algorithm", "methodology"],
    "next_day": ["next day", "next trading", "tomorrow forecast", "next market", "forecast tomorrow",
                 "forecast for", "upcoming", "next week forecast"],
    "help": ["help", "what can you", "commands", "guide", "features", "what do you", "how to use",
             "usage", "examples"],
}
# A word of each list together also means both sides; a word that blocks a rule.
BOTH_SIDES = (["buy", "long"], ["short", "bottom"])
BLOCKED_BY = {"news": "backtest"}

SEGMENT = r"(?U)(\w+|\W+)"
MOST_ROWS = 30


def normalised(text: Column) -> Column:
    return F.lower(F.trim(text))


def _has(text: Column, words: list[str], word_boundary: bool) -> Column:
    found = F.lit(False)
    for w in words:
        hit = text.rlike(rf"(?U)\b\Q{w}\E\b") if word_boundary else F.contains(text, F.lit(w))
        found = found | hit
    return found


def route_of(text: Column, has_stock: Column, word_boundary: bool = False) -> Column:
    """First rule that applies to normalised text; a named stock comes before all rules."""
    route = F.when(has_stock, "stock")
    for name, words in RULES.items():
        hit = _has(text, words, word_boundary)
        if name == "long_short":
            either, other = BOTH_SIDES
            hit = hit | (_has(text, either, word_boundary) & _has(text, other, word_boundary))
        if name in BLOCKED_BY:
            hit = hit & ~_has(text, [BLOCKED_BY[name]], word_boundary)
        route = route.when(hit, name)
    return route.otherwise("fallback")


def _segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(1))


def named_stocks(questions: DataFrame, ids: list[str], stocks: DataFrame, order: str) -> DataFrame:
    """(ids, stock): the first stock in ``order`` whose name stands in the question as whole words.

    A text is cut at every border between word and other characters. A name can only match a run
    of whole pieces, so runs as long as the longest name has pieces are looked up by equality;
    no name is tried against every text. Frequent words are counted once per question, and AQE
    splits a join partition that one word makes too large.
    """
    names = stocks.select("stock", order, F.lower("stock").alias("run"))
    longest = names.agg(F.max(F.size(_segments(F.col("run"))))).first()[0] or 0
    if longest == 0:
        return questions.select(*ids, F.lit(None).cast("string").alias("stock")).limit(0)
    cut = questions.select(*ids, _segments(normalised(F.col("text"))).alias("seg"))
    cut = cut.withColumn("n", F.size("seg")).filter(F.col("n") > 0)
    is_word = lambda s: s.rlike(r"(?U)^\w")
    first = F.when(is_word(F.element_at("seg", 1)), 1).otherwise(2)
    last = F.when(is_word(F.element_at("seg", -1)), F.col("n")).otherwise(F.col("n") - 1)
    bounded = cut.withColumn("first", first).withColumn("last", last).filter(F.col("first") <= F.col("last"))
    runs = F.flatten(F.transform(
        F.sequence("first", "last"),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.col("last") - i + 1)),
            lambda k: F.array_join(F.slice("seg", i, k), ""))))
    found = bounded.select(*ids, F.explode(F.array_distinct(runs)).alias("run")).join(names, "run")
    return found.groupBy(*ids).agg(F.min_by("stock", F.struct(order, "stock")).alias("stock"))


def routed(questions: DataFrame, ids: list[str], ranked: DataFrame, rank: str = "composite_rank",
           word_boundary: bool = False) -> DataFrame:
    """(ids, text, stock, route, n) for every question."""
    meant = named_stocks(questions, ids, ranked, rank)
    asked = questions.join(meant, ids, "left").withColumn("q", normalised(F.col("text")))
    return (asked.withColumn("route", route_of(F.col("q"), F.col("stock").isNotNull(), word_boundary))
            .withColumn("n", asked_count(F.col("text"))).drop("q"))


ADJUSTED = ["adj_ret_1d", "adj_ret_5d", "adj_ret_20d"]


def leaders(ranked: DataFrame, rank: str = "composite_rank") -> DataFrame:
    """(side, place, stock, ..., avg_prob): best and worst rows a question can ask for.

    At most 30 rows a side; ``avg_prob`` is the mean chance to rise of the first ``place`` rows.
    Adjusted returns are shown where the ranking has them.
    """
    shown = [c for c in ADJUSTED if c in ranked.columns]
    sides = None
    for side, worst in (("long", False), ("short", True)):
        rows = top_n(ranked, MOST_ROWS, rank, worst)
        order = W.orderBy(F.desc(rank) if worst else F.asc(rank), "stock")
        rows = rows.select(F.lit(side).alias("side"), F.row_number().over(order).alias("place"),
                           "stock", F.col(rank).alias("composite_rank"), *shown, "prob_up_1d",
                           F.avg("prob_up_1d").over(order.rowsBetween(W.unboundedPreceding, 0))
                           .alias("avg_prob"))
        sides = rows if sides is None else sides.unionByName(rows)
    return sides


def _sides(route: Column, regime: Column) -> Column:
    longs, shorts = candidates_shown(regime)
    both = F.array(F.lit("long"), F.lit("short"))
    masked = F.array_compact(F.array(F.when(longs, F.lit("long")), F.when(shorts, F.lit("short"))))
    return (F.when(route == "avoid", F.array(F.lit("short")))
             .when(route.isin("buy", "next_day"), F.array(F.lit("long")))
             .when(route == "long_short", masked).when(route == "market", both))


def answer_rows(routed_questions: DataFrame, ids: list[str], ranked: DataFrame,
                regime: Column | None = None) -> DataFrame:
    """(ids, route, side, place, stock, rank, adjusted returns, chance): the rows that answer each question."""
    shown = [c for c in ADJUSTED if c in ranked.columns]
    if regime is None:
        regime = ranked.select(F.max("regime")).scalar()
    n = F.when(F.col("route") == "market", 3).when(F.col("route") == "next_day", 10).otherwise(F.col("n"))
    wanted = (routed_questions.drop("stock")
              .withColumn("side", F.explode(_sides(F.col("route"), regime))).withColumn("rows", n).filter(F.col("rows") >= 1)
              .withColumn("place", F.explode(F.sequence(F.lit(1), F.col("rows")))))
    return (wanted.join(F.broadcast(leaders(ranked)), ["side", "place"])
            .select(*ids, "route", "side", "place", "stock", "composite_rank", *shown, "prob_up_1d"))


def next_day_answers(routed_questions: DataFrame, ids: list[str], ranked: DataFrame, data_until: Column,
                     calendar: DataFrame, today: Column) -> DataFrame:
    """(ids, next_day, data_until, total, strong_buy, avoid, neutral) for next-day questions.

    ``calendar`` is a trading calendar; the next day is its first open one after ``today``.
    """
    coming = calendar.filter(F.col("is_trading") & (F.col("date") > today)).select(F.min("date")).scalar()
    counted = answer_counts(routed_questions, ids, ranked).filter(F.col("route") == "next_day")
    return counted.drop("route").withColumn("next_day", coming).withColumn("data_until", data_until)


def answer_counts(routed_questions: DataFrame, ids: list[str], ranked: DataFrame) -> DataFrame:
    """(ids, route, total, strong_buy, avoid, neutral) for market and next-day questions."""
    counts = F.broadcast(overview(ranked).withColumn("join", F.lit(1)))   # one row
    return (routed_questions.filter(F.col("route").isin("market", "next_day"))
            .withColumn("join", F.lit(1)).join(counts, "join")
            .select(*ids, "route", "total", "strong_buy", "avoid", "neutral"))


def answer_averages(routed_questions: DataFrame, ids: list[str], ranked: DataFrame) -> DataFrame:
    """(ids, route, side, avg_prob): mean chance to rise over the rows each question selects."""
    side = (F.when(F.col("route") == "avoid", F.array(F.lit("short")))
             .when(F.col("route") == "buy", F.array(F.lit("long")))
             .when(F.col("route") == "long_short", F.array(F.lit("long"), F.lit("short"))))
    sizes = leaders(ranked)
    most = sizes.select(F.max("place")).scalar()
    wanted = (routed_questions.withColumn("side", F.explode(side))
              .withColumn("place", F.least(F.col("n"), most)))
    return (wanted.join(F.broadcast(sizes.select("side", "place", "avg_prob")), ["side", "place"])
            .select(*ids, "route", "side", "avg_prob"))


def stock_cards(routed_questions: DataFrame, ids: list[str], ranked: DataFrame) -> DataFrame:
    """(ids, stock, rank, signal, ...) for questions that name a stock."""
    total = ranked.select(F.count("*")).scalar()
    facts = statements(ranked, total)
    return (routed_questions.filter(F.col("route") == "stock").select(*ids, "stock")
            .join(facts, "stock"))


CHANCES = ["prob_up_1d", "prob_up_20d"]


def statements(ranked: DataFrame, total: Column) -> DataFrame:
    """Signal band, percentile and wording of every ranked stock."""
    rank = F.col("composite_rank")
    better = better_than_pct(rank, total)
    return ranked.select("stock", "composite_rank", total.cast("bigint").alias("total"),
                         *[c for c in CHANCES if c in ranked.columns], signal_band(rank, total).alias("signal"),
                         better.alias("better_than_pct"), (100 - better).alias("top_pct"),
                         volatility_wording(F.col("vol_ratio")).alias("volatility"),
                         strength_wording(better).alias("strength"))
