"""Routing and answering of questions in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.scalar import asked_count, regime_label
from tickloom.operators.calendar import holiday_table, trading_calendar
from tickloom.operators.performance import overview
from tickloom.operators.ranks import average_tie_rank
from tickloom.plans.routing import (BLOCKED_BY, BOTH_SIDES, RULES, answer_averages, answer_counts,
                                    answer_rows, named_stocks, next_day_answers, routed, stock_cards)
from tickloom.queries.data import staged_panel, table
from tickloom.queries.forecasts import FORECAST_SQL, TUESDAY, block_forecast
from tickloom.queries.registry import query, rounded
from tickloom.staging import stage

# Every customer asks one of these; {c}, {n} and {b} are the customer's key, a number and a brand.
PHRASES = ["top {n} stocks to avoid", "which stocks to buy and which to short?", "  Top {n} of 40 stocks to BUY ",
           "nse market overview", "show backtest results", "next trading day forecast",
           "can the model predict {n} days", "should i invest in {b} now", "{b}? or Brand#2",
           "is it safe", "nifty in {n} weeks", "dividend news of {c}", "pharma stocks {n}",
           "how does it work", "help", "hello {c}", "portfolio hedge top {n}", "x{b} and {b}5",
           "backtest dividend news", "best {n} ideas 0"]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(src, id, text): what users wrote, and one made question per customer."""
    wrote = (table(spark, sf, "conversations").filter(F.col("role") == "user")
             .select(F.lit("chat").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    key = F.col("c_custkey")
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (key % len(PHRASES) + 1).cast("int"))
    made = F.replace(F.replace(F.replace(phrase, F.lit("{c}"), key.cast("string")),
                               F.lit("{n}"), (key % 47).cast("string")),
                     F.lit("{b}"), F.concat(F.lit("brand#"), (key % 27).cast("string")))
    asked = table(spark, sf, "customer").select(F.lit("made").alias("src"), key.alias("id"), made.alias("text"))
    return wrote.unionByName(asked)


def brand_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A ranked table of brands: many ties, a chance to rise, a volatility, a regime."""
    items = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    r = items.groupBy(F.col("p_brand").alias("stock")).agg(
        (F.count("*") % 20).cast("double").alias("composite_score"),
        (100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("prob_up_1d"),
        (F.avg("l_discount") * 20).alias("vol_ratio"))
    ranked = average_tie_rank(r, [], "composite_score", "composite_rank", truncate=True)
    p = items.select(100.0 * F.count_if(F.col("l_linestatus") == "O") / F.count("*") + 10).scalar()
    return ranked.withColumn("regime", regime_label(p))


RANKING_SQL = """
WITH brands AS (
  SELECT p_brand AS stock, CAST(count(*) % 20 AS DOUBLE) AS composite_score,
         100.0::DOUBLE * count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS prob_up_1d,
         avg(l_discount) * 20 AS vol_ratio
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand),
share AS (SELECT 100.0 * count(*) FILTER (WHERE l_linestatus = 'O') / count(*) + 10 AS p
          FROM lineitem JOIN part ON p_partkey = l_partkey),
ranked AS (
  SELECT *, CAST(floor(rank() OVER (ORDER BY composite_score DESC)
                 + (count(*) OVER (PARTITION BY composite_score) - 1) / 2.0) AS INTEGER) AS composite_rank,
         (SELECT CASE WHEN p >= 55 THEN 'bull' WHEN p <= 42 THEN 'bear' ELSE 'neutral' END FROM share) AS regime
  FROM brands)
"""


def _phrase_sql() -> str:
    cases = " ".join("WHEN {} THEN '{}'".format(i, p.replace("'", "''")) for i, p in enumerate(PHRASES))
    return f"CASE c_custkey % {len(PHRASES)} {cases} END"


QUESTIONS_SQL = RANKING_SQL + f""",
questions AS (
  SELECT 'chat' AS src, conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT 'made', c_custkey, replace(replace(replace({_phrase_sql()}, '{{c}}', CAST(c_custkey AS VARCHAR)),
         '{{n}}', CAST(c_custkey % 47 AS VARCHAR)), '{{b}}', 'brand#' || CAST(c_custkey % 27 AS VARCHAR))
  FROM customer),
clean AS (SELECT *, lower(trim(text, ' ')) AS q FROM questions),
meant AS (
  SELECT c.src, c.id, arg_min(r.stock, row(r.composite_rank, r.stock)) AS stock
  FROM clean c JOIN ranked r
    ON CASE WHEN contains(c.q, lower(r.stock))
            THEN regexp_matches(c.q, '(^|[^\\pL\\pN_])' || lower(r.stock) || '($|[^\\pL\\pN_])') ELSE false END GROUP BY ALL)
"""


def _any_sql(words: list[str]) -> str:
    return "(" + " OR ".join("contains(q, '{}')".format(w.replace("'", "''")) for w in words) + ")"


def _route_sql() -> str:
    out = "CASE WHEN stock IS NOT NULL THEN 'stock'"
    for name, words in RULES.items():
        hit = _any_sql(words)
        if name == "long_short":
            hit = f"({hit} OR ({_any_sql(BOTH_SIDES[0])} AND {_any_sql(BOTH_SIDES[1])}))"
        if name in BLOCKED_BY:
            hit += f" AND NOT contains(q, '{BLOCKED_BY[name]}')"
        out += f" WHEN {hit} THEN '{name}'"
    return out + " ELSE 'fallback' END"


ROUTED_SQL = QUESTIONS_SQL + f""",
routed AS (
  SELECT c.src, c.id, c.text, m.stock, {_route_sql()} AS route,
         CASE WHEN last_number IS NULL THEN 10 WHEN last_number > 30 THEN 30
              ELSE CAST(last_number AS INTEGER) END AS n
  FROM (SELECT *, CAST(list_filter(string_split_regex(q, '\\s+'),
                       lambda w: regexp_full_match(w, '[0-9]+'))[-1] AS BIGINT) AS last_number FROM clean) c
  LEFT JOIN meant m USING (src, id)),
leaders AS (
  SELECT 'long' AS side, row_number() OVER (ORDER BY composite_rank, stock) AS place, * FROM ranked
  UNION ALL SELECT 'short', row_number() OVER (ORDER BY composite_rank DESC, stock), * FROM ranked)
"""
IDS = ["src", "id"]


def _routed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ranked = stage(brand_ranking(spark, sf), "ranking")
    return stage(routed(questions(spark, sf), IDS, ranked), "routed"), ranked


@query("named_stocks", QUESTIONS_SQL + "SELECT src, id, stock FROM meant")
def stocks_in_questions(spark: SparkSession, sf: str) -> DataFrame:
    return named_stocks(questions(spark, sf), IDS, stage(brand_ranking(spark, sf), "ranking"), "composite_rank")


@query("asked_counts", ROUTED_SQL + "SELECT src, id, n FROM routed")
def asked_counts(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select(*IDS, asked_count(F.col("text")).alias("n"))


@query("routed_questions", ROUTED_SQL + "SELECT src, id, coalesce(stock, '') AS stock, route, n FROM routed")
def routed_questions(spark: SparkSession, sf: str) -> DataFrame:
    ranked = stage(brand_ranking(spark, sf), "ranking")
    return (routed(questions(spark, sf), IDS, ranked)
            .select(*IDS, F.coalesce("stock", F.lit("")).alias("stock"), "route", "n"))


@query("answer_rows", ROUTED_SQL + """
SELECT r.src, r.id, r.route, l.side, CAST(l.place AS INTEGER) AS place, l.stock, l.composite_rank,
       round(l.prob_up_1d, 6) + 0.0 AS prob_up_1d
FROM routed r JOIN leaders l
  ON l.place <= CASE r.route WHEN 'market' THEN 3 WHEN 'next_day' THEN 10 ELSE r.n END
 AND ((r.route = 'avoid' AND l.side = 'short') OR (r.route IN ('buy', 'next_day') AND l.side = 'long')
      OR r.route = 'market'
      OR (r.route = 'long_short' AND ((l.side = 'long' AND l.regime <> 'bear') OR (l.side = 'short' AND l.regime <> 'bull'))))""")
def rows_of_answers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(answer_rows(*_with_ids(spark, sf)), "prob_up_1d")


def _with_ids(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], DataFrame]:
    questions_routed, ranked = _routed(spark, sf)
    return questions_routed, IDS, ranked


@query("answer_counts", ROUTED_SQL + """,
counts AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE composite_rank <= floor(t * 0.1)) AS strong_buy,
         count(*) FILTER (WHERE composite_rank >= t - floor(t * 0.1)) AS avoid
  FROM ranked, (SELECT count(*) AS t FROM ranked))
SELECT src, id, route, total, strong_buy, avoid, total - strong_buy - avoid AS neutral
FROM routed, counts WHERE route IN ('market', 'next_day')""")
def counts_of_answers(spark: SparkSession, sf: str) -> DataFrame:
    return answer_counts(*_with_ids(spark, sf))


@query("answer_averages", ROUTED_SQL + """
SELECT r.src, r.id, r.route, l.side, round(avg(l.prob_up_1d), 6) + 0.0 AS avg_prob
FROM routed r JOIN leaders l ON l.place <= r.n
 AND ((r.route IN ('avoid', 'long_short') AND l.side = 'short') OR (r.route IN ('buy', 'long_short') AND l.side = 'long'))
GROUP BY ALL""")
def averages_of_answers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(answer_averages(*_with_ids(spark, sf)), "avg_prob")


@query("stock_cards", ROUTED_SQL + """,
placed AS (SELECT *, composite_rank / count(*) OVER () * 100 AS pct,
                  CAST(round_even((1 - composite_rank / count(*) OVER ()) * 100, 0) AS INTEGER) AS better FROM ranked)
SELECT r.src, r.id, r.stock, p.composite_rank, (SELECT count(*) FROM ranked) AS total,
       round(prob_up_1d, 6) + 0.0 AS prob_up_1d,
       CASE WHEN pct <= 5 THEN 'STRONG BUY' WHEN pct <= 20 THEN 'BUY' WHEN pct >= 95 THEN 'STRONG AVOID'
            WHEN pct >= 80 THEN 'AVOID' ELSE 'NEUTRAL' END AS signal, better AS better_than_pct, 100 - better AS top_pct,
       CASE WHEN vol_ratio > 1.3 THEN 'more jumpy than usual' WHEN vol_ratio < 0.7 THEN 'calmer than usual' ELSE 'normal' END AS volatility,
       CASE WHEN better >= 95 THEN 'strong' WHEN better <= 20 THEN 'weak' ELSE 'moderate' END AS strength
FROM routed r JOIN placed p USING (stock) WHERE r.route = 'stock'""")
def cards(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stock_cards(*_with_ids(spark, sf)), "prob_up_1d")


@query("ranking_overview", RANKING_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE composite_rank <= floor(t * 0.1)) AS strong_buy,
       count(*) FILTER (WHERE composite_rank >= t - floor(t * 0.1)) AS avoid,
       count(*) - count(*) FILTER (WHERE composite_rank <= floor(t * 0.1))
                - count(*) FILTER (WHERE composite_rank >= t - floor(t * 0.1)) AS neutral
FROM ranked, (SELECT count(*) AS t FROM ranked)""")
def ranking_overview(spark: SparkSession, sf: str) -> DataFrame:
    return overview(stage(brand_ranking(spark, sf), "ranking"))


# ---- the same questions over the forecast; supplier 7 stands for Brand#7 -----------------------------

FORECAST_ANSWERS_SQL = (FORECAST_SQL.replace("{gate}", "").replace("ranked AS (", "placed_rows AS (").replace(
    "FROM ranked)", "FROM placed_rows)") + """,
ranked AS MATERIALIZED (SELECT * REPLACE ('Brand#' || stock AS stock) FROM forecast)""" + ROUTED_SQL[len(RANKING_SQL):])


def _over_forecast(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], DataFrame]:
    ranked = block_forecast(spark, sf, TUESDAY).withColumn("stock", F.concat(F.lit("Brand#"), "stock"))
    ranked = stage(ranked, "forecast")
    return stage(routed(questions(spark, sf), IDS, ranked), "routed"), IDS, ranked


@query("forecast_answer_rows", FORECAST_ANSWERS_SQL + """
SELECT r.src, r.id, r.route, l.side, CAST(l.place AS INTEGER) AS place, l.stock, l.composite_rank,
       l.adj_ret_1d, l.adj_ret_5d, l.adj_ret_20d, l.prob_up_1d
FROM routed r JOIN leaders l
  ON l.place <= CASE r.route WHEN 'market' THEN 3 WHEN 'next_day' THEN 10 ELSE r.n END
 AND ((r.route = 'avoid' AND l.side = 'short') OR (r.route IN ('buy', 'next_day') AND l.side = 'long')
      OR r.route = 'market'
      OR (r.route = 'long_short' AND ((l.side = 'long' AND l.regime <> 'bear') OR (l.side = 'short' AND l.regime <> 'bull'))))""")
def rows_over_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return answer_rows(*_over_forecast(spark, sf))


@query("forecast_stock_cards", FORECAST_ANSWERS_SQL + """,
placed AS (SELECT *, composite_rank / count(*) OVER () * 100 AS pct, count(*) OVER () AS total,
                  CAST(round_even((1 - composite_rank / count(*) OVER ()) * 100, 0) AS INTEGER) AS better FROM ranked)
SELECT r.src, r.id, r.stock, p.composite_rank, p.total, p.prob_up_1d, p.prob_up_20d,
       CASE WHEN pct <= 5 THEN 'STRONG BUY' WHEN pct <= 20 THEN 'BUY' WHEN pct >= 95 THEN 'STRONG AVOID'
            WHEN pct >= 80 THEN 'AVOID' ELSE 'NEUTRAL' END AS signal, better AS better_than_pct, 100 - better AS top_pct,
       CASE WHEN vol_ratio > 1.3 THEN 'more jumpy than usual' WHEN vol_ratio < 0.7 THEN 'calmer than usual' ELSE 'normal' END AS volatility,
       CASE WHEN better >= 95 THEN 'strong' WHEN better <= 20 THEN 'weak' ELSE 'moderate' END AS strength
FROM routed r JOIN placed p USING (stock) WHERE r.route = 'stock'""")
def cards_over_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return stock_cards(*_over_forecast(spark, sf))


@query("next_day_answers", FORECAST_ANSWERS_SQL + f""",
counts AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE composite_rank <= floor(t * 0.1)) AS strong_buy,
         count(*) FILTER (WHERE composite_rank >= t - floor(t * 0.1)) AS avoid
  FROM ranked, (SELECT count(*) AS t FROM ranked))
SELECT src, id, total, strong_buy, avoid, total - strong_buy - avoid AS neutral, DATE '{TUESDAY}' + 1 AS next_day,
       (SELECT max(date) FROM panel) AS data_until
FROM routed, counts WHERE route = 'next_day'""")
def next_days(spark: SparkSession, sf: str) -> DataFrame:
    """The Wednesday after a Tuesday that is no holiday, and the last day of the data."""
    calendar = trading_calendar(spark, F.lit(TUESDAY), F.date_add(F.lit(TUESDAY), 30), holiday_table(spark))
    until = staged_panel(spark, sf).select(F.max("date")).scalar()
    return next_day_answers(*_over_forecast(spark, sf), until, calendar, F.lit(TUESDAY))
