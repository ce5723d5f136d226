"""Tokens, next-token distributions and scores."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.paths import sample_paths, score_with
from tickloom.operators.stats import compounded, expected_return
from tickloom.operators.tokens import (contexts, detokenise, sample_windows, sequences, tokenise,
                                       training_windows, window_index)
from tickloom.operators.transitions import (cross_entropy, expected_growth, pair_counts, probabilities,
                                            score_states, token_pairs, with_unseen)
from tickloom.queries.data import (CENTRE_SQL, TOKENS_SQL, growth_steps_sql, staged_panel)
from tickloom.queries.registry import query, rounded
from tickloom.staging import stage


@query("tokenise_returns", TOKENS_SQL + "SELECT stock, date, token FROM tokens")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenise(staged_panel(spark, sf))


@query("token_centres", TOKENS_SQL + f"""
SELECT stock, date, round({CENTRE_SQL.format(t='token')}, 6) + 0.0 AS centre FROM tokens""")
def centres(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(detokenise(tokens(spark, sf)).select("stock", "date", "centre"), "centre")


@query("token_sequences", TOKENS_SQL + """
SELECT stock, count(*)::INTEGER AS n, string_agg(token::VARCHAR, ' ' ORDER BY date) AS tokens
FROM tokens GROUP BY stock HAVING count(*) >= 257""")
def token_sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = sequences(tokens(spark, sf))
    return s.select("stock", F.size("tokens").alias("n"),
                    F.concat_ws(" ", F.col("tokens").cast("array<string>")).alias("tokens"))


@query("training_windows", TOKENS_SQL + """,
runs AS (SELECT stock, date, row_number() OVER (PARTITION BY stock ORDER BY date) - 1 AS start,
                list(token) OVER (PARTITION BY stock ORDER BY date ROWS BETWEEN CURRENT ROW AND 256 FOLLOWING) AS run
         FROM tokens)
SELECT stock, start::INTEGER AS start, run[1]::INTEGER AS first_x, list_sum(run[1:256])::BIGINT AS sum_x, list_sum(run[2:257])::BIGINT AS sum_y,
       run[257]::INTEGER AS last_y FROM runs WHERE len(run) = 257""")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    def total(c: str) -> F.Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, t: a + t)
    w = training_windows(tokens(spark, sf))
    return w.select("stock", "start", F.col("x")[0].cast("int").alias("first_x"), total("x").alias("sum_x"),
                    total("y").alias("sum_y"), F.element_at("y", -1).cast("int").alias("last_y"))


@query("window_index", TOKENS_SQL + """
SELECT stock, start::INTEGER AS start FROM (
  SELECT stock, row_number() OVER (PARTITION BY stock ORDER BY date) - 1 AS start,
         count(*) OVER (PARTITION BY stock) AS n FROM tokens) WHERE start < n - 256""")
def windows_index(spark: SparkSession, sf: str) -> DataFrame:
    return window_index(tokens(spark, sf))


@query("sample_windows", "SELECT replacement, CAST(64 AS BIGINT) AS n, CAST(64 AS BIGINT) AS n_right FROM (SELECT unnest([true, false]) AS replacement)")
def window_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Random batches of 64, with and without replacement: every window equals the enumerated one."""
    t = stage(tokens(spark, sf), "tokens")
    all_windows = stage(training_windows(t), "windows").select("stock", "start", F.col("x").alias("all_x"), F.col("y").alias("all_y"))
    both = None
    for again in (True, False):
        drawn = sample_windows(t, batch=64, seed=7, replacement=again).withColumn("replacement", F.lit(again))
        both = drawn if both is None else both.unionByName(drawn)
    right = (F.col("x") == F.col("all_x")) & (F.col("y") == F.col("all_y"))
    return both.join(all_windows, ["stock", "start"], "left").groupBy("replacement").agg(
        F.count("*").alias("n"), F.count_if(right).alias("n_right"))


@query("scoring_contexts", TOKENS_SQL + """,
recent AS (SELECT * FROM tokens QUALIFY row_number() OVER (PARTITION BY stock ORDER BY date DESC) <= 256)
SELECT stock, repeat('0 ', 256 - count(*)::INTEGER) || string_agg(token::VARCHAR, ' ' ORDER BY date) AS x
FROM recent GROUP BY stock""")
def scoring_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return contexts(tokens(spark, sf)).select("stock", F.concat_ws(" ", F.col("x").cast("array<string>")).alias("x"))


PAIRS_SQL = TOKENS_SQL + """,
pairs AS (
  SELECT * FROM (SELECT stock, date, lag(token) OVER (PARTITION BY stock ORDER BY date) AS prev,
                        token AS next FROM tokens) WHERE prev IS NOT NULL),
counts AS (SELECT prev, next, count(*) AS n FROM pairs GROUP BY ALL)
"""


@query("transition_counts", PAIRS_SQL + "SELECT prev, next, n FROM counts")
def transition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pair_counts(token_pairs(tokens(spark, sf)))


@query("sharpened_distribution", PAIRS_SQL + """,
kept AS (SELECT * FROM counts QUALIFY rank() OVER (PARTITION BY prev ORDER BY n DESC) <= 10),
weighted AS (SELECT prev, next, pow(n / sum(n) OVER (PARTITION BY prev), 1.25) AS w FROM kept)
SELECT prev, next, round(w / sum(w) OVER (PARTITION BY prev), 6) + 0.0 AS p FROM weighted""")
def sharpened_distribution(spark: SparkSession, sf: str) -> DataFrame:
    p = probabilities(pair_counts(token_pairs(tokens(spark, sf))), temperature=0.8, top_k=10)
    return rounded(p.select("prev", "next", "p"), "p")


SEAM = date(2000, 1, 1)


@query("token_cross_entropy", PAIRS_SQL + """,
train AS (SELECT prev, next, count(*) AS n FROM pairs WHERE date < DATE '2000-01-01' GROUP BY ALL),
held AS (SELECT stock, prev, next, count(*) AS times FROM pairs WHERE date >= DATE '2000-01-01' GROUP BY ALL),
scored AS (
  SELECT h.stock, h.times,
         -ln((coalesce(t.n, 0) + (coalesce(m.n, 0) + 1.0::DOUBLE) / ((SELECT sum(n) FROM train) + 402))
             / (coalesce(s.n, 0) + 1)) AS nll
  FROM held h LEFT JOIN train t USING (prev, next)
  LEFT JOIN (SELECT prev, sum(n) AS n FROM train GROUP BY prev) s ON s.prev = h.prev
  LEFT JOIN (SELECT next, sum(n) AS n FROM train GROUP BY next) m ON m.next = h.next)
SELECT stock, round(sum(nll * times) / sum(times), 6) + 0.0 AS cross_entropy, sum(times)::BIGINT AS n_pairs
FROM scored GROUP BY stock""")
def token_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stage(token_pairs(tokens(spark, sf)), "pairs")
    train = pair_counts(pairs.filter(F.col("date") < SEAM))
    return rounded(cross_entropy(train, pairs.filter(F.col("date") >= SEAM), ["stock"]), "cross_entropy")


EXACT_SQL = PAIRS_SQL + """,
counted AS (SELECT prev, next, n FROM counts
            UNION ALL SELECT -1, next, CAST(sum(n) AS BIGINT) FROM counts GROUP BY next),
weighted AS (SELECT prev, next, pow(n / sum(n) OVER (PARTITION BY prev), 1.25) AS w FROM counted),
prob AS (SELECT prev, next, w / sum(w) OVER (PARTITION BY prev) AS p FROM weighted),
linked AS (
  SELECT a.prev, CASE WHEN s.prev IS NULL THEN -1 ELSE a.next END AS state,
         a.p * (1 + greatest(""" + CENTRE_SQL.format(t="a.next") + """, -0.9999)) AS gain
  FROM prob a LEFT JOIN (SELECT DISTINCT prev FROM prob) s ON s.prev = a.next)
""" + growth_steps_sql(3, "") + """,
last AS (SELECT stock, arg_max(token, date) AS token FROM tokens GROUP BY stock)
"""


@query("exact_expected_score", EXACT_SQL + """
SELECT l.stock, l.token, round(coalesce(e.g, u.g) - 1, 6) + 0.0 AS score
FROM last l LEFT JOIN e3 e ON e.state = l.token LEFT JOIN e3 u ON u.state = -1""")
def exact_expected_score(spark: SparkSession, sf: str) -> DataFrame:
    t = stage(tokens(spark, sf), "tokens")
    probs = probabilities(with_unseen(pair_counts(token_pairs(t))), temperature=0.8)
    last = t.groupBy("stock").agg(F.max_by("token", "date").alias("token"))
    return rounded(score_states(last, expected_growth(probs, 3)).select("stock", "token", "score"), "score")


@query("sampled_expected_score", TOKENS_SQL + "SELECT stock, true AS close_to_exact FROM tokens GROUP BY stock")
def sampled_expected_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean compounded return of 200 sampled five-day paths per stock, within six standard errors of the exact score."""
    t = stage(tokens(spark, sf), "tokens")
    probs = probabilities(with_unseen(pair_counts(token_pairs(t))), temperature=0.8)
    states = (t.groupBy("stock").agg(F.max_by("token", "date").alias("token"))
              .withColumn("vol_ratio", F.lit(1.0)))
    paths = stage(sample_paths(states, probs, 5, 200, seed=1), "paths")
    error = paths.groupBy("stock").agg((F.stddev_samp(compounded(F.col("rets"), 5)) / F.sqrt(F.count("*"))).alias("error"))
    exact = score_states(states.select("stock", "token"), expected_growth(probs, 5)).select("stock", F.col("score").alias("exact"))
    near = F.abs(F.col("score") - F.col("exact")) <= 6 * F.col("error") + 1e-9
    return (expected_return(paths, 5).join(error, "stock").join(exact, "stock")
            .select("stock", near.alias("close_to_exact")))


def mean_token_model():
    """Smallest possible plug-in: the mean centre of the known tokens of a context."""
    def score(x: np.ndarray) -> np.ndarray:
        known = x > 0
        centre = (x - 0.5) * 0.005 - 1.0
        return (centre * known).sum(axis=1) / known.sum(axis=1)
    return score


@query("plugged_in_model", TOKENS_SQL + """,
recent AS (SELECT * FROM tokens QUALIFY row_number() OVER (PARTITION BY stock ORDER BY date DESC) <= 256)
SELECT stock, round(avg((token - 0.5) * 0.005::DOUBLE - 1.0), 6) + 0.0 AS score FROM recent GROUP BY stock""")
def plugged_in_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(score_with(contexts(tokens(spark, sf)), mean_token_model), "score")
