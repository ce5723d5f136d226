"""Next-token distributions from counted transitions.

Sizes here are bounded by the vocabulary: at most 402 x 402 pairs, per period where there are
periods. ``UNSEEN`` is the state of a token that never had a successor so far; it moves by the
marginal distribution of all successors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.scalar import LOG_FLOOR, VOCABULARY, centre_of
from tickloom.staging import stage

UNSEEN = -1


def token_pairs(tokens: DataFrame) -> DataFrame:
    """(stock, date, prev, next): every token with its predecessor; dated by the later one."""
    before = F.lag("token").over(W.partitionBy("stock").orderBy("date"))
    return (tokens.withColumn("prev", before).filter(F.col("prev").isNotNull())
            .select("stock", "date", "prev", F.col("token").alias("next")))


def pair_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or []), "prev", "next").agg(F.count("*").alias("n"))


def cumulative_counts(pairs: DataFrame, days: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, prev, next, n): counts over all pairs known at each rebalance date.

    Counts are taken once per period and summed along periods, so history is read once rather
    than once per period.
    """
    last = periods.select(F.max("period")).scalar()
    known = days.filter(F.col("known_at").isNotNull()).select("date", F.col("known_at").alias("period"))
    new = pair_counts(pairs.join(F.broadcast(known), "date"), ["period"])
    along = W.partitionBy("prev", "next").orderBy("period")
    return (new.withColumn("n", F.sum("n").over(along.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("until", F.coalesce(F.lead("period").over(along) - 1, last))
            .select(F.explode(F.sequence("period", "until")).alias("period"), "prev", "next", "n"))


def with_unseen(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds the marginal distribution as the successors of ``UNSEEN``."""
    by = by or []
    marginal = (counts.groupBy(*by, "next").agg(F.sum("n").alias("n"))
                .select(*by, F.lit(UNSEEN).alias("prev"), "next", "n"))
    return counts.select(*by, "prev", "next", "n").unionByName(marginal)


def probabilities(counts: DataFrame, by: list[str] | None = None, temperature: float = 1.0,
                  top_k: int | None = None) -> DataFrame:
    """Adds ``p``: counts sharpened by p^(1/T); ``top_k`` keeps every token tied with the k-th."""
    state = W.partitionBy(*(by or []), "prev")
    if top_k is not None:
        counts = (counts.withColumn("place", F.rank().over(state.orderBy(F.desc("n"))))
                  .filter(F.col("place") <= top_k).drop("place"))
    share = F.col("n") / F.sum("n").over(state)
    return (counts.withColumn("w", F.pow(share, F.lit(1.0 / temperature)))
            .withColumn("p", F.col("w") / F.sum("w").over(state)).drop("w"))


def cross_entropy(train: DataFrame, held_out: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean -ln p(next | prev) over held-out pairs.

    Backs off one count's worth to the add-one marginal, so that no pair has probability 0.
    """
    by = by or []
    n_prev = train.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    n_next = train.groupBy("next").agg(F.sum("n").alias("n_next"))
    total = F.coalesce(train.select(F.sum("n")).scalar(), F.lit(0))
    cells = pair_counts(held_out, by).withColumnRenamed("n", "times")
    marginal = (F.coalesce("n_next", F.lit(0)) + 1) / (total + VOCABULARY)
    p = (F.coalesce("n", F.lit(0)) + marginal) / (F.coalesce("n_prev", F.lit(0)) + 1)
    return (cells.join(F.broadcast(train), ["prev", "next"], "left")
            .join(F.broadcast(n_prev), "prev", "left").join(F.broadcast(n_next), "next", "left")
            .withColumn("nll", -F.log(p) * F.col("times"))
            .groupBy(*by).agg((F.sum("nll") / F.sum("times")).alias("cross_entropy"),
                              F.sum("times").alias("n_pairs")))


def linked(probs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``state``: the next token where it has successors of its own, else ``UNSEEN``."""
    by = by or []
    seen = probs.select(*by, F.col("prev").alias("next")).distinct().withColumn("seen", F.lit(True))
    return (probs.join(seen, [*by, "next"], "left")
            .withColumn("state", F.when(F.col("seen"), F.col("next")).otherwise(UNSEEN))
            .drop("seen"))


def expected_growth(probs: DataFrame, horizon: int, by: list[str] | None = None,
                    horizons: DataFrame | None = None) -> DataFrame:
    """(by, state, growth): exact mean growth over ``horizon`` steps from each state.

    The limit of the mean over sampled paths: E_h(s) = sum p(s -> s') (1 + centre(s')) E_{h-1}(s').
    ``horizons(by, horizon)`` may set a shorter horizon per group: the steps before its last
    ``horizon`` ones then count as growth 1, so all groups share one chain of joins. The
    transition table is staged because every step reads it.
    """
    by = by or []
    gain = F.col("p") * (F.greatest(centre_of(F.col("next")), F.lit(LOG_FLOOR)) + 1)
    table = linked(probs, by).select(*by, "prev", "state", gain.alias("gain"))
    if horizons is not None:
        table = table.join(F.broadcast(horizons), by).withColumn("idle", horizon - F.col("horizon"))
    else:
        table = table.withColumn("idle", F.lit(0))
    table = stage(table.select(*by, "prev", "state", "gain", "idle"), "transitions")
    reached = table.groupBy(*by, "prev").agg(F.sum("gain").alias("growth"))
    for step in range(2, horizon + 1):
        onward = F.when(F.col("idle") >= step - 1, 1.0).otherwise(F.col("growth"))
        reached = (table.join(reached.withColumnRenamed("prev", "state"), [*by, "state"])
                   .groupBy(*by, "prev").agg(F.sum(F.col("gain") * onward).alias("growth")))
    return reached.select(*by, F.col("prev").alias("state"), "growth")


SENT = 1_000_000          # rows of a growth table that are sent to every executor


def score_states(states: DataFrame, growth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ``score`` to rows ``(by, stock, token)``: expected growth - 1, unseen tokens backed off."""
    by = by or []
    growth = stage(growth, "growth")           # read twice
    own = growth.filter(F.col("state") != UNSEEN).withColumnRenamed("state", "token")
    fallback = growth.filter(F.col("state") == UNSEEN).select(*by, F.col("growth").alias("fallback"))
    # one row for each token and period; most stocks share a few tokens, so they stay where they are while there
    # are not too many periods, and are else joined by shuffle, where the rows of a period are spread by token
    few = growth.count() <= SENT
    scored = states.join(F.broadcast(own) if few else own, [*by, "token"], "left")
    if by:
        scored = scored.join(F.broadcast(fallback), by, "left")      # one row a period
    else:
        scored = scored.withColumn("fallback", fallback.select("fallback").scalar())
    return scored.withColumn("score", F.coalesce("growth", "fallback") - 1).drop("growth", "fallback")
