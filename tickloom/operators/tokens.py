"""Return tokens, their sequences, training windows and scoring contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.scalar import PAD_TOKEN, centre_of, token_of
from tickloom.staging import stage

BLOCK = 256


def tokenise(panel: DataFrame, value: str = "return_1d") -> DataFrame:
    """(stock, date, token) of the days that have a return; days without one vanish."""
    return (panel.filter(F.col(value).isNotNull())
            .select("stock", "date", token_of(F.col(value)).alias("token")))


def detokenise(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("centre", centre_of(F.col("token")))


def numbered(tokens: DataFrame) -> DataFrame:
    """Adds ``pos`` (from 0) and ``n_tokens`` of the stock."""
    return (tokens.withColumn("pos", F.row_number().over(W.partitionBy("stock").orderBy("date")) - 1)
            .withColumn("n_tokens", F.count("*").over(W.partitionBy("stock"))))


def sequences(tokens: DataFrame, min_len: int = BLOCK + 1) -> DataFrame:
    """One array of tokens per stock in date order: one entry per traded day."""
    ordered = F.sort_array(F.collect_list(F.struct("date", "token")))
    return (tokens.groupBy("stock").agg(ordered.alias("s"))
            .select("stock", F.col("s.token").cast("array<smallint>").alias("tokens"))
            .filter(F.size("tokens") >= min_len))


def training_windows(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every (x, y) window: ``block`` tokens and the same shifted by one day."""
    ahead = W.partitionBy("stock").orderBy("date").rowsBetween(0, block)
    run = (numbered(tokens).withColumn("run", F.collect_list(F.col("token").cast("smallint")).over(ahead))
           .filter(F.size("run") == block + 1))
    return run.select("stock", F.col("pos").alias("start"),
                      F.slice("run", 1, block).alias("x"), F.slice("run", 2, block).alias("y"))


def window_index(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stock, start) of every training window, without the windows themselves."""
    return (numbered(tokens).filter(F.col("pos") < F.col("n_tokens") - block)
            .select("stock", F.col("pos").alias("start")))


SLOTS = 4096


def _drawn_windows(tokens: DataFrame, batch: int, block: int, seed: int) -> DataFrame:
    """(draw, stock, start): seeded draws with replacement, uniform over all windows.

    Windows are numbered without listing them: stocks lie in hashed slots, a slot starts where
    the ones before it end, and a stock where its slot's earlier stocks end.
    """
    sizes = (tokens.groupBy("stock").agg((F.count("*") - block).alias("n")).filter(F.col("n") > 0)
             .withColumn("slot", F.pmod(F.xxhash64("stock"), F.lit(SLOTS)).cast("int")))
    slots = sizes.groupBy("slot").agg(F.sum("n").alias("in_slot"))           # at most SLOTS rows
    ends = F.sum("in_slot").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))
    slots = slots.withColumn("end", ends).withColumn("begin", F.col("end") - F.col("in_slot"))
    in_order = F.sort_array(F.collect_list(F.struct("end", "slot")))
    table = slots.agg(in_order.alias("slots"), F.max("end").alias("total"))
    draws = (tokens.sparkSession.range(batch).withColumnRenamed("id", "draw")
             .withColumn("u", F.pmod(F.xxhash64("draw", F.lit(seed)), table.select("total").scalar()))
             .withColumn("slots", table.select("slots").scalar())
             .withColumn("slot", F.filter("slots", lambda s: s["end"] > F.col("u"))[0]["slot"])
             .drop("slots")
             .join(F.broadcast(slots.select("slot", "begin")), "slot")
             .withColumn("u", F.col("u") - F.col("begin")))
    upto = W.partitionBy("slot").orderBy("stock").rowsBetween(W.unboundedPreceding, 0)
    owners = sizes.withColumn("high", F.sum("n").over(upto)).withColumn("low", F.col("high") - F.col("n"))
    return (owners.join(draws, "slot")
            .filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
            .select("draw", "stock", (F.col("u") - F.col("low")).alias("start")))


def _distinct_windows(tokens: DataFrame, batch: int, block: int, seed: int) -> DataFrame:
    """(draw, stock, start): the first ``batch`` different windows of a sequence of draws; all, if there are no more.

    Draws that repeat a window are passed over, so every set of windows is as likely as any other. A draw costs the same
    whatever the number of windows; only a batch of half of all windows or more is taken from their list.
    """
    sizes = tokens.groupBy("stock").agg((F.count("*") - block).alias("n")).filter(F.col("n") > 0)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= 2 * batch:
        return (window_index(tokens, block).orderBy(F.xxhash64("stock", "start", F.lit(seed)), "stock", "start").limit(batch)
                .withColumn("draw", F.monotonically_increasing_id()))
    draws = 2 * batch
    while True:
        found = (_drawn_windows(tokens, draws, block, seed).groupBy("stock", "start").agg(F.min("draw").alias("draw"))
                 .orderBy("draw").limit(batch).select("draw", "stock", "start"))
        found = stage(found, "distinct-draws")
        if found.count() == batch:
            return found
        draws *= 2


def sample_windows(tokens: DataFrame, batch: int, block: int = BLOCK, seed: int = 0,
                   replacement: bool = True) -> DataFrame:
    """A seeded random batch of training windows, uniform over all of them.

    So a stock is met in proportion to its number of windows. Only (stock, start) pairs are drawn, with or without
    replacement, and the tokens are fetched for the ``batch`` chosen pairs alone.
    """
    chosen = (_drawn_windows if replacement else _distinct_windows)(tokens, batch, block, seed)
    chosen = stage(chosen, "drawn")
    held = tokens.join(chosen.select("stock").distinct(), "stock", "left_semi")
    inside = (numbered(held).join(chosen, "stock")
              .filter(F.col("pos").between(F.col("start"), F.col("start") + block)))
    run = F.sort_array(F.collect_list(F.struct("pos", F.col("token").cast("smallint").alias("token"))))
    return (inside.groupBy("draw", "stock", "start").agg(run.alias("run"))
            .select("stock", F.col("start").cast("int").alias("start"),
                    F.slice("run.token", 1, block).alias("x"), F.slice("run.token", 2, block).alias("y")))


def contexts(tokens: DataFrame, block: int = BLOCK, padded: bool = True,
             min_tokens: int = 1) -> DataFrame:
    """The last ``block`` tokens of each stock, zero-padded on the left if asked."""
    n = F.count("*").over(W.partitionBy("stock"))
    newest = W.partitionBy("stock").orderBy(F.desc("date"))
    recent = (tokens.withColumn("age", F.row_number().over(newest)).withColumn("n_tokens", n)
              .filter((F.col("age") <= block) & (F.col("n_tokens") >= min_tokens)))
    run = F.sort_array(F.collect_list(F.struct("date", F.col("token").cast("smallint").alias("token"))))
    got = recent.groupBy("stock").agg(run.alias("run")).select("stock", F.col("run.token").alias("x"))
    if padded:
        zeros = F.array_repeat(F.lit(PAD_TOKEN).cast("smallint"), F.lit(block) - F.size("x"))
        got = got.withColumn("x", F.concat(zeros, "x"))
    return got
