"""Sampled return paths and the plug-in point for other scorers.

A path is a chain of draws where each depends on the last, so it is stepped with numpy inside
Spark tasks: one vectorised step per day over a whole Arrow batch. Every uniform number is a hash
of (seed, stock, path, day), so neither partitioning nor a lost and repeated task changes a path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scalar import LOG_FLOOR, VOCABULARY, centre_of
from tickloom.operators.transitions import UNSEEN

_ROWS_PER_STEP = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(stock_hash: np.ndarray, path: np.ndarray, day: int) -> np.ndarray:
    key = stock_hash.astype(np.int64).view(np.uint64) ^ _mixed(path.astype(np.uint64))
    step = np.uint64(0x9E3779B97F4A7C15 * (day + 1) % (1 << 64))
    key = _mixed(key + step)
    return (key >> np.uint64(11)) * (1.0 / (1 << 53))


def _step_table(probs: DataFrame) -> dict[str, np.ndarray]:
    """The transition table as flat arrays, one ascending run of ``row + cdf`` per state.

    At most (402 + 1) x 402 rows by the size of the vocabulary, checked before use.
    """
    limit = (VOCABULARY + 1) * VOCABULARY
    rows = (probs.select("prev", "next", "p", centre_of(F.col("next")).alias("centre"))
            .limit(limit + 1).toPandas().sort_values(["prev", "next"], kind="stable"))
    if len(rows) > limit:
        raise ValueError("more transitions than the vocabulary allows")
    states, row = np.unique(rows["prev"].to_numpy(), return_inverse=True)
    cdf = rows.groupby("prev")["p"].cumsum().to_numpy()
    last = np.r_[row[1:] != row[:-1], True]
    cdf[last] = 1.0
    row_of = np.full(VOCABULARY, np.searchsorted(states, UNSEEN))
    seen = states >= 0
    row_of[states[seen]] = np.flatnonzero(seen)
    return {"key": row + cdf, "next": rows["next"].to_numpy(), "row_of": row_of,
            "centre": rows["centre"].to_numpy()}


def sample_paths(states: DataFrame, probs: DataFrame, days: int, n_paths: int = 200,
                 seed: int = 0) -> DataFrame:
    """(stock, path, rets) from ``states(stock, token, vol_ratio)``.

    ``probs`` must hold the ``UNSEEN`` state (``with_unseen``). Each drawn token's centre is
    scaled by the stock's volatility ratio.
    """
    spark = states.sparkSession
    table = spark.sparkContext.broadcast(_step_table(probs))
    # few small rows become n_paths times as many: spread them first, in a number of partitions
    # that adaptive execution does not merge again
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    started = (states.repartition(spread, "stock")
               .select("stock", F.xxhash64("stock", F.lit(seed)).alias("h"),
                       F.col("token").cast("int").alias("token"), "vol_ratio")
               .withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1)))))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        for whole in batches:
            for at in range(0, len(whole), _ROWS_PER_STEP):
                rows = whole.iloc[at:at + _ROWS_PER_STEP]
                token = rows["token"].to_numpy()
                h, path = rows["h"].to_numpy(), rows["path"].to_numpy()
                scale = rows["vol_ratio"].to_numpy()
                rets = np.empty((len(rows), days))
                for day in range(days):
                    u = uniforms(h, path, day)
                    hit = np.searchsorted(t["key"], t["row_of"][token] + u, side="right")
                    rets[:, day] = t["centre"][hit] * scale
                    token = t["next"][hit]
                yield pd.DataFrame({"stock": rows["stock"].to_numpy(), "path": path,
                                    "rets": list(rets)})

    return started.mapInPandas(walk, "stock string, path int, rets array<double>")


def score_with(contexts: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]],
               batch: int = 32, profile: ResourceProfile | None = None) -> DataFrame:
    """Run any model over ``contexts(stock, x)``; ``load`` is called once per task.

    The loaded callable maps an integer matrix (rows x block) to one score per row. With ``profile``, a stage's
    resources (say, a GPU a task), the model runs where these are, and its rows are dealt over such tasks first.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for whole in batches:
            for at in range(0, len(whole), batch):
                rows = whole.iloc[at:at + batch]
                x = np.stack(rows["x"].to_numpy()).astype(np.int64)
                yield pd.DataFrame({"stock": rows["stock"].to_numpy(),
                                    "score": np.asarray(model(x), dtype=float)})

    rows = contexts.select("stock", "x")
    if profile is None:
        return rows.mapInPandas(run, "stock string, score double")
    # a stage of its own, so that what is before it doesn't hold the accelerators
    return rows.repartition("stock").mapInPandas(run, "stock string, score double", profile=profile)


def growth_of(rets: np.ndarray) -> np.ndarray:
    """Compounded return of each row of a return matrix."""
    return np.expm1(np.log1p(np.maximum(rets, LOG_FLOOR)).sum(axis=1))
