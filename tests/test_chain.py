from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.paths import _step_table, growth_of, sample_paths, score_with, uniforms
from tickloom.operators.tokens import contexts, sample_windows, sequences, tokenise, training_windows, window_index
from tickloom.operators.transitions import (UNSEEN, cross_entropy, expected_growth, pair_counts, probabilities,
                                            token_pairs, with_unseen)
from tickloom.plans.backtest import backtest, staged_calendar, walk_forward_scores

D0 = date(2020, 1, 1)


def random_panel(spark, stocks=30, days=300, seed=5, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(stocks):
        for i in range(days):
            if gaps and rng.random() < 0.1:
                continue
            rows.append((D0 + timedelta(days=i), f"s{s:02d}", float(np.round(rng.normal(0, 0.008), 6))))
    return spark.createDataFrame(rows, "date date, stock string, return_1d double")


def centres(t):
    return -1.0 + (np.asarray(t) - 0.5) * 0.005


@pytest.fixture(scope="module")
def tokens(spark):
    t = tokenise(random_panel(spark, stocks=6)).cache()
    yield t
    t.unpersist()


def by_stock(tokens):
    return {s: g.sort_values("date")["token"].to_numpy() for s, g in tokens.toPandas().groupby("stock")}


def test_windows_and_sequences(spark, tokens):
    seqs = by_stock(tokens)
    got = {r.stock: r.tokens for r in sequences(tokens, 257).collect()}
    assert {s: list(t) for s, t in seqs.items() if len(t) >= 257} == got
    w = {(r.stock, r.start): (r.x, r.y) for r in training_windows(tokens, 64).collect()}
    assert len(w) == sum(len(t) - 64 for t in seqs.values())
    for (s, at), (x, y) in list(w.items())[:50]:
        assert x == seqs[s][at:at + 64].tolist() and y == seqs[s][at + 1:at + 65].tolist()
    assert window_index(tokens, 64).count() == len(w)
    batch = sample_windows(tokens, 20, 64, seed=1, replacement=False).collect()
    assert len({(r.stock, r.start) for r in batch}) == 20
    assert all((r.x, r.y) == w[r.stock, r.start] for r in batch)
    again = sample_windows(tokens.repartition(3), 20, 64, seed=1, replacement=False).collect()
    assert {(r.stock, r.start) for r in batch} == {(r.stock, r.start) for r in again}


def test_windows_drawn_with_replacement(spark, tokens):
    seqs = by_stock(tokens)
    block = 200
    sizes = {s: len(t) - block for s, t in seqs.items()}
    batch = sample_windows(tokens, 3000, block, seed=4).collect()
    assert len(batch) == 3000
    assert all(r.x == seqs[r.stock][r.start:r.start + block].tolist() for r in batch[:100])
    assert all(r.y == seqs[r.stock][r.start + 1:r.start + block + 1].tolist() for r in batch[:100])
    total = sum(sizes.values())
    for s, n in sizes.items():
        starts = [r.start for r in batch if r.stock == s]
        assert len(starts) == pytest.approx(3000 * n / total, abs=5 * np.sqrt(3000 * n / total))
        assert min(starts) >= 0 and max(starts) < n and len(set(starts)) == n


def test_contexts(spark, tokens):
    seqs = by_stock(tokens)
    for r in contexts(tokens, 300).collect():
        assert r.x == [0] * (300 - len(seqs[r.stock])) + seqs[r.stock].tolist()
    for r in contexts(tokens, 10, padded=False).collect():
        assert r.x == seqs[r.stock][-10:].tolist()


def test_top_k_keeps_ties(spark):
    counts = spark.createDataFrame([(1, 10, 5), (1, 11, 3), (1, 12, 3), (1, 13, 1)], "prev int, next int, n bigint")
    got = {r.next: r.p for r in probabilities(counts, temperature=0.8, top_k=2).collect()}
    w = np.array([5, 3, 3]) ** 1.25
    assert set(got) == {10, 11, 12} and list(got[k] for k in (10, 11, 12)) == pytest.approx(w / w.sum())


def model(tokens, temperature=0.8):
    return probabilities(with_unseen(pair_counts(token_pairs(tokens))), temperature=temperature)


def brute_growth(probs: pd.DataFrame, horizon: int) -> dict[int, float]:
    table = {s: (g["next"].to_numpy(), g["p"].to_numpy()) for s, g in probs.groupby("prev")}
    growth = {s: 1.0 for s in table}
    for _ in range(horizon):
        growth = {s: float(sum(p * (1 + centres(n)) * growth[n if n in table else UNSEEN]
                               for n, p in zip(*table[s]))) for s in table}
    return growth


def test_expected_growth(spark, tokens):
    probs = model(tokens)
    want = brute_growth(probs.toPandas(), 4)
    got = {r.state: r.growth for r in expected_growth(probs, 4).collect()}
    assert set(got) == set(want)
    assert all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)


def test_shorter_horizons_per_group(spark, tokens):
    probs = model(tokens)
    grouped = probs.withColumn("period", F.explode(F.array(F.lit(1), F.lit(2))))
    horizons = spark.createDataFrame([(1, 1), (2, 3)], "period int, horizon int")
    got = {(r.period, r.state): r.growth for r in expected_growth(grouped, 3, ["period"], horizons).collect()}
    for period, h in ((1, 1), (2, 3)):
        want = brute_growth(probs.toPandas(), h)
        assert all(got[period, s] == pytest.approx(want[s], rel=1e-12) for s in want)


def test_sampled_paths(spark, tokens):
    probs = model(tokens)
    states = (tokens.groupBy("stock").agg(F.max_by("token", "date").alias("token"))
              .withColumn("vol_ratio", F.when(F.col("stock") == "s00", 2.0).otherwise(1.0)))
    paths = sample_paths(states, probs, 5, 400, seed=9).toPandas().sort_values(["stock", "path"])
    assert len(paths) == 6 * 400
    other = sample_paths(states.repartition(5), probs, 5, 400, seed=9).toPandas().sort_values(["stock", "path"])
    assert np.array_equal(np.stack(paths["rets"]), np.stack(other["rets"]))
    # the same draws by a plain walk over the distribution
    table = {s: (g["next"].to_numpy(), g["p"].cumsum().to_numpy())
             for s, g in probs.toPandas().sort_values(["prev", "next"]).groupby("prev")}
    first = states.withColumn("h", F.xxhash64("stock", F.lit(9))).toPandas()
    for row in first.itertuples():
        own = np.stack(paths[paths.stock == row.stock]["rets"])
        for path in range(0, 400, 57):
            token = row.token
            for day in range(5):
                u = uniforms(np.array([row.h]), np.array([path]), day)[0]
                nxt, cdf = table[token if token in table else UNSEEN]
                token = nxt[min(np.searchsorted(cdf, u, side="right"), len(nxt) - 1)]
                assert own[path, day] == pytest.approx(centres(token) * row.vol_ratio, abs=1e-12)
    # their mean nears the exact expectation
    exact = brute_growth(probs.toPandas(), 5)
    for row in first[first.stock != "s00"].itertuples():
        mean = growth_of(np.stack(paths[paths.stock == row.stock]["rets"])).mean()
        assert mean == pytest.approx(exact[row.token] - 1, abs=0.006)


def test_step_table_is_bounded(spark):
    too_many = spark.range(403 * 402 + 1).select(F.col("id").cast("int").alias("prev"), F.lit(1).alias("next"), F.lit(1.0).alias("p"))
    with pytest.raises(ValueError):
        _step_table(too_many)


def test_cross_entropy(spark):
    train = spark.createDataFrame([(1, 2, 3), (1, 3, 1)], "prev int, next int, n bigint")
    held = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 9, 2), ("a", 1, 7)], "stock string, prev int, next int")
    row = cross_entropy(train, held).collect()[0]
    m2, m7 = (3 + 1) / (4 + 402), 1 / (4 + 402)
    want = -(2 * np.log((3 + m2) / 5) + np.log(m2 / 1) + np.log(m7 / 5)) / 4
    assert row.cross_entropy == pytest.approx(want) and row.n_pairs == 4


def test_plugged_in_model(spark, tokens):
    got = {r.stock: r.score for r in score_with(contexts(tokens, 16), lambda: lambda x: x[:, -1] * 1.0, batch=2).collect()}
    assert got == {s: float(t[-1]) for s, t in by_stock(tokens).items()}


def brute_scores(wide: pd.DataFrame, start: date, horizon: int, min_tokens: int, temperature: float):
    """Scores per rebalance date by a plain loop over dates."""
    edges = np.linspace(-1, 1, 401)
    days = [d for d in wide.index if d >= start]
    firsts = [min(d for d in days if (d.year, d.month) == m) for m in sorted({(d.year, d.month) for d in days})]
    out = {}
    for reb, nxt in zip(firsts, firsts[1:]):
        h = min(sum(reb < d <= nxt for d in days), horizon)
        seqs = {s: np.digitize(wide.loc[wide.index <= reb, s].dropna().to_numpy(), edges) for s in wide}
        pairs = pd.DataFrame([(a, b) for q in seqs.values() for a, b in zip(q, q[1:])], columns=["prev", "next"])
        both = pd.concat([pairs, pairs.assign(prev=UNSEEN)])
        n = both.value_counts().rename("n").reset_index()
        n["w"] = (n["n"] / n.groupby("prev")["n"].transform("sum")) ** (1 / temperature)
        n["p"] = n["w"] / n.groupby("prev")["w"].transform("sum")
        growth = brute_growth(n, h)
        for s, q in seqs.items():
            if len(q) >= min_tokens:
                out[reb, s] = growth.get(q[-1], growth[UNSEEN]) - 1
    return out


def test_walk_forward_equals_a_loop_over_dates(spark):
    p = random_panel(spark, stocks=22, days=260).filter(~((F.col("stock") == "s03") & (F.col("date") > "2020-07-20")))
    p = p.cache()
    start = date(2020, 6, 1)
    _, periods, days = staged_calendar(p, start)
    got = walk_forward_scores(p, periods, days, horizon=3).join(periods, "period").collect()
    wide = p.toPandas().pivot(index="date", columns="stock", values="return_1d")
    want = brute_scores(wide, start, 3, 100, 0.8)
    assert {(r.reb_date, r.stock) for r in got} == set(want)
    assert max(abs(r.score - want[r.reb_date, r.stock]) for r in got) < 1e-12
    # a delisted stock keeps its last state; changing the future leaves earlier scores as they are
    cut = date(2020, 7, 15)
    changed = p.withColumn("return_1d", F.when(F.col("date") > cut, -F.col("return_1d")).otherwise(F.col("return_1d")))
    _, periods2, days2 = staged_calendar(changed, start)
    later = {(r.reb_date, r.stock): r.score
             for r in walk_forward_scores(changed, periods2, days2, horizon=3).join(periods2, "period").collect()}
    early = [(r.reb_date, r.stock, r.score) for r in got if r.reb_date <= cut]
    assert early and all(abs(later[d, s] - x) < 1e-12 for d, s, x in early)
    assert any(abs(later[r.reb_date, r.stock] - r.score) > 1e-9 for r in got if r.reb_date > cut)


def test_backtest_equals_a_loop_over_dates(spark):
    p = random_panel(spark, stocks=35, days=260, gaps=False).cache()
    start = date(2020, 6, 1)
    b = backtest(p, start, horizon=2)
    wide = p.toPandas().pivot(index="date", columns="stock", values="return_1d")
    want = brute_scores(wide, start, 2, 100, 0.8)
    rebs = sorted({d for d, _ in want})
    results = {r.date: r for r in b.results.collect()}
    assert sorted(results) == rebs
    ends = dict(zip(rebs, rebs[1:] + [date(2020, 9, 1)]))
    for reb in rebs:
        scores = pd.Series({s: x for (d, s), x in want.items() if d == reb}).round(12)
        future = wide[(wide.index > reb) & (wide.index <= ends[reb])]
        rank, n = scores.rank(ascending=False), len(scores)
        k = max(1, int(n * 10 / 100))
        long = future[scores[rank <= k].index].mean(axis=1).mean() - 0.001
        short = future[scores[rank > n - k].index].mean(axis=1).mean() - 0.001
        r = results[reb]
        assert (r.long_ret is None) == bool(np.isnan(long)) and (r.short_ret is None) == bool(np.isnan(short))
        if not np.isnan(long):
            assert r.long_ret == pytest.approx(long, abs=1e-12)
        if not np.isnan(long) and not np.isnan(short):
            assert r.ls_ret == pytest.approx(long - short, abs=1e-12)
    assert {r.label for r in b.summary.collect()} <= {"Long-Short Portfolio", "Long-Only Portfolio", "Short-Only Portfolio"}
    assert b.fama_macbeth.collect()[0].n_periods == len(rebs)
    assert {r.name for r in b.factor_summary.collect()} == {"score", "momentum", "reversal", "volatility"}
    assert b.factor_coefficients.count() == len(rebs)
