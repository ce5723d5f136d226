from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tickloom.operators.asof import asof_join

T0 = datetime(2024, 1, 1)
LEFT, RIGHT = "id int, stock string, at timestamp", "stock string, seen timestamp, close double, n int"


def plain(left, right, strict):
    out = []
    for i, s, t in left:
        held = [(seen, c if c is not None else float("-inf"), c, n) for k, seen, c, n in right if s is not None and t is not None and k == s and seen is not None
                and (seen < t if strict else seen <= t)]
        best = max(held, default=None, key=lambda r: r[:2])
        out.append((i, best[0] if best else None, best[2] if best else None))
    return sorted(out)


def tables(seed, n):
    """Half of all rows are of one stock; times repeat, also between the tables."""
    rng = np.random.default_rng(seed)
    name = lambda: "hot" if rng.random() < 0.5 else f"s{rng.integers(0, 9)}"
    at = lambda: T0 + timedelta(minutes=int(rng.integers(0, n // 2)))
    left = [(i, name(), at()) for i in range(n)] + [(n, None, T0), (n + 1, "hot", None), (n + 2, "unknown", T0)]
    right = [(name(), at(), float(i), i) for i in range(n)] + [(None, T0, 1.0, 0), ("hot", None, 2.0, 0)]
    return left, right


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tasks", [None, 1, 13])
def test_against_plain_search(spark, strict, tasks):
    left, right = tables(3, 400)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # keeps the ranges apart
    try:
        got = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "stock", "at", strict, "seen", tasks=tasks).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert sorted((r.id, r.seen, r.close) for r in got) == plain(left, right, strict)


def test_a_hot_key_is_spread(spark, monkeypatch):
    from tickloom.operators import asof
    staged = {}
    plain_stage = asof.stage
    monkeypatch.setattr(asof, "stage", lambda df, label: staged.setdefault(label, plain_stage(df, label)))
    left = spark.range(4000).selectExpr("CAST(id AS INT) AS id", "'hot' AS stock", "timestamp_seconds(id) AS at")
    right = spark.range(50).selectExpr("'hot' AS stock", "timestamp_seconds(id * 80 + 1) AS seen", "CAST(id AS DOUBLE) AS close")
    got = asof_join(left, right, "stock", "at", right_at="seen", tasks=8).toPandas().sort_values("id")
    want = pd.merge_asof(left.toPandas().sort_values("at"), right.toPandas().sort_values("seen"), left_on="at", right_on="seen", by="stock")
    assert got["close"].fillna(-1).tolist() == want["close"].fillna(-1).tolist()
    assert staged["asof-order"].groupBy("_range").count().agg({"count": "max"}).first()[0] < 1500


def test_same_names_need_a_prefix(spark):
    rows = spark.createDataFrame([("a", T0, 1.0)], "stock string, at timestamp, close double")
    with pytest.raises(ValueError):
        asof_join(rows, rows, "stock", "at")
    assert asof_join(rows, rows, "stock", "at", prefix="last_").first().asDict() == {
        "stock": "a", "at": T0, "close": 1.0, "last_at": T0, "last_close": 1.0}
    assert asof_join(rows, rows.limit(0), "stock", "at", prefix="last_").first()["last_close"] is None
    assert asof_join(rows.limit(0), rows, "stock", "at", prefix="last_").count() == 0
