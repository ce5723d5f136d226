from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import nearcopies, simhash
from tickloom.llm.components import components


def plain_fingerprint(text):
    small = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", small)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, threshold=2):
    """Of (key, text): the least key reachable, by comparing all pairs."""
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= threshold:
            up[top(j)] = top(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [(k, f, least.get(top(i))) for i, (k, f) in enumerate(zip((r[0] for r in rows), prints))]


def as_rows(df, key="doc_id"):
    return sorted(((r[key], r.fp % 2 ** 64, r.component_id) for r in df.collect()), key=str)


def test_every_text_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(simhash.near_duplicates(docs)) == sorted(plain_components(rows), key=str)


def test_odd_rows_and_clashing_columns(docs_of, odd_rows):
    got = as_rows(simhash.near_duplicates(docs_of(odd_rows, clash=True)))
    assert got == sorted(plain_components(odd_rows), key=str)


def test_long_text_is_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * 7 % 1000) for i in range(5000))
    monkeypatch.setattr(simhash, "AT_ONCE", 64)
    assert simhash.text_fingerprint(text.encode()) == plain_fingerprint(text)


def test_code_is_perfect_and_no_pair_is_missed():
    patterns, over = simhash.error_patterns()
    assert ((over == 0).sum(axis=1) == 1).all()
    rng = random.Random(3)
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        one, two = (np.array([x], np.uint64).view(np.int64) for x in (a, b))
        assert simhash.anchors(one, patterns, over, True)[1][0] in simhash.anchors(two, patterns, over, False)[1]


def test_linked_fingerprints_are_all_close_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    fps = {b ^ (1 << i) ^ (1 << j) for b in base for i, j in ((0, 0), (3, 40), (3, 41), (62, 7), (20, 21), (50, 51))}
    got = {(r.a, r.b) for r in simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


def test_replicas_are_not_broadcast(spark):
    """61 rows a fingerprint: the planner takes them for one and would send them through the driver."""
    pairs = simhash.linked_fingerprints(spark.range(50).select(F.col("id").alias("fp")).repartition("fp"))
    assert pairs.count() > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_hubs_and_cycles(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5000, i) for i in range(4000, 4300)]
    links = chain + hub + [(1, 2), (2, 3), (3, 1), (2, 1), (7, 7), (8, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 4000 for i in [*range(4000, 4300), 5000]} | {1: 1, 2: 1, 3: 1}
    assert got == want


def test_components_do_not_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(links, most_rounds=1)


def test_one_of_each(docs_of, odd_rows):
    """Each row by its own text: of the copies of one text the least key stays, whatever else has that key."""
    got = [(r.doc_id, r.text) for r in simhash.one_of_each(docs_of(odd_rows, clash=True)).collect()]
    nothing = [(k, t) for k, t in odd_rows if not (t or "").split()]
    least = {}
    for k, t in odd_rows:
        if k is not None and (k, t) not in nothing:
            least[t] = min(k, least.get(t, k))
    wanted = [(k, t) for t, k in least.items()] + [r for r in odd_rows if r[0] is None] + [(2, None)]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_unlike_texts_of_one_key_all_stay(docs_of):
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abc"]
    rows = [(5, t) for t in texts] + [(5, texts[0])]
    assert sorted(r.text for r in simhash.one_of_each(docs_of(rows)).collect()) == sorted(texts)


def test_a_key_of_two_texts_leaves_one_of_each_group(docs_of):
    one, two = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(5, one), (7, one), (2, two), (5, two)]
    assert sorted((r.doc_id, r.text) for r in simhash.one_of_each(docs_of(rows)).collect()) == [(2, two), (5, one)]


@pytest.mark.parametrize("hot, sent", [(2, 100), (2, 0), (1000, 100)])
def test_large_classes_by_broadcast_or_shuffle(docs_of, odd_rows, monkeypatch, hot, sent):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    monkeypatch.setattr(nearcopies, "SENT", sent)
    rows = [r for r in odd_rows if r[0] is not None] + [(100 + i, "one two three four") for i in range(20)] + [(200 + i, "") for i in range(9)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((k, c) for k, _, c in plain_components(rows))


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.one_of_each(docs_of([])).count() == 0
