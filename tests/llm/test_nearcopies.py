from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import nearcopies, simhash


def plain_set(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(rows):
    """The ids of ``near_dedup``, by comparing the shingles of all pairs."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        small, large = sorted((len(sets[i]), len(sets[j])))
        if small * 5 >= large * 4 and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
            up[top(j)] = top(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return sorted(least.values())


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"new{rng.randrange(10 ** 9)}"
    return " ".join(words)


def test_near_dedup_finds_near_copies(spark, docs_of):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(rng.randint(60, 500)))
             for _ in range(60)]
    texts += [edited(rng, t, share) for t in texts for share in (0, 0.01, 0.02, 0.04)] + ["", " ", "three short words"]
    texts += [" ".join(texts[0].split() + [f"tail{i}"]) for i in range(100)]     # one large group
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect())
    assert got == plain_kept(rows)


def test_near_dedup_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == plain_kept(rows)


def test_pairs_at_the_limit_share_a_key():
    rng = np.random.default_rng(4)
    for _ in range(300):
        found = rng.integers(0, 1 << 63, 90, np.uint64)
        a, b = np.unique(found[:81]), np.unique(found[9:])          # 72 of 90
        assert nearcopies.alike(a, b) and not nearcopies.alike(a, np.setdiff1d(b, found[40:41]))
        assert len(np.intersect1d(nearcopies.band_keys(a), nearcopies.band_keys(b)))


def test_hashes_of_48_bits_keep_their_order():
    found = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500, np.uint64) * np.uint64(2))
    assert (nearcopies.unpacked(nearcopies.packed(found)) == found >> np.uint64(16)).all()


def passages(rng, n, common, own):
    """Texts of one common passage and own words, unlike each other but alike in most of their minima."""
    passage = [f"p{i}" for i in range(common)]
    return [" ".join(passage + [f"w{rng.randrange(10 ** 9)}" for _ in range(own)]) for _ in range(n)]


def test_unlike_texts_that_share_keys(spark, docs_of, monkeypatch):
    """Two large crowds of unlike texts on one key each, near copies among them; a hub in small groups."""
    monkeypatch.setattr(nearcopies, "GROUP", 16)
    rng = random.Random(12)
    crowd = passages(rng, 250, 100, 40) + passages(rng, 100, 60, 16)
    crowd += [edited(rng, t, 0.01) for t in crowd[:40]] + [edited(rng, crowd[300], 0.005) for _ in range(20)]
    rng.shuffle(crowd)
    rows = list(enumerate(crowd))
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect())
    assert got == plain_kept(rows)


def test_pairs_of_a_crowd_grow_with_it(spark, docs_of):
    """What is rare in unlike texts tells them apart: far fewer comparisons than pairs."""
    rng = random.Random(13)
    texts = passages(rng, 400, 100, 40)
    texts += [edited(rng, t, 0.01) for t in texts[:50]]
    pairs, kept = [], nearcopies._verified

    def counted(found, texts):
        pairs.append(found.count())
        return kept(found, texts)
    nearcopies._verified = counted
    try:
        left = corpus_pipeline.near_dedup(spark, docs_of(list(enumerate(texts))), "").count()
    finally:
        nearcopies._verified = kept
    assert left == len(plain_kept(list(enumerate(texts)))) and sum(pairs) < 60 * len(texts)


def test_a_key_in_several_tasks(spark, docs_of):
    """Hubs of one key in different tasks are paired with the least of them."""
    members = spark.createDataFrame([(7, i, 10) for i in range(500)] + [(9, 3, 10), (9, 4, 10), (8, 5, 10)], "band long, id long, size int")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        gathered, split = nearcopies._gathered(members)
        links = [(r.a, r.b) for r in gathered.where("a <> b").collect()]
        alone = {r.a: r["keys"] for r in gathered.where("a = b").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(links) == 500 and (3, 4) in links
    up = list(range(500))
    for a, b in links:
        up[b] = a
    assert {i for i in range(500) if up[i] == i} == {0}
    assert {r.top for r in split.collect()} <= {0} and set(alone) >= {0, 3} and alone[3] >= 1 and 5 not in {a for a, _ in links}
    centres, stars = nearcopies._centred(gathered)
    assert {r.hub: r.a for r in centres.collect()}[3] == 3          # shares two keys
    assert stars.where("a = b").count() == 0 and {0, 3} <= {r.a for r in stars.collect()} | {0}


def test_near_dedup_with_clashing_columns(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows, clash=True).withColumn("K_", F.lit(1)).withColumn("row", F.lit("x"))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    plain = corpus_pipeline.near_dedup(spark, docs_of(odd_rows), "")
    as_rows = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    assert as_rows(got) == as_rows(plain)


def test_near_dedup_compares_linked_fingerprints_first(spark, docs_of, monkeypatch):
    """Fingerprints and the code's anchors decide about close texts; without keys they alone find these copies."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400)) for _ in range(12)]
    rows = list(enumerate(texts + [t + " tail" for t in texts] + [t + " tail end" for t in texts[:6]] + [texts[0].upper(), ""]))
    fps = {k: simhash.text_fingerprint((t or "").encode()) for k, t in rows}
    close = sum((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in combinations(fps, 2))
    asked = []
    linked = simhash.linked_fingerprints
    monkeypatch.setattr(simhash, "linked_fingerprints", lambda fps: asked.append(1) or linked(fps))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == plain_kept(rows)
    assert asked and close > 6

    found = nearcopies._sets(docs_of(rows), simhash.text_fingerprint, "doc_id", "text")
    classes = nearcopies.stage(found.where("size > 0").select(F.col("k").alias("id"), F.struct("k", "h").alias("least"), "fp", "size"), "test")
    links, of = nearcopies._fingerprint_links(classes, linked, nearcopies._Texts(docs_of(rows), found, classes, "doc_id", "text"))
    top = {r.node: r.component for r in of.collect()}
    by_id = dict(rows)
    for a, b in combinations(sorted(k for k in fps if by_id[k]), 2):
        x, y = plain_set(by_id[a]), plain_set(by_id[b])
        if (fps[a] ^ fps[b]).bit_count() <= 2 and len(x & y) * 5 >= len(x | y) * 4:
            assert top.get(a, a) == top.get(b, b)
    assert all(len(plain_set(by_id[r.a]) & plain_set(by_id[r.b])) * 5 >= len(plain_set(by_id[r.a]) | plain_set(by_id[r.b])) * 4 for r in links.collect())


def test_rows_of_unknown_number_are_not_broadcast(spark, docs_of, monkeypatch):
    """Joins by shingle, with texts wanted and, beyond ``SENT`` rows, with components: their files tell little of their rows."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:200], *(rng.choice(words) for _ in range(60 + i % 5))]) for i in range(12)]
    texts += [edited(rng, t, 0.01) for t in texts for _ in range(2)]
    plans = {}

    def staged(df, label, write=nearcopies.stage):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return write(df, label)
    monkeypatch.setattr(nearcopies, "stage", staged)
    monkeypatch.setattr(nearcopies, "SENT", 0)
    rows = list(enumerate(texts))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()) == plain_kept(rows)
    for label in ("linked-fingerprints", "first-shingles", "rare-pairs", "hubs-components", "near-copies"):
        assert "SortMergeJoin" in plans[label], label
    assert "Broadcast" not in plans["linked-fingerprints"] + plans["near-copies"]
