from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import eliasfano, ngram


def plain(rows):
    """[(key, held, n_tokens, n_known, N, base, score)] of (key, text, held) by whole counts."""
    tokens = [((t or "").encode().lower().split()) + [None] for _, t, _ in rows]
    words, pairs, times, after = Counter(), Counter(), Counter(), Counter()
    for (_, _, held), ts in zip(rows, tokens):
        if not held:
            words.update(ts)
            for v, w in zip([""] + ts, ts):
                pairs[v, w] += 1
                times[v] += 1
    for v, _ in pairs:
        after[v] += 1
    n, size = sum(words.values()), len(words)
    out = []
    for (key, _, held), ts in zip(rows, tokens):
        base = score = 0.0
        for v, w in zip([""] + ts, ts):
            one = (words[w] + 1) / (n + size + 1)
            base += log10(one)
            score += log10((max(pairs[v, w] - .75, 0) + .75 * after[v] * one) / times[v]) if times[v] else log10(one)
        out.append((key, bool(held), len(ts), sum(words[w] > 0 for w in ts), n, base, score))
    return sorted(out, key=str)


def same(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    want = plain(rows)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6 * a[2])
        assert a[6] == pytest.approx(b[6], abs=4e-4 * a[2])          # quantised


@pytest.fixture
def scored(docs_of):
    def make(rows, clash=False, **more):
        docs = docs_of([r[:2] for r in rows], clash)
        held = {r[1]: r[2] for r in rows}
        marked = [t for t, h in held.items() if h and t is not None]
        return ngram.score_texts(docs, F.coalesce(F.col("text").isin(marked), F.lit(False)) if marked else F.lit(False), **more)
    return make


def test_every_text_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.doc_id % 5 == 2) for r in docs.collect()]
    same(ngram.score_texts(docs, F.col("doc_id") % 5 == 2), rows)
    same(ngram.score_texts(docs.repartition(6), F.col("doc_id") % 5 == 2, chunk=500), rows)


def test_contexts_that_are_split(spark, scored, monkeypatch):
    """With many shards nearly all frequent contexts are, and nothing changes."""
    rows = [(i, f"no{i} " + " ".join(f"the w{(i * j) % 37} of" for j in range(40)), i % 4 == 1) for i in range(60)]
    monkeypatch.setattr(ngram, "SHARD", 100)
    same(scored(rows, chunk=300), rows)


def test_odd_rows_and_clashing_columns(scored, odd_rows):
    rows = [(k, t, t is not None and t.startswith("w")) for k, t in odd_rows]
    same(scored(rows, clash=True), rows)


def test_nothing_learned_and_empty_table(scored, docs_of):
    rows = [(1, "a b a", True), (2, "c", True)]
    same(scored(rows), rows)
    assert ngram.score_texts(docs_of([]), F.lit(False)).count() == 0


def test_null_fold_is_training(docs_of):
    rows = [(1, "a b a", None), (2, "c", None)]
    same(ngram.score_texts(docs_of([r[:2] for r in rows]), F.lit(None).cast("boolean")), rows)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 2 ** 64 - 1), (5, 6), (1000, 1200), (1000, 2 ** 64 - 1), (40_000, 2 ** 40), (300, 10 ** 5)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    coded = eliasfano.EliasFano.of(values)
    assert (coded.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, top, 300, dtype=np.uint64, endpoint=True),
                            np.array([0, 2 ** 64 - 1], np.uint64)])
    place, there = coded.successor(asked)
    assert (place == np.searchsorted(values, asked)).all() and (there == np.isin(asked, values)).all()
    head, *rest = eliasfano.mapped(eliasfano.packed(coded.arrays()))
    again = eliasfano.EliasFano(int(head[0]), int(head[1]), *rest)
    assert (again.get(np.arange(len(values))) == values).all()


def test_repeated_values():
    values = np.sort(np.random.default_rng(1).integers(0, 50, 400)).astype(np.uint64)
    assert (eliasfano.EliasFano.of(values).get(np.arange(400)) == values).all()


def test_trie_answers_its_own_and_no_other_pairs():
    rng = np.random.default_rng(4)
    context = np.sort(rng.choice(rng.integers(0, 2 ** 64, 400, dtype=np.uint64), 5000))
    word = rng.choice(rng.integers(0, 2 ** 40, 300, dtype=np.uint64), 5000)
    rows, n = np.unique(np.stack([context, word]), axis=1, return_counts=True)
    trie = eliasfano.Trie(eliasfano.mapped(eliasfano.Trie.build(rows[0], rows[1], n, 0.75)))
    count = Counter()
    for c, k in zip(rows[0].tolist(), n.tolist()):
        count[c] += k
    known = {(c, w): (k - 0.75) / count[c] for c, w, k in zip(rows[0].tolist(), rows[1].tolist(), n.tolist())}
    c, w = np.meshgrid(np.unique(rows[0])[:80], np.unique(rows[1]))
    c, w = c.ravel(), w.ravel()
    at, there = trie.context_of(c)
    rank, real = trie.word_of(w)
    assert there.all() and real.all()
    got = eliasfano.unquantised(trie.prob_of(at, rank))
    want = np.array([known.get((a, b), 0.0) for a, b in zip(c.tolist(), w.tolist())])
    assert ((got > 0) == (want > 0)).all()
    assert np.allclose(np.log10(got[got > 0]), np.log10(want[want > 0]), atol=1e-4)
    assert not trie.context_of(np.array([12345], np.uint64))[1][0]
