from __future__ import annotations

import random
import re
from itertools import combinations
from math import ceil

import pytest

from tickloom.llm import spaced


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_overlaps(docs, items):
    """{(row, item): (matched, length, start)} by comparing every window of every pair."""
    found = {}
    for i, (_, text) in enumerate(docs):
        d = plain_words(text)
        for item, other in items:
            b = plain_words(other)
            if not b:
                continue
            n = min(20, len(b))
            best = max(((sum(x == y for x, y in zip(d[s:s + n], b[j:j + n])), -s) for s in range(len(d) - n + 1)
                        for j in range(len(b) - n + 1)), default=(0, 0))
            if best[0] >= (n if n < 12 else ceil(n * 0.8)):
                found[i, item] = (best[0], n, -best[1])
    return found


@pytest.fixture
def planted():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((12, 13, 15, 19, 20, 24, 40, 60))]
    items += [(90, "too short to judge"), (91, None), (92, "")]
    docs = []
    for no, text in items[:8]:
        for wrong in (0, 2, 3, 4, 6):
            words = text.split()
            n = min(20, len(words))
            at = rng.randrange(len(words) - n + 1)
            part = words[at:at + n]
            for p in rng.sample(range(n), min(wrong, n)):
                part[p] = "zz"
            docs.append((len(docs), " ".join(rng.choices(vocabulary, k=rng.randrange(30)) + part
                                             + rng.choices(vocabulary, k=rng.randrange(30)))))
    return docs, items


def test_masks_leave_no_window_unseen():
    for length in range(spaced.FEWEST, spaced.WINDOW + 1):
        wrong = length - ceil(length * spaced.LEAST)
        seeds = [sum(1 << s + k for k, c in enumerate(m) if c == "1")
                 for m in spaced.MASKS for s in range(length - len(m) + 1)]
        for places in combinations(range(length), wrong):
            miss = sum(1 << p for p in places)
            assert any(not seed & miss for seed in seeds), (length, places)


def test_planted_passages(spark, docs_of, planted):
    docs, items = planted
    got = spaced.overlaps(docs_of(docs, clash=True), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.matched, r.length, r.doc_start) for r in got.collect()}
    assert found == plain_overlaps(docs, items) and len(found) > 20


@pytest.mark.parametrize("rows_sent", [500_000, 0])
def test_short_items_are_found_where_all_their_words_are(spark, docs_of, monkeypatch, rows_sent):
    monkeypatch.setattr(spaced, "BROADCAST_ROWS", rows_sent)
    rng = random.Random(4)
    items = [(1, "Paris"), (3, "capital of France?"), (7, "what is the capital of france paris"), (11, " ".join(f"k{i}" for i in range(11))),
             (12, " ".join(f"m{i}" for i in range(12))), (4, "paris paris"), (5, "two two two"), (6, "漢字")]
    docs = [(0, "in PARIS, what is the capital-of France: Paris"), (1, "the capital of paris france"), (2, "what is the capital"),
            (3, " ".join(f"k{i}" for i in range(11))), (4, " ".join(f"k{i}" for i in range(11) if i != 5)), (5, "paris paris paris two two two two"),
            (6, " ".join(["m0"] + [f"m{i}" for i in range(12)][:10] + ["x", "y"])), (7, ""), (8, None), (9, "漢字 and")]
    docs += [(20 + i, " ".join(rng.choices(["paris", "two", "capital", "of", "france", "k0", "what"], k=rng.randrange(40)))) for i in range(60)]
    got = spaced.overlaps(docs_of(docs, clash=True), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.matched, r.length, r.doc_start) for r in got.collect()}
    want = {(docs[i][0], item): v for (i, item), v in plain_overlaps(docs, items).items()}
    assert found == want and (0, 7) in found and {item for _, item in found} == {1, 3, 4, 5, 6, 7, 11} | {i for _, i in want}
    kept = spaced.decontaminated(docs_of(docs, clash=True), spark.createDataFrame(items[:3], "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {k for k, _ in docs} - {k for k, item in want if item in (1, 3, 7)}


def test_names_do_not_clash(spark, docs_of, odd_rows):
    from pyspark.sql import functions as F
    docs = docs_of(odd_rows, clash=True).withColumn("__k", F.lit(1)).withColumn("K_", F.lit(1)).withColumn("H_", F.lit(1))
    items = spark.createDataFrame([(1, "word word word word word word word word word word word word word")], "item_id long, text string")
    kept = spaced.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows) - 1


def test_shuffled_instead_of_broadcast(spark, docs_of, planted, monkeypatch):
    monkeypatch.setattr(spaced, "BROADCAST_ROWS", 0)
    docs, items = planted
    got = spaced.overlaps(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(plain_overlaps(docs, items))


def test_odd_rows(spark, docs_of, odd_rows):
    passage = " ".join(f"q{i}" for i in range(25))
    rows = odd_rows + [(1, passage), (1, passage), (None, "x " * 3000 + passage.upper()), (2, passage)]
    items = spark.createDataFrame([(5, passage), (5, passage), (None, passage + " more")], "item_id long, text string")
    docs = docs_of(rows, clash=True)
    got = sorted((str(r.doc_id), str(r.item_id), r.doc_start) for r in spaced.overlaps(docs, items).collect())
    one = lambda k, s: [(k, i, s) for i in ("5", "None")]      # noqa: E731
    assert got == sorted(one("1", 0) * 2 + one("2", 0) + one("None", 3000)) or got == sorted(one("1", 0) + one("2", 0) + one("None", 3000))
    kept = spaced.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows)


def test_empty_tables(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert spaced.overlaps(docs_of(odd_rows), none).count() == 0
    assert spaced.decontaminated(docs_of(odd_rows), none).count() == len(odd_rows)
    assert spaced.overlaps(docs_of([]), spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")).count() == 0
