from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import iblt


def plain_units(text):
    """Words between line and sentence ends; a longer stretch is cut behind words by their hash, or at the most."""
    out = []
    for line in re.split(r"\n|(?<=[.!?]) ", text):
        words, unit = line.encode().split(), []
        long = len(words) > 12
        for w in words:
            unit.append(w)
            if long and (len(unit) == 12 or len(unit) >= 3 and zlib.crc32(w) % 6 == 0):
                out.append(b" ".join(unit))
                unit = []
        if unit:
            out.append(b" ".join(unit))
    return out


def plain_likeness(a, b):
    a, b = Counter(plain_units(a)), Counter(plain_units(b))
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 1.0


def plain_edits(rows):
    """The expected rows of ``fingerprint_edits``, without the fingerprints."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (k, t), (_, u) in zip(order, order[1:] + order[:1]):
        edited = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(plain_likeness(t, edited), 9),
                    round(plain_likeness(t, u), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
                   for r in df.collect()), key=str)


def test_every_text_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    found = iblt.fingerprint_edits(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got(found) == plain_edits(texts.items())
    by_text = {}
    for r in found.collect():
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_odd_rows_and_clashing_columns(docs_of, odd_rows):
    assert got(iblt.fingerprint_edits(docs_of(odd_rows, clash=True))) == plain_edits(odd_rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "single text. of two")], [(5, "same")] * 40, [(None, "a"), (None, "b")]])
def test_few_rows(docs_of, rows):
    assert got(iblt.fingerprint_edits(docs_of(rows))) == plain_edits(rows)


def test_tasks_hand_over_between_batches(docs_of, spark):
    rows = [(i, " ".join(f"{i} {j}." for j in range(i % 30))) for i in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(iblt.fingerprint_edits(docs_of(rows))) == plain_edits(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_units_against_plain_ones():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["word", "x", "a.", "b!", "c?", "\n", "d" * rng.randrange(1, 9), str(rng.randrange(99))])
                      for _ in range(rng.randrange(90))) for _ in range(400)] + ["", " ", "\n\n", "a. ", "a.  b", "? ! . x"]
    for t in texts:
        assert iblt.units(t) == plain_units(t)
        assert max([len(u.split()) for u in iblt.units(t)], default=0) <= iblt.MOST
        at = iblt.last_end(t, len(t) * 2 // 3)
        assert iblt.units(t[:at]) + iblt.units(t[at:]) == iblt.units(t)


def test_an_edit_changes_the_units_around_it_alone():
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(1000)]
    one = Counter(iblt.units(" ".join(words)))
    for at in range(0, 1000, 50):
        two = Counter(iblt.units(" ".join(words[:at] + ["inserted"] + words[at:])))
        assert sum((one - two).values()) <= 12 and sum(one.values()) > 120


def test_peeling_recovers_the_differences_and_retries():
    rng = random.Random(2)
    common = [f"line {i} of both" for i in range(300)]
    for n in (0, 1, 4, 30, 400, 5000):
        old = common + [f"old {rng.random()}" for _ in range(n)] + ["twice"] * 2
        new = common + [f"new {rng.random()}" for _ in range(n // 2)] + ["twice"]
        a, b = iblt.Digests.of_texts(["\n".join(old)]), iblt.Digests.of_texts(["\n".join(new)])
        _, digest, sign, used = iblt.differences(a, b, (np.array([0]), np.array([0])))
        assert sorted(digest[sign > 0].tolist()) == sorted(set(a.digest.tolist()) - set(b.digest.tolist()))
        assert sorted(digest[sign < 0].tolist()) == sorted(set(b.digest.tolist()) - set(a.digest.tolist()))
        assert (sign > 0).sum() == n + 1 and (sign < 0).sum() == n // 2
        assert used[0] == iblt.CELLS if n < 4 else used[0] <= 8 * len(sign) + 8 * iblt.CELLS


def test_the_strata_name_the_size():
    """Few sketches are made twice."""
    rng = random.Random(3)
    texts = ["\n".join(f"{rng.random()}" for _ in range(rng.choice([20, 60, 200, 900]))) for _ in range(200)]
    a = iblt.Digests.of_texts(texts)
    made = []
    plain = iblt.sketch
    iblt.sketch = lambda row, digest, n, cells: made.append((cells, n)) or plain(row, digest, n, cells)
    try:
        iblt.differences(a, a, (np.arange(199), np.arange(199) + 1))
    finally:
        iblt.sketch = plain
    assert sum(n for cells, n in made if cells > iblt.CELLS) < 2 * 1.5 * 199


def test_a_small_sketch_fails_honestly():
    digests = iblt.Digests.of_texts(["\n".join(f"line {i}" for i in range(200))])
    *_, whole = iblt.peel(iblt.sketch(digests.row, digests.digest, 1, iblt.CELLS))
    assert not whole[0]


def test_likeness_does_not_jump_with_the_number_of_paragraphs(docs_of):
    rows = []
    for n in (7, 8, 9, 40):         # a text, followed by itself and a sentence
        text = "\n".join(f"paragraph {i} of " + " ".join(f"word{i * 13 + j}" for j in range(8)) for i in range(n))
        rows += [(10 * n + 1, text), (10 * n, text + "\none sentence more")]
    near = {r.doc_id: r.near_next for r in iblt.fingerprint_edits(docs_of(rows)).collect()}
    assert all(near[10 * n + 1] == 2 * n / (2 * n + 1) for n in (7, 8, 9, 40))


def test_one_key_in_many_rows_is_split(docs_of, spark):
    rows = [(5, f"{i * 7919 % 1000:04} text") for i in range(1000)] + [(i, "x") for i in range(20)]
    assert got(iblt.fingerprint_edits(docs_of(rows))) == plain_edits(rows)
    parts = iblt._chained(docs_of(rows), "doc_id", "text").where("k = 5").select("part").distinct().count()
    assert parts > 4


@pytest.mark.parametrize("kind", ["string", "date", "decimal(9,2)", "int"])
def test_keys_of_other_types(spark, kind):
    docs = spark.range(30).selectExpr(f"CAST({'date_from_unix_date(CAST(id AS INT))' if kind == 'date' else 'id + 10'} AS {kind}) AS name", "concat('text ', id) AS text")
    order = sorted(docs.collect(), key=lambda r: r.name, reverse=True)
    near = iblt.fingerprint_edits(docs, "name")
    assert near.schema["name"].dataType == docs.schema["name"].dataType
    want = {}
    for r, s in zip(order, order[1:] + order[:1]):
        n = len(r.text)
        want[r.name] = hashlib.sha256((r.text[:n - n // 3] + s.text[:n // 3]).encode()).hexdigest()
    assert {r.name: r.edited_sha256 for r in near.collect()} == want
