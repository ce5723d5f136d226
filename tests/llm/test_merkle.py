from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)]
    return H(*said)


def raise_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def walk(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 8 * 8
        out.append((level[run:i], level[i + 1:run + 8]))
        i //= 8
    return out


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for r in rows:
        text = r[1]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), leaf_of(r, text)))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = {v: raise_tree([x[2] for x in sorted(by[v])]) for v in langs}
    top = raise_tree([trees[v][-1][0] for v in langs])
    out = []
    for t, v in enumerate(langs):
        for i, (known, k, leaf, other) in enumerate(sorted(by[v])):
            path = walk(trees[v], i) + walk(top, t)
            fold = other
            for before, behind in path:
                fold = H(*before, fold, *behind)
            root = top[-1][0]
            out.append((k if known else None, leaf, trees[v][-1][0], root,
                        H(*[x for pair in path for side in pair for x in side]), fold, fold == root))
    return out


def got(spark, docs, key="doc_id"):
    held = merkle.manifest(docs, key, other={"text": merkle.tampered()})
    return [tuple(r) for r in merkle.proofs(docs, held, key).select(
        key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, docs_of, odd_rows, clash):
    docs = docs_of(odd_rows + [(20, "Upper CASE", None, None), (20, None, "", "s"), (3, "É", "zz", "s")], clash)
    assert ordered(got(spark, docs)) == ordered(plain(rows_of(docs)))


def test_trees_of_many_shapes(spark, docs_of, monkeypatch):
    """Partitions of 64 leaves, so that a tree has several passes of them; lone last nodes; more trees than a run."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rng = random.Random(3)
    sizes = {"a": 1, "b": 8, "c": 9, "d": 65, "e": 4097, "f": 512, "g": 513, "h": 64, "i": 63, None: 7, "": 2}
    rows = [(f"Text {rng.random()}", lang, "s") for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    docs = docs_of([(i, *r) for i, r in enumerate(rows)])
    assert ordered(got(spark, docs)) == ordered(plain(rows_of(docs)))


def test_all_rows_equal(spark, docs_of):
    docs = docs_of([(1, "Same", "en", "s")] * 100)
    assert ordered(got(spark, docs)) == ordered(plain(rows_of(docs)))


def test_empty_table(spark, docs_of):
    docs = docs_of([])
    assert got(spark, docs) == []
    assert merkle.manifest(docs).root is None


def test_one_row(spark, docs_of):
    assert got(spark, docs_of([(4, "Ab")])) == plain([(4, "Ab", "en", "s0", 2)])


def test_other_key_and_fields(spark):
    docs = spark.createDataFrame([("x", 1, None), ("y", 2, "v"), ("x", 3, "")], "name string, n int, part string")
    held = merkle.manifest(docs, "n", "name", ("n", "part"))
    found = merkle.proofs(docs, held, "n").orderBy("n").collect()
    assert [r.verified for r in found] == [True] * 3
    assert [r.leaf for r in found] == [H("1:1", "-"), H("1:2", "1:v"), H("1:3", "0:")]


def test_missing_is_minimal():
    """Against the union of all proofs without what the leaves give."""
    rng = random.Random(5)
    for n in (1, 2, 8, 9, 70, 600):
        for share in (1, 3, n):
            known = sorted(rng.sample(range(n), min(share, n)))
            levels = raise_tree([str(i) for i in range(n)])
            given, need = set(), set()
            for level in range(len(levels)):
                width = 8 ** level
                for i in range(len(levels[level])):
                    if all(x in known for x in range(i * width, min((i + 1) * width, n))):
                        given.add((level, i))
            on_path = {(level, k // 8 ** level) for level in range(len(levels)) for k in known}
            for level, i in on_path:
                if level < len(levels) - 1:
                    need |= {(level, j) for j in range(i // 8 * 8, min(i // 8 * 8 + 8, len(levels[level])))}
            assert sorted(need - on_path) == sorted(merkle.missing(n, known))
            assert not set(merkle.missing(n, known)) & given


def test_a_forged_row_is_told(spark, docs_of):
    """Each field counts, and where one value ends."""
    docs = docs_of([(i, f"t{i}", "en", "s") for i in range(30)])
    root = merkle.manifest(docs).root
    for change in ({"text": F.lit("t")}, {"source": F.lit(None).cast("string")}, {"n_chars": F.col("n_chars") + 1}):
        forged = docs.withColumns({c: F.when(F.col("doc_id") == 7, e).otherwise(F.col(c)) for c, e in change.items()})
        assert merkle.manifest(forged).root != root
