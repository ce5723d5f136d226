from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tickloom.llm import repair
from tickloom.llm.queries import QUERIES


def plain_runs(words):
    """All runs, by trying every period; of a stretch with several periods the smallest."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                if not any(a <= i and j + q <= b and q % p == 0 for (a, b), p in out.items()):
                    out[i, j + q] = q
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plain_rest(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def plain_looped(key, words):
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return list(words)
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def check(texts):
    found, rest = repair.runs_and_rest(texts)
    for words, own, left in zip(texts, found, rest):
        want = plain_runs(words)
        assert [tuple(map(int, r)) for r in own] == want, words
        assert left == plain_rest(words, want)


def strange_text(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        return [rng.choice("abc") for _ in range(rng.randrange(120))]
    if kind == 2:       # nested repetition
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 4))] * rng.randint(1, 6) + [rng.choice("xyz")]
        return unit * rng.randint(1, 9) + unit[:rng.randrange(len(unit))]
    if kind == 3:       # next to each other, overlapping by less than a period
        return sum(([rng.choice("ab") for _ in range(rng.randint(1, 3))] * rng.randint(1, 8) for _ in range(rng.randint(1, 8))), [])
    if kind == 4:
        a, b = ["a"], ["a", "b"]
        while len(b) < 150:
            a, b = b, b + a
        return b[:rng.randrange(len(b))]
    words = [str(rng.randrange(9)) for _ in range(rng.randint(1, 150))]
    at = rng.randrange(len(words))
    return words[:at] + (words[at:at + rng.randint(1, 20)] * 12)[:rng.randrange(150)] + words[at:]


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_plain_ones(seed):
    rng = random.Random(seed)
    check([[w.encode() for w in strange_text(rng)] for _ in range(250)])


def test_parts_do_not_matter(monkeypatch):
    rng = random.Random(9)
    texts = [[w.encode() for w in strange_text(rng)] for _ in range(100)]
    monkeypatch.setattr(repair, "AT_ONCE", 3)
    monkeypatch.setattr(repair, "FREQUENT", 0)
    check(texts)
    check([[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 7])
    check([])


def test_long_texts():
    """Ones that a plain search takes too long for: their runs are known."""
    n = 200_000
    unit = [str(i).encode() for i in range(777)]
    found, rest = repair.runs_and_rest([[b"w"] * n, unit * 100, [b"x"] + unit * 30 + [b"y"], [str(i).encode() for i in range(n)]])
    assert [f.tolist() for f in found] == [[[0, n, 1]], [[0, 77_700, 777]], [[1, 23_310, 777]], []]
    assert rest[:3] == [b"w", b" ".join(unit), b" ".join([b"x", *unit, b"y"])]


def test_a_grammar_gives_its_text_back():
    rng = random.Random(4)
    texts = [[w.encode() for w in strange_text(rng)] for _ in range(60)]
    ids = [np.array([ord(w[0:1]) + 300 * i for w in t], np.int64) for i, t in enumerate(texts)]
    words, doc = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    g = repair.Grammar(words, doc, 300 * len(ids))
    assert (g.first < g.middle).all() and (g.middle < g.last).all() and len(g.at) == len(g.first) + 1
    for i, (a, b) in enumerate(zip(g.first, g.last)):
        assert len(set(doc[a:b])) == 1
        for p in g.places[g.at[i]:g.at[i + 1]]:
            assert (words[p:p + b - a] == words[a:b]).all()
    # every text is covered by one symbol, each of whose halves is a symbol or a word
    spans = {(a + p - g.first[i], b + p - g.first[i]) for i, (a, b) in enumerate(zip(g.first, g.last)) for p in g.places[g.at[i]:g.at[i + 1]]}
    for i, t in enumerate(ids):
        if len(t) > 1:
            a = np.searchsorted(doc, i)
            assert (a, a + len(t)) in spans


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(spark, docs_of, odd_rows, clash):
    rows = odd_rows + [(60, "a b " * 9), (61, "x\x0by\x0cx y x\ty x\ry x y\n"), (62, "z " * 6 + "q"), (63, "\x1c\x85a b " * 5)]
    got = repair.periodic_runs(docs_of(rows, clash)).collect()
    want = []
    for k, t in rows:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w]
        found = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        want.append((k, found, plain_rest(words, found).decode()))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark, docs_of):
    assert repair.periodic_runs(docs_of([])).collect() == []


def test_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(rows)
    changed = 0
    for d in rows:
        words = plain_looped(d.doc_id, [w for w in re.split(rb"[\x20\x09-\x0D]+", (d.text or "").encode()) if w])
        r, found = got[d.doc_id], plain_runs(words)
        changed += bool(found)
        assert r.n_runs == len(found)
        top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == want
        said = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        assert r.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_rest(words, found)).hexdigest()
    assert changed
