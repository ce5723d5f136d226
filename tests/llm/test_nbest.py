from __future__ import annotations

import random

import numpy as np
import pytest

from tickloom.llm import nbest


@pytest.fixture(scope="module")
def pieces():
    return nbest.Pieces.read()


def every_segmentation(pieces, text):
    """{ids: score} of all paths through the lattice of a text."""
    found = {}

    def walk(at, score, ids):
        if at == len(text):
            found[tuple(ids)] = score
            return
        for end in range(at + 1, min(len(text), at + pieces.longest) + 1):
            if hit := pieces.known.get(text[at:end]):
                walk(end, score + hit[1], ids + [hit[0]])
        if text[at] not in pieces.known:
            walk(at + 1, score + pieces.unknown, ids + [pieces.byte_ids[b] for b in text[at].encode()])
    walk(0, 0.0, [])
    return found


def some_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(" the and a çé☃z.!3\n\t\r") for _ in range(rng.randint(1, 10))) for _ in range(n)]


def test_nbest_are_the_best_of_all_paths(pieces):
    for text in some_texts(150):
        paths = every_segmentation(pieces, nbest.SPACE + text.replace(" ", nbest.SPACE))
        got = nbest.nbest(pieces, text, 4)
        assert [s for s, _ in got] == sorted(paths.values(), reverse=True)[:4]
        assert len({tuple(i) for _, i in got}) == len(got) and all(paths[tuple(i)] == s for s, i in got)
        assert all(nbest.decode_ids(pieces, i) == text for _, i in got)


def test_many_words_at_once(pieces):
    solver = nbest.Solver(pieces)
    words = [w for t in some_texts(200, 2) for w in nbest.words(pieces, t)] + ["x" * 300, "\0\0", "ab\0", "漢字漢字"]
    for part in (words[:90], words[90:]):
        for w in part:
            solver.number[w]
        solver.solve()
    for w in set(words) - {"x" * 300}:
        i, paths = solver.number[w], every_segmentation(pieces, w)
        best = sorted(paths.values(), reverse=True)
        assert solver.score[i] == best[0] == paths[tuple(solver.ids[solver.first[i]:solver.first[i + 1]])]
        assert solver.loss[i] == (best[0] - best[1] if len(best) > 1 else np.inf)
    assert solver.score[solver.number["x" * 300]] == nbest.word_nbest(pieces, "x" * 300, 1)[0][0]


def test_documents(spark, sf, pieces):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = nbest.encode(docs, pieces)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert r.round_trip and r.n_pieces == len(r.ids) and nbest.decode_ids(pieces, r.ids) == texts[r.doc_id]
        if len(r.text) < 600:
            want = nbest.nbest(pieces, r.text, nbest.N_BEST)
            assert r.score == want[0][0] and r.nbest_scores == [s for s, _ in want]
    again = nbest.decode(out.drop("text"), pieces)
    assert {r.doc_id: r.text for r in again.select("doc_id", "text").collect()} == texts


def test_alternatives_of_documents(spark, sf, pieces):
    """Every document's N id lists: those of ``nbest`` over the whole text (where no scores are equal), each of them
    different, with the score that is told, and decoding to the text."""
    score = {i: s for i, s in pieces.known.values()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = nbest.encode(docs, pieces).withColumns({f"ids{k}": nbest.alternative(k) for k in range(nbest.N_BEST + 1)})
    seen = 0
    for r in out.collect():
        lists = [r[f"ids{k}"] for k in range(nbest.N_BEST)]
        assert r[f"ids{nbest.N_BEST}"] is None and len(r.changes) == len(r.nbest_scores) - 1
        lists = [x for x in lists if x is not None]
        assert len(lists) == len(r.nbest_scores) and len(set(map(tuple, lists))) == len(lists)
        for ids, said in zip(lists, r.nbest_scores):
            assert nbest.decode_ids(pieces, ids) == r.text.replace(nbest.SPACE, " ")
            if all(i in score for i in ids):
                assert sum(score[i] for i in ids) == said
        want = nbest.nbest(pieces, r.text, nbest.N_BEST + 1)
        if len({s for s, _ in want}) == len(want):
            assert lists == [ids for _, ids in want[:nbest.N_BEST]]
            seen += 1
    assert seen > 20


def test_alternatives_of_small_texts(spark, docs_of, pieces):
    texts = some_texts(120, 5) + ["", "x" * 300, "a" * 60]
    out = nbest.encode(docs_of(list(enumerate(texts))), pieces, n=5).withColumns({f"ids{k}": nbest.alternative(k) for k in range(5)})
    for r in out.collect():
        text = texts[r.doc_id]
        lists = [r[f"ids{k}"] for k in range(5) if r[f"ids{k}"] is not None]
        assert len(lists) == len(r.nbest_scores) and len(set(map(tuple, lists))) == len(lists)
        assert all(nbest.decode_ids(pieces, x) == text for x in lists)
        if 0 < len(text) < 20:
            paths = every_segmentation(pieces, nbest.SPACE + text.replace(" ", nbest.SPACE))
            assert [paths[tuple(x)] for x in lists] == sorted(paths.values(), reverse=True)[:5] == r.nbest_scores


def test_odd_rows_and_small_caches(docs_of, odd_rows, pieces, monkeypatch):
    monkeypatch.setattr(nbest, "CACHE", 5)
    monkeypatch.setattr(nbest, "CHARS", 1000)
    docs = docs_of(odd_rows, clash=True)
    out = nbest.encode(docs, pieces)
    assert out.columns == [c for c in docs.columns if c not in nbest.ADDED] + list(nbest.ADDED)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.round_trip and nbest.decode_ids(pieces, r.ids) == (r.text or "")
        if not r.text:
            assert (r.ids, r.n_pieces, r.score, r.nbest_scores, r.changes) == ([], 0, 0.0, [0.0], [])


def test_one_best_and_control_pieces(docs_of, pieces):
    r = nbest.encode(docs_of([(1, "a <s> ▁ b")]), pieces, n=1).first()
    assert len(r.nbest_scores) == 1 and r.round_trip and 1 not in r.ids
    assert nbest.decode_ids(pieces, r.ids) == "a <s>   b"


def test_empty_table(docs_of, pieces):
    assert nbest.encode(docs_of([]), pieces).count() == 0
    assert nbest.decode(nbest.encode(docs_of([]), pieces).drop("text"), pieces).count() == 0


def test_models_whose_pieces_cross_words():
    with pytest.raises(ValueError):
        nbest.Pieces({"a▁b": (0, 0.0)}, [0] * 256, [b"a b"])
