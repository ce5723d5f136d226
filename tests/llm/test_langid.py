from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid
from tickloom.llm.queries import fold


@pytest.fixture(scope="module")
def net(spark, sf):
    return langid.learn(spark.read.parquet(f"{sf}/documents.parquet").where(fold(3) != 1))


def test_held_out_accuracy(spark, sf, net):
    """Of the documents that were not learned from, on the larger table too, nearly all are right."""
    for folder, least in ((sf, 0.95), ("/root/testdata/sf0.01", 0.97)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").where(fold(3) == 1)
        right = langid.identify(docs, net).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
        assert right >= least


def test_same_network_again(spark, sf, net):
    again = langid.learn(spark.read.parquet(f"{sf}/documents.parquet").repartition(5).where(fold(3) != 1))
    assert all(np.array_equal(getattr(net, k), getattr(again, k)) for k in ("table", "filters", "dense"))


def test_scores_are_means_of_windows(net):
    texts = ["the one and the other " * 40, "", "x", "é" * 500, None]
    got = langid.score_texts(net, pa.array(texts))
    for text, row in zip(texts, got):
        raw = (text or "").encode()
        parts = [raw[i:i + langid.LENGTH] for i in range(0, len(raw), langid.LENGTH)]
        total = np.zeros(len(net.languages))
        for p in parts:
            cut = np.zeros((1, langid.LENGTH), np.uint8)
            cut[0, :len(p)] = np.frombuffer(p, np.uint8)
            # filters, bias, pooling and softmax one by one
            x = net.table[cut[0]]
            wide = max(langid.WIDTHS)
            pooled = np.max([x[i:i + wide].reshape(-1) @ net.filters for i in range(langid.LENGTH - wide + 1)], axis=0)
            z = np.maximum(pooled + net.bias, 0) @ net.dense + net.offset
            e = np.exp(z - z.max())
            total += e / e.sum() * len(p)
        assert np.allclose(row, total / max(1, len(raw)), atol=1e-5)


def test_a_slice_of_a_batch(net):
    texts = pa.array(["one text", "ein anderer Text", "the third of the texts"])
    assert np.allclose(langid.score_texts(net, texts)[1:], langid.score_texts(net, texts.slice(1)), atol=1e-6)


def test_odd_rows(docs_of, odd_rows, net):
    docs = docs_of(odd_rows + [(10, "12 34 !?"), (11, None, None)], clash=True)
    out = langid.identify(docs, net)
    assert out.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(odd_rows) + 2
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in net.languages) == letters and (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0)
    assert len({(r.lang_pred, r.score) for r in rows if r.text == "one two three four"}) == 1


def test_nothing_to_learn(docs_of):
    rows = [(1, "text", None), (2, None, "en"), (3, "!!", "en"), (4, "", "en")]
    assert langid.learn(docs_of(rows)) is None and langid.learn(docs_of([])) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(docs_of(rows), None).collect()} == {("und", 0.0)}
    assert langid.identify(docs_of([]), None).count() == 0


def test_one_language_and_rare_ones(docs_of):
    assert langid.learn(docs_of([(1, "all the same", "en")])).languages == ["en"]
    rows = [(i, "the same words again", "en") for i in range(300)] + [(900, "seltene Sprache", "de")]
    net = langid.learn(docs_of(rows), windows=40)
    assert net.languages == ["de", "en"]
