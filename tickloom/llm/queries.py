"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from tickloom.llm import arc, iblt, langid, lines, markov, merkle, nbest, ngram, pii, quotes, repair, simhash, spaced

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Byte network learned from two of three folds, applied to every document."""
    docs = table(spark, sf, "documents").withColumn("held_out", fold(3) == 1)
    net = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, net, keep=["doc_id", "held_out"])


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return (simhash.near_duplicates(table(spark, sf, "documents"))
            .select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id"))


@query("op5_decontamination", spaced.SQL)
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return (spaced.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
            .select("doc_id", "item_id", "matched", "length", F.col("doc_start").cast("long").alias("doc_start")))


@query("op2_line_dedup", lines.SQL)
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that many sites carry."""
    return (lines.without_boilerplate(table(spark, sf, "documents"))
            .select("doc_id", "n_lines", "n_removed", "text"))


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's sketch, that of an edited version, and how alike they are."""
    return iblt.fingerprint_edits(table(spark, sf, "documents"))


@query("op8_arc_to_warc", arc.SQL)
def op8_arc_to_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page archived in the legacy format, converted and read back."""
    return arc.archived(table(spark, sf, "pages"))


@query("op7_personal_data", pii.SQL)
def op7_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data, and terms that disclose them, in every document."""
    return (pii.spans(table(spark, sf, "documents"))
            .select("doc_id", *[pii.count_of(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])],
                    F.sha2(pii.written(4), 256).alias("base_sha256"), pii.written(6).alias("spans")))


@query("op3_quotation_linking", quotes.SQL)
def op3_quotation_linking(spark: SparkSession, sf: str) -> DataFrame:
    """Every message of the conversations, read as quoting mail and put in reply order."""
    return quotes.linked_conversations(quotes.as_mail(table(spark, sf, "conversations")))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's best segmentation and the scores of the best three."""
    return nbest.encode(table(spark, sf, "documents"), nbest.Pieces.read(), keep=["doc_id"])


@query("op6_lm_scores")
def op6_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's score under the model of six of seven folds."""
    return ngram.score_texts(table(spark, sf, "documents"), fold(7) == 2)


@query("op11_merkle_manifest", merkle.SQL)
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's proof under the manifest of all, and whether a tampered text is told by it."""
    docs = table(spark, sf, "documents")
    return merkle.proofs(docs, merkle.manifest(docs, other={"text": merkle.tampered()}))


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document, by patterns and by models learned from all documents."""
    docs = table(spark, sf, "documents")
    return markov.find(docs, markov.learn(docs)).select(
        "doc_id", *[markov.count_of(i).alias(f"n_{k}") for i, k in enumerate(markov.KINDS)],
        F.sha2(markov.written(3), 256).alias("base_sha256"), markov.written(4).alias("spans"))


def looped(key: int | None, words: list[bytes]) -> list[bytes]:
    """Of every tenth key, the words from some place on go round."""
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (period * (-(-(n - a) // len(period))))[:n - a]


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's periodic runs of words, the most repeated one, and the text without repetitions."""
    found = repair.periodic_runs(table(spark, sf, "documents"), change=looped).withColumn("top", repair.most_repeated())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(repair.written(), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The whole training corpus."""
    return corpus_pipeline.run(spark, sf)
