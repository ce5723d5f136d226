"""A training corpus from raw documents: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import langid, lines, nbest, simhash, spaced
from tickloom.staging import stage

LEAST_SCORE = 0.4      # mean probability below which no language is believed,
LONG_ENOUGH = 40       # of texts that have so many characters


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and longer ones of which no language is likely; without labels all others stay."""
    net = langid.learn(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, net)
    likely = (F.col("score") >= LEAST_SCORE) | (F.length("text") < LONG_ENOUGH)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & likely).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites carry go out of the texts; a text of such lines alone is left whole for near-dedup."""
    return lines.without_boilerplate(docs, most=None).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles) the document with the least id stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark go."""
    return spaced.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids."""
    return nbest.encode(docs, nbest.Pieces.read())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL can't express the network or the piece lattice; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
