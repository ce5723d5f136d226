"""Removal of boilerplate lines: lines that many different sites carry.

Each line's sites are summarised by a HyperLogLog sketch, merged by aggregation, so that a line of a third of
all documents costs one sketch a task. Lines whose estimate is near the threshold get an exact distinct count;
the band around the threshold is several standard errors wide, so the result is that of exact counts. A
document loses its boilerplate lines, unless they are most of it: then it is a copy of a document rather than
a page around its own text, near-dedup decides on it, and it is left whole. The share can be lifted (``most``):
then only a text without any line of its own is left whole.

Defined cases: a null text stays null and has no lines; blank lines are never boilerplate and stay; a null site
counts as none; an empty table gives an empty result; rows with equal key and text are treated alike, and null
keys match each other. Lines are compared without the spaces, tabs and returns around them, over whole texts of
any length. Other columns pass unchanged, whatever their names; ``n_chars``, if there, follows the text, and columns
called ``n_lines`` or ``n_removed`` are replaced.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.names import fresh
from tickloom.staging import stage

MIN_SITES = 5          # sites from which a line is boilerplate
MOST = 0.5             # share of a text that may be taken from it
LOG_K = 12             # sketch size, a standard error of 1.6 %


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _line_rows(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """(k, h, site, place, a, b): a row for each line that isn't blank; a and b are two hashes of it."""
    return (docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(site).alias("site"),
                        F.posexplode(_split(F.col(text))).alias("place", "line"))
            .withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
            .select("k", "h", "site", "place", F.xxhash64("line").alias("a"), F.hash("line").alias("b")))


def boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
                min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b): the hashes of all lines that at least ``min_sites`` different sites carry."""
    rows = _line_rows(docs, key, text, site)
    band = 1 + ceil(min_sites * 6 * 1.04 / 2 ** (LOG_K / 2))
    spread = stage(rows.groupBy("a", "b").agg(F.hll_sketch_agg(F.col("site").cast("string"), LOG_K).alias("s"))
                   .select("a", "b", F.hll_sketch_estimate("s").alias("sites"))
                   .where(F.col("sites") >= min_sites - band), "line-spread")
    sure = spread.where(F.col("sites") > min_sites + band).select("a", "b")
    near = spread.where(F.col("sites") <= min_sites + band).select("a", "b")
    exact = (rows.join(near, ["a", "b"], "left_semi").groupBy("a", "b")
             .agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("a", "b"))
    return stage(sure.unionByName(exact), "boilerplate")


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
                        min_sites: int = MIN_SITES, most: float | None = MOST) -> DataFrame:
    """``docs`` with cleaned texts, and ``n_lines`` and ``n_removed`` of each.

    With ``most`` None, every text that has a line of its own loses all boilerplate lines, whatever their share.
    """
    common = boilerplate(docs, key, text, site, min_sites)
    marks = stage(_line_rows(docs, key, text, site).join(common, ["a", "b"], "left_semi")
                  .groupBy("k", "h").agg(F.array_sort(F.collect_set("place")).alias("marks")), "marked-lines")
    own_marks, own_lines, own_cut = fresh(docs, "marks", "lines", "cut")
    joined = docs.alias("d").join(
        marks.alias("m"), F.col(f"d.{key}").eqNullSafe(F.col("m.k")) & (F.xxhash64(F.col(f"d.{text}")) == F.col("m.h")),
        "left").select("d.*", F.col("m.marks").alias(own_marks))
    joined = joined.withColumn(own_lines, _split(F.col(text)))
    size = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda n, i: n + F.length(
        _trimmed(F.get(own_lines, i))).cast("long"))
    every = F.sequence(F.lit(0), F.size(own_lines) - 1)
    own = F.size(own_marks) < F.size(F.filter(own_lines, lambda x: _trimmed(x) != ""))
    cut = F.col(own_marks).isNotNull() & (own if most is None else size(F.col(own_marks)) <= most * size(every))
    kept = F.transform(F.array_except(every, F.col(own_marks)), lambda i: F.get(own_lines, i))
    out = (joined.withColumn(own_cut, F.coalesce(cut, F.lit(False)))
           .withColumn(text, F.when(F.col(own_cut), F.array_join(kept, "\n")).otherwise(F.col(text)))
           .withColumn("n_lines", F.when(F.col(own_lines).isNull(), 0).otherwise(F.size(own_lines)))
           .withColumn("n_removed", F.when(F.col(own_cut), F.size(own_marks)).otherwise(0)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(own_cut), F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(own_lines, own_marks, own_cut)


SQL = """
WITH l AS (
  SELECT doc_id, source, line, i, trim(line, ' ' || chr(9) || chr(13)) AS t FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents WHERE text IS NOT NULL)),
common AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 5),
marked AS (SELECT *, t IN (SELECT t FROM common) AS bad FROM l),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad,
         coalesce(sum(length(t)) FILTER (bad), 0) <= 0.5 * sum(length(t)) AS cut,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(CASE WHEN cut THEN n_bad ELSE 0 END AS INTEGER) AS n_removed,
       CASE WHEN cut AND n_bad > 0 THEN coalesce(kept, '') ELSE text END AS text
FROM documents d LEFT JOIN per USING (doc_id)
"""
