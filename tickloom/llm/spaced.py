"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become lower-case words (runs of letters and digits). Fixed masks pick some of the neighbouring words at
every place; hashes of the picked words are joined between benchmark and documents, so that a changed word
under a mask's gap does not hide a hit. Every hit names a diagonal (the document's place less the item's);
along it the words are compared one by one, and an item is found in a document if any ``WINDOW`` words in a row
(the whole item, if it is shorter) agree in at least ``LEAST`` of their places. The two masks leave no such window
unseen for 12 words and more: whichever places are substituted, one mask fits between them somewhere. An item of
fewer than ``FEWEST`` words is found where all of its words stand in a row: in the same pass, the hash of the whole
item is joined with those of the documents' runs of that many words.

Defined cases: null or empty texts match nothing; texts of any length are read whole. Rows are told apart by key and text; equal rows give equal results,
null keys match each other. Empty tables give empty results. Other columns are not read by ``overlaps`` and
pass ``decontaminated`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.names import fresh
from tickloom.staging import stage

MASKS = ("111101", "10011101")
WINDOW, LEAST, FEWEST = 20, 0.8, 12
BROADCAST_ROWS = 500_000      # seeds of a benchmark, or keys of documents with hits, that are sent to every
                              # executor; more are joined by shuffle


def words(text: str | Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("w", words(F.col(text))).withColumn("w", F.transform("w", lambda x: F.xxhash64(x)))


def _seeds(mask_no: int) -> Column:
    """Hashes of the words ``w`` under a mask, in order of place."""
    mask = MASKS[mask_no]
    picked = [k for k, c in enumerate(mask) if c == "1"]
    return F.when(F.size("w") >= len(mask), F.transform(
        F.sequence(F.lit(0), F.size("w") - len(mask)),
        lambda i: F.xxhash64(F.lit(mask_no), *[F.get("w", i + k) for k in picked]))).otherwise(
        F.array().cast("array<bigint>"))


def _runs(n: int) -> Column:
    """Hashes of all runs of n words ``w``, in order of place."""
    return F.when(F.size("w") >= n, F.transform(
        F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.lit(len(MASKS) + n), *[F.get("w", i + k) for k in range(n)])
    )).otherwise(F.array().cast("array<bigint>"))


def _seeded(df: DataFrame, keys: list[str], short: list[int]) -> DataFrame:
    """(keys, seed, place) of all masks, and of the runs of ``short`` numbers of words."""
    parts = [(len(m), _seeds(i)) for i, m in enumerate(MASKS)] + [(n, _runs(n)) for n in short]
    begins, at = {}, F.lit(0)
    for i, (width, _) in enumerate(parts[:-1], 1):
        at = at + F.greatest(F.size("w") - width + 1, F.lit(0))
        begins[f"begin_{i}"] = at
    every = F.posexplode(F.concat(*[hashes for _, hashes in parts])).alias("place", "seed")
    place = F.col("place")
    for b in begins:        # the last part that begins at or before the place
        place = F.when(F.col("place") >= F.col(b), F.col("place") - F.col(b)).otherwise(place)
    return (df.select(*keys, *[e.alias(b) for b, e in begins.items()], every).withColumn("place", place).drop(*begins))


def _enough(length: Column) -> Column:
    """Words of a window that have to agree: all of a short item's."""
    return F.when(length < FEWEST, length).otherwise(F.ceil(length * LEAST))


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """(key, text_hash, item, matched, length, doc_start) for every row and item found in it.

    ``matched`` of ``length`` words agree in the best window, whose first word in the document is number
    ``doc_start`` (the earliest of equals, from 0). ``text_hash`` tells rows of one key apart.
    """
    bench = _hashed(items.select(F.col(item).alias("item"), F.col(item_text).alias("t")), "t").drop("t")
    bench = stage(bench.where(F.size("w") > 0).withColumn("no", F.xxhash64("item", "w")), "benchmark")
    size = F.size("w")
    short = sorted(r["n"] for r in bench.where(size < FEWEST).select(size.alias("n")).distinct().collect())    # below FEWEST
    of = lambda df: df.select("seed", "no", F.col("place").alias("item_place"), "whole")
    seeds = of(_seeded(bench.where(size >= FEWEST), ["no"], []).withColumn("whole", F.lit(False)))
    for n in short:
        seeds = seeds.unionByName(of(bench.where(size == n).select("no", F.get(_runs(n), F.lit(0)).alias("seed"), F.lit(0).alias("place"),
                                                                   F.lit(True).alias("whole"))))
    seeds = stage(seeds.distinct(), "benchmark-seeds")
    small = seeds.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else (lambda df: df)

    rows = _hashed(docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t")), "t")
    hits = (_seeded(rows, ["k", "h"], short).join(sent(seeds), "seed")
            .select("k", "h", "no", "whole", (F.col("place") - F.col("item_place")).alias("diagonal")))
    if short:       # of a whole item the first place will do
        hits = hits.where("NOT whole").drop("whole").distinct().unionByName(
            hits.where("whole").groupBy("k", "h", "no").agg(F.min("diagonal").alias("diagonal")))
    else:
        hits = hits.drop("whole").distinct()
    # one row for each document with hits: as many entries as it has candidate diagonals
    entries = hits.groupBy("k", "h").agg(F.collect_list(F.struct("no", "diagonal")).alias("entries"))
    entries = stage(entries, "candidates")
    keys = entries.select(F.col("k").alias("ek"), F.col("h").alias("eh"))
    few = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    texts = texts.join(few, F.col("k").eqNullSafe(F.col("ek")) & (F.col("h") == F.col("eh")), "left_semi")
    near = _hashed(texts, "t").alias("r").join(
        entries.alias("e"), F.col("r.k").eqNullSafe(F.col("e.k")) & (F.col("r.h") == F.col("e.h"))
    ).select("r.k", "r.h", "r.w", "e.entries")
    found = near.select("k", "h", "w", F.explode("entries").alias("e")).select("k", "h", "w", "e.*")
    found = (found.join(sent(bench.select("no", "item", F.col("w").alias("iw"))), "no").withColumn("length", F.least(F.size("iw"), F.lit(WINDOW)))
             .withColumn("low", F.greatest(F.lit(0), -F.col("diagonal")))
             .withColumn("high", F.least(F.size("iw"), F.size("w") - F.col("diagonal")) - F.col("length"))
             .where("high >= low")
             .withColumn("same", F.transform(
                 F.slice("iw", F.col("low") + 1, F.col("high") - F.col("low") + F.col("length")),
                 lambda x, j: (x == F.get("w", j + F.col("low") + F.col("diagonal"))).cast("int")))
             .select("k", "h", "item", "length", (F.col("low") + F.col("diagonal")).alias("start"), F.transform(
                 F.sequence(F.lit(1), F.col("high") - F.col("low") + 1),
                 lambda s: F.aggregate(F.slice("same", s, F.col("length")), F.lit(0), lambda a, x: a + x)).alias("sums"))
             .withColumn("matched", F.array_max("sums"))
             .where(F.col("matched") >= _enough(F.col("length")))
             .withColumn("start", F.col("start") + F.array_position("sums", F.col("matched")) - 1))
    best = (found.groupBy("k", "h", "item")
            .agg(F.max(F.struct("matched", "length", (-F.col("start")).alias("back"))).alias("b")))
    return best.select(F.col("k").alias(key), F.col("h").alias("text_hash"), F.col("item").alias(item),
                       F.col("b.matched").alias("matched"), F.col("b.length").alias("length"),
                       (-F.col("b.back")).alias("doc_start"))


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item of the benchmark is found."""
    k, h = fresh(docs, "k", "h")
    found = stage(overlaps(docs, items, key, text).select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct(), "contaminated")
    return docs.join(found, F.col(k).eqNullSafe(docs[key]) & (F.xxhash64(docs[text]) == F.col(h)), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
bw AS (SELECT item_id, len(w) AS m, least(len(w), 20) AS length, unnest(w) AS word, unnest(range(len(w))) AS j
       FROM b),
same AS (SELECT doc_id, item_id, length, m, n, i - j AS diagonal, j FROM dw JOIN bw USING (word)),
enough AS (
  SELECT doc_id, item_id, length, m, n, diagonal, list(j) AS js FROM same
  GROUP BY ALL HAVING count(*) >= CASE WHEN length < 12 THEN length ELSE ceil(length * 0.8) END),
windows AS (
  SELECT doc_id, item_id, length, diagonal, js,
         unnest(range(greatest(0, -diagonal), least(m, n - diagonal) - length + 1)) AS s
  FROM enough),
counted AS (
  SELECT doc_id, item_id, length, diagonal + s AS doc_start,
         len(list_filter(js, lambda j: j >= s AND j < s + length)) AS matched
  FROM windows),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_start) AS r
  FROM counted WHERE matched >= CASE WHEN length < 12 THEN length ELSE ceil(length * 0.8) END)
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(length AS INTEGER) AS length,
       CAST(doc_start AS BIGINT) AS doc_start
FROM placed WHERE r = 1
"""
