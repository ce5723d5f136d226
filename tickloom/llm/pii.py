r"""Personal data: patterns, and terms that reveal them, in DataFrame functions only.

Base entities are e-mail addresses, IP addresses, card numbers (13 to 19 digits with a right check digit) and
phone numbers (9 to 15 digits). Around them corpus statistics decide what else has to go. The unit is a distinct
line of text, so that copies count once: IC(c) = -log2 p(c) is what an entity c tells, PMI(c; t) how much of it a
term t of the same line tells already, and IC - PMI = -log2 p(c|t) what is still uncertain of the entity when the
term is known. p(c|t) is estimated from the n lines that have both and the m lines that have the term as n / (m + 1),
as if one more line had the term without the entity: a name seen once, beside one address, leaves one bit, a word of
two lines of which one has the address already more. A term that leaves at most one bit (``MOST``) discloses the
entity and is generalised in the documents that hold it; it is removed where it leaves at most log2 1.5 bits
(``SURE``), that is, where it was met with the entity again and again and hardly elsewhere. So common words are ruled
out by their spread. The bounds are compared as whole numbers. Terms are words of ``LETTERS`` letters and more.

Positions come from the gaps between matches, summed by a window over a document's own matches; patterns
cannot backtrack, so that long runs of one character cost linear time.

Defined cases: a null text is empty; texts of any length are read whole; repeated rows give repeated results; a
null key is kept; empty tables give empty results. Other columns are not read by ``spans`` and pass
``sanitised`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.names import fresh
from tickloom.staging import stage

KINDS = ("email", "ip", "card", "phone", "removed", "generalised")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
LETTERS = 3
MOST, SURE = (1, 2), (2, 3)         # the least p(c|t) of a term that is generalised, or removed
SMALL = 1_000_000          # candidate terms, or hashes of texts, that are sent to every executor; more are joined by shuffle


def _matches(text: Column, pattern: str) -> Column:
    """Matches in order as (gap, lines, value): the code points and line ends since the match before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    return F.zip_with(gaps, values, lambda g, v: F.struct(
        F.length(g).alias("gap"), (F.length(g) - F.length(F.replace(g, F.lit("\n"), F.lit("")))).alias("lines"),
        v.alias("value")))


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)      # noqa: E731  i-th from the right
    luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + at(i) - F.when(at(i) > 9, 9).otherwise(0))
    return (F.when(kind == 1, value.rlike(PARTS))
            .when(kind == 2, F.when((n >= 13) & (n <= 19), luhn % 10 == 0).otherwise(False))
            .when(kind == 3, (n >= 9) & (n <= 15)).otherwise(True))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Matches exploded in column ``m`` (with number ``i``) as (start, end, line, value)."""
    before = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (rows.select(*keys, "i", "m.*")
            .withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before))
            .withColumn("line", F.sum("lines").over(before))
            .withColumn("start", F.col("end") - F.length("value")).select(*keys, "start", "end", "line", "value"))


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, k, h, kinds): every row, numbered, with the matches of each base kind."""
    t = F.coalesce(F.col("t"), F.lit(""))
    none = F.array().cast("array<struct<gap:int,lines:int,value:string>>")
    digit = t.rlike("[0-9]")
    has = [t.contains("@"), digit, digit, t.contains("+")]
    kinds = F.array(*[F.when(h, _matches(t, p)).otherwise(none) for h, p in zip(has, (EMAIL, IP, CARD, PHONE))])
    return stage(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).select(
        F.monotonically_increasing_id().alias("rid"), "k", F.xxhash64(t).alias("h"), kinds.alias("kinds")), "matches")


def _base(found: DataFrame) -> DataFrame:
    """(rid, h, kind, start, end, line, value) of the base entities."""
    rows = (found.select("rid", "h", F.posexplode("kinds").alias("kind", "ms"))
            .select("rid", "h", "kind", F.posexplode("ms").alias("i", "m")))
    return _placed(rows, ["rid", "h", "kind"]).where(_valid(F.col("kind"), F.col("value")))


def _words(line: Column) -> Column:
    """Distinct lower-case words of a line outside e-mail addresses."""
    plain = F.when(line.contains("@"), F.regexp_replace(line, EMAIL, " ")).otherwise(line)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}{%d,}+" % LETTERS), F.lit(0)))


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SMALL else small


def _at_least(both: Column, spread: Column, share: tuple[int, int]) -> Column:
    """Whether both / (spread + 1) is at least the share."""
    return both * share[1] >= (spread + 1) * share[0]


def _disclosing(docs: DataFrame, base: DataFrame, key: str, text: str) -> DataFrame:
    """(kind, entity, term, removed): the terms that disclose an entity."""
    held = stage(base.select("kind", "entity", "h", "line").distinct(), "entities")
    lines = (docs.select(F.col(text).alias("t")).where("t IS NOT NULL").withColumn("h", F.xxhash64("t"))
             .join(_sent(held.select("h").distinct()), "h", "left_semi").dropDuplicates(["h"])
             .select("h", F.posexplode(F.split("t", "\n")).alias("line", "x")))
    near = (lines.join(held, ["h", "line"]).select("kind", "entity", F.xxhash64("x").alias("unit"), "x").distinct()
            .select("kind", "entity", F.explode(_words(F.col("x"))).alias("term")))
    both = stage(near.groupBy("kind", "entity", "term").agg(F.count("*").alias("both")), "together")
    terms = stage(both.groupBy("term").agg(F.max("both").alias("most")), "terms")
    if terms.isEmpty():
        return both.select("kind", "entity", "term", F.lit(True).alias("removed"))
    every = (docs.select(F.explode(F.split(text, "\n")).alias("x"))
             .select(F.xxhash64("x").alias("unit"), F.explode(_words(F.col("x"))).alias("term")))
    # a term whose least and greatest lines are the same has one line; that is all that a term met once needs
    asked = every.join(F.broadcast(terms.select("term")), "term", "left_semi") if terms.count() <= SMALL else every
    ends = asked.groupBy("term").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    ends = stage(ends.join(terms, "term"), "term-lines")
    spread = ends.where("low = high").select("term", F.lit(1).cast("long").alias("n"))
    again = stage(ends.where("low <> high AND most > 1").select("term", "most"), "repeated-terms")
    if not again.isEmpty():
        # common words are told by a sketch, which errs by 3 %, at twice the bound; the others are counted
        about = every.join(_sent(again), "term").groupBy("term", "most").agg(F.approx_count_distinct("unit", 0.03).alias("n"))
        rare = stage(about.where(F.col("n") <= 2 * F.col("most") * MOST[1] / MOST[0]).select("term"), "rare-terms")
        spread = spread.unionByName(every.join(_sent(rare), "term", "left_semi").groupBy("term")
                                    .agg(F.count_distinct("unit").alias("n")))
    return (both.join(spread, "term").where(_at_least(F.col("both"), F.col("n"), MOST))
            .select("kind", "entity", "term", _at_least(F.col("both"), F.col("n"), SURE).alias("removed")))


def _terms(docs: DataFrame, found: DataFrame, base: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, kind, start, end) of disclosing terms in the rows that hold their entity."""
    marked = stage(base.join(_disclosing(docs, base, key, text), ["kind", "entity"])
                   .groupBy("rid", "h", "term").agg(F.max("removed").alias("removed")), "disclosing")
    rows = found.select("rid", "h").join(marked.select("rid").distinct(), "rid", "left_semi")
    # a text once for each of its hashes, then its words for each row that has it
    texts = (docs.select(F.col(text).alias("t")).where("t IS NOT NULL").withColumn("h", F.xxhash64("t"))
             .join(_sent(rows.select("h").distinct()), "h", "left_semi").groupBy("h").agg(F.first("t").alias("t")))
    words = _placed(texts.select("h", F.posexplode(_matches(F.col("t"), EMAIL + r"|\p{L}++")).alias("i", "m")), ["h"])
    words = words.select("h", "start", "end", F.lower("value").alias("term"))
    return (words.join(marked, ["h", "term"])
            .select("rid", F.when(F.col("removed"), 4).otherwise(5).alias("kind"), "start", "end"))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, spans) of every row: spans is an array of (kind, start, end) by kind and start, in code
    points, the end exclusive; kind is a place in ``KINDS``."""
    found = _found(docs, key, text)
    entity = F.when(F.col("kind") == 0, F.lower("value")).when(F.col("kind") == 1, F.col("value")).otherwise(
        F.regexp_replace("value", "[^0-9]", ""))
    base = stage(_base(found).withColumn("entity", entity), "base-spans")
    terms = _terms(docs, found, base, key, text)
    every = base.select("rid", "kind", "start", "end").unionByName(terms)
    kind = "array<struct<kind:int,start:bigint,end:bigint>>"
    grouped = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(
        F.col("kind").cast("int"), F.col("start").cast("long"), F.col("end").cast("long")))).cast(kind).alias("spans"))
    return (found.select("rid", "k", "h").join(grouped, "rid", "left")
            .select(F.col("k").alias(key), F.col("h").alias("text_hash"),
                    F.coalesce("spans", F.array().cast(kind)).alias("spans")))


def count_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def written(most: int) -> Column:
    """The spans of the kinds before ``most`` as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter("spans", lambda s: s.kind < most), lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start, s.end)), ",")


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities replaced by [KIND], generalised terms by [TERM], and removed terms cut out."""
    k, h, found_spans = fresh(docs, "k", "h", "spans")
    found = (spans(docs, key, text).where(F.size("spans") > 0)
             .select(F.col(key).alias(k), F.col("text_hash").alias(h), F.col("spans").alias(found_spans)).distinct())
    label = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[TERM]")])
    joined = docs.join(found, F.col(k).eqNullSafe(docs[key])
                       & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(h)), "left")
    by_place = F.array_sort(F.transform(found_spans, lambda s: F.struct(s.start.alias("s"), s.end.alias("e"), s.kind.alias("k"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(by_place, start, lambda a, s: F.when(s.s >= a.at, F.struct(
        s.e.alias("at"), F.concat(a.out, F.substring(F.col(text), (a.at + 1).cast("int"), (s.s - a.at).cast("int")),
                                  F.get(label, s.k)).alias("out"))).otherwise(
        F.struct(F.greatest(s.e, a.at).alias("at"), a.out.alias("out"))))
    clean = F.concat(cut.out, F.substring(F.col(text), (cut.at + 1).cast("int"), F.length(text)))
    return joined.withColumn(text, F.when(F.col(found_spans).isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)


_MATCH = """SELECT doc_id, {kind} AS kind, unnest(range(len(m))) AS i, unnest(m) AS value,
  unnest(list_transform(s[1:len(m)], lambda x: len(x))) AS gap,
  unnest(list_transform(s[1:len(m)], lambda x: len(x) - len(replace(x, chr(10), '')))) AS lines
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s FROM d)"""
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS (""" + " UNION ALL ".join(_MATCH.format(kind=k, p=p) for k, p in enumerate((
    _EMAIL, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]"))) + r"""),
placed AS (
  SELECT *, sum(gap + len(value)) OVER w AS stop, sum(lines) OVER w AS line,
         regexp_replace(value, '[^0-9]', '', 'g') AS digits
  FROM raw WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
base AS (
  SELECT doc_id, kind, stop - len(value) AS start, stop, line,
         CASE kind WHEN 0 THEN lower(value) WHEN 1 THEN value ELSE digits END AS entity
  FROM placed
  WHERE kind = 0
     OR kind = 1 AND list_max(list_transform(string_split(value, '.'), lambda x: CAST(x AS DOUBLE))) <= 255
     OR kind = 2 AND len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(len(digits)), lambda i:
          CASE WHEN i % 2 = 0 THEN CAST(digits[len(digits) - i] AS INT)
               ELSE CAST(digits[len(digits) - i] AS INT) * 2
                    - CASE WHEN CAST(digits[len(digits) - i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
     OR kind = 3 AND len(digits) BETWEEN 9 AND 15),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS line FROM d),
lw AS (
  SELECT DISTINCT x, unnest(regexp_extract_all(lower(regexp_replace(x, '""" + _EMAIL + r"""', ' ', 'g')), '\p{L}{3,}')) AS term
  FROM (SELECT DISTINCT x FROM l)),
units AS (SELECT DISTINCT kind, entity, x FROM base JOIN l USING (doc_id, line)),
near AS (SELECT kind, entity, term, count(*) AS n FROM units JOIN lw USING (x) GROUP BY ALL),
spread AS (SELECT term, count(*) AS n FROM lw GROUP BY term),
disclosing AS (
  SELECT kind, entity, term, near.n * 3 >= 2 * (spread.n + 1) AS removed
  FROM near JOIN spread USING (term) WHERE near.n * 2 >= spread.n + 1),
marked AS (SELECT doc_id, term, bool_or(removed) AS removed FROM base JOIN disclosing USING (kind, entity) GROUP BY ALL),
w AS (
  SELECT doc_id, lower(value) AS term, sum(gap + len(value)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, len(value) AS n
  FROM (""" + _MATCH.format(kind=9, p=_EMAIL + r"|\p{L}+").replace("FROM d)", "FROM d SEMI JOIN marked USING (doc_id))") + r""")),
every AS (
  SELECT doc_id, kind, start, stop FROM base
  UNION ALL SELECT doc_id, CASE WHEN removed THEN 4 ELSE 5 END, stop - n, stop FROM w JOIN marked USING (doc_id, term)),
named AS (
  SELECT *, ['email', 'ip', 'card', 'phone', 'removed', 'generalised'][kind + 1] || ':'
            || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM every),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip,
         count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         string_agg(s, ',' ORDER BY kind, start) FILTER (kind < 4) AS based,
         string_agg(s, ',' ORDER BY kind, start) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""
