"""Chat formatting by quotation linking, in DataFrame functions only.

Messages quote others as mail does: every ``>`` before a line is one level of quoting. A passage is a line;
its hash, after lower-casing and squeezing white space, is joined to the message of the same conversation that
said it first, without quoting it. What a message quotes at level one names the message that it answers: the
latest one, if it quotes several. Replies are ordered behind what they answer: threads by their first turn, then
by turn, so that every message comes after its parent. Quoted lines are taken out of the texts.

The first saying of a passage is an aggregate (one row for each passage and conversation, however often it
occurs), so links cost one join and no pairs; roots are found by pointer doubling, in as many rounds as the
logarithm of the longest chain.

Defined cases: a null text stays null, an empty one stays empty, texts of any length are read whole; blank lines
are no passages. Rows with equal conversation and turn count as one message, whose lines are those of all of
them, and all are returned. A null conversation or turn links to nothing. A message that quotes only itself,
later turns or unknown text starts a thread. Empty tables give empty results. Other columns pass unchanged,
whatever their names; those of the result (reply_to, thread, depth, n_quoted, chat) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.staging import stage

MARK = r"^(?:[ \t]*>)+[ \t]?"
ADDED = ("reply_to", "thread", "depth", "n_quoted", "chat")


def level(line: Column) -> Column:
    mark = F.regexp_extract(line, MARK, 0)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARK, "")), r"[ \t\r]+", " "))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def replies(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(c, t, parent, n_quoted): messages that quote earlier ones, each once."""
    lines = (messages.select(F.col(conversation).alias("c"), F.col(turn).alias("t"),
                             F.explode(_lines(F.col(text))).alias("line"))
             .where("c IS NOT NULL AND t IS NOT NULL")
             .select("c", "t", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("p"))
             .where("p <> ''").select("c", "t", "level", F.xxhash64("p").alias("a"), F.hash("p").alias("b")))
    said = lines.where("level = 0").groupBy("c", "a", "b").agg(F.min("t").alias("said"))
    quoted = lines.where("level > 0").distinct()
    linked = quoted.join(said, ["c", "a", "b"]).where("said < t")
    return (linked.groupBy("c", "t").agg(F.max(F.when(F.col("level") == 1, F.col("said"))).alias("parent"),
                                         F.count("*").alias("n_quoted")))


def roots(replied: DataFrame) -> DataFrame:
    """(c, t, thread, depth) of every message with a parent."""
    at = stage(replied.where("parent IS NOT NULL").select("c", "t", F.col("parent").alias("up"),
                                                          F.lit(1).alias("depth")), "parents")
    while True:
        above = at.select("c", F.col("t").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = stage(at.join(above, ["c", "up"], "left"), "ancestors")
        done = moved.where("next IS NOT NULL").isEmpty()
        at = moved.select("c", "t", F.coalesce("next", "up").alias("up"),
                          (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if done:
            return at.select("c", "t", F.col("up").alias("thread"), "depth")


def linked_conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """``messages`` without quoted lines, and with ``reply_to``, ``thread``, ``depth``, ``n_quoted`` and ``chat``,
    the message as one block of a chat. Sorted by (conversation, thread, turn) they read in reply order."""
    replied = stage(replies(messages, conversation, turn, text), "replies")
    links = replied.join(roots(replied), ["c", "t"], "left")
    kept = [c for c in messages.columns if c not in ADDED]
    own = F.array_join(F.filter(_lines(F.col(text)), lambda x: level(x) == 0), "\n")
    links = links.select(*[F.col(x).alias(f"__{x}") for x in ("c", "t", "parent", "n_quoted", "thread", "depth")])
    joined = messages.select(*[F.col(x) for x in kept]).withColumn(text, own).join(
        links, (F.col(conversation) == F.col("__c")) & (F.col(turn) == F.col("__t")), "left")
    return joined.select(
        *[F.col(x) for x in kept], F.col("__parent").alias("reply_to"), F.coalesce("__thread", turn).alias("thread"),
        F.coalesce("__depth", F.lit(0)).alias("depth"),
        F.coalesce("__n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.concat(F.lit("<|"), F.coalesce(role, F.lit("user")), F.lit("|>\n"), F.coalesce(text, F.lit("")),
                 F.lit("\n<|end|>")).alias("chat"))


def as_mail(messages: DataFrame) -> DataFrame:
    """The given conversations as quoting mail: an odd turn answers the one before it, an even turn the one two
    before; it quotes that message's text, and one level deeper what that message itself answers."""
    answers = F.when(F.col("turn") % 2 == 1, F.col("turn") - 1).otherwise(F.col("turn") - 2)
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    one = said.select(F.col("conv_id").alias("c1"), F.col("turn").alias("t1"), F.col("text").alias("x1"))
    two = said.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("text").alias("x2"))
    nested = F.when(F.col("t1") % 2 == 1, F.col("t1") - 1).otherwise(F.col("t1") - 2)
    mark = lambda x, m: F.array_join(F.transform(_lines(F.col(x)), lambda y: F.concat(F.lit(m), y)), "\n")
    return (messages.join(one, (F.col("conv_id") == F.col("c1")) & (answers == F.col("t1")), "left")
            .join(two, (F.col("conv_id") == F.col("c2")) & (nested == F.col("t2")), "left")
            .select("conv_id", "turn", "role", F.concat_ws("\n", mark("x2", ">> "), mark("x1", "> "), "text").alias("text")))


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 1 THEN turn - 1 ELSE turn - 2 END AS up FROM conversations),
said AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
mail AS (
  SELECT m.conv_id, m.turn, m.role,
         concat_ws(chr(10), array_to_string(list_transform(string_split(b.text, chr(10)), lambda x: '>> ' || x), chr(10)),
                   array_to_string(list_transform(string_split(a.text, chr(10)), lambda x: '> ' || x), chr(10)),
                   m.text) AS text
  FROM m LEFT JOIN said a ON a.conv_id = m.conv_id AND a.turn = m.up
  LEFT JOIN said b ON b.conv_id = m.conv_id
    AND b.turn = CASE WHEN a.turn % 2 = 1 THEN a.turn - 1 ELSE a.turn - 2 END),
l AS (
  SELECT conv_id, turn, role, i, line, len(mark) - len(replace(mark, '>', '')) AS level,
         trim(regexp_replace(lower(line[len(mark) + 1:]), '[ \t\r]+', ' ', 'g')) AS p
  FROM (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+[ \t]?') AS mark FROM (
    SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS i FROM mail))),
first AS (SELECT conv_id, p, min(turn) AS said FROM l WHERE level = 0 AND p <> '' GROUP BY ALL),
linked AS (
  SELECT DISTINCT q.conv_id, q.turn, q.level, q.p, f.said
  FROM l q JOIN first f ON f.conv_id = q.conv_id AND f.p = q.p AND f.said < q.turn WHERE q.level > 0),
replied AS (
  SELECT conv_id, turn, max(said) FILTER (level = 1) AS parent, count(*) AS n_quoted FROM linked GROUP BY ALL),
tree AS (
  SELECT DISTINCT c.conv_id, c.turn, c.turn AS thread, 0 AS depth
  FROM conversations c LEFT JOIN replied r ON r.conv_id = c.conv_id AND r.turn = c.turn WHERE r.parent IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.thread, t.depth + 1 FROM tree t JOIN replied r ON r.conv_id = t.conv_id AND r.parent = t.turn),
own AS (
  SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), '') AS text
  FROM l GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, o.text, r.parent AS reply_to, t.thread, CAST(t.depth AS INTEGER) AS depth,
       coalesce(r.n_quoted, 0) AS n_quoted, '<|' || m.role || '|>' || chr(10) || o.text || chr(10) || '<|end|>' AS chat
FROM mail m JOIN own o USING (conv_id, turn) JOIN tree t USING (conv_id, turn) LEFT JOIN replied r USING (conv_id, turn)
"""
