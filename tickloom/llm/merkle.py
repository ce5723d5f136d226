"""Merkle manifest of a table, with a proof for every row from one octopus multiproof a leaf partition.

Each row is a leaf: the SHA-256 (lowercase hex, as all digests here are hashed as hex text) of its fields, each
``-`` if null, else its UTF-8 byte count, ``:`` and the value. The leaves of one value of ``by`` form a tree, in
ascending order of key: every ``FAN`` consecutive nodes (the last run may be shorter, even one) become the digest
of their concatenation until one node, the subroot, remains. The subroots, in order of ``by`` with null first,
form the top tree in the same way; its last node is the root.

A leaf partition holds ``BLOCK`` consecutive leaves of a tree, so a tree of any size is split evenly. Each
partition computes the coordinates of all nodes that it needs and cannot derive from its own leaves (the minimal
union over its proofs), fetches them in one join, derives the interiors that its proofs share, and expands every
row's proof in place. Only one node in ``BLOCK`` is written above the leaves.

Defined cases: a null text differs from an empty one; null keys come first; rows with one key are ordered by
their leaf, equal rows are leaves of their own; an empty table gives an empty result and has no root; a lone leaf
is its subroot, a lone subroot the root, and both have an empty proof. Columns that are not among the fields
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.staging import stage

FAN = 8
LEVELS = 4
BLOCK = FAN ** LEVELS
TOP = -1                                    # number of the tree over the subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART_BITS = 33                              # of a row number by Spark: its place inside the task
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Path = list[tuple[bytes, bytes]]            # by level: the siblings before a node and those behind it


def leaf_digest(fields: list[Column]) -> Column:
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def digest(nodes: bytes) -> bytes:
    return sha256(nodes).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def raised(nodes: list[bytes]) -> list[bytes]:
    return [digest(b"".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]


def missing(n: int, known: Iterable[int]) -> list[tuple[int, int]]:
    """(level, place) of all nodes that the proofs of the ``known`` leaves of ``n`` need and these can't give."""
    out, level, nodes = [], 0, sorted(known)
    while n > 1:
        have, parents = set(nodes), sorted({i // FAN for i in nodes})
        out += [(level, i) for p in parents for i in range(p * FAN, min(p * FAN + FAN, n)) if i not in have]
        n, level, nodes = -(-n // FAN), level + 1, parents
    return out


def interiors(n: int, first: int, leaves: list[bytes], fetched: dict[tuple[int, int], bytes]) -> list[dict[int, bytes]]:
    """By level, all nodes that the leaves from place ``first`` on and the ``fetched`` ones give."""
    out = []
    nodes = {first + i: h for i, h in enumerate(leaves)}
    for level in range(depth(n)):
        nodes |= {i: h for (at, i), h in fetched.items() if at == level}
        out.append(nodes)
        parents = {i // FAN for i in nodes}
        nodes = {p: digest(b"".join(nodes[i] for i in range(p * FAN, min(p * FAN + FAN, n)))) for p in parents}
        n = -(-n // FAN)
    return [*out, nodes]


def path_of(levels: list[dict[int, bytes]], place: int, level: int, known: dict) -> Path:
    """Siblings of a node up to the last level; paths of inner nodes are shared through ``known``."""
    if level == len(levels) - 1:
        return []
    if (level, place) not in known:
        nodes, run = levels[level], place // FAN * FAN
        known[level, place] = [(b"".join(nodes[i] for i in range(run, place)),
                                b"".join(nodes[i] for i in range(place + 1, run + FAN) if i in nodes)),
                               *path_of(levels, place // FAN, level + 1, known)]
    return known[level, place]


def folded(leaf: bytes, path: Path) -> bytes:
    for before, behind in path:
        leaf = digest(before + leaf + behind)
    return leaf


def numbered(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` with ``place``, the number of each row in ascending order (nulls first), without one task for all."""
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("m", F.monotonically_increasing_id()), label)
    task = F.shiftright("m", PART_BITS)
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)       # one row a task
    offsets = (rows.groupBy(task.alias("task")).count()
               .select("task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    return (rows.withColumn("task", task).join(F.broadcast(offsets), "task")
            .withColumn("place", F.col("offset") + F.col("m").bitwiseAND((1 << PART_BITS) - 1))
            .drop("m", "task", "offset"))


@dataclass
class Manifest:
    """``rows`` (tree, block, place, n, k, leaf, other), ``nodes`` (tree, level, place, h) above the leaf
    partitions, ``trees`` (tree, value, n, subroot) and the root (None of an empty table)."""
    rows: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def _climbed(nodes: DataFrame, whole: bool) -> DataFrame:
    """(tree, n, level, place, h): from nodes of the same columns, by partitions of ``BLOCK``, those of the next
    levels; only the topmost of each partition unless ``whole``."""
    def apply(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        rows = table.sort_by("place")
        n, level = rows["n"][0].as_py(), rows["level"][0].as_py()
        held, out = rows["h"].cast(pa.binary()).to_pylist(), []
        last = min(depth(n), level + LEVELS)
        place = block * BLOCK
        while level < last:
            held, level, place = raised(held), level + 1, place // FAN
            if whole or level == last:
                out += [(tree, n, level, place + i, h.decode()) for i, h in enumerate(held)]
        if not out and not whole:           # a lone leaf
            out = [(tree, n, level, place, held[0].decode())]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (
            pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["tree", "n", "level", "place", "h"])

    return (nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block"))
            .applyInArrow(apply, "tree long, n long, level int, place long, h string"))


def _depth(n: Column) -> Column:
    """Levels above n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN ** e) for e in range(21)]), lambda p: p < n))


def _grown(tops: DataFrame, most: int, level: int) -> DataFrame:
    """``tops`` (all of one level) and every node above them; ``most`` is the size of the largest tree."""
    out, step = tops, tops
    while level < depth(most):
        step = stage(_climbed(step.where((F.col("level") == level) & (_depth(F.col("n")) > level)), whole=True), "tree-nodes")
        out = out.unionByName(step)
        level += LEVELS
    return out


def manifest(docs: DataFrame, key: str = "doc_id", by: str = "lang", fields: tuple[str, ...] = FIELDS,
             other: dict[str, Column] | None = None) -> Manifest:
    """The trees of ``docs``. ``other`` replaces fields of the leaf that is kept beside the true one (``other``)."""
    true = leaf_digest([F.col(f) for f in fields])
    changed = leaf_digest([(other or {}).get(f, F.col(f)) for f in fields]) if other else true
    leaves = stage(docs.select(F.col(by).alias("value"), F.col(key).alias("k"), true.alias("leaf"), changed.alias("other")),
                   "leaves")
    # equal rows may be dealt to different tasks
    rows = numbered(leaves.withColumn("salt", F.rand(7)), ["value", "k", "leaf", "salt"], "ordered-leaves").drop("salt")
    sizes = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("place").alias("start"))
    trees = stage(numbered(sizes, ["start"], "trees").withColumnRenamed("place", "tree"), "numbered-trees")
    rows = (rows.join(trees.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v")))
            .withColumn("place", F.col("place") - F.col("start")).drop("value", "v", "start"))
    # each partition's topmost node, then the few nodes above
    tops = stage(_climbed(rows.select("tree", "n", F.lit(0).alias("level"), "place", F.col("leaf").alias("h")), False),
                 "partition-tops")
    most, count = trees.agg(F.max("n"), F.count("*")).first()
    rows = rows.withColumn("block", F.floor(F.col("place") / BLOCK))
    if not count:
        return Manifest(rows, tops, trees.withColumn("subroot", F.lit(None).cast("string")), None)
    low = tops.where(F.col("level") < LEVELS)
    high = _grown(tops.where(F.col("level") == LEVELS), most, LEVELS)
    subroots = stage(low.unionByName(high).where(F.col("level") == _depth(F.col("n")))
                     .select("tree", F.col("h").alias("subroot")), "subroots")
    top = _grown(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(count).alias("n"),
                                 F.lit(0).alias("level"), F.col("tree").alias("place"), F.col("subroot").alias("h")), count, 0)
    root = top.where(F.col("level") == depth(count)).first()["h"]
    return Manifest(rows, high.unionByName(top).drop("n"), trees.join(subroots, "tree").drop("start"), root)


def _requests(held: Manifest) -> DataFrame:
    """(tree, block, at, level, place): for each leaf partition the nodes that its proofs lack, and its subroot."""
    count = held.trees.count()

    def apply(batches):
        for batch in batches:
            for tree, n, block in zip(*(c.to_pylist() for c in batch.columns)):
                known = range(block * BLOCK, min(n, block * BLOCK + BLOCK))
                wanted = ([(tree, *x) for x in missing(n, known)] + [(TOP, *x) for x in missing(count, [tree])]
                          + [(TOP, 0, tree)])
                at, level, place = zip(*wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(at), pa.int64()), pa.array([block] * len(at), pa.int64()),
                     pa.array(at, pa.int64()), pa.array(level, pa.int32()), pa.array(place, pa.int64())],
                    names=["tree", "block", "at", "level", "place"])

    partitions = held.trees.select("tree", "n", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    return partitions.mapInArrow(apply, "tree long, block long, at long, level int, place long")


def proofs(docs: DataFrame, held: Manifest, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs`` under its manifest.

    The proof is the siblings level by level from leaf to root, left to right; ``folded_root`` comes from the
    row's ``other`` leaf and the proof, and is ``verified`` if it is the root.
    """
    root = held.root
    kind = docs.schema[key].dataType.simpleString()
    count = held.trees.count()

    def apply(group: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        tree, first = group[0].as_py(), group[1].as_py() * BLOCK
        rows = rows.sort_by("place")
        fetched = {(at, level, i): h.encode() for at, level, i, h in zip(*(
            nodes[c].to_pylist() for c in ("at", "level", "place", "h")))}
        of = lambda t: {(level, i): h for (at, level, i), h in fetched.items() if at == t}
        leaves = rows["leaf"].cast(pa.binary()).to_pylist()
        others = rows["other"].cast(pa.binary()).to_pylist()
        levels = interiors(rows["n"][0].as_py() if len(leaves) else 0, first, leaves, of(tree))
        subroot = levels[-1][0]
        above = path_of(interiors(count, tree, [subroot], {x: h for x, h in of(TOP).items() if x != (0, tree)}), tree, 0, {})
        known: dict = {}
        proof, found = [], []
        for i, other in enumerate(others):
            path = path_of(levels, first + i, 0, known) + above
            proof.append(sha256(b"".join([x for pair in path for x in pair])).hexdigest())
            found.append(folded(other, path).decode())
        published = fetched[TOP, 0, tree].decode()
        n = len(leaves)
        return pa.table([rows["k"], rows["leaf"], pa.array([published] * n), pa.array([root] * n), pa.array(proof),
                         pa.array(found), pa.array([f == root for f in found])],
                        names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = (f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    if root is None:
        return docs.sparkSession.createDataFrame([], schema)
    fetched = stage(_requests(held).join(held.nodes.withColumnRenamed("tree", "at"), ["at", "level", "place"]), "fetched-nodes")
    return (held.rows.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block"))
            .applyInArrow(apply, schema))


def tampered(text: str = "text", key: str = "doc_id") -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal key."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.when(crc % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))


def _sql(levels: int = 8, top_levels: int = 4) -> str:
    """The twin: each level of the trees is a table of its nodes with their siblings to the left and right."""
    crc = ("list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
           "lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))")
    field = lambda c: (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')")
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"

    def tree(name: str, first: str, by: str, count: int) -> str:
        out = [f"{name}_n0 AS ({first})"]
        for i in range(count):
            run = f"PARTITION BY {by}, i // {FAN} ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}_w{i} AS MATERIALIZED (SELECT {by}, i, h, count(*) OVER (PARTITION BY {by}) > 1 AS up,
                coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_n{i})""")
            out.append(f"""{name}_n{i + 1} AS (SELECT {by}, i // {FAN} AS i, CASE WHEN bool_or(up)
                THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}_w{i} GROUP BY {by}, i // {FAN})""")
        return ",\n".join(out)

    def climb(name: str, first: str, by: str, count: int) -> str:
        out = [f"{name}_p0 AS ({first})"]
        for i in range(count):
            out.append(f"""{name}_p{i + 1} AS (SELECT p.* REPLACE (p.i // {FAN} AS i,
                CASE WHEN up THEN sha256(l || f || r) ELSE f END AS f, proof || CASE WHEN up THEN l || r ELSE '' END AS proof)
                FROM {name}_p{i} p JOIN {name}_w{i} w ON p.{by} IS NOT DISTINCT FROM w.{by} AND p.i = w.i)""")
        return ",\n".join(out)

    return f"""
WITH leaves AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 <> 0 THEN NULL ELSE
       {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
{tree("a", "SELECT lang, i, leaf AS h FROM placed", "lang", levels)},
subs AS MATERIALIZED (SELECT 0 AS one, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM a_n{levels}),
{tree("t", "SELECT one, i, h FROM subs", "one", top_levels)},
{climb("a", "SELECT doc_id, lang, i, leaf, coalesce(changed, leaf) AS f, '' AS proof FROM placed", "lang", levels)},
{climb("t", f"SELECT p.doc_id, p.leaf, s.h AS subroot, s.one, s.i, p.f, p.proof FROM a_p{levels} p JOIN subs s ON p.lang IS NOT DISTINCT FROM s.lang", "one", top_levels)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM t_p{top_levels} JOIN t_n{top_levels} USING (one)
"""


SQL = _sql()
