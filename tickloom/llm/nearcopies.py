"""Near copies of texts: equal in at least four fifths of their shingles of five words.

The distinct shingles of a text are its set; texts of equal sets count as one node, however many they are. First come
the links of ``op1``'s method: nodes of equal fingerprints, and of fingerprints that its code finds to be close, are
compared exactly. Those bits reach little more than copies, so what they leave apart is looked for by minima: Each
set has ``BANDS`` keys, each made of ``ROWS`` minima under different hashes; two sets of likeness 0.8 share no key
with a probability of 5e-6. Keys are sorted once, by ranges that also split a key which many sets share, and the sets
of a key are gathered around one of them in one pass over the order, its hub. The hub's place is then taken by its
centre: the set among them that shares most of its keys with any other, as an original does with its edited copies.
Exact comparisons, by the shingles of the
texts, then go in three rounds:

1. each set with the one centre that it shares most keys with;
2. the other pairs with centres whose ends are not in one component yet;
3. where a hub's sets still lie in several components, those apart from the centre's one with all sets of that hub: the
   shingles of these sets are ordered by their number among them, the rarest first, and sets of likeness 0.8 must
   share one of their first shingles (a fifth of the greater set's, a ninth of the smaller one's).

So a large group of near copies costs a few comparisons a text, unlike sets that share a key are told apart by what
is rare in them, and no candidate that could join two components is left out.

For a comparison a set is sent to its hub, as hashes of 48 bits; a hub of many sets is sent to several groups of them,
so that no task has to take a whole group.

Defined cases: words are compared with A-Z lower-cased; a text of fewer than five words is one shingle; null and
empty texts have the empty set and are copies of each other; texts of any length are read whole; rows without a key
are left out; an empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.components import components
from tickloom.llm.workers import tidy
from tickloom.staging import SENT, sendable, stage

SHINGLE = 5
LIKE, OF = 4, 5                 # the least likeness is LIKE / OF
BANDS, ROWS = 40, 6
GROUP = 256                     # sets that are compared with one copy of their hub
AT_ONCE = 512                   # shingles under all hashes at once
HOT = 1000                      # rows from which a class counts as large

_ODD = np.random.default_rng(42).integers(0, 1 << 63, (SHINGLE + 2 * BANDS * ROWS + ROWS,), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _XOR, _TIMES, _IN_BAND = np.split(_ODD, np.cumsum([SHINGLE, BANDS * ROWS, BANDS * ROWS]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """The hashes of a UTF-8 text's distinct shingles, ascending."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))][:len(words)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += each[k:k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(found), AT_ONCE):
        np.minimum(least, ((found[None, i:i + AT_ONCE] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    return _mixed((least.reshape(BANDS, ROWS) * _IN_BAND).sum(axis=1, dtype=np.uint64)
                  + np.arange(BANDS, dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * OF >= LIKE * (len(a) + len(b) - common)


def packed(found: np.ndarray) -> bytes:
    """The upper 48 bits of ascending hashes."""
    return (found >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _sets(docs: DataFrame, fingerprint: Callable[[bytes], int], key: str, text: str) -> DataFrame:
    """(k, h, fp, node, size, bands): h is a hash of the row's text, fp its fingerprint, node a hash of its set."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2)]
            sets = [shingles(t) for t in texts]
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bands = [band_keys(s).view(np.int64) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["k", "h", "fp", "node", "size", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("binary").alias("t"))
            .mapInArrow(tidy(apply), f"k {kind}, h long, fp long, node long, size int, bands array<long>"))


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) * OF >= F.greatest(a, b) * LIKE


def _gathered(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, n, keys): each hub a, the sets that share keys with it (itself included) with their sizes, and how many
    keys; and (a, top): hubs of one key in different tasks, with the least of them. ``members`` is (band, id, size)."""
    names = ["band", "a", "b", "n"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None             # band, hub, its size and whether it has another set, at the end of the batch before
        edge = lambda x: pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((x[0], x[1], x[1], x[2]), kinds)], names=names)
        for batch in batches:
            band, node, size = (batch.column(c).to_numpy() for c in ("band", "id", "size"))
            if not len(band):
                continue
            new = np.concatenate([[last is None or band[0] != last[0]], band[1:] != band[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
            hub = np.where(head >= 0, node[head], last[1] if last else 0)
            its = np.where(head >= 0, size[head], last[2] if last else 0).astype(np.int32)
            if last is None:
                yield edge((band[0], node[0], size[0]))
            rest = ~new
            second = rest & np.concatenate([[last is not None and not last[3]], new[:-1]])      # a hub's first other set
            last = band[-1], hub[-1], its[-1], bool(rest[-1])
            a, b = np.concatenate([hub[rest], hub[second]]), np.concatenate([node[rest], hub[second]])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b),
                                              pa.array(np.concatenate([size[rest], its[second]]))], names=names)
        if last is not None:
            yield edge(last)

    order = ["band", "id"]
    rows = stage(members.repartitionByRange(*order).sortWithinPartitions(*order)
                 .mapInArrow(tidy(apply), "band long, a long, b long, n int"), "hub-pairs")
    edges = rows.where("band IS NOT NULL").select("band", "a", "n")               # two a task
    tops = edges.groupBy("band").agg(F.min(F.struct("a", "n")).alias("top"))
    across = edges.join(F.broadcast(tops), "band").where("a <> top.a").select("top", "a", "n").distinct()
    ends = across.select(F.col("top.a").alias("a"), F.col("a").alias("b"), "n").unionByName(
        across.select("a", F.col("a").alias("b"), "n")).unionByName(
        across.select(F.col("top.a").alias("a"), F.col("top.a").alias("b"), F.col("top.n").alias("n")))
    pairs = (rows.where("band IS NULL").select("a", "b", "n").unionByName(ends)
             .groupBy("a", "b", "n").agg(F.count("*").alias("keys")))
    return stage(pairs, "gathered"), stage(across.select("a", F.col("top.a").alias("top")).distinct(), "split-keys")


def _centred(gathered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hub, a): the centre of each hub's sets; and (a, m, b, n, keys): centres with the other sets of their hubs."""
    shared = stage(gathered.groupBy("b").agg(F.sum("keys").alias("shared")), "shared-keys")
    of = gathered.join(shared, "b").groupBy("a").agg(F.max_by(F.struct("b", "n"), F.struct(
        "shared", -F.col("n"), -F.col("b"))).alias("centre"))
    of = stage(of.select(F.col("a").alias("hub"), F.col("centre.b").alias("a"), F.col("centre.n").alias("m")), "centres")
    stars = (gathered.withColumnRenamed("a", "hub").join(of, "hub").where("a <> b")
             .groupBy("a", "m", "b", "n").agg(F.sum("keys").alias("keys")))
    return of.select("hub", "a"), stage(stars, "stars")


class _Texts:
    """The texts of nodes, each read from one row: the least of its class."""

    def __init__(self, docs: DataFrame, found: DataFrame, classes: DataFrame, key: str, text: str):
        self.rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("binary").alias("t"))
        self.classes = classes.select("id", F.col("least.k").alias("k"), F.col("least.h").alias("h"))
        self.repeated = stage(found.groupBy("k", "h").count().where("count > 1").select("k", "h"), "repeated-rows")
        self.any_repeated = not self.repeated.isEmpty()

    def of(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (id, payload; ids are unique) with t beside each payload, whose length is not known: none is broadcast."""
        wanted = stage(wanted.join(self.classes, "id"), "wanted-texts")
        keys = wanted.select("k", "h")
        # few texts are told by their keys alone before they are shuffled
        rows = self.rows.join(F.broadcast(keys), ["k", "h"], "left_semi") if keys.count() <= SENT else self.rows
        if not self.any_repeated:
            return rows.join(wanted.hint("merge"), ["k", "h"]).select("id", "payload", "t")
        once = rows.join(wanted.join(self.repeated, ["k", "h"], "left_anti").hint("merge"), ["k", "h"]).select("id", "payload", "t")
        often = wanted.join(self.repeated, ["k", "h"], "left_semi")
        texts = rows.join(often.select("k", "h"), ["k", "h"]).groupBy("k", "h").agg(F.min("t").alias("t"))
        return once.unionByName(texts.join(often.hint("merge"), ["k", "h"]).select("id", "payload", "t"))


def _verified(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """Those of ``pairs`` (a, b), which are distinct, whose sets are alike."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for to, t in zip(batch.column(0), batch.column(1)):
                data, to = packed(shingles(t.as_py())), to.as_py()
                for i in range(0, len(to), 64):
                    part = to[i:i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["a"] for x in part], pa.int64()), pa.array([x["part"] for x in part], pa.int32()),
                         pa.array([x["b"] for x in part], pa.int64()), pa.array([data] * len(part))],
                        names=["a", "part", "b", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            a, part, b, data = batch.columns
            keep = []
            for i in range(len(batch)):
                of = a[i].as_py(), part[i].as_py()
                found = unpacked(data[i].as_py())
                if of != hub:           # the hub itself comes first
                    hub, held = of, found
                    keep.append(False)
                else:
                    keep.append(alike(held, found))
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    placed = stage(pairs.join(parts, "a").withColumn("part", F.pmod(F.hash("b"), F.col("parts"))).drop("parts"), "placed-pairs")
    to = lambda b: F.struct("a", "part", F.col(b).alias("b")).alias("to")
    # a hub's own row, with b null, stands before those of its sets
    sent = (placed.select(F.col("b").alias("id"), to("b")).unionByName(
        placed.select("a", "part").distinct().withColumn("none", F.lit(None).cast("long"))
        .select(F.col("a").alias("id"), to("none"))).groupBy("id").agg(F.collect_list("to").alias("payload")))
    rows = (texts.of(sent).select("payload", "t").mapInArrow(tidy(send), "a long, part int, b long, data binary")
            .repartition("a", "part").sortWithinPartitions("a", "part", "b"))
    return stage(rows.mapInArrow(tidy(compare), "a long, b long"), "near-copies")


def _joined(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs`` with ca and cb, the components of a and b. ``of`` is a written table."""
    of = sendable(of, SENT)
    for end in "ab":
        pairs = (pairs.join(of.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left")
                 .withColumn(f"c{end}", F.coalesce("c", end)).drop("c"))
    return pairs


def _fingerprint_links(classes: DataFrame, linked: Callable[[DataFrame], DataFrame], texts: _Texts) -> tuple[DataFrame, DataFrame]:
    """(a, b) of alike sets with equal or linked fingerprints, and their components.

    Sets of one fingerprint are compared with the first of them, which stands for it, and that with the one of the least
    linked fingerprint; then the other links, where their ends are still apart.
    """
    firsts = stage(classes.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("first")).select("fp", "first.*"), "fingerprint-classes")
    one = firsts.select("fp", F.col("id").alias("a"), F.col("size").alias("m"))
    equal = classes.join(one, "fp").where("id <> a").select("a", "m", F.col("id").alias("b"), F.col("size").alias("n"))
    # at least as many tasks as the session shuffles into, as each fingerprint is replicated
    pairs = stage(linked(firsts.select("fp").repartition("fp")), "linked-fingerprints")

    def ends(pairs: DataFrame) -> DataFrame:
        return (pairs.join(one.withColumnRenamed("fp", "x"), "x")
                .join(firsts.select(F.col("fp").alias("y"), F.col("id").alias("b"), F.col("size").alias("n")), "y")
                .where(_sizes_fit("m", "n")).select("a", "b"))

    pairs = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    least = pairs.groupBy("y").agg(F.min("x").alias("x"))
    first = stage(equal.where(_sizes_fit("m", "n")).select("a", "b").unionByName(ends(least)), "fingerprint-pairs")
    links = _verified(first, texts)
    of = stage(components(links), "components")
    # a pair of the first round whose ends are apart was unlike
    rest = stage(_joined(ends(pairs.join(least, ["x", "y"], "left_anti")), of).where("ca <> cb").select("a", "b"), "other-links")
    if rest.isEmpty():
        return links, of
    links = links.unionByName(_verified(rest, texts))
    return links, stage(components(links), "components")


def _rare_pairs(gathered: DataFrame, split: DataFrame, centres: DataFrame, stars: DataFrame, of: DataFrame,
                texts: _Texts) -> DataFrame | None:
    """(a, b) of round 3; None where every hub's sets are in one component."""
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, t in zip(batch.column(0), batch.column(1)):
                found = shingles(t.as_py())
                for i in range(0, len(found), 1 << 16):
                    part = found[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node.as_py())), pa.array(part.view(np.int64)),
                                                      pa.array(np.full(len(part), len(found), np.int32))], names=["id", "s", "size"])

    # a hub's sets, and those of the hubs of the same key in other tasks, against the centre
    groups = gathered.select("a", "b").unionByName(gathered.join(F.broadcast(split), "a").select(F.col("top").alias("a"), "b"))
    groups = groups.withColumnRenamed("a", "hub").join(centres, "hub").select("hub", "a", "b").distinct()
    groups = stage(_joined(groups, of), "hubs-components")
    apart = groups.where("ca <> cb")
    if apart.isEmpty():
        return None
    ends = groups.join(stage(apart.select("hub").distinct(), "hubs-apart"), "hub", "left_semi")
    ends = (ends.select(F.col("b").alias("id"), F.col("cb").alias("c"), (F.col("ca") != F.col("cb")).alias("stray"))
            .unionByName(ends.select(F.col("a").alias("id"), F.col("ca").alias("c"), F.lit(False).alias("stray")))
            .groupBy("id", "c").agg(F.max("stray").alias("stray")))
    rows = stage(texts.of(ends.select("id", F.struct("c", "stray").alias("payload"))).select("id", "t", "payload")
                 .select("id", "t").mapInArrow(tidy(shingled), "id long, s long, size int"), "rare-shingles")
    # many rows a set, of which the same recur: their files are small, so joins by shingle are told to shuffle
    counts = rows.groupBy("s").agg(F.count("*").alias("held")).where("held > 1").hint("merge")
    place = F.row_number().over(Window.partitionBy("id").orderBy("held", "s"))
    # shingles of one set alone come first, and join nothing
    alone = F.col("size") - F.count("*").over(Window.partitionBy("id"))
    first = (rows.join(counts, "s").withColumn("place", place + alone).join(ends, "id")
             .withColumn("probed", F.col("size") - F.ceil(F.col("size") * LIKE / OF) + 1)
             .withColumn("listed", F.col("size") - F.ceil(F.col("size") * (2 * LIKE) / (LIKE + OF)) + 1)
             .where("place <= probed"))
    first = stage(first.select("s", "id", "size", "c", "stray", "place", (F.col("place") <= F.col("listed")).alias("listed")), "first-shingles")
    named = lambda end: first.select("s", *[F.col(c).alias(f"{end}_{c}") for c in ("id", "size", "c", "stray", "place", "listed")])
    # at the first shingle that two alike sets share, what is behind it has to be enough in both
    fits = ("x_c <> y_c AND x_listed AND x_size <= y_size AND x_size * %d >= y_size * %d AND "
            "(1 + least(x_size - x_place, y_size - y_place)) * %d >= (x_size + y_size) * %d" % (OF, LIKE, LIKE + OF, LIKE))
    out = [named("x").where(f"{one}_stray").join(named("y").hint("merge"), "s").where(fits) if one == "x" else
           named("x").join(named("y").where("y_stray").hint("merge"), "s").where(fits) for one in "xy"]
    pairs = out[0].unionByName(out[1]).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    known = stars.where(_sizes_fit("m", "n")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stage(pairs.join(known, ["a", "b"], "left_anti"), "rare-pairs")


def with_class(rows: DataFrame, classes: DataFrame, on: str) -> DataFrame:
    """``rows`` beside their class. ``classes`` (a written table) has ``members``, the number of rows; the rows of large
    classes meet a broadcast of them, if these are not too many, and the others are joined by shuffle."""
    large = classes.where(F.col("members") >= HOT)
    if large.count() > SENT:
        return rows.join(classes, on).drop("members")
    few = rows.join(F.broadcast(large.select(on)), on, "left_anti").join(classes.where(F.col("members") < HOT), on)
    return rows.join(F.broadcast(large), on).unionByName(few).drop("members")


def near_copies(docs: DataFrame, fingerprint: Callable[[bytes], int], linked: Callable[[DataFrame], DataFrame],
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, component_id, keeper): every row with a known key, a hash of its text, the least key that is reachable
    over near copies, itself included, and the least text hash of that key there.

    ``fingerprint`` is of a text's UTF-8; ``linked`` gives the pairs (a, b) of close ones from a table of fingerprints (fp).
    """
    docs = docs.where(F.col(key).isNotNull())
    found = stage(_sets(docs, fingerprint, key, text), "shingle-sets")
    classes = stage(found.groupBy("node").agg(F.min(F.struct("k", "h")).alias("least"), F.count("*").alias("members"),
                                              F.min_by("fp", F.struct("k", "h")).alias("fp"),
                                              F.first("size").alias("size"), F.first("bands").alias("bands"))
                    .withColumn("id", F.monotonically_increasing_id()), "set-classes")
    gathered, split = _gathered(classes.select(F.explode("bands").alias("band"), "id", "size"))
    centres, stars = _centred(gathered)
    texts = _Texts(docs, found, classes, key, text)
    close, of = _fingerprint_links(classes.where("size > 0"), linked, texts)

    fit = stars.where(_sizes_fit("m", "n"))
    best = fit.groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b")
    best = stage(_joined(best, of).where("ca <> cb").select("a", "b"), "first-pairs")
    links = close.unionByName(_verified(best, texts))
    of = stage(components(links), "components")
    rest = stage(_joined(fit.select("a", "b"), of).where("ca <> cb").select("a", "b"), "second-pairs")
    # a pair of the first round whose ends are apart was unlike
    rest = stage(rest.join(best, ["a", "b"], "left_anti"), "other-pairs")
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts))
        of = stage(components(links), "components")
    rare = _rare_pairs(gathered, split, centres, stars, of, texts)
    if rare is not None and not rare.isEmpty():
        of = stage(components(links.unionByName(_verified(rare, texts))), "components")

    joined = sendable(of, SENT).select(F.col("node").alias("id"), F.col("component").alias("c"))
    least = joined.join(classes, "id").groupBy("c").agg(F.min("least").alias("reached"))
    by_class = stage(classes.join(joined.join(least, "c"), "id", "left")
                     .select("node", "members", F.coalesce("reached", "least").alias("least")), "classes")
    return with_class(found.select("k", "h", "node"), by_class, "node").select(
        F.col("k").alias(key), "h", F.col("least.k").alias("component_id"), F.col("least.h").alias("keeper"))
