"""SimHash near-duplicates, found by anchors of a covering code.

Two disjoint blocks of 23 fingerprint bits are each covered by the perfect Golay code: every block value lies
within 3 bits of exactly one code word. An anchor is a pair of code words. A fingerprint's home is its nearest
anchor; a fingerprint within ``THRESHOLD`` bits of it can stray from that home by no more than the covering
radius plus the threshold, so every fingerprint is replicated to all such anchors (61 on average) and meets
its partner at the partner's home, where all 64 bits are compared. No pair is missed, each is found once.

Exact copies share a fingerprint and count as one node, however many they are. Linked fingerprints are joined
into components by star steps.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other; texts of any
length are read whole, in blocks; repeated rows give repeated results; an empty table gives an empty result. A
null key keeps its fingerprint, and its component is the least key that is known (null if there is none). Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.components import components
from tickloom.llm.names import fresh
from tickloom.llm.nearcopies import near_copies, with_class
from tickloom.llm.workers import tidy
from tickloom.staging import stage

SHINGLE, SEED, THRESHOLD = 3, 42, 2
GOLAY = 0b110001110101          # generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the 23-bit code
BLOCK_BITS, RADIUS = 23, 3
AT_ONCE = 1 << 16               # shingles hashed, or fingerprints replicated, at once


def text_fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text: lower-cased A-Z, shingles of three words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words)] + [b""] * (SHINGLE - 1)
        total, counts = 1, _bit_counts([xxhash.xxh64_intdigest(words[0], SEED)])
    else:
        total, counts = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
        for i in range(0, total, AT_ONCE):
            part = words[i:i + AT_ONCE + SHINGLE - 1]
            counts += _bit_counts([xxhash.xxh64_intdigest(b" ".join(s), SEED)
                                   for s in zip(*(part[k:] for k in range(SHINGLE)))])
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): every row's fingerprint as a signed long."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((text_fingerprint(t.as_py() or b"") for t in batch.column(1)), np.uint64,
                                len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(tidy(apply), f"`{key}` {kind}, fp long")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    rest = values.astype(np.int64)
    for bit in range(BLOCK_BITS - 1, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome all patterns of up to ``RADIUS + THRESHOLD`` errors, and by how many each exceeds the
    radius (99 fills up the rows). The first of a row is its only pattern within the radius."""
    every = [sum(1 << b for b in bits) for w in range(RADIUS + THRESHOLD + 1)
             for bits in combinations(range(BLOCK_BITS), w)]
    every = np.array(every, np.int64)
    excess = np.maximum(np.bitwise_count(every).astype(np.int64) - RADIUS, 0)
    of = _syndromes(every)
    order = np.argsort(of, kind="stable")
    of, every, excess = of[order], every[order], excess[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    patterns = np.zeros((2048, place.max() + 1), np.int64)
    over = np.full(patterns.shape, 99, np.int64)
    patterns[of, place], over[of, place] = every, excess
    return patterns, over


def anchors(fps: np.ndarray, patterns: np.ndarray, over: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of fingerprints: their homes alone, or all anchors within radius plus threshold."""
    low = (1 << BLOCK_BITS) - 1
    first, second = (fps & low).astype(np.int64), (fps >> BLOCK_BITS & low).astype(np.int64)
    a, b = _syndromes(first), _syndromes(second)
    if home:
        rows, i, j = np.arange(len(fps)), 0, 0
    else:
        rows, i, j = np.nonzero(over[a][:, :, None] + over[b][:, None, :] <= THRESHOLD)
    return rows, (first[rows] ^ patterns[a[rows], i]) << BLOCK_BITS | (second[rows] ^ patterns[b[rows], j])


def _anchored(fps: DataFrame, home: bool, name: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, over = error_patterns()
        for batch in batches:
            values = batch.column(0).to_numpy()
            for i in range(0, len(values), AT_ONCE >> 4):
                part = values[i:i + (AT_ONCE >> 4)]
                rows, at = anchors(part, patterns, over, home)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[rows])], names=["anchor", name])

    return fps.select("fp").mapInArrow(tidy(apply), f"anchor long, {name} long")


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of different fingerprints (column ``fp``, distinct) within the threshold.

    The planner takes replicas to be as few as fingerprints and would broadcast them; they are joined by shuffle.
    """
    return (_anchored(fps, True, "a").join(_anchored(fps, False, "b").hint("merge"), "anchor")
            .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD))
            .select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): every row with the least key that is reachable over links, itself included."""
    found = stage(fingerprints(docs, key, text), "simhash")
    # a class of equal fingerprints; at least as many tasks as the session shuffles into, as each row is replicated
    classes = stage(found.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("members")), "simhash-classes")
    spread = classes.repartition("fp")
    linked = components(linked_fingerprints(spread))
    linked = linked.select(F.col("node").alias("fp"), "component")
    smallest = (linked.join(classes, "fp").groupBy("component").agg(F.min("least").alias("reached")))
    reached = linked.join(smallest, "component").select("fp", "reached")
    by_class = stage(classes.join(reached, "fp", "left")
                     .select("fp", "members", F.coalesce("reached", "least").alias("component_id")), "simhash-components")
    return with_class(found, by_class, "fp").select(key, "fp", "component_id")


def hexadecimal(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the row of the least key, and there of the least text hash, stays.

    Linked fingerprints, checked exactly, join texts first; near copies that are further apart are found by ``near_copies``.

    It is decided by row, so of several texts with one key each is kept or dropped by its own component. Rows of one
    key and one text are one document, of which one row stays; rows without a key can't be told apart and all stay.
    """
    k, h, row = fresh(docs, "k", "h", "row")
    near = stage(near_copies(docs, text_fingerprint, linked_fingerprints, key, text).groupBy(F.col(key).alias(k), F.col("h").alias(h), "component_id", "keeper")
                 .agg(F.count("*").alias("n")), "decided")
    stays = (F.col(k) == F.col("component_id")) & (F.col(h) == F.col("keeper"))
    same = (F.col(key) == F.col(k)) & (F.xxhash64(F.col(text)) == F.col(h))
    kept = docs.join(near.where(~stays).select(k, h), same, "left_anti")
    repeated = near.where(stays & (F.col("n") > 1)).select(k, h)
    if repeated.isEmpty():
        return kept
    columns = docs.columns
    single = (kept.join(repeated, same).groupBy(k, h).agg(F.min(F.struct(*columns)).alias(row)).select(f"{row}.*"))
    return kept.join(repeated, same, "left_anti").unionByName(single.select(*columns))
