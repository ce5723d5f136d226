"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut into units, by one rule whatever its size: at line and sentence ends, and where more than ``MOST`` words
are left, behind words whose hash says so, so that an edit changes the units around it alone. Each digest of a unit
goes into three of a fixed number of cells, as a count, an XOR of digests and an XOR of checks. Two versions' cells are
subtracted, which leaves only the units that differ, and peeling recovers their digests.

The first sketch, of ``CELLS`` cells in base64, is the text's fingerprint. Where it doesn't peel, sketches of the same
size over a fourth, a sixteenth, ... of the digests (those with that many trailing zeros) tell how many differ, and both
texts are sketched again for that number; where that fails, twice as large, until it peels. So two fingerprints alone
give the likeness of texts that differ in a few units; beyond that the final sketches decide, whose number of cells
is returned beside the likeness. A pair's likeness is the share of common units among the units of both.

All texts of a piece of some megabytes are sketched and peeled together in numpy; a text and its edited version have
the digests of what they share computed once.

Defined cases: a null text counts as empty; two texts without units are alike (1), one of them with a text
is not (0); repeated units count as often as they occur; white space inside a unit counts as one space; texts of any
length are read whole. In ``fingerprint_edits`` null keys come last, rows of one key are ordered by their texts, an
empty table gives an empty result, a single row is its own successor; keys may be of any type that has an order; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.staging import stage

CELLS, GROWTH, HASHES = 15, 2, 3
SPARE = 1.6                   # cells a digest that is expected to differ
STRATA = 6                    # of the first size: over all digests, a fourth, a sixteenth, ...
LEAST, EVERY, MOST = 3, 6, 12           # words of a unit: at least, behind one of so many, at most
PIECE = 4_000_000             # characters of texts at once
TABLE = 1 << 21               # cells held at once
START = 16                    # characters of a text that help to split the rows of one key
CELL = np.dtype([("key", "<u8"), ("check", "<u4"), ("count", "<i4")])


def units(text: str) -> list[bytes]:
    data = text.encode(errors="surrogatepass")
    for end in (b".", b"!", b"?"):
        data = data.replace(end + b" ", end + b"\n")
    out = []
    for line in data.split(b"\n"):
        words = line.split()
        if len(words) <= MOST:
            if words:
                out.append(b" ".join(words))
            continue
        at = 0
        for i in [i for i, w in enumerate(words) if not crc32(w) % EVERY] + [len(words) - 1]:
            while i - at >= MOST:
                out.append(b" ".join(words[at:at + MOST]))
                at += MOST
            if i - at + 1 >= LEAST or i == len(words) - 1 >= at:
                out.append(b" ".join(words[at:i + 1]))
                at = i + 1
    return out


def last_end(text: str, before: int) -> int:
    """Where the last line or sentence of ``text[:before]`` begins: units never reach over it."""
    return max([text.rfind("\n", 0, before) + 1, *(at + 2 for e in ".!?" if (at := text.rfind(f"{e} ", 0, before)) >= 0)])


def digests(text: str) -> list[int]:
    return [xxhash.xxh64_intdigest(u) for u in units(text)]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: any salt gives another hash of the digests."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Digests:
    """Digests of many texts' units: ``row`` (ascending) and ``digest`` side by side."""

    def __init__(self, parts: list[list[int]]):
        self.n = len(parts)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.row = np.repeat(np.arange(self.n), self.size)
        self.digest = np.array([d for p in parts for d in p], np.uint64)
        again = np.repeat([len(set(p)) < len(p) for p in parts], self.size)
        if again.any():         # a unit's later occurrences count as others
            at = np.flatnonzero(again)
            at = at[np.lexsort((self.digest[at], self.row[at]))]
            digest, row = self.digest[at], self.row[at]
            new = np.r_[True, (np.diff(row) != 0) | (digest[1:] != digest[:-1])]
            times = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            self.digest[at] = np.where(times > 0, _mixed(digest + times.astype(np.uint64), 77), digest)

    @classmethod
    def of_texts(cls, texts: list[str]) -> Digests:
        return cls([digests(t) for t in texts])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, digest) of the texts ``rows``."""
        first = np.concatenate([[0], np.cumsum(self.size)])
        size = self.size[rows]
        at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        return np.repeat(np.arange(len(rows)), size), self.digest[at]


def _places(digest: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // HASHES
    return [j * third + (_mixed(digest, cells * HASHES + j + 1) % np.uint64(third)).astype(np.int64)
            for j in range(HASHES)]


def sketch(row: np.ndarray, digest: np.ndarray, n: int, cells: int) -> np.ndarray:
    """``n`` sketches of ``cells`` cells each."""
    table = np.zeros(n * cells, CELL)
    check = (_mixed(digest, 99) >> np.uint64(32)).astype(np.uint32)
    for place in _places(digest, cells):
        at = row * cells + place
        np.bitwise_xor.at(table["key"], at, digest)
        np.bitwise_xor.at(table["check"], at, check)
        np.add.at(table["count"], at, np.int32(1))
    return table.reshape(n, cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    out["key"], out["check"], out["count"] = a["key"] ^ b["key"], a["check"] ^ b["check"], a["count"] - b["count"]
    return out


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, digest, sign) of all recovered paragraphs, and for each sketch whether it came out whole."""
    n, cells = table.shape
    flat = table.copy().reshape(-1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        at = np.flatnonzero(np.abs(flat["count"]) == 1)
        key, sign = flat["key"][at], flat["count"][at]
        pure = (_mixed(key, 99) >> np.uint64(32)).astype(np.uint32) == flat["check"][at]
        row, key, sign = at[pure] // cells, key[pure], sign[pure]
        if not len(row):
            break
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]
        first = np.r_[True, (np.diff(row) != 0) | (key[1:] != key[:-1])]
        row, key, sign = row[first], key[first], sign[first]
        found.append((row, key, sign))
        check = (_mixed(key, 99) >> np.uint64(32)).astype(np.uint32)
        for place in _places(key, cells):
            cell = row * cells + place
            np.bitwise_xor.at(flat["key"], cell, key)
            np.bitwise_xor.at(flat["check"], cell, check)
            np.subtract.at(flat["count"], cell, sign)
    flat = flat.reshape(n, cells)
    whole = ((flat["count"] == 0) & (flat["key"] == 0) & (flat["check"] == 0)).all(axis=1)
    row, key, sign = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind)
                      for i, kind in enumerate((np.int64, np.uint64, np.int32)))
    return row, key, sign, whole


def strata(held: Digests) -> np.ndarray:
    """Sketches of the first size of each text, over ever fewer of its digests."""
    out = np.zeros((held.n, STRATA, CELLS), CELL)
    for level in range(STRATA):
        some = held.digest & np.uint64(4 ** level - 1) == 0
        out[:, level] = sketch(held.row[some], held.digest[some], held.n, CELLS)
    return out


def differences(a: Digests, b: Digests, pairs: tuple[np.ndarray, np.ndarray], firsts: tuple[np.ndarray, np.ndarray] | None = None
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all units that one text of a pair has and the other lacks (+1: only in a), and the
    cells of the sketch of each pair that gave them. ``firsts`` are the strata of a and b."""
    firsts = firsts or (strata(a), strata(b))
    left, out = np.arange(len(pairs[0])), []
    most = a.size[pairs[0]] + b.size[pairs[1]]
    expected = most.astype(np.int64)
    used = np.full(len(left), CELLS)
    for level in range(STRATA):
        row, digest, sign, whole = peel(subtract(firsts[0][pairs[0][left], level], firsts[1][pairs[1][left], level]))
        if level == 0:
            done = whole[row]
            out.append((left[row[done]], digest[done], sign[done]))
        else:
            found = np.bincount(row, minlength=len(left))[whole]
            expected[left[whole]] = np.clip(found * 4 ** level, 1, most[left[whole]])
        left = left[~whole]
        if level == 0:
            rest = left
    expected = np.maximum(expected, np.abs(a.size[pairs[0]] - b.size[pairs[1]]))
    steps = np.ceil(np.log2(np.maximum(expected * SPARE / CELLS, 1)) / np.log2(GROWTH)).astype(np.int64).clip(1)
    step = 0
    while len(rest):
        step = max(step + 1, int(steps[rest].min()))
        cells = CELLS * GROWTH ** step
        now, rest = rest[steps[rest] <= step], rest[steps[rest] > step]
        failed = [rest]
        for i in range(0, len(now), max(1, TABLE // cells)):
            part = now[i:i + max(1, TABLE // cells)]
            one, two = (sketch(*x.of(p[part]), len(part), cells) for x, p in ((a, pairs[0]), (b, pairs[1])))
            row, digest, sign, whole = peel(subtract(one, two))
            done = whole[row]
            out.append((part[row[done]], digest[done], sign[done]))
            used[part] = cells
            failed.append(part[~whole])
        rest = np.concatenate(failed)
    return *(np.concatenate([o[i] for o in out]) for i in range(3)), used


def likeness(a: Digests, b: Digests, pairs: tuple[np.ndarray, np.ndarray],
             firsts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Common units of each pair among the units of both, and the cells that it took."""
    pair, _, _, used = differences(a, b, pairs, firsts)
    total = a.size[pairs[0]] + b.size[pairs[1]]
    differ = np.bincount(pair, minlength=len(pairs[0]))
    return np.where(total == 0, 1.0, (total - differ) / np.maximum(total, 1)), used


def encoded(sketches: np.ndarray) -> list[str]:
    return [base64.b64encode(t.tobytes()).decode() for t in sketches]


def _chained(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, k, t, extra) in descending order of key inside tasks; each part ends in an extra copy of the row
    that follows its last, so that every row finds its successor next to it.

    The keys alone are sorted first, with the beginnings of the texts, so that the rows of one key can be split too.
    The firsts of its tasks (a few times as many as tasks) bound the parts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).withColumn("s", F.left("t", F.lit(START)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("k"), F.asc("s")]
    keys = stage(rows.select("k", "s").repartitionByRange(2 * tasks, *order).sortWithinPartitions(*order)
                 .withColumn("m", F.monotonically_increasing_id()), "ordered-keys")
    bounds = keys.groupBy(F.shiftright("m", 33)).agg(F.min_by(F.struct("k", "s"), "m").alias("first"), F.min("m").alias("m"))
    bounds = bounds.agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "first"))), lambda b: b.first).alias("bounds"))
    bounds = stage(bounds, "bounds")
    # the last bound that does not come behind the row, by binary search
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(2 * tasks.bit_length() + 2))])
    not_behind = lambda b: F.when(b.k.isNull(), F.col("k").isNull() & (b.s <= F.col("s"))).otherwise(
        F.col("k").isNull() | (b.k > F.col("k")) | ((b.k == F.col("k")) & (b.s <= F.col("s"))))
    found = F.aggregate(steps, F.lit(0), lambda low, x: F.when(
        (low + x < F.size("bounds")) & not_behind(F.get(F.col("bounds"), low + x)), low + x).otherwise(low))
    placed = rows.withColumn("bounds", bounds.select("bounds").scalar()).withColumn("part", found).drop("bounds")
    heads = bounds.select(F.posexplode("bounds").alias("part", "b"), F.size("bounds").alias("n")).select(
        F.pmod(F.col("part") - 1, F.col("n")).alias("part"), F.col("b.k").alias("head"), F.col("b.s").alias("start"))
    extras = (rows.join(F.broadcast(heads), F.col("k").eqNullSafe(F.col("head")) & (F.col("s") == F.col("start")))
              .groupBy("part", "k").agg(F.min("t").alias("t")))
    every = placed.select("part", "k", "t", F.lit(0).alias("extra")).unionByName(
        extras.select("part", "k", "t", F.lit(1).alias("extra")))
    return (every.repartition(tasks, "part")
            .sortWithinPartitions("part", "extra", F.desc_nulls_last("k"), "t").select("part", "k", "t", "extra"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's fingerprint beside that of an edited version.

    The edit replaces the last third of a text by as much of the beginning of the next one, in descending order
    of key; the first follows the last. The texts are shuffled once, into ranges of keys.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "cells_edited", "cells_next"]

    def answers(rows: list[tuple], more: tuple, kind: pa.DataType) -> pa.RecordBatch:
        texts = [r[2] for r in rows] + [more[2]]
        own, new, written = [], [], []
        for t, u in zip(texts, texts[1:]):
            edited = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
            at = last_end(t, len(t) - len(t) // 3)
            same = digests(t[:at])
            own.append(same + digests(t[at:]))
            new.append(same + digests(edited[at:]))
            written.append(hashlib.sha256(edited.encode()).hexdigest())
        own, new = Digests(own + [digests(more[2])]), Digests(new)
        first, changed = strata(own), strata(new)
        real = np.array([i for i, r in enumerate(rows) if not r[3]], np.int64)
        near, used = likeness(own, new, (real, real), (first, changed))
        after, used_after = likeness(own, own, (real, real + 1), (first, first))
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in real], kind), pa.array([len(texts[i]) for i in real], pa.int64()),
            pa.array([written[i] for i in real], pa.string()),
            pa.array(encoded(first[real, 0]), pa.string()), pa.array(encoded(changed[real, 0]), pa.string()),
            pa.array(near), pa.array(after), pa.array(used, pa.int64()), pa.array(used_after, pa.int64())], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.column(1).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2])
                if size > PIECE and len(held) > 1:
                    yield answers(held[:-1], held[-1], kind)
                    held, size = held[-1:], len(held[-1][2])
        if held:            # the last row of a task is an extra
            yield answers(held, held[-1], kind)

    kind = docs.schema[key].dataType.simpleString()
    return _chained(docs, key, text).mapInArrow(
        apply, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double, cells_edited long, cells_next long")
