r"""Secrets in texts: patterns, and strings that look random rather than named.

Three patterns give the base spans: values assigned to a key word, access keys, and hexadecimal strings. Beside
them every string of ``LEAST`` and more characters of ``SYMBOLS`` is judged by two character Markov models of order
two (backed off to order one), one of random strings and one of ordinary identifiers. A string whose log-likelihood
ratio is at least ``BITS`` bits is a secret, of kind ``random``. A trigram counts once in a string, so that repetition
(``aaaa``, ``====``) is no evidence.

The models are learned from labelled samples. Random: the values that the base patterns find in all texts, and
``GENERATED`` strings of each alphabet in ``ALPHABETS`` drawn with a fixed seed, which weigh at least as much.
Ordinary: all strings of fewer than ``LEAST`` characters in all texts outside base values, and names of the Python
language joined in the usual ways, which weigh ``NAMES_SHARE`` of the former. Each task counts trigrams over its rows
and the counts are added by an aggregation; the table that reaches the driver and the tasks is bounded by the
alphabet, not by the data.

Defined cases: a null text is empty and has no spans; texts of any length are read whole; repeated rows give repeated
results; a null key is kept; an empty table gives an empty result (the models then come from the fixed samples alone).
Spans are in code points, the end exclusive. Other columns are not read by ``find`` and pass ``redacted`` unchanged,
whatever their names.
"""

from __future__ import annotations

import builtins
import keyword
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"               # a shorter match cannot be had from the same place or inside it
HEX = r"[0-9a-f]{16,}"
VALUE = 12                                  # characters of an assigned value
LEAST = 16
BITS = 64.0
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = DIGITS + SMALL + LARGE + "+/_=-"
ALPHABETS = (DIGITS + "abcdef", DIGITS + SMALL, DIGITS + LARGE, DIGITS + SMALL + LARGE, DIGITS + SMALL + LARGE + "+/",
             DIGITS + SMALL + LARGE + "_-")
GENERATED, LONG, SEED = 4000, 40, 42
NAMES_SHARE = 0.1
BACKED = 2.0                                # weight of order one in order two, and of evenness in order one

PIECE = 1 << 22                             # bytes of text that are looked through at once
STEP = 1 << 20                              # symbols counted at once

S = len(SYMBOLS) + 1                        # 0 stands before and after a string
_CODE = bytes(SYMBOLS.find(chr(i)) + 1 for i in range(256))
_ASSIGN = re.compile(ASSIGN.encode(), re.I)
_KEYWORDS = (b"passw", b"secret", b"token", b"api")         # no assignment without one of them
_INSIDE = (re.compile(ACCESS.encode()), re.compile(HEX.encode()))


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(bytearray(text.translate(_CODE)), np.uint8)


def trigrams(codes: np.ndarray) -> np.ndarray:
    """A number for each symbol with the two before it in its string, of strings with zeros between."""
    codes = np.concatenate([[0, 0], codes]).astype(np.int32)
    before = codes[1:-1]
    return ((codes[:-2] * (before > 0) * S + before) * S + codes[2:])[codes[2:] > 0]


def _count(codes: np.ndarray) -> np.ndarray:
    total = np.zeros(S ** 3, np.int64)
    for i in range(0, len(codes), STEP):
        first = max(0, i - 2)
        # the two symbols before the step give the context only
        part = codes[first:i + STEP]
        total += np.bincount(trigrams(part), minlength=S ** 3)
        if first < i:
            total -= np.bincount(trigrams(part[:i - first]), minlength=S ** 3)
    return total


def _long_strings(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of ``LEAST`` and more symbols."""
    edges = np.flatnonzero(np.diff((codes > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    long = edges[1::2] - edges[::2] >= LEAST
    return edges[::2][long], edges[1::2][long]


def _lines_with(text: bytes, words: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """(start, end) of the lines that hold one of the lower-case ``words``, in either case."""
    lower, found = text.lower(), set()
    for word in words:
        at = lower.find(word)
        while at >= 0:
            end = lower.find(b"\n", at)
            end = len(lower) if end < 0 else end
            found.add((lower.rfind(b"\n", 0, at) + 1, end))
            at = lower.find(word, end)
    return sorted(found)


def looked_through(texts: Iterable[bytes]) -> Iterator[tuple[list[bytes], bytes, np.ndarray, list, list]]:
    """Pieces of texts as (texts, their bytes joined by line ends, codes, base matches, long strings). Matches are
    (start, kind, end, start of the value), strings are (start, end), both in order, in bytes of the joined text."""
    def looked(part: list[bytes]):
        joined = b"\n".join(part)           # no pattern reaches over a line end
        codes = _codes(joined)
        strings = list(zip(*(x.tolist() for x in _long_strings(codes))))
        base = [(m.start(), 0, m.end(), m.start(2)) for a, b in _lines_with(joined, _KEYWORDS)
                for m in _ASSIGN.finditer(joined, a, b) if len(m[2]) >= VALUE]
        base += [(m.start(), kind, m.end(), m.start()) for a, b in strings
                 for kind, p in enumerate(_INSIDE, 1) for m in p.finditer(joined, a, b)]
        return part, joined, codes, sorted(base), strings

    held, size = [], 0
    for text in texts:
        if held and size + len(text) > PIECE:
            yield looked(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield looked(held)


def sample_counts(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the random and the ordinary strings that ``texts`` hold."""
    total = np.zeros((2, S ** 3), np.int64)
    for _, joined, codes, base, strings in looked_through(texts):
        total[0] += _count(_codes(b"\n".join([joined[v:b] for _, _, b, v in base])))
        for a, b in strings + [(v, b) for _, _, b, v in base]:
            codes[a:b] = 0
        total[1] += _count(codes)
    return total[0], total[1]


def random_strings(seed: int = SEED, count: int = GENERATED) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(np.array(list(a))[x]) for a in ALPHABETS for x in rng.integers(0, len(a), (count, LONG))]


def names() -> list[str]:
    """Names of the language, joined by an underscore, a hyphen, a slash or a capital, with a number behind, and all
    of these in capitals; numbers that count up, alone and grouped."""
    known = sorted({*sys.stdlib_module_names, *dir(builtins), *keyword.kwlist})
    joined = [f"{a}{sep}{b.capitalize() if not sep else b}" for sep in ("_", "-", "/", "")
              for a, b in zip(known, known[7:] + known[:7])]
    numbered = [f"{a}{sep}{i}" for sep in ("", "_", "-") for i, a in enumerate(known)]
    numbers = [f"{1970 + i % 80}{sep}{1 + i % 12:02}{sep}{1 + i % 28:02}" for sep in ("", "-", "/", "_") for i in range(900)]
    return [*known, *joined, *numbered, *numbers, *(x.upper() for x in known + joined + numbered)]


def _probabilities(counts: np.ndarray) -> np.ndarray:
    """log2 of p(symbol | two before), backed off."""
    three = counts.reshape(S, S, S)[:, :, 1:].astype(float)
    two = three.sum(axis=0)
    one = (two + BACKED / (S - 1)) / (two.sum(axis=1, keepdims=True) + BACKED)
    p = (three + BACKED * one[None]) / (three.sum(axis=2, keepdims=True) + BACKED)
    return np.log2(np.concatenate([np.ones((S, S, 1)), p], axis=2)).reshape(-1)


def ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Bits of evidence of each trigram for randomness, from counts of the texts' samples."""
    drawn, named = (_count(_codes(" ".join(x).encode())).astype(float) for x in (random_strings(), names()))
    random = drawn + random * min(1.0, drawn.sum() / max(1, random.sum()))
    ordinary = ordinary + named * max(1.0, NAMES_SHARE * ordinary.sum() / named.sum())
    return _probabilities(random) - _probabilities(ordinary)


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The ratios by the samples in all texts of ``docs``."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, S ** 3), np.int64)
        for batch in batches:
            total += sample_counts(t.as_py() for t in batch.column(0))
        label, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(at.astype(np.int32)),
                                          pa.array(total[label, at])], names=["label", "trigram", "n"])

    texts = docs.select(F.col(text).cast("binary").alias("t")).where("t IS NOT NULL")
    counts = (texts.mapInArrow(apply, "label int, trigram int, n long").groupBy("label", "trigram")
              .agg(F.sum("n").alias("n")).collect())            # at most two for each trigram of the alphabet
    total = np.zeros((2, S ** 3), np.int64)
    for r in counts:
        total[r["label"], r["trigram"]] = r["n"]
    return ratios(*total)


def evidence(codes: np.ndarray, ratio: np.ndarray) -> float:
    """Bits by which a string looks random."""
    return float(ratio[np.unique(trigrams(codes))].sum())


def spans(texts: Iterable[bytes], ratio: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """For each text, (start, kind, end) of all secrets in order, in code points; a random string inside a base span
    is not told again."""
    for part, joined, codes, base, strings in looked_through(texts):
        found = [(a, k, b) for a, k, b, _ in base]
        reach, i = -1, 0                    # the furthest end of the base spans that start before a string ends
        for a, b in strings:
            while i < len(base) and base[i][0] <= a:
                reach, i = max(reach, base[i][2]), i + 1
            if b > reach and evidence(codes[a:b], ratio) >= BITS:
                found.append((a, 3, b))
        found.sort()
        starts = np.cumsum([0] + [len(t) + 1 for t in part])
        at = np.searchsorted([a for a, _, _ in found], starts) if found else np.zeros(len(part) + 1, np.int64)
        for n, text in enumerate(part):
            own = [(a - starts[n], k, b - starts[n]) for a, k, b in found[at[n]:at[n + 1]]]
            if own and not text.isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                own = [(points[a], k, points[b]) for a, k, b in own]
            yield [(int(a), k, int(b)) for a, k, b in own]


def find(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row; spans is an array of (start, kind, end), kind a place in ``KINDS``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "kind": k, "end": b} for a, k, b in own]
                     for own in spans((t.as_py() or b"" for t in batch.column(1)), ratio)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "spans"])

    of = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("binary").alias("t")).mapInArrow(
        apply, f"`{key}` {of}, spans array<struct<start:bigint,kind:int,end:bigint>>")


def redacted(docs: DataFrame, ratio: np.ndarray, text: str = "text", by: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced; of overlapping spans the union is one."""
    place = docs.columns.index(text)

    def clean(t: str, found: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, _, b in found:
            if a >= at:
                out += [t[at:a], by]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = spans(((t or "").encode() for t in texts), ratio)
            column = pa.array([t and clean(t, own) for t, own in zip(texts, found)], pa.string())
            yield batch.set_column(place, batch.schema.field(place).name, column)

    return docs.mapInArrow(apply, docs.schema)


def count_of(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def written(most: int) -> Column:
    """The spans of the kinds before ``most`` as kind:start:end, comma-joined."""
    of = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter("spans", lambda s: s.kind < most), lambda s: F.concat_ws(
        ":", F.get(of, s.kind), s.start, s.end)), ",")
