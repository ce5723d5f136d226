r"""Periodic runs of words, found on a grammar.

A run is a stretch of words with smallest period q (words q apart are equal) of at least ``max(SHORTEST, TIMES * q)``
words that no neighbouring word extends. Re-Pair turns each text's word ids into a grammar: a pair of symbols that
occurs ``REPEATS`` times becomes a new symbol (where pairs overlap the more frequent one wins, many pairs in a round),
until no pair is so frequent; what is left is paired in balanced halves. A run has some pair ``REPEATS`` times, so a
text without a rule has none. Every run lies in a smallest symbol, whose boundary (between its left and its right part)
it crosses. So for each symbol, once, the runs across its boundary are computed: one side holds two periods, which
names the candidate periods, and longest common extensions by prefix hashes give both ends. They are translated to all
places where the symbol is derived, and stretches of one period that overlap by a period are merged, which leaves the
maximal ones.

Hashes are polynomials modulo two primes near 2^31. All texts of a piece go through numpy together; the cost is
O(n log n) for a text of n words, whatever it holds.

Defined cases: a null text has no words; words are separated by space, tab, line end, vertical tab, form feed and
return; texts of any length are read whole; repeated rows give repeated results; a null key is kept; an empty table
gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SHORTEST, TIMES = 6, 4
REPEATS = 4                   # occurrences that some pair has in every run
FREQUENT = 12                 # rounds in which the more frequent pair wins; then any fixed order, to end soon
PIECE = 1 << 21               # bytes of text at once
AT_ONCE = 1 << 20             # candidate periods at once
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)

Words = list[bytes]
_POWERS = [np.ones(1, np.uint64) for _ in PRIMES]


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the bases up to the n-th at least."""
    for i, (p, base) in enumerate(zip(PRIMES, BASES)):
        while len(_POWERS[i]) <= n:
            have = _POWERS[i]
            _POWERS[i] = np.concatenate([have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)])
    return _POWERS


class Text:
    """Word ids with prefix hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.powers = _powers(len(words))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((words.astype(np.uint64) + np.uint64(1)) * of[:len(words)] % np.uint64(p)) % np.uint64(p)])
                     for p, of in zip(PRIMES, self.powers)]

    def equal(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on are those from i + q on."""
        out = np.ones(len(i), bool)
        for p, of, sums in zip(PRIMES, self.powers, self.sums):
            p = np.uint64(p)
            a, b = sums[i + n] + p - sums[i], sums[i + q + n] + p - sums[i + q]
            out &= a % p * of[q] % p == b % p
        return out

    def extension(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words, ``most`` at most, from i on (or before i) equal those q further."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            same = self.equal(i - n if back else i, q, n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low


class Grammar:
    """Re-Pair over texts side by side, whose symbols (below ``symbols``) no two texts share.

    ``first``, ``middle``, ``last`` are the words that each symbol spans where it was derived first, cut at its
    boundary. ``places`` are all words where it was derived, those of symbol i from ``at[i]`` to ``at[i + 1]``.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, symbols: int):
        sequence, start, size = words.astype(np.int64), np.arange(len(words)), np.ones(symbols, np.int64)
        rules, derived, ended = [], [], []
        count = 0
        for round_ in range(len(words) + 1):
            if len(sequence) < 2:
                break
            code, pairs = pd.factorize(sequence[:-1] * len(size) + sequence[1:])
            often = np.bincount(code)[code]
            good = often >= REPEATS
            alive = np.zeros(len(doc), bool)
            alive[:-1] = good
            texts = np.zeros(doc[-1] + 1, bool)
            texts[doc[alive]] = True
            alive = texts[doc]
            ended.append((start[~alive], doc[~alive]))
            sequence, start, doc = sequence[alive], start[alive], doc[alive]
            if not len(sequence):
                break
            # the pair of a text's last symbol and the next text's first is never good
            code, often, good = (x[alive[:-1]][:len(sequence) - 1] for x in (code, often, good))
            mixed = (code.astype(np.uint64) + np.uint64(round_)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)
            rank = (often if round_ < FREQUENT else 0) * (1 << 30) + mixed.astype(np.int64) + 1
            order = np.where(good, rank, 0)
            around = np.concatenate([[0], order, [0]])
            again = np.concatenate([[False], code[1:] == code[:-1]])         # a symbol that stands three times and more
            begins = np.maximum.accumulate(np.where(again, 0, np.arange(len(code))))
            chosen = np.flatnonzero(good & (order >= around[:-2]) & (order >= around[2:])
                                    & ((np.arange(len(code)) - begins) % 2 == 0))
            chosen = chosen[np.concatenate([[True], np.diff(chosen) > 1])]   # of equal ranks next to each other the first
            rule, kinds = pd.factorize(code[chosen])
            left, right = sequence[chosen], sequence[chosen + 1]
            first = np.empty(len(kinds), np.int64)
            first[rule[::-1]] = np.arange(len(chosen))[::-1]
            one, two = size[left[first]], size[right[first]]
            at = start[chosen[first]]
            rules.append((at, at + one, at + one + two))
            derived.append((rule + count, start[chosen]))
            count += len(kinds)
            sequence[chosen] = len(size) + rule
            size = np.concatenate([size, one + two])
            kept = np.ones(len(sequence), bool)
            kept[chosen + 1] = False
            sequence, start, doc = sequence[kept], start[kept], doc[kept]
        ended.append((start, doc))
        self.first, self.middle, self.last = (np.concatenate([r[i] for r in rules]) if rules else np.zeros(0, np.int64)
                                              for i in range(3))
        rule, place = (np.concatenate([d[i] for d in derived]) if derived else np.zeros(0, np.int64) for i in range(2))
        self.places = place[np.argsort(rule, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(rule, minlength=count))])
        self._halved(*(np.concatenate([e[i] for e in ended]) for i in range(2)), len(words))

    def _halved(self, start: np.ndarray, doc: np.ndarray, n: int) -> None:
        """Adds the symbols over what is left of each text."""
        order = np.argsort(start)
        start, doc = start[order], doc[order]
        ends = np.concatenate([start[1:], [n]])
        low = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        high = np.concatenate([low[1:], [len(doc)]]) if len(doc) else low
        more = []
        while len(low := low[split := high - low > 1]):
            high = high[split]
            middle = (low + high) // 2
            more.append((start[low], start[middle], ends[high - 1]))
            low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        for name, i in (("first", 0), ("middle", 1), ("last", 2)):
            setattr(self, name, np.concatenate([getattr(self, name), *[m[i] for m in more]]))
        single = self.first[len(self.at) - 1:]
        self.places = np.concatenate([self.places, single])
        self.at = np.concatenate([self.at, self.at[-1] + np.arange(1, len(single) + 1)])


def _least_factors(n: int) -> np.ndarray:
    """The least prime factor of all numbers up to n."""
    out = np.arange(n + 1)
    for f in range(2, int(n ** 0.5) + 1):
        if out[f] == f:
            part = out[f * f::f]
            part[part == np.arange(f * f, n + 1, f)] = f
    return out


def _crossing(text: Text, x: np.ndarray, b: np.ndarray, y: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """(candidate, start, end): the stretches of period q across b inside the words from x to y."""
    w, out = text.words, []
    last = len(w) - 1
    same = lambda i, j, fits: fits & (w[np.clip(i, 0, last)] == w[np.clip(j, 0, last)])
    # two periods right of the boundary, or left of it
    fits = y - b >= 2 * q
    right = np.flatnonzero(same(b, b + q, fits) & same(b + q - 1, b + 2 * q - 1, fits))
    fits = b - x >= 2 * q
    left = np.flatnonzero(same(b - 1, b - 1 - q, fits) & same(b - q, b - 2 * q, fits))
    for at, i in ((right, b[right]), (left, b[left] - q[left])):
        before = text.extension(i, q[at], i - x[at], back=True)
        behind = text.extension(i, q[at], y[at] - q[at] - i, back=False)
        out.append((at, i - before, i + q[at] + behind))
    at, start, end = (np.concatenate([o[i] for o in out]) for i in range(3))
    long = end - start >= np.maximum(SHORTEST, TIMES * q[at])
    return at[long], start[long], end[long]


def _smallest(text: Text, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether a stretch of period q has no smaller one (which would divide q)."""
    out, rest, factors = np.ones(len(q), bool), q.copy(), _least_factors(int(q.max(initial=1)))
    while (at := np.flatnonzero(rest > 1)).size:
        factor = factors[rest[at]]
        d = q[at] // factor
        out[at] &= ~text.equal(start[at], d, end[at] - start[at] - d)
        rest[at] //= factor
    return out


def maximal(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap by it, merged; by period and start."""
    order = np.lexsort((-end, start, q))
    start, end, q = start[order], end[order], q[order]
    if not len(q):
        return start, end, q
    group = np.cumsum(np.concatenate([[False], np.diff(q) > 0]))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = np.concatenate([[True], (np.diff(group) > 0) | (start[1:] > reach[:-1] - q[1:])])
    at = np.flatnonzero(new)
    return start[at], np.maximum.reduceat(end, at), q[at]


def runs(words: np.ndarray, doc: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts side by side, by start and period; no two texts share a word id."""
    found = [(np.zeros(0, np.int64),) * 3]
    frequent = _with_frequent_pair(words, doc, symbols)
    place = np.flatnonzero(frequent)
    if len(place):
        words, doc = words[frequent], doc[frequent]
        text, grammar = Text(words), Grammar(words, doc, symbols)
        first, middle, last = grammar.first, grammar.middle, grammar.last
        most = np.where(last - first >= SHORTEST, (last - first) // TIMES, 0)
        for i, j in _slices(most):
            of = np.repeat(np.arange(i, j), most[i:j])
            q = np.arange(len(of)) - np.repeat(np.cumsum(most[i:j]) - most[i:j], most[i:j]) + 1
            at, start, end = _crossing(text, first[of], middle[of], last[of], q)
            of, q = of[at], q[at]
            small = _smallest(text, start, end, q)
            of, q, start, end = of[small], q[small], start[small], end[small]
            # to all places where the symbol is derived
            times = grammar.at[of + 1] - grammar.at[of]
            again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            shift = grammar.places[np.repeat(grammar.at[of], times) + again] - np.repeat(first[of], times)
            found.append(maximal(np.repeat(start, times) + shift, np.repeat(end, times) + shift, np.repeat(q, times)))
    start, end, q = maximal(*(np.concatenate([f[i] for f in found]) for i in range(3)))
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    # texts without a frequent pair were left out
    return (place[start], place[end - 1] + 1, q) if len(place) else (start, end, q)


def _with_frequent_pair(words: np.ndarray, doc: np.ndarray, symbols: int) -> np.ndarray:
    """The words of the texts that have a pair ``REPEATS`` times."""
    texts = np.zeros(doc[-1] + 1 if len(doc) else 0, bool)
    if len(words) > 1:
        code, _ = pd.factorize(words[:-1] * symbols + words[1:])
        texts[doc[:-1][np.bincount(code)[code] >= REPEATS]] = True
    return texts[doc]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive parts of ``sizes`` that add up to ``AT_ONCE`` at most, or of one element."""
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + AT_ONCE, "right")))
        yield i, j
        i = j


def runs_and_rest(texts: list[Words]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's runs (rows of start, length, period, by start and period), and its words without repetitions:
    a word goes if a run holds it after that run's first period."""
    ids, base = [], 0
    for words in texts:
        of = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        ids.append(np.fromiter(map(of.__getitem__, words), np.int64, len(words)))
        base += len(of)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    every = np.concatenate([*ids, np.zeros(0, np.int64)])
    start, end, q = runs(every, np.repeat(np.arange(len(texts)), sizes), max(base, 1))
    cut = np.searchsorted(start, starts)
    out, rest = [], []
    for i, words in enumerate(texts):
        a, b = cut[i], cut[i + 1]
        own = np.stack([start[a:b] - starts[i], end[a:b] - start[a:b], q[a:b]], axis=1)
        if b > a:
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, own[:, 0] + own[:, 2], 1)
            np.add.at(marks, own[:, 0] + own[:, 1], -1)
            words = [w for w, gone in zip(words, (np.cumsum(marks[:-1]) > 0).tolist()) if not gone]
        out.append(own)
        rest.append(b" ".join(words))
    return out, rest


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  change: Callable[[object, Words], Words] | None = None) -> DataFrame:
    """(key, runs, collapsed) of every row: runs is an array of (start, length, period) in words, by start and period;
    collapsed is the text without the words that repeat. ``change`` gives other words for a key's."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answers(keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in texts]
        if change is not None:
            words = [change(k, w) for k, w in zip(keys.to_pylist(), words)]
        found, rest = runs_and_rest(words)
        flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
            [pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type)))
        return pa.RecordBatch.from_arrays([keys, column, pa.array(rest, pa.binary()).cast(pa.string())],
                                          names=[key, "runs", "collapsed"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, size, held = batch.column(0), 0, 0, []
            for t in batch.column(1):
                held.append(t.as_py() or b"")
                size += len(held[-1])
                if size > PIECE:
                    yield answers(keys.slice(at, len(held)), held)
                    at, size, held = at + len(held), 0, []
            if held:
                yield answers(keys.slice(at, len(held)), held)

    of = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("binary").alias("t")).mapInArrow(
        apply, f"`{key}` {of}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def most_repeated(found: str = "runs") -> Column:
    """The run of the greatest length by period (ties: the first); null without one."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(found, none, lambda best, r: F.when(
        best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def written(found: str = "runs") -> Column:
    """All runs as lines of start,length,period."""
    return F.array_join(F.transform(found, lambda r: F.concat(
        F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
