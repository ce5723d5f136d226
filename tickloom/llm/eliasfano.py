"""Elias-Fano sequences and a two-level n-gram trie of them, queried for whole numpy arrays at once.

A sorted sequence keeps the low bits of its values packed and the high bits in unary, about two bits a value
more than the least possible. A trie is one run of bytes: contexts and the words after them are Elias-Fano
sequences, so are the pointers from a context to its first follower; probabilities are 16-bit codes on a
logarithmic scale. The bytes are mapped from a file, and nothing is unpacked: a query finds its context's
place, then searches the successor of its word relative to that context.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

STEP = 4                                 # words of 64 bits between counts
AT_ONCE = 1 << 15                        # queries answered at once
LEAST, CODES = -12.0, (1 << 16) - 1      # the scale of quantised log10 probabilities; code 0 is none


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities in (0, 1]; 0 for none."""
    with np.errstate(divide="ignore"):
        code = 1 + np.round((np.maximum(np.log10(p), LEAST) / -LEAST + 1) * (CODES - 1))
    return np.where(p > 0, code, 0).astype(np.uint16)


def unquantised(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (((code.astype(np.float64) - 1) / (CODES - 1) - 1) * -LEAST), 0.0)


class EliasFano:
    """``head``: how many values and low bits; ``low``, ``high``: packed words; ``ones``: counts every ``STEP``."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * (STEP * 64) - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """The sequence of ascending unsigned values."""
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(values[-1]).bit_length() - max(1, n).bit_length()) if n else 0
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        length = (int(place[-1]) if n else 0) + 2
        flags = np.zeros(-(-length // (STEP * 64)) * STEP * 64, bool)
        flags[place] = True
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).reshape(-1, STEP).sum(axis=1)
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.ones]

    def _select(self, k: np.ndarray, of: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the one (or zero) number ``k``, counted from 0."""
        block = np.searchsorted(of, k, side="right") - 1
        rest = k - of[block]
        word = block * STEP
        for _ in range(STEP - 1):
            bits = self.high[word]
            have = np.bitwise_count(~bits if flip else bits).astype(np.int64)
            go = rest >= have
            rest, word = np.where(go, rest - have, rest), np.where(go, word + 1, word)
        bits = ~self.high[word] if flip else self.high[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            have = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            go = rest >= have
            rest, place = np.where(go, rest - have, rest), np.where(go, place + width, place)
            bits = np.where(go, bits >> np.uint64(width), bits)
        return word * 64 + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> off | over) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values number ``i``."""
        high = (self._select(i, self.ones, False) - i).astype(np.uint64)
        return high << np.uint64(self.bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first value not below ``x``, whether it is ``x``)."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = x >> np.uint64(self.bits)
        zeros = len(self.high) * 64 - self.n
        below = h < np.uint64(zeros - 1)                          # beyond: greater than every value
        h = np.where(below, h, 0).astype(np.int64)
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, True) + 1 - h, 0)
        last = self._select(h, self.zeros, True) - h
        want = x & np.uint64((1 << self.bits) - 1)
        a, b = first.copy(), last.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < want)
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        same = below & (a < last) & (self._low(np.minimum(a, self.n - 1)) == want)
        return np.where(below, a, self.n), same


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each with its type and size, all on bounds of eight bytes."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        raw = a.tobytes()
        out += [a.dtype.str.encode().ljust(8), np.array([len(a)], np.int64).tobytes(), raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


def mapped(data: bytes) -> list[np.ndarray]:
    """Views of packed arrays in a mapped file, which has no name any more and goes with the views."""
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    at, out = 8, []
    for _ in range(int(np.frombuffer(view, np.int64, 1)[0])):
        kind = np.dtype(bytes(view[at:at + 8]).decode().strip())
        n = int(np.frombuffer(view, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(view, kind, n, at + 16))
        at += 16 + -(-n * kind.itemsize // 8) * 8
    return out


class Trie:
    """Contexts with counts and back-off weights, and their followers with probabilities."""

    def __init__(self, arrays: list[np.ndarray]):
        take = lambda i: EliasFano(int(arrays[i][0]), int(arrays[i][1]), *arrays[i + 1:i + 4])      # noqa: E731
        self.contexts, self.pointers, self.words, self.pairs = (take(i) for i in (0, 4, 8, 12))
        self.count, self.weight, self.prob = arrays[16:19]

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, n: np.ndarray, discount: float,
              total: dict[int, int] | None = None) -> bytes:
        """A trie of n-grams (sorted by context, then word; ``n`` times each) by absolute discounting.

        ``total`` has counts of contexts whose followers are not all here.
        """
        contexts, first, of = np.unique(context, return_index=True, return_inverse=True)
        words, rank = np.unique(word, return_inverse=True)
        count = np.bincount(of, n, len(contexts)).astype(np.int64)
        followers = np.bincount(of, minlength=len(contexts))
        if total:
            count = np.array([total.get(int(c), k) for c, k in zip(contexts, count)], np.int64)
        prob = quantised((n - discount) / np.maximum(count, 1)[of])
        weight = quantised(discount * followers / np.maximum(count, 1))
        relative = of.astype(np.uint64) * np.uint64(max(1, len(words))) + rank.astype(np.uint64)
        pointers = np.append(first, len(context)).astype(np.uint64)
        return packed([*EliasFano.of(contexts).arrays(), *EliasFano.of(pointers).arrays(), *EliasFano.of(words).arrays(),
                       *EliasFano.of(relative).arrays(), count, weight, prob])

    def context_of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether known) of contexts."""
        return self.contexts.successor(context)

    def word_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, whether known) of words as followers of any context."""
        return self.words.successor(word)

    def prob_of(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Codes of known followers after known contexts; 0 where the context doesn't have the follower."""
        out = np.zeros(len(place), np.uint16)
        wide = np.uint64(max(1, self.words.n))
        for i in range(0, len(place) if self.pairs.n else 0, AT_ONCE):
            at, word = place[i:i + AT_ONCE], rank[i:i + AT_ONCE]
            near, of = np.unique(at, return_inverse=True)
            start, end = (self.pointers.get(near + k).astype(np.int64)[of] for k in (0, 1))
            found, same = self.pairs.successor(at.astype(np.uint64) * wide + word.astype(np.uint64))
            same &= (found >= start) & (found < end)
            out[i:i + AT_ONCE] = np.where(same, self.prob[np.minimum(found, self.pairs.n - 1)], 0)
        return out
