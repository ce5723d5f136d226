"""SentencePiece encoding and decoding with the N best segmentations.

A text becomes a lattice of the model's pieces (spaces as U+2581, one before the text); a segmentation's score is
the sum of its pieces' scores. Characters that are no piece become their UTF-8 bytes' pieces at a penalty. The N
best come from a backward A-star search from the end of the lattice: the forward Viterbi score of a place is the
exact best score of the rest, so the search opens nothing but prefixes of the answers.

No piece crosses the beginning of a word, so lattices fall into words. Each word is solved once in a task's
cache, all new words of a batch together in numpy: the Viterbi path, and from forward and backward scores how
much the second path loses. The N best of a text can only differ from the best in the N - 1 words that lose
least; those alone are searched, and their answers combined.

Tokenizers are given, never trained; the driver reads the model file and sends its pieces to the tasks.

Defined cases: null and empty texts have no pieces, score 0 and one segmentation; texts and words of any length
are read whole; equal scores are settled in favour of longer last pieces; fewer than N segmentations give a
shorter list. Control pieces are never matched in a text. A U+2581 in a text decodes as a space. Repeated rows
give repeated results, empty tables an empty one. Other columns pass unchanged, whatever their names; those of
the result (ids, n_pieces, score, nbest_scores, round_trip, changes) are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.llm.workers import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, ALONE = "▁", "\n\t\r"      # a space; white space that stands alone where no piece holds it
N_BEST = 3
PENALTY = 10.0               # of an unknown character, below the worst score
CACHE, CELLS, CHARS = 200_000, 32_000, 1_000_000     # words kept, places solved and characters read at once: a task's memory
WIDE = 48                    # longer words are solved one by one
ADDED = ("ids", "n_pieces", "score", "nbest_scores", "round_trip", "changes")
CHANGES = T.ArrayType(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()),
                                                T.StructField("ids", T.ArrayType(T.IntegerType()))])))
SEARCHED = 50_000            # words whose segmentations a task remembers
_SCALE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The pieces of a model: ``known`` maps text to (id, score), ``raw`` has the bytes of each id."""

    def __init__(self, known: dict[str, tuple[int, float]], byte_ids: list[int], raw: list[bytes]):
        if any(SPACE in p.lstrip(SPACE) for p in known):
            raise ValueError("a piece crosses the beginning of a word")
        alone = "".join(c for c in ALONE if not any(c in p and len(p) > 1 for p in known))
        self.parts = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + f"|[{alone}]" * bool(alone)
        self.known, self.byte_ids, self.raw = known, byte_ids, raw
        real = [s for _, s in known.values() if s > -1e8]      # some pieces are scored out of use
        self.unknown = min(real, default=0.0) - PENALTY
        self.longest = max(map(len, known), default=1)

    @classmethod
    def read(cls, model: str = MODEL) -> Pieces:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        known, byte_ids, raw = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:-1], 16)] = i
                raw.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                known[piece] = (i, sp.get_score(i))
                raw.append(piece.replace(SPACE, " ").encode())
        return cls(known, byte_ids, raw)


def words(pieces: Pieces, text: str) -> list[str]:
    """The independent parts of a text's lattice, in order."""
    return re.findall(pieces.parts, SPACE + text.replace(" ", SPACE)) if text else []


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    return b"".join(map(pieces.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


# --- one word --------------------------------------------------------------------------------------------------

def _edges(pieces: Pieces, word: str, end: int) -> list[tuple[int, int, float]]:
    """(start, id or -1, score) of all pieces that end at a place; the longest first."""
    found = []
    for start in range(max(0, end - pieces.longest), end):
        if hit := pieces.known.get(word[start:end]):
            found.append((start, *hit))
    if not found or found[-1][0] != end - 1:
        found.append((end - 1, -1, pieces.unknown))
    return found


def word_nbest(pieces: Pieces, word: str, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a word: forward Viterbi, then backward A-star."""
    ahead = [0.0]
    for end in range(1, len(word) + 1):
        ahead.append(max(ahead[start] + s for start, _, s in _edges(pieces, word, end)))
    order = count()
    # of equal scores the nearest to the beginning goes on, or ties would open all of their prefixes
    heap = [(-ahead[-1], len(word), next(order), 0.0, None)]
    found = []
    while heap and len(found) < n:
        _, end, _, score, path = heapq.heappop(heap)
        if end == 0:
            ids = []
            while path:
                (start, piece), path = path
                ids += [piece] if piece >= 0 else [pieces.byte_ids[b] for b in word[start].encode(errors="replace")]
            found.append((score, ids))
            continue
        for start, piece, s in _edges(pieces, word, end):
            heapq.heappush(heap, (-(ahead[start] + s + score), start, next(order), s + score, ((start, piece), path)))
    return found


def nbest(pieces: Pieces, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a text as (score, ids), best first."""
    total: list[tuple[float, list[int]]] = [(0.0, [])]
    for word in words(pieces, text):
        own = word_nbest(pieces, word, n)
        total = heapq.nsmallest(n, ((a + b, i + j) for a, i in total for b, j in own), key=lambda x: -x[0])
    return total


# --- many words ------------------------------------------------------------------------------------------------

def _char_hash(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * _SCALE
    return x ^ (x >> np.uint64(29))


class Solver:
    """Best paths of many words at once, kept by number."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.tables = []
        for size in range(1, pieces.longest + 1):
            of = [(p, *v) for p, v in pieces.known.items() if len(p) == size]
            codes = np.array([p for p, _, _ in of], f"U{size}").view(np.uint32).reshape(len(of), size)
            h = np.zeros(len(of), np.uint64)
            for i in range(size):
                h = h * _SCALE + _char_hash(codes[:, i])
            by = np.argsort(h)
            self.tables.append((np.append(h[by], ~np.uint64(0)), np.append(np.array([s for _, _, s in of])[by], -np.inf),
                                np.append(np.array([i for _, i, _ in of], np.int64)[by], 0)) if of else None)
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.words: list[str] = []
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def solve(self) -> None:
        """Solve the words that got a number since the last call."""
        new = list(islice(self.number, len(self.words), None))
        if not new:
            return
        size = np.fromiter(map(len, new), np.int64, len(new))
        width = -(-size // 4) * 4
        score, loss = np.zeros(len(new)), np.zeros(len(new))
        paths: list[list[int]] = [[]] * len(new)
        for k in np.flatnonzero(size > WIDE):            # nothing to gain from columns
            (score[k], paths[k]), *more = word_nbest(self.pieces, new[k], 2)
            loss[k] = score[k] - more[0][0] if more else np.inf
        for w in np.unique(width[size <= WIDE]):
            of = np.flatnonzero(width == w)
            step = max(1, CELLS // int(w))
            for i in range(0, len(of), step):
                part = of[i:i + step]
                score[part], loss[part], got = self._together([new[k] for k in part], size[part], int(w))
                for k, path in zip(part, got):
                    paths[k] = path
        self.words += new
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])
        lengths = np.fromiter(map(len, paths), np.int64, len(paths))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.array([i for p in paths for i in p], np.int32)])

    def _together(self, part: list[str], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        m, most = len(part), min(self.pieces.longest, width)
        codes = np.array(part, f"U{width}").view(np.uint32).reshape(m, width)
        rows = np.arange(m)
        char, h = _char_hash(codes), np.zeros((m, width), np.uint64)
        s = np.full((most, m, width), -np.inf)          # score and id of the piece of each length from each start
        ids = np.zeros((most, m, width), np.int32)
        inside = np.arange(width) < size[:, None]
        for k in range(most):
            n = width - k
            h[:, :n] = h[:, :n] * _SCALE + char[:, k:]
            if self.tables[k] is None:
                continue
            known, scores, numbers = self.tables[k]
            at = np.searchsorted(known, h[:, :n])
            hit = (known[np.minimum(at, len(known) - 1)] == h[:, :n]) & inside[:, k:]
            at = np.where(hit, at, len(known) - 1)
            s[k, :, :n] = np.where(hit, scores[at], -np.inf)
            ids[k, :, :n] = numbers[at]
        lone = inside & np.isneginf(s[0])
        s[0][lone], ids[0][lone] = self.pieces.unknown, -1

        ahead, last = np.full((m, width + 1), -np.inf), np.zeros((m, width + 1), np.int64)
        ahead[:, 0] = 0
        for end in range(1, width + 1):
            for k in range(min(most, end) - 1, -1, -1):         # the longest first: it wins a tie
                got = ahead[:, end - k - 1] + s[k, :, end - k - 1]
                better = got > ahead[:, end]
                ahead[better, end], last[better, end] = got[better], k
        behind = np.full((m, width + most + 1), -np.inf)
        behind[rows, size] = 0
        for start in range(width - 1, -1, -1):
            got = s[:, :, start] + behind[:, start + 1:start + most + 1].T
            behind[:, start] = np.maximum(behind[:, start], got.max(axis=0))

        total = ahead[rows, size]
        taken = np.zeros((most, m, width), bool)
        steps, at = [], size.copy()
        while (going := at > 0).any():
            k = last[rows, at]
            start = at - k - 1
            piece = np.where(going, ids[k, rows, start], -2)
            steps.append((piece, start))
            taken[k[going], rows[going], start[going]] = True
            at = np.where(going, start, 0)
        second = np.full(m, -np.inf)
        for k in range(most):
            through = ahead[:, :width] + s[k] + behind[:, k + 1:k + 1 + width]
            second = np.maximum(second, np.where(taken[k], -np.inf, through).max(axis=1))
        pieces = np.array([p for p, _ in steps[::-1]]).T
        starts = np.array([p for _, p in steps[::-1]]).T
        odd = (pieces == -1).any(axis=1)
        paths = []
        for r, (row, strange) in enumerate(zip(pieces.tolist(), odd)):
            if strange:
                row = [i for p, a in zip(row, starts[r]) for i in (
                    (self.pieces.byte_ids[b] for b in part[r][a].encode(errors="replace")) if p == -1 else (p,))]
            paths.append([p for p in row if p != -2] if row and row[0] == -2 or strange else row)
        return total, total - second, paths


Choice = tuple[float, tuple[tuple[int, int], ...]]      # what is lost, and (word, which of its segmentations)


def _nbest_choices(solver: Solver, numbers: np.ndarray, n: int, search) -> list[Choice]:
    """The ``n`` best segmentations of a text of words, by what they lose; the best itself changes no word."""
    total: list[Choice] = [(0.0, ())]
    if n < 2 or not len(numbers):
        return total
    loss = solver.loss[numbers]
    least = np.argpartition(loss, n - 2)[:n - 1] if len(loss) > n - 1 else np.arange(len(loss))
    for i in np.sort(least).tolist():
        if np.isfinite(loss[i]):
            own = search(solver.words[numbers[i]])
            total = heapq.nsmallest(n, ((a + lost, c + ((i, j),) if j else c) for a, c in total
                                        for j, (lost, _) in enumerate(own)), key=lambda x: x[0])
    return total


def _own_nbest(pieces: Pieces, word: str, best: list[int], n: int) -> list[tuple[float, list[int]]]:
    """(loss, ids) of a word's ``n`` best segmentations, of which ``best`` is the first."""
    found = word_nbest(pieces, word, n)
    rest = [(found[0][0] - s, ids) for s, ids in found if ids != best]
    return [(0.0, best), *rest[:n - 1]]


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", n: int = N_BEST, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the best segmentation's ``ids``, ``n_pieces`` and ``score``, the
    scores of the ``n`` best, whether the ids decode to the text, and the other segmentations of these (from the
    second on) as ``changes`` against the best: from place ``at`` of its ids on, ``drop`` of them give way to others.
    ``alternative`` has their ids."""
    shown = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    read = shown + [text] * (text not in shown)
    out = T.StructType([docs.schema[c] for c in shown] + [
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("nbest_scores", T.ArrayType(T.DoubleType())),
        T.StructField("round_trip", T.BooleanType()), T.StructField("changes", CHANGES)])
    changes_type = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(pieces)

        known: dict[str, list[tuple[float, list[int]]]] = {}

        def search(word: str) -> list[tuple[float, list[int]]]:
            if word not in known:
                if len(known) >= SEARCHED:
                    known.clear()
                i = solver.number[word]
                known[word] = _own_nbest(pieces, word, solver.ids[solver.first[i]:solver.first[i + 1]].tolist(), n)
            return known[word]

        def some(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(read.index(text)).to_pylist()]
            if len(solver.words) > CACHE:
                solver.clear()
            numbers = [np.array([solver.number[w] for w in words(pieces, t)], np.int64) for t in texts]
            solver.solve()
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in numbers])
            best = np.bincount(doc, solver.score[flat], len(texts)).astype(np.float64)
            length = np.diff(solver.first)[flat]
            per_doc = np.bincount(doc, length, len(texts)).astype(np.int64)
            at = np.repeat(solver.first[flat] - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
            ids, ends = solver.ids[at], np.concatenate([[0], np.cumsum(per_doc)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            scores, changes = [], []
            places = np.concatenate([[0], np.cumsum(length)])
            before = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
            for x, b, first in zip(numbers, best.tolist(), before.tolist()):
                choices = _nbest_choices(solver, x, n, search)
                scores.append([b - lost for lost, _ in choices])
                changes.append([[{"at": int(places[first + i] - places[first]), "drop": int(length[first + i]),
                                  "ids": search(solver.words[x[i]])[j][1]} for i, j in c] for _, c in choices[1:]])
            same = [decode_ids(pieces, ids[a:b].tolist()) == t.replace(SPACE, " ") for t, a, b in zip(texts, ends, ends[1:])]
            return pa.RecordBatch.from_arrays(
                batch.columns[:len(shown)] + [lists, pa.array(per_doc), pa.array(best),
                                              pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_()),
                                              pa.array(changes, changes_type)],
                names=shown + list(ADDED))

        for batch in batches:
            sizes = np.fromiter((len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(read.index(text))),
                                np.int64, len(batch))
            group = np.cumsum(sizes) // CHARS
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                yield some(batch.slice(rows[0], len(rows)))

    return docs.select(*[F.col(c) for c in read]).mapInArrow(tidy(apply), out)


def alternative(k: int, ids: str = "ids", changes: str = "changes") -> Column:
    """The ids of the k-th best segmentation (from 0); null if there are not so many."""
    if k == 0:
        return F.col(ids)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    done = F.aggregate(F.get(changes, F.lit(k - 1)), start, lambda a, c: F.struct(
        (c["at"] + c["drop"]).alias("at"), F.concat(a["out"], F.slice(ids, a["at"] + 1, c["at"] - a["at"]), c["ids"]).alias("out")))
    return F.concat(done["out"], F.slice(ids, done["at"] + 1, F.size(ids)))


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; null ids decode to null."""
    kept = [c for c in encoded.columns if c != into]
    out = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(into, T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(pieces, x) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(texts, pa.string())], names=kept + [into])

    return encoded.select(*[F.col(c) for c in kept]).mapInArrow(tidy(apply), out)
