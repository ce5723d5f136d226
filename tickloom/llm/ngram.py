"""LM scoring with a bigram model kept in Elias-Fano tries, one for each shard of the contexts.

Documents are gathered into chunks of some million tokens, which number their own words. A chunk asks the shards
about its different bigrams, with how often it has each in training text: what is frequent is combined before
it is shuffled, and one row carries all of a chunk's bigrams of a shard. A shard adds up the counts, builds its
trie, looks every asked bigram up in it and answers with codes in the order of the questions. The chunks then
score their documents. Everything grows with the input: shards in number, not in size.

Probabilities: absolute discounting, interpolated with add-one words,
P(w|v) = max(c(vw) - D, 0)/c(v) + D N1+(v)/c(v) P(w) and P(w) = (c(w) + 1)/(N + V + 1).
A word's count is that of a context, as every word is followed by a word or the end.

Contexts of more than a quarter of a shard's share of the tokens are split by follower over several shards; there
are at most four such contexts a shard, whose counts and numbers of followers pass through the driver.

Words are known by 64-bit hashes, followers of one context by 40 bits. Defined cases: a null text is empty, its
only token is the end; texts of any length are read whole; a null fold counts as training; repeated rows count
and are scored each; null keys are kept; an empty table gives an empty result; without training text every word
is unknown. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from collections import defaultdict
from itertools import count
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.eliasfano import Trie, mapped, unquantised
from tickloom.staging import stage

CHUNK = 1_000_000            # tokens numbered together
SHARD = 2_000_000            # tokens a shard, about
DISCOUNT = 0.75
END, BEGIN = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b" ")       # no word holds white space
LOW = np.uint64((1 << 40) - 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _pressed(a: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _opened(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Bigrams:
    """A chunk's different bigrams in the order of questions: by shard, then context, then word.

    ``of``: the number of each token's bigram; ``run``: where a context begins among a shard's bigrams.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray, shards: int, split: dict[int, int]):
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], np.cumsum(sizes)])[:-1]] = 1
        pairs, of = np.unique(before.astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64), return_inverse=True)
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        parts = np.ones(len(vocabulary), np.uint64)
        if split:
            names = np.array(sorted(split), np.uint64)
            at = np.minimum(np.searchsorted(names, vocabulary), len(names) - 1)
            parts = np.where(names[at] == vocabulary, np.array([split[int(k)] for k in names], np.uint64)[at], parts)
        shard = ((_mixed(vocabulary)[context] + _mixed(vocabulary[word]) % parts[context]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        self.shard, self.context, self.word = shard[order], context[order], word[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of, self.before = place[of], before
        new = np.r_[True, (self.context[1:] != self.context[:-1]) | (self.shard[1:] != self.shard[:-1])] if len(order) else np.zeros(0, bool)
        self.run = np.flatnonzero(new)


def _ends(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if not len(sorted_):
        return []
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return list(zip(sorted_[starts].tolist(), starts.tolist(), np.append(starts[1:], len(sorted_)).tolist()))


def _chunks(docs: DataFrame, key: str, text: str, held: Column, shards: int, chunk: int) -> DataFrame:
    """(chunk, keys, held, sizes, tokens, vocabulary, seen, n_train, n_train_docs, often, times) of all texts.

    In a chunk's numbering 0 is the end and 1 the begin. ``seen``: training counts of its words; ``often``,
    ``times``: the words that may be more than a quarter of a shard.
    """
    names = ["chunk", "keys", "held", "sizes", "tokens", "vocabulary", "seen", "n_train", "n_train_docs", "often", "times"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0

        def row(keys: list, out: list[bool], lists: list[list[int]], words: dict[bytes, int]) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, lists), np.uint32, len(lists))
            tokens = np.concatenate([np.array(x, np.uint32) for x in lists])
            vocabulary = np.array([END, BEGIN] + [xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            train = np.repeat(~np.array(out), sizes)
            seen = np.bincount(tokens[train], minlength=len(vocabulary)).astype(np.uint32)
            seen[1] = len(out) - sum(out)                              # the begin is a context of each text
            often = np.flatnonzero(seen * (8.0 * shards) >= max(1, train.sum()))
            often = often[often > 0]                                   # the end is no context
            cells = [[f"{part}-{made}"], [keys], [np.array(out).tobytes()], [_pressed(sizes)], [_pressed(tokens)],
                     [vocabulary.tobytes()], [_pressed(seen)], [int(train.sum())], [len(out) - sum(out)],
                     [vocabulary[often].view(np.int64).tolist()], [seen[often].tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

        keys, out, lists, size = [], [], [], 0
        words: defaultdict[bytes, int] = defaultdict(count(2).__next__)
        for batch in batches:
            for k, t, h in zip(*batch.columns):
                keys.append(k.as_py())
                out.append(bool(h.as_py()))
                lists.append([words[w] for w in (t.as_py() or b"").lower().split()] + [0])
                size += len(lists[-1])
                if size >= chunk:
                    yield row(keys, out, lists, words)
                    keys, out, lists, size, made = [], [], [], 0, made + 1
                    words = defaultdict(count(2).__next__)
        if keys:
            yield row(keys, out, lists, words)

    kind = docs.schema[key].dataType
    kinds = [pa.string(), pa.list_({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()])]
    kinds += [pa.binary()] * 5 + [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary"), F.coalesce(held, F.lit(False)))
    return rows.mapInArrow(apply, f"chunk string, keys array<{kind.simpleString()}>, held binary, sizes binary, tokens binary, "
                                  "vocabulary binary, seen binary, n_train long, n_train_docs long, often array<long>, times array<long>")


def _heavy(chunks: DataFrame, shards: int, n: int) -> dict[int, int]:
    """Exact training counts of the contexts that have over a quarter of a shard's share: at most four a shard."""
    often = (chunks.select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy("o.often")
             .agg(F.sum("o.times").alias("n")).where(F.col("n") * (4 * shards) >= n).collect()) if n else []
    names = np.array(sorted(r["often"] & 0xFFFFFFFFFFFFFFFF for r in often), np.uint64)
    if not len(names):
        return {}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vocabulary, seen in zip(*batch.columns):
                vocabulary, seen = np.frombuffer(vocabulary.as_py(), np.uint64), _opened(seen.as_py(), np.uint32)
                ours = np.flatnonzero(np.isin(vocabulary, names))
                yield pa.RecordBatch.from_arrays([pa.array(vocabulary[ours].view(np.int64)),
                                                  pa.array(seen[ours].astype(np.int64))], names=["h", "n"])

    exact = chunks.select("vocabulary", "seen").mapInArrow(apply, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return {r["h"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in exact.collect()}


def _questions(chunks: DataFrame, shards: int, split: dict[int, int]) -> DataFrame:
    """(shard, chunk, contexts, runs, words, times): each chunk's bigrams for each shard."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, sizes, tokens, vocabulary in zip(*batch.columns):
                sizes, tokens = _opened(sizes.as_py(), np.uint32).astype(np.int64), _opened(tokens.as_py(), np.uint32)
                vocabulary = np.frombuffer(vocabulary.as_py(), np.uint64)
                asked = Bigrams(tokens, sizes, vocabulary, shards, split)
                train = np.repeat(~np.frombuffer(held.as_py(), bool), sizes)
                times = np.bincount(asked.of[train], minlength=len(asked.word)).astype(np.uint32)
                words = vocabulary[asked.word] & LOW
                runs = np.diff(np.append(asked.run, len(asked.word))).astype(np.uint32)
                rows = []
                for shard, a, b in _ends(asked.shard):
                    i, j = np.searchsorted(asked.run, [a, b])
                    low = np.ascontiguousarray(words[a:b]).view(np.uint8).reshape(-1, 8)[:, :5]
                    rows.append((shard, chunk.as_py(), vocabulary[asked.context[asked.run[i:j]]].tobytes(),
                                 _pressed(runs[i:j]), low.tobytes(), _pressed(times[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), *[pa.binary()] * 4))],
                    names=["shard", "chunk", "contexts", "runs", "words", "times"])

    return chunks.select("chunk", "held", "sizes", "tokens", "vocabulary").mapInArrow(
        apply, "shard long, chunk string, contexts binary, runs binary, words binary, times binary")


def _answers(questions: DataFrame, heavy: dict[int, int]) -> DataFrame:
    """(chunk, shard, counts, weights, codes, n_words, split, followers) in the order of the questions.

    One row of each shard also has the number of its own words, and of the followers of split contexts.
    """
    out = ("chunk string, shard long, counts binary, weights binary, codes binary, n_words long, split array<long>, "
           "followers array<long>")
    kinds = [pa.string(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def serve(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        contexts = [np.frombuffer(x.as_py(), np.uint64) for x in rows["contexts"]]
        runs = [_opened(x.as_py(), np.uint32) for x in rows["runs"]]
        known, of_run = np.unique(np.concatenate(contexts), return_inverse=True)
        low = np.frombuffer(b"".join(x.as_py() for x in rows["words"]), np.uint8).reshape(-1, 5)
        word = np.zeros((len(low), 8), np.uint8)
        word[:, :5] = low
        words, word = np.unique(word.view(np.uint64).reshape(-1), return_inverse=True)
        wide = np.int64(len(words))
        pairs, of = np.unique(np.repeat(of_run, np.concatenate(runs)) * wide + word, return_inverse=True)
        times = np.bincount(of, np.concatenate([_opened(x.as_py(), np.uint32) for x in rows["times"]]), len(pairs))
        context, word = pairs // wide, pairs % wide
        own = times > 0
        trie = Trie(mapped(Trie.build(known[context[own]], words[word[own]], times[own], DISCOUNT, heavy)))
        at, there = trie.context_of(known)
        rank, real = trie.word_of(words)
        codes = np.zeros(len(pairs), np.uint16)
        ask = np.flatnonzero(there[context] & real[word])
        codes[ask] = trie.prob_of(at[context[ask]], rank[word[ask]])
        place = np.where(there, at, 0)
        empty = np.zeros(1, np.int64)
        counts = np.where(there, (trie.count if trie.contexts.n else empty)[place], 0)
        weights = np.where(there, (trie.weight if trie.contexts.n else empty)[place], 0).astype(np.uint16)
        split = np.isin(known, np.array(sorted(heavy), np.uint64)) if heavy else np.zeros(len(known), bool)
        followers = np.bincount(context[own], minlength=len(known))
        n_words = int((there & ~split & (known != np.uint64(BEGIN))).sum())
        counts, weights, codes = counts[of_run], weights[of_run], codes[of]
        ends_r, ends_p = np.cumsum([len(x) for x in contexts]), np.cumsum([int(x.sum()) for x in runs])
        cells = [rows["chunk"].to_pylist(), rows["shard"].to_pylist(), [], [], [], [n_words] + [0] * (len(contexts) - 1),
                 [known[split].view(np.int64).tolist()] + [[]] * (len(contexts) - 1),
                 [followers[split].tolist()] + [[]] * (len(contexts) - 1)]
        for i in range(len(contexts)):
            a, b = (0, 0) if i == 0 else (ends_r[i - 1], ends_p[i - 1])
            cells[2].append(_pressed(counts[a:ends_r[i]].astype(np.int64)))
            cells[3].append(_pressed(weights[a:ends_r[i]]))
            cells[4].append(_pressed(codes[b:ends_p[i]]))
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in out.split(", ")])

    return questions.groupBy("shard").applyInArrow(serve, out)


def score_texts(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; rows that ``held`` marks
    are scored but not learned from."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = stage(_chunks(docs, key, text, held, tasks, chunk), "lm-chunks")
    n, n_docs = chunks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_train_docs"), F.lit(0))).first()
    shards = max(tasks, ceil(n / SHARD))
    heavy = _heavy(chunks, shards, n)
    split = {h: max(2, ceil(4 * shards * c / n)) for h, c in heavy.items()}
    answers = stage(_answers(_questions(chunks, shards, split), heavy), "lm-answers")
    n_words = answers.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_words += sum(c > 0 for h, c in heavy.items() if h != BEGIN) + (n_docs > 0)
    # of the split contexts alone
    weights = {r["split"] & 0xFFFFFFFFFFFFFFFF: DISCOUNT * r["n"] / heavy[r["split"] & 0xFFFFFFFFFFFFFFFF] for r in answers.select(
        F.explode(F.arrays_zip("split", "followers")).alias("s")).groupBy("s.split").agg(F.sum("s.followers").alias("n")).collect()}

    kind = docs.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def answer(mine: pa.Table, told: pa.Table) -> pa.Table:
        own = {c: mine[c][0].as_py() for c in ("keys", "held", "sizes", "tokens", "vocabulary")}
        sizes, tokens = _opened(own["sizes"], np.uint32).astype(np.int64), _opened(own["tokens"], np.uint32)
        vocabulary = np.frombuffer(own["vocabulary"], np.uint64)
        asked = Bigrams(tokens, sizes, vocabulary, shards, split)
        by = {s.as_py(): i for i, s in enumerate(told["shard"])}
        counts, weight = np.zeros(len(vocabulary), np.int64), np.ones(len(vocabulary))
        codes = np.empty(len(asked.word), np.uint16)
        for shard, a, b in _ends(asked.shard):
            i, j = np.searchsorted(asked.run, [a, b])
            at, context = by[shard], asked.context[asked.run[i:j]]
            counts[context] = _opened(told["counts"][at].as_py(), np.int64)
            weight[context] = unquantised(_opened(told["weights"][at].as_py(), np.uint16))
            codes[a:b] = _opened(told["codes"][at].as_py(), np.uint16)
        weight[counts == 0] = 1.0
        if heavy:
            names = np.array(sorted(heavy), np.uint64)
            for i in np.flatnonzero(np.isin(vocabulary, names)):
                counts[i], weight[i] = heavy[int(vocabulary[i])], weights.get(int(vocabulary[i]), 1.0)
        counts[0] = n_docs
        single = (counts + 1) / (n + n_words + 1)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda x: np.bincount(doc, x, len(sizes))                                          # noqa: E731
        prob = unquantised(codes)[asked.of] + weight[asked.before] * single[tokens]
        return pa.table([mine["keys"].combine_chunks().flatten(), pa.array(np.frombuffer(own["held"], bool)),
                         pa.array(sizes.astype(np.int64)), pa.array(sums(counts[tokens] > 0).astype(np.int64)),
                         pa.array(np.full(len(sizes), n)), pa.array(sums(np.log10(single)[tokens])),
                         pa.array(sums(np.log10(prob)))],
                        names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    parts = chunks.select("chunk", "keys", "held", "sizes", "tokens", "vocabulary")
    replies = answers.select("chunk", "shard", "counts", "weights", "codes")
    return parts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(answer, out)
