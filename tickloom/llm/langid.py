"""Language ID: a byte convolutional network over fixed-length windows.

``learn`` fits the network on the driver from a bounded sample of labelled rows (at most ``LANGUAGES``
languages and ``WINDOWS`` windows in all); ``identify`` applies it to every byte of every text, in the
executors. Bytes are embedded, filtered at several widths, max-pooled and classified by softmax; a text's
probabilities are its windows', weighted by their bytes.

Defined cases: a null text, or one without letters, gives ``und`` with score 0; so does every text if no row
is labelled. Rows with a null text or label are not learned from. Texts of any length are read whole.
Repeated rows give repeated results. Other columns, whatever their names, pass ``identify`` unchanged, except
that ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.workers import tidy

UNKNOWN = "und"
LANGUAGES = 256          # most frequent labels that are learned
WINDOWS = 6000           # windows learned from, shared equally among the labels
LENGTH = 192             # bytes of a window
PLACES = 16              # windows of one text, at most, where there are few texts
ROUNDS, SEEN = 6, 50_000 # how often each window is learned from, at least, and how many in all
WIDTHS, FILTERS, SIZE = (2, 3, 4, 5), 12, 6
BLOCK = 256              # windows scored at once


@dataclass
class ByteNet:
    """``table``: byte embeddings; ``filters``: all widths side by side, zero beyond their width."""
    languages: list[str]
    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def _mask() -> np.ndarray:
    keep = np.zeros((max(WIDTHS), SIZE, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        keep[:w, :, i * FILTERS:(i + 1) * FILTERS] = 1
    return keep.reshape(max(WIDTHS) * SIZE, -1)


def _patches(net: ByteNet, windows: np.ndarray) -> np.ndarray:
    """Rows of ``max(WIDTHS)`` neighbouring embeddings, one for each start in a window."""
    x = net.table[windows]
    n, length, size = x.shape
    starts = length - max(WIDTHS) + 1
    s0, s1, s2 = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, starts, max(WIDTHS) * size), (s0, s1, s2)).reshape(n * starts, -1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: ByteNet, windows: np.ndarray) -> np.ndarray:
    """Softmax outputs of byte windows (rows of ``LENGTH`` bytes, zero-padded)."""
    found = []
    for i in range(0, len(windows), BLOCK):
        part = windows[i:i + BLOCK]
        pooled = (_patches(net, part) @ net.filters).reshape(len(part), -1, net.filters.shape[1]).max(axis=1)
        found.append(_softmax(np.maximum(pooled + net.bias, 0) @ net.dense + net.offset))
    return np.concatenate(found) if found else np.zeros((0, len(net.languages)), np.float32)


def train(windows: np.ndarray, labels: list[str], batch: int = 64, rate: float = 0.004) -> ByteNet:
    """Adam on the cross-entropy; the same rows in the same order give the same network."""
    rng = np.random.default_rng(0)
    fold = np.arange(256)
    fold[65:91] += 32                       # capitals are learned as small letters
    windows = fold[windows]
    languages = sorted(set(labels))
    y = np.searchsorted(languages, labels)
    wide, n_filters = max(WIDTHS) * SIZE, len(WIDTHS) * FILTERS
    keep = _mask()
    net = ByteNet(languages, rng.normal(0, 0.5, (256, SIZE)).astype(np.float32),
                  (rng.normal(0, 0.25, (wide, n_filters)) * keep).astype(np.float32), np.zeros(n_filters, np.float32),
                  rng.normal(0, 0.2, (n_filters, len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    net.table[0] = 0
    names = ("table", "filters", "bias", "dense", "offset")
    mean = {k: np.zeros_like(getattr(net, k)) for k in names}
    square = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(max(ROUNDS, SEEN // max(1, len(y))) if len(languages) > 1 else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i:i + batch]
            part, n = windows[rows], len(rows)
            patches = _patches(net, part)
            flat = (patches @ net.filters).reshape(n, -1, n_filters)
            at = flat.argmax(axis=1)
            pooled = np.take_along_axis(flat, at[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ net.dense + net.offset)
            error[np.arange(n), y[rows]] -= 1
            error /= n
            back = (error @ net.dense.T) * (pooled > 0)
            starts = flat.shape[1]
            picked = patches.reshape(n, starts, wide)[np.arange(n)[:, None], at]       # (n, filters, wide)
            grads = {"dense": hidden.T @ error, "offset": error.sum(0), "bias": back.sum(0),
                     "filters": np.einsum("nf,nfw->wf", back, picked) * keep}
            spread = (back[:, :, None] * net.filters.T[None]).reshape(n, n_filters, max(WIDTHS), SIZE)
            table = np.zeros_like(net.table)
            near = at[:, :, None] + np.arange(max(WIDTHS))
            np.add.at(table, part[np.arange(n)[:, None, None], near], spread)
            table[0] = 0
            grads["table"] = table
            step += 1
            for k in names:
                mean[k] = 0.9 * mean[k] + 0.1 * grads[k]
                square[k] = 0.999 * square[k] + 0.001 * grads[k] ** 2
                move = rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    net.table[65:91] = net.table[97:123]
    return net


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of ``data`` from each start to each end, zero-padded to ``LENGTH``."""
    at = starts[:, None] + np.arange(LENGTH)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          windows: int = WINDOWS, languages: int = LANGUAGES) -> ByteNet | None:
    """The network of ``labelled``, or None without labels.

    Every label gets an equal part of ``windows``; its rows are drawn by a hash of the key, and the places of
    windows in a text by another, so that the sample covers all of a text's parts.
    """
    known = labelled.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(languages).collect()
    if not counts:
        return None
    each = max(1, windows // len(counts))
    # a margin of a quarter over the wanted share, then the exact cut
    share, places = F.lit(0.0), F.lit(1)
    for r in counts:
        several = min(PLACES, -(-each // r["count"]))
        share = F.when(F.col("l") == r["l"], min(1.0, (1.25 * each + 20) / (r["count"] * several))).otherwise(share)
        places = F.when(F.col("l") == r["l"], several).otherwise(places)
    known = known.withColumn("place", F.explode(F.sequence(F.lit(1), places)))
    chance = (F.pmod(F.xxhash64(F.lit(1), "k", "place"), F.lit(1 << 30)) / float(1 << 30))
    room = F.greatest(F.length("t") - LENGTH, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit(2), "k", "place"), room.cast("long")).cast("int") + 1
    drawn = (known.where(chance < share).withColumn("draw", chance)
             .select("l", "draw", "k", F.substring("t", start, F.lit(LENGTH)).alias("w"))
             .orderBy("draw", "k", "w").limit(windows + windows // 4 + 40 * len(counts)).collect())
    rows, taken = [], {}
    for r in drawn:
        if taken.setdefault(r["l"], 0) < each:
            taken[r["l"]] += 1
            rows.append(r)
    texts = [r["w"].encode()[:LENGTH] for r in rows]
    # half of each label's windows are also learned from their beginnings alone: short texts occur
    short = [(t[:8 + 11 * (i % 6)], r["l"]) for i, (t, r) in enumerate(zip(texts, rows)) if i % 2]
    texts += [t for t, _ in short]
    cut = np.zeros((len(texts), LENGTH), np.uint8)
    for i, t in enumerate(texts):
        cut[i, :len(t)] = np.frombuffer(t, np.uint8)
    return train(cut, [r["l"] for r in rows] + [l for _, l in short])


def score_texts(net: ByteNet, texts: pa.Array) -> np.ndarray:
    """Mean probabilities of each text, weighted by its windows' bytes; rows of empty texts are zero."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"\0", np.uint8)
    total = np.zeros((len(texts), len(net.languages)))
    sizes = np.diff(ends)
    counts = -(-sizes // LENGTH)
    first = np.concatenate([[0], np.cumsum(counts)])
    for i in range(0, int(first[-1]), BLOCK):
        no = np.arange(i, min(i + BLOCK, int(first[-1])))
        row = np.searchsorted(first, no, side="right") - 1
        start = ends[row] + (no - first[row]) * LENGTH
        weight = np.minimum(ends[row + 1] - start, LENGTH)
        np.add.at(total, row, probabilities(net, _cut(data, start, ends[row + 1])) * weight[:, None])
    return total / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``lang_pred`` and ``score``: the likeliest language and its mean
    probability."""
    shown = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = shown + [text] * (text not in shown)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if net else F.lit(False)
    out = T.StructType([docs.schema[c] for c in shown] + [T.StructField("lang_pred", T.StringType()),
                                                         T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            if net is None:
                best, score = np.full(len(read), UNKNOWN, object), np.zeros(len(read))
            else:
                p = score_texts(net, batch.column(kept.index(text)))
                best = np.where(read, np.array(net.languages, object)[p.argmax(axis=1)], UNKNOWN)
                score = np.where(read, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:len(shown)] + [pa.array(best.tolist(), pa.string()), pa.array(score, pa.float64())],
                names=shown + ["lang_pred", "score"])

    return docs.select(*[F.col(c) for c in kept], letters.alias("__letters")).mapInArrow(tidy(apply), out)
