"""Operator 9: quality scores by a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers (shares of character classes, word lengths, repetition, ...). A model has one lookup
table a feature, learned by boosting shallow trees on one feature at a time in turns (cyclic), and some tables on pairs of
features, chosen by what they still explain and boosted after the single ones. A score is the logistic of a sum of table
entries, looked up for whole batches at once.

The model is fitted on a bounded sample: the ``SAMPLE`` labelled rows with the least hash of the id. Scoring is one narrow
pass over whole texts.

Cases: null texts count as empty and are scored like any other. Rows with a null id are not learned from and count as not
held out. Null labels are no labels. Without labels of both kinds every score is the share of label 1 (0.5 without any).
Repeated rows repeat. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelwave.llm.arrowtext import blocks, text_view, word_hashes, words
from voxelwave.llm.rows import pick
from voxelwave.runtime import ship

SAMPLE = 20_000
BINS = 32
ROUNDS, RATE = 150, 0.1
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 60
SMOOTH = 4.0
CUT = 0.3
MARKS = b"!?.,;:'\"-#$%&*|@/_=+<>()[]{}~^`\\"

_CLASS = np.zeros(256, np.int64)  # 0: other control
for _k, _r in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), range(128, 256)), 1):
    _CLASS[list(_r)] = _k
_GROUPS = (b"!?", b".", b",;:", b"#$%&*", b"|", b"@/\\", b"_=+<>~^`", b"()[]{}", b"'\"-")
for _k, _r in enumerate(_GROUPS, 7):
    _CLASS[list(_r)] = _k
CLASSES = 7 + len(_GROUPS)
NAMES = ["log_bytes", "log_words", "mean_word", "sd_word", "longest_word", "short_words", "distinct_words", "repeated_next", "marked_ends", "upper_starts", *(f"class_{k}" for k in range(CLASSES)), "words_a_line", "words_a_stop", "upper_of_letters"]


def features(column: pa.Array) -> np.ndarray:
    """(rows, features) for a string column."""
    data, offsets = text_view(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)))
    for a, b in blocks(offsets):
        out[a:b] = _block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    classes = np.bincount(row * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    starts, ends, at = words(data, offsets)
    count = np.diff(at)
    w_row = np.repeat(np.arange(n), count)
    per = np.maximum(count, 1)
    total = lambda v: np.bincount(w_row, v, minlength=n)
    length = (ends - starts).astype(float)
    mean = total(length) / per
    sd = np.sqrt(np.maximum(total(length**2) / per - mean**2, 0))
    longest = np.zeros(n)
    if len(length):
        np.maximum.at(longest, w_row, length)
    h = word_hashes(data, starts, ends, 9)
    order = np.lexsort((h, w_row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w_row[order][1:] != w_row[order][:-1])
    distinct = np.bincount(w_row[order], new, minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w_row[1:] == w_row[:-1])
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    first = _CLASS[data[starts]] if len(starts) else np.zeros(0, np.int64)
    share = classes / np.maximum(size, 1)[:, None]
    return np.column_stack([
        np.log1p(size), np.log1p(count), mean, sd, np.log1p(longest), total(length <= 3) / per, distinct / per, total(same) / per,
        total((last == 7) | (last >= 10)) / per, total(first == 2) / per, share,
        count / (classes[:, 5] + 1), count / (classes[:, 8] + 1), classes[:, 2] / np.maximum(classes[:, 1] + classes[:, 2], 1),
    ])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for p in self.pairs for j in p[:2]}
        for j, k, t in self.pairs:
            total += t[coarse[j], coarse[k]]
        return 1 / (1 + np.exp(-total))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree on bins: the split of most gain, again in both halves; steps by bin."""
    out = np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + SMOOTH) + (g.sum() - cg) ** 2 / (h.sum() - ch + SMOOTH)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + SMOOTH) + 1e-9:
            out[:cut], out[cut:] = _leaves(g[:cut], h[:cut], depth - 1), _leaves(g[cut:], h[cut:], depth - 1)
    return out


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Quadrants around the best pair of cuts of a two-way table; steps by cell, and the gain."""
    best, out = -1.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            qs = []
            for c in (cg, ch):
                tl, t, left, all_ = c[a - 1, b - 1], c[a - 1, -1], c[-1, b - 1], c[-1, -1]
                qs.append(np.array([tl, t - tl, left - tl, all_ - t - left + tl]))
            gain = float((qs[0] ** 2 / (qs[1] + SMOOTH)).sum())
            if gain > best:
                best, step = gain, qs[0] / (qs[1] + SMOOTH)
                out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = step
    return out, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        clip = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(clip / (1 - clip))), [], [], [], [])
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j, (b, t) in enumerate(zip(bins, tables)):
            if len(t) == 1:
                continue
            p = 1 / (1 + np.exp(-total))
            step = RATE * _leaves(np.bincount(b, y - p, minlength=len(t)), np.bincount(b, p * (1 - p), minlength=len(t)), 2)
            t += step
            total += step[b]
    pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]

    def cells(j: int, k: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int], np.ndarray]:
        shape = (len(pair_edges[j]) + 1, len(pair_edges[k]) + 1)
        cell = coarse[j] * shape[1] + coarse[k]
        p = 1 / (1 + np.exp(-total))
        make = lambda v: np.bincount(cell, v, minlength=shape[0] * shape[1]).reshape(shape)
        return make(y - p), make(p * (1 - p)), shape, cell

    wide = [j for j, e in enumerate(pair_edges) if len(e)]
    ranked = sorted(((_pair_tree(*cells(j, k)[:2])[1], j, k) for i, j in enumerate(wide) for k in wide[i + 1 :]), reverse=True)[:PAIRS]
    pairs = [(j, k, np.zeros((len(pair_edges[j]) + 1, len(pair_edges[k]) + 1))) for _, j, k in ranked]
    for _ in range(PAIR_ROUNDS):
        for j, k, t in pairs:
            g, h, shape, cell = cells(j, k)
            step = RATE * _pair_tree(g, h)[0]
            t += step
            total += step.reshape(-1)[cell]
    return Model(base, edges, tables, pair_edges, pairs)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality), on rows that are not held out.

    Rows that share an id are one learning row (of the least features), an id with several labels has the least.
    """
    ship(docs.sparkSession)
    marked = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_quality"))
    # SAMPLE rows at most: a bounded broadcast
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).withColumnRenamed("doc_id", "_id")
    rows = pick(docs, "doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_quality")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in features(b.column(1))], pa.binary())], ["id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = rows.mapInArrow(run, f"id {kind}, y int, x binary").groupBy("id").agg(F.min(F.struct("x", "y")).alias("r"))
    found = sorted((r.id, r.r.x, r.r.y) for r in one.collect())  # SAMPLE rows at most
    x = np.array([np.frombuffer(r[1]) for r in found]).reshape(len(found), len(NAMES))
    return fit(x, np.array([r[2] for r in found], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted. Narrow."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(features(b.column(1))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
