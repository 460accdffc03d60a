"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are cut into at most ``BINS`` bins at quantiles. One lookup table per feature is learnt by
cyclic boosting: feature after feature, a tree of few leaves is fitted to the gradient and its leaf values are added to
the feature's table. Then the pairs of features that explain most of what is left get tables of two dimensions in the
same way. A score is the logistic of an intercept and the table entries of a text's bins: additions by bin.

* ``MAX_TRAIN`` bounds the labelled rows that a model is fitted on (taken in hash order); features of that many rows
  are what the driver sees. Every text is scored whole, in batches.
* Null text is empty and gets the score of an empty text. Rows with null labels or without a label train nothing; with
  several labels for a doc_id each counts. Without training rows every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialloom.llm.training import held_out, sample_order
from trialloom.llm.words import VISIBLE, find_words, grams, slices, text_bytes

MAX_TRAIN = 20_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 120
PAIRS = 10
RATE = 0.1

_codes = np.arange(256)
_UPPER = (_codes >= 65) & (_codes <= 90)
_LOWER = (_codes >= 97) & (_codes <= 122)
_DIGIT = (_codes >= 48) & (_codes <= 57)
_BEYOND = _codes >= 128
_BLANK = ~VISIBLE
_STOP = np.isin(_codes, [ord(c) for c in ".!?"])
_SYMBOL = np.isin(_codes, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"])
_CLASSES = [_UPPER, _LOWER, _DIGIT, _BEYOND, _BLANK, _STOP, _SYMBOL]
NAMES = ["bytes", "words", "word_length", "upper", "lower", "digits", "beyond_ascii", "blank", "stops", "symbols", "lines",
         "line_words", "distinct_words", "distinct_runs", "distinct_lines", "top_word", "wordless", "symbol_ends",
         "upper_starts", "longest_word", "same_byte_pairs", "exclaimed", "bars"]


def features(texts: pa.Array) -> np.ndarray:
    """One row per text, one column per name in ``NAMES``; all zeros for an empty text."""
    data, bounds = text_bytes(texts)
    n = len(texts)
    size = np.diff(bounds).astype(float)
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    per_text = lambda flags: np.diff(upto(flags)[bounds])
    found = find_words(texts, VISIBLE)
    words = np.diff(found.bounds).astype(float)
    some = np.maximum(words, 1)
    long = found.end - found.start
    hashes = found.hashes()
    lines = per_text(data == 10) + (size > 0)
    out = np.zeros((n, len(NAMES)))
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(words), np.diff(upto(long)[found.bounds]) / some
    for j, members in enumerate(_CLASSES):
        out[:, 3 + j] = per_text(members[data]) / np.maximum(size, 1)
    out[:, 10], out[:, 11] = np.log1p(lines), words / np.maximum(lines, 1)
    if not len(hashes):
        return out
    letters = upto((_UPPER | _LOWER | _BEYOND)[data])
    wordless = letters[found.end] == letters[found.start]
    last, first = data[found.end - 1], data[found.start]
    by_word = lambda flags: np.diff(upto(flags)[found.bounds]) / some
    out[:, 16], out[:, 17], out[:, 18] = by_word(wordless), by_word((_SYMBOL | (_codes == 33))[last]), by_word(_UPPER[first])
    pairs = np.zeros(len(data), bool)
    pairs[1:] = (data[1:] == data[:-1]) & VISIBLE[data[1:]]
    out[:, 20] = per_text(pairs) / np.maximum(size, 1)
    out[:, 21], out[:, 22] = per_text(data == 33) / some, per_text(data == 124) / some
    runs = grams(hashes, 3)
    line_words = find_words(texts, _codes != 10)
    line_hashes = line_words.hashes(fold=False)
    for i in range(n):
        lo, hi = found.bounds[i], found.bounds[i + 1]
        if hi > lo:
            _, counts = np.unique(hashes[lo:hi], return_counts=True)
            out[i, 12], out[i, 15] = len(counts) / (hi - lo), counts.max() / (hi - lo)
            out[i, 13] = len(np.unique(runs[lo:hi - 2])) / (hi - lo - 2) if hi - lo > 2 else 1.0
            a, b = line_words.bounds[i], line_words.bounds[i + 1]
            out[i, 14] = len(np.unique(line_hashes[a:b])) / max(1, b - a)
            out[i, 19] = np.log1p(long[lo:hi].max())
    return out


@dataclass
class Model:
    """Bin edges by feature, a table for each feature, tables of pairs, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], rows[:, j], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(self.pair_edges)]
            for a, b, table in self.pairs:
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins)) if len(column) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values over ordered bins with gradients ``g`` and weights ``h``: the best split, leaf after leaf."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for at, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            if gains.max() > best[0]:
                best = (gains.max(), at, lo + int(gains.argmax()) + 1)
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best table of four constant quadrants over a grid, and its gain."""
    sums = lambda x: np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    cg, ch = sums(g), sums(h)
    corner = lambda c: (
        c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1],
        c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    gains = sum(_gain(a, b) for a, b in zip(corner(cg), corner(ch))) - _gain(cg[-1, -1], ch[-1, -1])
    r, c = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, r + 1), slice(r + 1, None)):
        for cols in (slice(0, c + 1), slice(c + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1.0)
    return out, float(gains.max())


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting on a bounded sample of features and 0/1 labels."""
    width = rows.shape[1]
    edges = [_edges(rows[:, j], BINS) for j in range(width)]
    coarse_edges = [_edges(rows[:, j], PAIR_BINS) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(labels):
        return Model(edges, tables, coarse_edges, [], 0.0)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(share / (1 - share)))
    total = np.full(len(labels), intercept)
    bins = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(edges)]

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = gradients()
            step = RATE * shallow_tree(*(np.bincount(bins[j], x, len(tables[j])) for x in (g, h)))
            tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(e, rows[:, j], side="right") for j, e in enumerate(coarse_edges)]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = gradients()
    gains = sorted(((quadrants(grid(a, b, g), grid(a, b, h))[1], a, b) for a in range(width) for b in range(a)), reverse=True)
    chosen = [(a, b, np.zeros(grid(a, b, g).shape)) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(ROUNDS // 2):
        for a, b, table in chosen:
            g, h = gradients()
            step = RATE * quadrants(grid(a, b, g), grid(a, b, h))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return Model(edges, tables, coarse_edges, chosen, intercept)


def training_features(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(values, quality) of at most ``max_train`` labelled rows whose crc32(doc_id) mod 3 is not 1, in hash order.

    ``max_train`` labels are chosen, then ``max_train`` of the rows that carry their ids, however often an id is repeated.
    """
    marked = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), "quality").where(
        ~held_out(F.col("_id"), 3, 1))
    chosen = marked.orderBy(sample_order(F.col("_id")), "_id", "quality").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # max_train rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("place"), pa.array(list(values), pa.list_(pa.float64())), part.column("quality")], ["place", "values", "quality"])

    kind = labels.schema["quality"].dataType.simpleString()
    made = sample.select(sample_order(F.col("_id")).alias("place"), "text", "quality").mapInArrow(
        run, f"place long, values array<double>, quality {kind}")
    return made.orderBy("place", "quality", "values").limit(max_train).select("values", "quality")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    rows = training_features(docs, labels, max_train).toArrow()
    values = np.array(rows.column("values").to_pylist(), float).reshape(rows.num_rows, len(NAMES))
    marks = np.array(rows.column("quality").to_pylist(), float)
    order = np.lexsort([*values.T, marks])  # the order in which rows arrive does not matter
    return fit(values[order], marks[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS entries a feature, PAIR_BINS x PAIR_BINS a pair
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            scores = shared.value.score(features(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
