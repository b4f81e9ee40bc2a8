"""Quality scores from a generalised additive model with pairwise interactions.

Every text becomes a row of surface features. Features are cut into quantile bins; cyclic boosting
visits one feature after the other and adds a shallow tree's leaf values to that feature's lookup
table, then does the same for the pairs of features that explain most of what is left, on a coarser
grid. A score is the logistic of the intercept plus one table entry per feature and pair: lookups and
additions over whole batches.

The model is fitted on the driver from a sample of labelled rows whose size is bounded by
``TRAIN_ROWS``, taken by a hash of the id, so the same rows train on every run. Scoring covers every row
and whole texts, and uses the text alone.

Defined results: null and empty texts get the score of their (zero) features; with no
usable label the score is 0.5 everywhere; with labels of one kind it is near that kind; repeated
label rows of a document count once (the larger label); further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.odd_sketch import word_hashes
from wirefold.llm.shared import bounded, remainder

TRAIN_ROWS = 20_000          # labelled rows a model is fitted on, at most
BINS, GRID = 32, 8           # bins of a feature alone and in a pair
ROUNDS, PAIR_ROUNDS = 120, 60
RATE, PENALTY, LEAST = 0.15, 1.0, 2.0
PAIRS = 6
CHUNK_BYTES = 1 << 18

FEATURES = ("words", "word_bytes", "symbols", "stops", "capitals", "digits", "bars", "exclamations",
            "distinct", "repeats", "top_word", "lines", "line_words", "short_words", "long_words",
            "entropy", "wide_bytes")


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; null and empty texts give zeros."""
    texts = texts.cast(pa.large_string())
    size = len(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + size + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    out, at = np.zeros((size, len(FEATURES))), 0
    while at < size:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, size)
        out[at:stop] = _surface(raw[edges[at]:edges[stop]], edges[at:stop + 1] - edges[at])
        at = stop
    return out


def _kinds() -> np.ndarray:
    """Class of every byte: 1 symbol, 2 stop, 3 capital, 4 digit, 5 bar, 6 exclamation, 7 line end."""
    kind = np.zeros(256, np.int64)
    for i, chars in enumerate(("#$%&*+/<=>@\\^_`{}~[]", ".,;:?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               "0123456789", "|", "!", "\n"), 1):
        kind[[ord(c) for c in chars]] = i
    kind[128:] = 8
    return kind


_KIND = _kinds()


def _surface(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    texts = len(edges) - 1
    length = np.diff(edges)
    owner = np.repeat(np.arange(texts), length)
    kinds = np.bincount(owner * 9 + _KIND[raw], minlength=texts * 9).reshape(texts, 9)
    capital = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)     # capitals of Latin-1
    capitals = kinds[:, 3] + np.bincount(owner[1:][capital], minlength=texts)
    starts = np.minimum(edges[:-1], max(len(raw) - 1, 0))
    words, of = (word_hashes(raw, starts[length > 0]) if len(raw)
                 else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    of = np.flatnonzero(length > 0)[of]
    n = np.bincount(of, minlength=texts)
    white = np.isin(raw, (9, 10, 11, 12, 13, 32))
    body = length - np.bincount(owner[white], minlength=texts)
    order = np.lexsort((words, of))
    sorted_of, sorted_words = of[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = (sorted_of[1:] != sorted_of[:-1]) | (sorted_words[1:] != sorted_words[:-1])
    distinct = np.bincount(sorted_of[new], minlength=texts)
    runs = np.diff(np.concatenate((np.flatnonzero(new), [len(words)])))
    top = np.zeros(texts)
    np.maximum.at(top, sorted_of[new], runs)
    again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[1:][again], minlength=texts)
    begin = np.flatnonzero(~white & np.concatenate(([True], white[:-1] | (owner[1:] != owner[:-1])))
                           ) if len(raw) else np.zeros(0, np.int64)
    inside = np.cumsum(~white)
    size = np.diff(np.concatenate((inside[begin] - 1, [inside[-1]]))) if len(begin) else begin
    short = np.bincount(of[size <= 3], minlength=texts)
    long = np.bincount(of[size >= 12], minlength=texts)
    spread = np.bincount(owner * 64 + (raw >> 2), minlength=texts * 64).reshape(texts, 64)
    share = spread / np.maximum(length, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    some, bytes_ = np.maximum(n, 1), np.maximum(body, 1)
    lines = kinds[:, 7] + (length > 0)
    out = np.stack([
        np.log1p(n), body / some, kinds[:, 1] / bytes_, kinds[:, 2] / some, capitals / bytes_,
        kinds[:, 4] / bytes_, kinds[:, 5] / some, kinds[:, 6] / some, distinct / some,
        repeats / some, top / some, np.log1p(lines), n / np.maximum(lines, 1), short / some,
        long / some, entropy, kinds[:, 8] / bytes_], axis=1)
    out[length == 0] = 0
    return out


@dataclass
class Additive:
    """Intercept, per-feature cuts and tables, and tables of feature pairs on coarser cuts."""
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, rows[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], rows[:, a], side="right"),
                           np.searchsorted(self.coarse[b], rows[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(slope: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of a tree of ``depth`` over ordered bins, from sums of slopes and weights."""
    g, h = np.cumsum(slope), np.cumsum(weight)
    value = np.full(len(slope), g[-1] / (h[-1] + PENALTY))
    if depth == 0 or len(slope) < 2:
        return value
    left, right = h[:-1], h[-1] - h[:-1]
    gain = g[:-1] ** 2 / (left + PENALTY) + (g[-1] - g[:-1]) ** 2 / (right + PENALTY)
    gain[(left < LEAST) | (right < LEAST)] = -1
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= g[-1] ** 2 / (h[-1] + PENALTY) + 1e-9:
        return value
    return np.concatenate((_split(slope[:at], weight[:at], depth - 1),
                           _split(slope[at:], weight[at:], depth - 1)))


def _split_grid(slope: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cross of one cut per axis over a grid: its four values, and its gain."""
    g, h = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    best, table = 0.0, np.zeros(slope.shape)
    for i in range(slope.shape[0] - 1):
        for j in range(slope.shape[1] - 1):
            q = np.array([[g[i, j], g[i, -1] - g[i, j]],
                          [g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]]])
            w = np.array([[h[i, j], h[i, -1] - h[i, j]],
                          [h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]]])
            gain = float((q ** 2 / (w + PENALTY)).sum())
            if gain > best:
                best = gain
                leaf = q / (w + PENALTY)
                table = leaf[np.ix_((np.arange(slope.shape[0]) > i).astype(int),
                                    (np.arange(slope.shape[1]) > j).astype(int))]
    return table, best


def fit(rows: np.ndarray, labels: np.ndarray) -> Additive:
    """An additive model of ``labels`` (0 or 1)."""
    model = Additive()
    if not len(rows):
        return model
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    if labels.min() == labels.max():
        return model
    wide = range(rows.shape[1])
    model.cuts = [_cut_points(rows[:, j], BINS) for j in wide]
    model.coarse = [_cut_points(rows[:, j], GRID) for j in wide]
    fine = [np.searchsorted(c, rows[:, j], side="right") for j, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, rows[:, j], side="right") for j, c in enumerate(model.coarse)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(rows), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)
    for _ in range(ROUNDS):
        for j in wide:
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _split(np.bincount(fine[j], g, n), np.bincount(fine[j], h, n), 2)
            model.tables[j] += step
            total += step[fine[j]]
    for j, table in enumerate(model.tables):              # tables around zero, the rest to the intercept
        mean = float(table[fine[j]].mean())
        table -= mean
        model.intercept += mean

    def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        cell = rough[a] * shape[1] + rough[b]
        return (np.bincount(cell, g, shape[0] * shape[1]).reshape(shape),
                np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))
    g, h = slopes()
    gains = sorted(((_split_grid(*grid(a, b, g, h))[1], a, b) for a in wide for b in wide if a < b),
                   reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)))
                   for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * _split_grid(*grid(a, b, *slopes()))[0]
            table += step
            total += step[rough[a], rough[b]]
    return model


def features_of(text: Column) -> Column:
    """The features of ``text``, as an array."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(list(features(batch)), pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<double>")(text)


def score_of(text: Column, model: Additive) -> Column:
    """The model's probability of label 1 for ``text``."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(features(batch)), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, keep: Column,
             rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents whose id's fold satisfies ``keep``,
    a condition on the column ``fold``. Of rows that repeat an id one stands for all."""
    some = (labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("label"))
            .where("doc_id is not null and label in (0, 1)")
            .withColumn("fold", remainder(F.col("doc_id"), parts)).where(keep)
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    found = (docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(bounded(some, F.col("doc_id"), rows)), "doc_id"))
    return (found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
            .select("doc_id", "t.text", "label"))


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Additive:
    """The quality model of ``labels.quality``, from rows outside the held-out fold."""
    sample = labelled(docs, labels, "quality", 3, F.col("fold") != 1, rows)
    got = sample.select("doc_id", "label", features_of(F.col("text")).alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)),
               np.array([r["label"] for r in got], float))


def scored(docs: DataFrame, model: Additive, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of every row."""
    return docs.withColumn(score, score_of(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), model))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
                       .alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
