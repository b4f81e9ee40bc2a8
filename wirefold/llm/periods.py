"""Periodic runs of words: stretches that repeat one phrase again and again.

A run is a stretch of consecutive words whose smallest period is q, which no neighbouring word
extends with that period, and which is at least ``max(SHORTEST, REPEATS * q)`` words long. Runs are
found one dyadic scale after the other; scale B finds the periods from B to 2B - 1:

* a text is cut into blocks of B words. For every block the sum of squared differences to each
  stretch of B words that starts B to 2B - 1 words later comes from one convolution of word
  numbers, by number-theoretic transforms modulo as many primes as make the sums exact. A sum of 0
  is an occurrence of the block, its distance a seed;
* a run of period q holds at least two neighbouring blocks with the seed q, so lone seeds go; the
  others are chained and extended word by word to both sides.

Blocks are left out only where they cannot help: a word of the block has no later equal within
2B - 1 words, no neighbouring block is left, or block and window lie in a known run whose period
fits twice into the block, so that every seed is a multiple of that period. Two runs that share a
stretch as long as both periods together are the same run, so what lies in a known run is looked up
by start alone. All texts of an Arrow batch are searched together; the transforms work on pieces of
at most ``PIECE`` numbers, or one block and its window.

Nothing is shuffled: rows are judged on their own, in linear memory of the text.

Defined results: a null text has no words; texts of no or few words have no runs and keep all their
words. Repeated rows, null ids and other columns do not matter; an empty table gives no rows. Texts
may have up to 2**27 words.
"""

from __future__ import annotations

from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.llm.shared import fresh

SHORTEST, REPEATS = 6, 4                   # least words of a run; least repetitions of its period
PIECE = 1 << 18                            # numbers that are transformed at once
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

# Primes k * 2**m + 1 below 2**32 and a primitive root of each.
PRIMES = ((3221225473, 5), (2013265921, 31), (469762049, 3))


def _mod(values: np.ndarray, prime: int) -> np.ndarray:
    p = np.uint64(prime)
    return values - values // p * p        # a division by a constant is far cheaper than a remainder


def _powers(prime: int, root: int, count: int) -> np.ndarray:
    """root**0 .. root**(count - 1), by doubling."""
    out, step = np.ones(1, np.uint64), root
    while len(out) < count:
        out = np.concatenate([out, _mod(out * np.uint64(step), prime)])
        step = step * step % prime
    return out[:count]


def _forward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transforms of the rows of ``a``, values in bit-reversed order."""
    rows, size = a.shape
    p, length = np.uint64(prime), size
    while length > 1:
        half = length // 2
        turn = _powers(prime, pow(generator, (prime - 1) // length, prime), half)
        pairs = a.reshape(rows, size // length, 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        a = np.stack([_mod(low + high, prime), _mod(_mod(low + (p - high), prime) * turn, prime)], axis=2)
        length = half
    return a.reshape(rows, size)


def _backward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The rows whose transforms ``a`` holds, each multiplied by its size."""
    rows, size = a.shape
    p, length = np.uint64(prime), 2
    while length <= size:
        half = length // 2
        turn = _powers(prime, pow(generator, prime - 1 - (prime - 1) // length, prime), half)
        pairs = a.reshape(rows, size // length, 2, half)
        low, high = pairs[:, :, 0], _mod(pairs[:, :, 1] * turn, prime)
        a = np.stack([_mod(low + high, prime), _mod(low + (p - high), prime)], axis=2)
        length *= 2
    return a.reshape(rows, size)


def occurrences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether row i of ``blocks`` (B numbers) occurs at place t of row i of ``windows`` (2B numbers).

    The sum of squared differences at t is sum(a * a) + sum(w * w) - 2 * sum(a * w), taken modulo
    primes whose product is larger than any such sum.
    """
    rows, width = blocks.shape
    largest, product, found = int(windows.max(initial=0)), 1, np.ones((rows, width), bool)
    largest = max(largest, int(blocks.max(initial=0)))
    for prime, generator in PRIMES:
        a, w = _mod(blocks.astype(np.uint64), prime), _mod(windows.astype(np.uint64), prime)
        turned = np.zeros((rows, 2 * width), np.uint64)
        turned[:, 0] = a[:, 0]
        turned[:, width + 1:] = a[:, :0:-1]                  # a[j] at place -j
        mixed = _mod(_forward(turned, prime, generator) * _forward(w, prime, generator), prime)
        mixed = _backward(mixed, prime, generator)[:, :width]
        sums = np.zeros((rows, 2 * width + 1), np.uint64)
        np.cumsum(_mod(w * w, prime), axis=1, out=sums[:, 1:])
        own = _mod(a * a, prime).sum(axis=1, dtype=np.uint64)
        squares = _mod(own[:, None] + sums[:, width:2 * width] - sums[:, :width], prime)
        squares = _mod(squares * np.uint64(2 * width % prime), prime)
        found &= squares == _mod(mixed * np.uint64(2), prime)
        product *= prime
        if product > width * (largest + 1) ** 2:
            return found
    raise ValueError("the words of a text are too many for exact sums")


class Found:
    """Runs found so far, per scale. Inside one scale no run holds another, so the last one that
    starts at or before a place also ends last."""

    def __init__(self) -> None:
        self.scales: list[np.ndarray] = []                   # start, end, period; by start

    def add(self, runs: np.ndarray) -> None:
        if len(runs):
            self.scales.append(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def around(self, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
        """The period, at most ``longest``, of the run that holds start..end; 0 for none."""
        out = np.zeros(len(start), np.int64)
        for runs in self.scales:
            at = np.searchsorted(runs[:, 0], start, "right") - 1
            run = runs[np.maximum(at, 0)]
            holds = (at >= 0) & (run[:, 1] >= end) & (run[:, 2] <= longest)
            out = np.where(holds, run[:, 2], out)
        return out


def _reach(x: np.ndarray, place: np.ndarray, shift: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many places on from ``place``, in the direction of ``step`` and less than ``limit``, have a
    word equal to the one ``shift`` later."""
    out = np.zeros(len(place), np.int64)
    live, width = np.flatnonzero(limit > 0), 8
    while len(live):
        for piece in np.array_split(live, -(-len(live) * width // PIECE)):
            ahead = out[piece, None] + np.arange(width)
            inside = ahead < limit[piece, None]
            at = place[piece, None] + step * np.where(inside, ahead, 0)
            same = inside & (x[at] == x[at + shift[piece, None]])
            out[piece] += np.where(same.all(axis=1), width, np.argmin(same, axis=1))
            live = np.concatenate([live[~np.isin(live, piece)], piece[same.all(axis=1)]])
        width = min(2 * width, PIECE)
    return out


def _seeds(x: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of every occurrence of the blocks at ``at`` in the windows after them."""
    blocks, shifts = [], []
    rows = max(1, PIECE // (2 * width))
    for first in range(0, len(at), rows):
        start, end = at[first:first + rows], ends[first:first + rows]
        block = x[start[:, None] + np.arange(width)]
        place = start[:, None] + np.arange(width, 3 * width)
        inside = place < end[:, None]
        window = x[np.where(inside, place, 0)]
        low = np.minimum(block.min(axis=1), np.where(inside, window, block[:, :1]).min(axis=1))[:, None]
        block, window = block - low, window - low
        high = max(int(block.max()), int(np.where(inside, window, 0).max()))
        hit = np.nonzero(occurrences(block, np.where(inside, window, high + 1)))
        blocks.append(start[hit[0]])
        shifts.append(hit[1] + width)
    return np.concatenate(blocks), np.concatenate(shifts)


def _paired(values: np.ndarray, gap: int) -> np.ndarray:
    """Which of the ascending ``values`` have a neighbour that is ``gap`` away."""
    near = np.zeros(len(values) + 1, bool)
    near[1:-1] = np.diff(values) == gap
    return near[1:] | near[:-1]


def find_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start and period, of the runs in the texts whose words have the
    numbers ``x``; text i is x[bounds[i]:bounds[i + 1]], and no two texts share a number."""
    order = np.argsort(x, kind="stable")
    later = np.full(len(x), len(x), np.int64)                # distance to the next equal word
    same = x[order[1:]] == x[order[:-1]]
    later[order[:-1][same]] = (order[1:] - order[:-1])[same]
    sizes, known, width = np.diff(bounds), Found(), 1
    while (long := np.flatnonzero(sizes >= max(SHORTEST, REPEATS * width))).size:
        counts = sizes[long] // width
        text = np.repeat(long, counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at, ends = bounds[text] + within * width, bounds[text + 1]
        far = np.concatenate([[0], np.cumsum(later >= 2 * width)])
        fits = far[at + width] == far[at]
        at, ends = at[fits], ends[fits]
        if len(at):
            new = known.around(at, np.minimum(at + 3 * width, ends), width // 2) == 0
            at, ends = at[new], ends[new]
        near = _paired(at, width)
        at, ends = at[near], ends[near]
        if len(at):
            known.add(_extended(x, bounds, known, *_seeds(x, at, ends, width), width))
        width *= 2
    runs = np.concatenate([np.zeros((0, 3), np.int64), *known.scales])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _extended(x: np.ndarray, bounds: np.ndarray, known: Found, at: np.ndarray, shift: np.ndarray,
              width: int) -> np.ndarray:
    """The new runs that the seeds belong to."""
    text = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((at, shift, text))
    at, shift, text = at[order], shift[order], text[order]
    joined = np.append(False, (np.diff(at) == width) & (shift[1:] == shift[:-1]) & (text[1:] == text[:-1]))
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(at)) - 1
    two = last > first
    start, stop, shift, text = at[first[two]], at[last[two]] + width, shift[first[two]], text[first[two]]
    period = known.around(start, stop + shift, width)
    new = (period == 0) | (shift % np.maximum(period, 1) != 0)
    start, stop, shift, text = start[new], stop[new], shift[new], text[new]
    start = start - _reach(x, start - 1, shift, start - bounds[text], -1)
    stop = stop + shift + _reach(x, stop, shift, bounds[text + 1] - shift - stop, 1)
    whole = stop - start >= np.maximum(SHORTEST, REPEATS * shift)
    return np.unique(np.stack([start, stop, shift], axis=1)[whole], axis=0)


def search(texts: pa.Array) -> pa.Array:
    """Runs and collapsed text of every text of a batch."""
    split = [(t or "").encode().split() for t in texts.to_pylist()]      # at just these blanks
    bounds = np.cumsum([0, *map(len, split)])
    numbers, base = np.empty(bounds[-1], np.int64), 0
    for words, first, end in zip(split, bounds[:-1], bounds[1:]):
        number = dict(zip(dict.fromkeys(words), range(base, base + len(words))))
        numbers[first:end] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        base += len(number)
    runs = find_runs(numbers, bounds)
    text = np.searchsorted(bounds, runs[:, 0], "right") - 1
    dropped = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    hit, offsets = set(text.tolist()), np.searchsorted(text, np.arange(len(split) + 1))
    collapsed = [b" ".join(compress(words, kept[first:end].tolist()) if i in hit else words).decode()
                 for i, (words, first, end) in enumerate(zip(split, bounds[:-1], bounds[1:]))]
    items = pa.StructArray.from_arrays([pa.array(runs[:, 0] - bounds[text]), pa.array(runs[:, 1] - runs[:, 0]),
                                        pa.array(runs[:, 2])], ["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items), pa.array(collapsed, pa.string())],
        ["runs", "collapsed"])


def with_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of ``text`` (by start, then period) and its words, joined by one space,
    without those that a run repeats after its first period."""
    def run(batch: pa.Array) -> pa.Array:
        return search(batch)
    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    both = fresh(docs, "_periods")
    once = F.arrow_udf(run, f"struct<runs: {RUNS}, collapsed: string>").asNondeterministic()   # never inlined
    found = docs.withColumn(both, once(F.col(f"`{text}`").cast("string")))
    return found.withColumns({runs: F.col(both)["runs"], collapsed: F.col(both)["collapsed"]}).drop(both)


def plant(keys: pa.Array, texts: pa.Array) -> pa.Array:
    """The texts, where a tenth of the keys repeat a stretch of words from a place on that the key decides."""
    out = texts.to_pylist()
    for row, (key, text) in enumerate(zip(keys.to_pylist(), out)):
        hashed = 1 if key is None else crc32(key.encode())
        words = (text or "").encode().split() if hashed % 10 == 0 else []
        if words:
            start = hashed // 10 % len(words)
            period = 1 + (len(words) - start) // (3 + hashed // 10 % 8)
            phrase = words[start:start + period]
            again = -(-(len(words) - start) // period)
            out[row] = b" ".join((words[:start] + phrase * again)[:len(words)]).decode()
    return pa.array(out, pa.string())


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the repetitions that the contract of the registered query plants.
    Rows without an id stay as they are."""
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return plant(keys, texts)
    run.__annotations__ = {"keys": pa.Array, "texts": pa.Array, "return": pa.Array}
    return docs.withColumn("text", F.arrow_udf(run, "string")(
        F.col("doc_id").cast("string"), F.col("text").cast("string")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    found = with_runs(with_planted_runs(docs.select("doc_id", "text")))
    runs = F.col("runs")
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(
        b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size(runs).cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
