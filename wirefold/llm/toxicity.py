"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

The lexicon has a fixed core and terms mined from labelled rows: words far more frequent in toxic than in
clean documents, each weighted by its log odds. Texts are lower-cased and look-alike letters
folded to the letters they imitate; one automaton finds all terms in one pass, at word borders only. Texts with
digits or signs in place of letters are passed once more with those folded too, and a hit
counts there only if it contains such a substitution. Hits inside an exception phrase do not count.
The weighted hits are divided by a power of the text's length; the power and the cut that best separate the
labelled rows turn the quotient q into the score q / (q + cut).

Terms and cut are learnt from a sample of labelled rows bounded by ``TRAIN_ROWS``; the terms are counted by Spark,
and at most ``TERMS`` reach the driver. Scoring covers every row and whole texts.

Defined results: null and empty texts score 0; with no usable labels the core alone decides, with a
cut of CUT; repeated label rows count once (the larger label); further columns are kept as they are.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.gam import TRAIN_ROWS, labelled
from wirefold.llm.shared import Scratch, remainder

TERMS = 5_000                # mined terms, at most; those of the largest weight
EVIDENCE = 30.0              # likelihood-ratio statistic a mined term needs
ODDS = 3.0                   # log odds it needs
CUT, POWER = 0.05, 0.5       # used without labels
CORE_WEIGHT = 4.0

# Insults that are always looked for, and phrases in which they are none.
CORE = ("idiot", "moron", "scum", "loser", "trash", "stupid", "pathetic", "worthless", "disgusting",
        "clown", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "vermin", "filth")
EXCEPTIONS = ("clown fish", "clown car", "circus clown", "class clown", "trash can", "trash bag",
              "trash bin", "trash collection", "loser bracket", "pond scum", "soap scum")
# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏвкмнтαορνικτμηβԛѡ", "aeopcyxijsdhlbkmhtaopviktunbqw"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
         "!": "i"}
INVISIBLE = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad")


@lru_cache(maxsize=1)
def _folding() -> tuple[dict, dict]:
    """Translation tables: to plain letters; and further to a skeleton in which l counts as i."""
    plain: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for start, stop in ((0x2100, 0x2150), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for point in range(start, stop):
            shape = unicodedata.normalize("NFKC", chr(point)).lower()
            if len(shape) == 1 and shape.isascii() and shape.isalnum():
                plain[point] = shape
    plain.update({ord(a): b for a, b in LOOK_ALIKES.items()})
    return plain, {ord(a): b for a, b in {**SIGNS, "l": "i"}.items()}


def folded(text: str) -> str:
    low = text.lower()
    if low.isascii():
        return low
    # Latin letters beyond ASCII stay; only texts with other scripts or signs need the table.
    return low.translate(_folding()[0]) if any(c > "\u024f" or c == "\u00ad" for c in set(low)) else low


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms, exception phrases, and how a weighted count becomes a score."""
    terms: tuple[tuple[str, float], ...] = tuple((t, CORE_WEIGHT) for t in CORE)
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = POWER
    cut: float = CUT


@lru_cache(maxsize=8)
def _automata(terms: tuple, exceptions: tuple) -> tuple:
    def build(shape) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for phrase in exceptions:
            if shape(phrase):
                machine.add_word(shape(phrase), (len(shape(phrase)), None))
        for term, weight in terms:
            word = shape(folded(term))
            if word and (word not in machine or machine.get(word)[1] is not None):
                known = machine.get(word)[1] if word in machine else 0.0
                machine.add_word(word, (len(word), max(weight, known)))
        machine.make_automaton()
        return machine
    return build(lambda w: w), build(lambda w: w.translate(_folding()[1]))


def _outer(text: str, start: int, stop: int) -> bool:
    """The stretch neither begins nor ends inside a word."""
    return not ((start and text[start - 1].isalnum()) or (stop < len(text) and text[stop].isalnum()))


def _hits(machine, haystack: str, plain: str, altered: bool) -> float:
    """Summed weights of the terms at word borders and outside exception phrases."""
    found, spared = [], []
    for last, (size, weight) in machine.iter(haystack):
        start = last - size + 1
        if not _outer(plain, start, last + 1):
            continue
        if weight is None:
            spared.append((start, last))
        elif not altered or any(c in SIGNS for c in plain[start:last + 1]):
            found.append((start, last, weight))
    spared.sort()
    starts, reach = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))

    def outside(first: int, last: int) -> bool:              # of all phrases that start at or before it
        at = bisect_right(starts, first)
        return not at or reach[at - 1] < last
    return sum(w for a, b, w in found if outside(a, b))


def weigh(text: str, lexicon: Lexicon, automata: tuple | None = None) -> tuple[float, int]:
    """(summed weights of the hits, number of words) of one text; ``automata`` are the lexicon's own."""
    if not text:
        return 0.0, 0
    direct, skeleton = automata or _automata(lexicon.terms, lexicon.exceptions)
    plain = folded(text)
    total = _hits(direct, plain, plain, False)
    if any(c in plain for c in SIGNS):
        total += _hits(skeleton, plain.translate(_folding()[1]), plain, True)
    return total, len(plain.split())


def _score(total: np.ndarray, words: np.ndarray, power: float, cut: float) -> np.ndarray:
    share = total / np.maximum(words, 1) ** power
    return share / (share + cut)


def weights_of(text: Column, lexicon: Lexicon) -> Column:
    """struct(total, words) of ``text``."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            automata = _automata(lexicon.terms, lexicon.exceptions)
            pairs = [weigh(t, lexicon, automata) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.float64()),
                                              pa.array([p[1] for p in pairs], pa.int64())],
                                             ["total", "words"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<total: double, words: bigint>")(text)


def mine(sample: DataFrame, terms: int = TERMS) -> list[tuple[str, float]]:
    """Words of the sample (text, label) that mark toxic documents, with their log odds."""
    words = sample.select("label", F.explode(F.array_distinct(
        F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("length(word) between 3 and 40")
    totals = sample.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    toxic, clean = totals["t"] or 0, totals["c"] or 0
    if not toxic or not clean:
        return []
    counted = words.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    rate = toxic / (toxic + clean)
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))

    def part(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0.0)
    rows = (counted.select("word", odds.alias("odds"),
                           (2 * (part(a, rate) + part(b, 1 - rate))).alias("evidence"))
            .where((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE))
            .orderBy(F.desc("odds"), "word").limit(terms).collect())
    return [(r["word"], r["odds"]) for r in rows]


def calibrate(total: np.ndarray, words: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The power of the length, and the cut, that make the fewest balanced errors."""
    best, chosen = math.inf, (POWER, CUT)
    toxic = labels == 1
    if not toxic.any() or toxic.all():
        return chosen
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):
        share = total / np.maximum(words, 1) ** power
        levels = np.unique(share[share > 0])
        if not len(levels):
            continue
        edges = np.concatenate((levels[:1] / 2, np.sqrt(levels[:-1] * levels[1:])))
        order = np.sort(share[~toxic])
        false = 1 - np.searchsorted(order, edges) / len(order)
        missed = np.searchsorted(np.sort(share[toxic]), edges) / toxic.sum()
        at = int(np.argmin(false + missed))
        if (false + missed)[at] < best - 1e-12:
            best, chosen = (false + missed)[at], (power, float(edges[at]))
    return chosen


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon of ``labels.toxic``, from rows outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(labelled(docs, labels, "toxic", 5, F.col("fold") != 0, rows), "sample")
    terms = {t: CORE_WEIGHT for t in CORE} | dict(mine(sample))
    lexicon = Lexicon(tuple(sorted(terms.items())))
    got = sample.select("label", weights_of(F.col("text"), lexicon).alias("w")).select(
        "label", "w.*").collect()
    scratch.drop("sample")
    label, total, words = (np.array([r[k] for r in got], float) for k in ("label", "total", "words"))
    power, cut = calibrate(total, words, label)
    return Lexicon(lexicon.terms, lexicon.exceptions, power, cut)


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the score of every row."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            automata = _automata(lexicon.terms, lexicon.exceptions)
            pairs = np.array([weigh(t, lexicon, automata) for t in batch.to_pylist()], float).reshape(-1, 2)
            yield pa.array(_score(pairs[:, 0], pairs[:, 1], lexicon.power, lexicon.cut), pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(score, F.arrow_udf(run, "double")(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
                       .alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
