"""Near-duplicate groups by MinHash bands, odd sketches and a last exact test.

1. Every text becomes the set of its distinct word shingles (64-bit hashes), from which come MinHash
   samples, band keys over runs of samples, and two parity bitmaps. An odd sketch folds the MinHash samples:
   the population count of two sketches' XOR estimates how many samples differ, precisely where few do.
   The same fold over the whole set never counts more than the true difference, so it rejects without loss.
2. Texts with equal sets are one class, found by a map-side minimum. Only classes go on.
3. Classes that share a band key form a bucket. A bucket compares its members with one pivot, the member
   that collides most over all buckets, so a group of n near copies costs n comparisons. Pairs
   that pass both sketches are confirmed on their full sets.
4. Links give components. Buckets that still hold several components compare members of different
   components, block by block, again sketches first. Members already known to be connected are not
   compared, so the pairs of a group are never listed.

With the bands of ``Bound()`` and FOUR_FIFTHS a pair at exactly the threshold is missed by all bands with
a chance below 3e-7; everything after the bands is exact or, for the sampled sketch, five deviations wide.
All state is in written tables; nothing is collected.

Defined results: null and wordless texts have no shingles and are linked with nothing; a text with
fewer words than a shingle is one shingle of all its words; a null id is kept and linked with
nothing; rows that repeat an id are one node, so all of them share its component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.shared import Scratch

WORDS = 5                           # words of a shingle
BANDS, ROWS = 32, 6                 # MinHash bands and samples of a band
BITS = 512                          # bits of a sketch
BLOCK = 128                         # members of one bucket compared in one step
CHUNK_BYTES = 1 << 18               # text hashed at once; a longer text is hashed alone
MARGIN = 0.18                       # similarity given away for the sampled sketch's spread

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _SEED.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_SCALE = _SEED.integers(1, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _SEED.integers(1, 1 << 63, BANDS * ROWS, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)

SIGNATURE = "struct<n: bigint, set_id: binary, bands: array<bigint>, sampled: array<bigint>, whole: array<bigint>>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _ODD))))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in ``raw`` (UTF-8), and the text each belongs to; texts begin at ``starts``.

    Words are runs of bytes other than space and 9..13; A-Z count as a-z.
    """
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[starts] = True
    begin = np.flatnonzero(inside & (fresh[:-1] | ~np.concatenate(([False], inside[:-1]))))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    body = low[inside]
    first = (np.cumsum(inside) - 1)[begin]                # where each word begins in ``body``
    length = np.diff(np.concatenate((first, [len(body)])))
    at = np.arange(len(body)) - np.repeat(first, length)
    sums = np.add.reduceat(_BYTE[body] * _powers(int(length.max()))[at], first)
    return (_mix(sums + length.astype(np.uint64) * _ODD),
            np.searchsorted(starts, begin, side="right") - 1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text, in order."""
    texts = texts.cast(pa.large_string())
    size = len(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + size + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < size:
        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, size)
        words, owner = word_hashes(raw[edges[at]:edges[stop]],
                                   np.minimum(edges[at:stop], edges[stop]) - edges[at])
        bounds = np.searchsorted(owner, np.arange(stop - at + 1))
        runs = np.zeros(0, np.uint64)
        if len(words) >= WORDS:
            runs = sum(words[k:len(words) - WORDS + 1 + k] * _PLACE[k] for k in range(WORDS))
            runs = _mix(runs + np.uint64(WORDS))
        for i in range(stop - at):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= WORDS:
                yield np.unique(runs[a:b - WORDS + 1])
            elif b > a:
                yield _mix(np.array([(words[a:b] * _PLACE[:b - a]).sum() + np.uint64(b - a)]))
            else:
                yield runs[:0]
        at = stop


def _samples(items: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples: the smallest of every one of ``count`` permutations."""
    best = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 2048):
        part = items[i:i + 2048, None] * _SCALE[:count] + _SHIFT[:count]
        np.minimum(best, part.min(axis=0), out=best)
    return best


def _fold(hashes: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit h is set if an odd number of hashes fall on it."""
    odd = np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@dataclass(frozen=True)
class Bound:
    """Links hold if ``whole`` * intersection >= ``least`` * union; the bands that find them, of at
    most BANDS * ROWS samples, and the similarity given away for the sampled sketch's spread."""
    least: int = 85
    whole: int = 100
    bands: int = BANDS
    rows: int = ROWS
    margin: float = MARGIN

    @property
    def similarity(self) -> float:
        return self.least / self.whole

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def sampled_limit(self) -> int:
        """Largest XOR count of sampled sketches that is followed up."""
        differ = 2 * self.samples * (1 - self.similarity + self.margin)
        return math.ceil(BITS * (1 - math.exp(-2 * differ / BITS)) / 2)

    def difference_limit(self, total):
        """Largest symmetric difference of two sets whose sizes add up to ``total``."""
        return total * (self.whole - self.least) / (self.whole + self.least)


# A pair at exactly 0.8 shares none of 38 bands of 5 samples with a chance of (1 - 0.8^5)^38, below 3e-7;
# a lower similarity spreads the sampled sketch more.
FOUR_FIFTHS = Bound(80, 100, 38, 5, 0.21)


def signature_of(text: Column, bound: Bound = Bound()) -> Column:
    """Struct of set size, set id, band keys and both sketches of ``text``."""
    place = np.arange(bound.samples, dtype=np.uint64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            n, ids, bands, sampled, whole = [], [], [], [], []
            for items in shingle_sets(batch):
                n.append(len(items))
                if not len(items):
                    ids.append(None)
                    for part in (bands, sampled, whole):
                        part.append(np.zeros(0, np.int64))
                    continue
                ids.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                sample = _samples(items, bound.samples)
                tagged = _mix(sample + place * _ODD)
                keys = (tagged.reshape(bound.bands, bound.rows) * _PLACE[:bound.rows]).sum(axis=1)
                bands.append(_mix(keys + place[:bound.bands]).view(np.int64))
                sampled.append(_fold(tagged))
                whole.append(_fold(items))
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(ids, pa.binary()),
                 *(pa.array(v, pa.list_(pa.int64())) for v in (bands, sampled, whole))],
                ["n", "set_id", "bands", "sampled", "whole"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, SIGNATURE)(text)


def set_of(text: Column) -> Column:
    """The shingle set itself, as an array of hashes."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s.view(np.int64) for s in shingle_sets(batch)], pa.list_(pa.int64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<bigint>")(text)


def _xor_count(a: Column, b: Column) -> Column:
    parts = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)]
    return sum(parts[1:], parts[0])


def _close(a: str, b: str, bound: Bound) -> Column:
    """Both sketches and the sizes allow a link between the structs ``a`` and ``b``."""
    x, y = F.col(a), F.col(b)
    total = x["n"] + y["n"]
    return ((F.least(x["n"], y["n"]) * bound.whole >= F.greatest(x["n"], y["n"]) * bound.least)
            & (_xor_count(x["whole"], y["whole"]) <= bound.difference_limit(total))
            & (_xor_count(x["sampled"], y["sampled"]) <= bound.sampled_limit))


def _confirmed(pairs: DataFrame, sets: DataFrame, bound: Bound) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    first = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(common * bound.whole >= union * bound.least).select("a", "b")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges(a, b)``, for every node of an edge.

    Large-star and small-star in turn until the edges stand still: every node then
    points at its root. A node's neighbourhood is only ever reduced to its minimum.
    """
    now = scratch.save(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0", True)
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    step, before = 0, now.select(mark).first()
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = scratch.save(small.select("e.a", "e.b").where("a <> b").distinct(),
                             f"{name}-{step}", True)
        scratch.drop(f"{name}-{step - 1}")
        now, mark_now = after, after.select(mark).first()
        if mark_now == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark_now


def _cross_pairs(bound: Bound):
    """Rows of one block pair to the pairs of different components that both sketches let through."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for members in batch.column("members"):
                rows = members.values
                node, label, n = (rows.field(k).to_numpy() for k in ("node", "label", "n"))
                whole, sampled = (rows.field(k).flatten().to_numpy().view(np.uint64).reshape(
                    len(node), -1) for k in ("whole", "sampled"))
                order = np.argsort(n, kind="stable")
                for place, i in enumerate(order):
                    rest = order[place + 1:]
                    rest = rest[n[rest] * bound.least <= n[i] * bound.whole]
                    rest = rest[label[rest] != label[i]]
                    rest = rest[np.bitwise_count(whole[rest] ^ whole[i]).sum(axis=1)
                                <= bound.difference_limit(n[rest] + n[i])]
                    rest = rest[np.bitwise_count(sampled[rest] ^ sampled[i]).sum(axis=1)
                                <= bound.sampled_limit]
                    first.append(np.minimum(node[rest], node[i]))
                    second.append(np.maximum(node[rest], node[i]))
            columns = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], schema=kind)
    return run


def _signed(docs: DataFrame, doc_id: str, text: str, bound: Bound, scratch: Scratch) -> DataFrame:
    return scratch.save(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        signature_of(F.col(f"`{text}`").cast("string"), bound).alias("s")).select("doc_id", "s.*"), "signed")


def _groups(rows: DataFrame, signed: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id, kept from ``rows(doc_id, text)`` and their signatures."""
    classes = scratch.save(
        signed.where("doc_id is not null and n > 0").groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.min_by(
                F.struct("n", "bands", "sampled", "whole"), "doc_id").alias("s"))
        .select("set_id", "node", "s.*"), "classes")
    card = classes.select("node", F.struct("n", "sampled", "whole").alias("card"))

    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.save(keys.join(shared, "key"), "members", True)
    crowd = members.groupBy("node").agg(F.sum("size").alias("crowd"))
    pivots = members.join(crowd, "node").groupBy("key").agg(F.max(
        F.struct("crowd", (-F.col("node")).alias("minus"))).alias("top")).select(
            "key", (-F.col("top.minus")).alias("pivot"))
    stars = (members.join(pivots, "key").where("node <> pivot")
             .select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    close = (stars.join(card.withColumnsRenamed({"node": "a", "card": "x"}), "a")
             .join(card.withColumnsRenamed({"node": "b", "card": "y"}), "b")
             .where(_close("x", "y", bound)).select("a", "b"))
    wanted = members.select("node").distinct()
    # A merge join at every size: the ids grow with the rows, and a plan that broadcasts few of them
    # says nothing about one that has many.
    sets = scratch.save(
        rows.join(wanted.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("node"), set_of(F.col("text")).alias("items")), "sets")
    roots = components(_confirmed(close, sets, bound), scratch, "stars")

    labelled = (members.join(roots, "node", "left")
                .select("key", "size", "node", F.coalesce("root", "node").alias("label")))
    # Members of a bucket's largest component are only compared with those of others, so they are
    # repeated for every block of the others; these few are repeated for every block.
    mixed = (labelled.where("size > 2").groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("most"),
                                 F.sum("n").alias("all"))
             .where(F.col("all") > F.col("most"))
             .select("key", "major", F.ceil(F.col("most") / BLOCK).alias("majors"),
                     F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("minors")))
    major, hashed = F.col("label") == F.col("major"), F.xxhash64("node")
    last = F.col("majors") + F.col("minors") - 1
    dealt = (labelled.join(mixed, "key").join(card, "node")
             .withColumn("own", F.when(major, F.pmod(hashed, F.col("majors"))).otherwise(
                 F.col("majors") + F.pmod(hashed, F.col("minors"))))
             .withColumn("other", F.explode(F.sequence(F.when(major, F.col("majors")).otherwise(
                 F.lit(0).cast("bigint")), last)))
             .groupBy("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
             .agg(F.collect_list(F.struct("node", "label", "card.n", "card.sampled", "card.whole"))
                  .alias("members")))
    crossing = dealt.select("members").mapInArrow(
        _cross_pairs(bound), "a bigint, b bigint").distinct()
    every = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
        _confirmed(crossing, sets, bound))
    final = components(every, scratch, "all")
    by_set = classes.select("set_id", "node").join(final, "node", "left").select(
        "set_id", F.coalesce("root", "node").alias("component_id"))
    out = signed.select("doc_id", "n", "set_id").join(by_set, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                bound: Bound = Bound()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "near-groups")
    signed = _signed(docs, doc_id, text, bound, scratch)
    return _groups(_rows(docs, doc_id, text), signed, bound, scratch)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                bound: Bound = Bound()) -> DataFrame:
    """``docs`` with one row of every near-duplicate group, the one of the smallest id.

    Rows without an id stay; of rows that repeat an id one stays. Texts are only shuffled if
    the list of ids to drop is too long for Spark to broadcast.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    signed = _signed(docs, doc_id, text, bound, scratch)
    groups = _groups(_rows(docs, doc_id, text), signed, bound, scratch)
    extra = scratch.save(groups.where("not kept").select("doc_id").distinct(), "extra", True)
    again = scratch.save(signed.where("doc_id is not null").groupBy("doc_id").count()
                         .where("count > 1").select("doc_id")
                         .join(extra, "doc_id", "left_anti"), "again", True)
    kept = docs.join(extra.withColumnRenamed("doc_id", doc_id), doc_id, "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    again = again.withColumnRenamed("doc_id", doc_id)
    return kept.join(again, doc_id, "left_anti").select(docs.columns).unionByName(
        docs.join(again, doc_id, "left_semi").dropDuplicates([doc_id]).select(docs.columns))
