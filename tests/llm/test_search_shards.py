"""Exact top-k and sharding against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirefold.llm import sharding, topk
from wirefold.llm.sharding import Leaf, digest, place, tree, with_slots


def brute(vectors, queries, k):
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and usable(v)]
    out = []
    for q in sorted(set(queries)):
        mine = min((v for i, v in whole if i == q), default=None)
        if mine is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in whole if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("kind", ["even", "ties", "sparse"])
def test_search(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "ROWS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "FIRST_DEPTH", 4)
    rnd = np.random.default_rng(5)
    data = rnd.normal(size=(300, 6)) * 0.2
    if kind == "ties":
        data[50:250] = data[50]
    if kind == "sparse":
        data[rnd.random(data.shape) < 0.7] = 0
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = topk.search(df, df.where("vec_id % 20 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute(vectors, range(0, 300, 20), 5)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.5]),
               (6, []), (7, [-1.0, -1.0]), (7, [-1.0, -1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, None)]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id bigint, embedding array<float>, score string")
    got = topk.search(df, df.where("vec_id % 100 = 0"), 10)
    assert sorted(map(tuple, got.collect())) == brute(vectors, [0, 100], 10)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_large_numbers_stay_exact(spark):
    big = [(i, [2.0 ** 18 + i, -(2.0 ** 18) + 3 * i]) for i in range(100)]
    df = spark.createDataFrame(big, "vec_id bigint, embedding array<double>")
    got = topk.search(df, df.where("vec_id = 0"), 3)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in big]
    want = sorted((-sum(a * b for a, b in zip(whole[0][1], v)), i) for i, v in whole if i)[:3]
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(i, -s) for s, i in want]


def docs_of(spark, n, text="t"):
    return spark.createDataFrame([(i, text * (i % 7)) for i in range(n)], "doc_id bigint, text string")


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = digest(docs_of(spark, 4000)).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert moved and all(r["grown_shard"] == 40 for r in moved)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 2 * min(sizes.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_growth_at_every_count(spark):
    docs = docs_of(spark, 600)
    for n in (1, 4, 9, 10, 41):
        got = place(docs, tree(n), grown=("more", tree(n + 1))).collect()
        assert all(r["more"] in (r["shard"], n) for r in got)


def test_weights_move_rows_only_with_the_subtree_that_changes(spark):
    docs = docs_of(spark, 3000)
    before = {r["doc_id"]: r["shard"] for r in place(docs, tree(20)).collect()}
    heavy = {r["doc_id"]: r["shard"] for r in place(docs, tree(20, {3: 3.0})).collect()}
    light = {r["doc_id"]: r["shard"] for r in place(docs, tree(20, {3: 0.0})).collect()}
    assert all(heavy[i] in (s, 3) for i, s in before.items())
    assert all(light[i] == s for i, s in before.items() if s != 3) and 3 not in set(light.values())
    share = Counter(heavy.values())[3] / Counter(before.values())[3]
    assert 2.0 < share < 3.6
    uneven = [Leaf(0, 0, 0, 1.0), Leaf(0, 1, 1, 1.0), Leaf(1, 0, 2, 6.0)]
    got = Counter(r["shard"] for r in place(docs, uneven).collect())
    assert 0.68 < got[2] / 3000 < 0.82


def test_shard_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "é", "b"), (None, "x", "c"), (1, "é", "b")],
                                 "doc_id bigint, text string, _draws string")
    placed = place(docs, tree(40))
    assert placed.columns == [*docs.columns, "shard"]
    assert with_slots(placed).columns == [*docs.columns, "shard", "slot"]
    got = sorted(digest(docs).collect(), key=str)
    assert sorted((r["size"], r["text_crc32"] == 0) for r in got) == [(16, True), (17, False), (18, False), (18, False)]
    one = [r for r in got if r["doc_id"] == 1]
    assert len({r["shard"] for r in one}) == 1 and sorted(r["slot"] for r in one)[-1] >= 2
    assert digest(docs.limit(0)).count() == 0


def test_chunks_do_not_matter_for_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNKS", 3)
    rows = digest(docs_of(spark, 500)).collect()
    random.shuffle(rows)
    for shard in range(40):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_hot_keys_and_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 64)
    rows = [(None, f"text {i}") for i in range(900)] + [(None, None)] * 700 + [(5, "same")] * 300 + [(i, "x") for i in range(400)]
    got = digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got)[None, 16] == 700
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    # The null id's rows lie in many parts of its chunk: no window holds more than a few of them.
    docs = spark.createDataFrame([(None, i) for i in range(5000)], "doc_id bigint, size bigint").withColumn("shard", F.lit(0))
    part = sharding._hash(F.col("size").cast("string")) % sharding.CHUNKS
    assert docs.groupBy(part).count().agg({"count": "max"}).first()[0] < 25
    assert sorted(r["slot"] for r in with_slots(docs, ties=("size",)).collect()) == list(range(5000))
