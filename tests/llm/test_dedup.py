"""Near-duplicate groups against brute force over full sets."""

import random
import re

import pyarrow as pa
import pytest

import corpus_pipeline
from wirefold.llm import odd_sketch
from wirefold.llm.odd_sketch import near_groups, one_of_each, shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows, least=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in near_groups(docs).collect()}
    assert got == brute(rows)
    return got


def corpus(rnd, groups, size, words=80):
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10 ** 6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rnd.shuffle(rows)
    return rows


def test_groups_of_near_copies(spark):
    got = check(spark, corpus(random.Random(1), 12, 15))
    assert len({v[1] for v in got.values()}) < len(got)


def test_one_large_group_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(odd_sketch, "BLOCK", 16)           # many blocks per bucket
    check(spark, corpus(random.Random(2), 1, 150, 60))


def test_shared_passages_do_not_link(spark):
    rnd = random.Random(3)
    line = " ".join(f"common{i}" for i in range(40))
    rows = [(i, line + " " + " ".join(f"u{rnd.randrange(10 ** 6)}" for _ in range(30))) for i in range(80)]
    assert all(v[2] for v in check(spark, rows).values())


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "a b c d e"),
            (8, "A b\nc d e"), (9, long), (10, long + " more"), (11, "é È"), (12, "É È"), (13, "a\u00a0b"),
            (14, "a b")]
    got = check(spark, rows)
    assert got[5][1] == 4 and got[8][1] == 7 and got[10][1] == 9 and got[3] == (0, 3, True)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "p"), (1, text, "q"), (None, text, "r"), (2, text, "s")],
                                 "doc_id bigint, text string, component_id string")
    got = near_groups(docs).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [
        (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
    assert near_groups(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [10, 200, 1 << 20])
def test_sets_do_not_depend_on_chunks(monkeypatch, chunk):
    texts = ["a b c d e f", None, "", "x", "Hello there general kenobi you are bold", "a b c d e f g"]
    whole = [s.tolist() for s in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(odd_sketch, "CHUNK_BYTES", chunk)
    assert [s.tolist() for s in shingle_sets(pa.array(texts))] == whole
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    assert [s.tolist() for s in shingle_sets(pa.array(["zz", *texts]).slice(1))] == whole


def test_stage_of_the_pipeline_links_from_four_fifths_on(spark):
    rows = []
    for n in range(60):                                # 5 to 9 of 76 shingles differ: 0.79 to 0.88
        base = [f"w{n}x{k}" for k in range(80)]
        copy = base[:-(n // 12 + 5)] + [f"y{n}x{k}" for k in range(n // 12 + 5)]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    want = {i for i, v in brute(rows, 80).items() if v[2]}
    assert kept == want
    assert len(want) < len([v for v in brute(rows).values() if v[2]]) < len(rows)
