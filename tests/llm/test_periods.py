"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wirefold.llm import periods


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)          # the smallest period comes first
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def text_of(rnd):
    """Random words with repeated phrases, also phrases that hold runs themselves."""
    few = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 30, 400]))]
    out = []
    for _ in range(rnd.randrange(1, 8)):
        phrase = [rnd.choice(few) for _ in range(rnd.choice([1, 1, 2, 3, 5, 9, 16, 31, 32, 33, 70]))]
        if rnd.random() < 0.4:
            phrase = phrase * rnd.randrange(3, 7) + [rnd.choice(few)]
        out += (phrase * rnd.randrange(1, 9))[:rnd.randrange(1, 900)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rnd = random.Random(seed)
    texts = [text_of(rnd) for _ in range(120)]
    got = periods.search(pa.array([" ".join(t) for t in texts])).to_pylist()
    for words, row in zip(texts, got):
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == brute_runs(words)


def test_fibonacci_and_long_runs():
    a, b = "a", "b"
    while len(b) < 3000:
        a, b = b, b + a
    texts = [" ".join(b), " ".join("ab" * 900 + "a" * 700 + "ab" * 300), " ".join((["x"] * 50 + ["y"]) * 30)]
    for t, row in zip(texts, periods.search(pa.array(texts)).to_pylist()):
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == brute_runs(t.split())


def test_occurrences_are_exact():
    rnd = np.random.default_rng(3)
    for width in (1, 2, 8, 64, 512):
        for top in (2, 1 << 20, 1 << 27):
            w = rnd.integers(0, top, (4, 2 * width))
            a = w[:, width // 2:width // 2 + width].copy()
            a[3] = rnd.integers(0, top, width)
            want = np.array([[(a[i] == w[i, t:t + width]).all() for t in range(width)] for i in range(4)])
            assert (periods.occurrences(a, w) == want).all()


def test_digest(spark):
    rnd = random.Random(4)
    docs = [(i, rnd.choice([" ", "\n ", "\t"]).join(text_of(rnd)[:rnd.choice([3, 40, 500])])) for i in range(150)]
    docs += [(i, " ".join(f"v{k}" for k in range(i % 37))) for i in range(150, 260)]
    docs += [(None, "a a a a a a b"), (None, None), (300, None), (300, ""), (301, " \t\r\n"), (7, "x"), (7, "x"),
             (302, "\xa0 \x1c a\xa0b " * 8), (303, "é é é é é é é"), (-4, "k l " * 5)]
    got = periods.digest(spark.createDataFrame([(*d, "runs") for d in docs], "doc_id bigint, text string, _periods string"))
    want = [brute(*d) for d in docs]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(zlib.crc32(str(d[0]).encode()) % 10 == 0 and w[1] > 0 for d, w in zip(docs, want)) > 5
    assert periods.digest(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c", 5, "k")], "doc_id bigint, text string, _periods int, best string")
    out = periods.with_runs(docs)
    assert out.columns == [*docs.columns, "runs", "collapsed"]
    row = out.collect()[0]
    assert row["collapsed"] == "a b c" and [tuple(r) for r in row["runs"]] == [(0, 8, 2)] and row["best"] == "k"


def test_very_long_texts_take_linear_time():
    n = 400_000
    rnd = random.Random(9)
    phrase = [f"w{rnd.randrange(5000)}" for _ in range(n // 5)]
    start = time.time()
    rows = periods.search(pa.array([" ".join(["a"] * n), " ".join(phrase * 5), " ".join(f"u{i}" for i in range(n))])).to_pylist()
    assert [[tuple(r.values()) for r in x["runs"]] for x in rows] == [[(0, n, 1)], [(0, n, n // 5)], []]
    assert time.time() - start < 60
