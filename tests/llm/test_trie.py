"""The prefix trie against brute force, at shards of a few turns and of all."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wirefold.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(lender, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        worth = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += worth
    return sorted((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node],
                   saved[node], hashlib.sha256(",".join(str(c) for c in sorted(who) if len(built[c]) == len(node)).encode()).hexdigest())
                  for node, who in members.items())


def run(spark, rows, shard=prefix_trie.SHARD):
    got = prefix_trie.digest(spark.createDataFrame(rows, SCHEMA), shard)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()))


def conversations(rnd, n, longest, words):
    out = []
    for c in rnd.sample(range(-n, 2 * n), n):
        out += [(c, t, rnd.choice(["user", "tool"]), "é" * rnd.randrange(1, words)) for t in range(rnd.randrange(1, longest))]
    return out


@pytest.mark.parametrize("shard", [3, 25, 1 << 18])
def test_trie_against_brute_force(spark, shard):
    rnd = random.Random(shard)
    rows = conversations(rnd, 60, 12, 3)
    assert run(spark, rows, shard) == brute(rows)


def test_copies_over_many_shards(spark):
    """One conversation many times, one that goes on after it, and long ones of one beginning."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 700, 2) for t in range(10)]
    rows += [(c, t, "user", f"t{t}") for c in (9000, 9001) for t in range(45 + c % 2)]
    rows += [(c, t, "user", f"t{t}" if t < 40 else f"own {c}") for c in (9002, 9003, 9004) for t in range(70)]
    want = brute(rows)
    assert run(spark, rows, 200) == want and run(spark, rows) == want


def test_trie_edges(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"),
            (7, None, "user", "z"), (5, 3, "user", "a"), (-3, 0, "a", "b"), (-1, 0, "ab", ""), (3, 9, "", "ab"), (8, 0, "", None)]
    want = brute(rows)
    assert run(spark, rows) == run(spark, rows, 1) == want and any(r[1] == 0 and r[2] is None for r in want)
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []
    one = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert run(spark, [(one, 0, "user", "gone")]) == brute([(one, 0, "user", "gone")])        # turnless
    long = [(0, 0, "user", "é" * 500_000), (1, 0, "user", "é" * 500_000)] + [(9, t, "user", str(t)) for t in range(5000)]
    assert run(spark, long) == sorted(brute_long(long))


def brute_long(rows):
    """As ``brute``; prefixes of one long conversation are too many to hold as tuples of turns."""
    short = brute([r for r in rows if r[0] != 9])
    h = zlib.crc32(b"9") % 9
    empty = hashlib.sha256(b"").hexdigest()
    n = 5000 - h                                   # conversation 5 is absent, so 9 lends nothing
    chain = [(9, d, 0 if d == 1 else 9, 1, int(d < n), 1, 0, empty if d < n else hashlib.sha256(b"9").hexdigest())
             for d in range(1, n + 1)]
    root = next(r for r in short if r[1] == 0)
    return [r for r in short if r[1]] + chain + [(0, 0, None, 3, root[4] + 1, root[5] + 1, root[6], root[7])]


def test_other_columns_do_not_matter(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", "s", 4)], SCHEMA + ", seq string, size int")
    assert prefix_trie.digest(rows).count() == len(brute([(1, 0, "user", "a")]))
