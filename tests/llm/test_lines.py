"""Line dedup against brute force, and its plan without Python."""

import hashlib
import random
from collections import defaultdict

from wirefold.llm import line_dedup

BLANKS = " \t\n\x0b\f\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, documents=5, code_points=40):
    def key(line):
        return line.strip(BLANKS).translate(UPPER)
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= code_points:
                holders[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < documents or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    return sorted(map(tuple, line_dedup.digest(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()), key=str)


def test_lines_against_brute_force(spark):
    rnd = random.Random(11)
    pool = [f"{'line ÄÉ' if n % 3 else 'Line ab'} number {n} " + "x" * rnd.choice([10, 24, 25, 26, 60]) for n in range(60)]
    docs = []
    for i in range(150):
        lines = [rnd.choice(pool) for _ in range(rnd.randrange(8))] + [f"own {i} " + "y" * 50] * (i % 2)
        lines = [rnd.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rnd.random() < .3 else x) + rnd.choice(["", "\r", "\f "]) for x in lines]
        docs.append((i, "\n".join(lines) + "\n" * (i % 3)))
    got = run(spark, docs)
    assert got == brute(docs) and sum(r[2] for r in got) > 50


def test_line_edges(spark):
    line = "a line that is long enough to be counted, in all"
    docs = [(None, line), (None, None), (1, None), (2, ""), (2, ""), (3, "\n\n"), (4, line + "\n" + line), (5, line), (5, line),
            (5, "another\n" + line), (6, "  " + line.upper() + "\r"), (7, line), (8, " " + line), (8, line + "\n")]
    got = run(spark, docs)
    assert got == brute(docs)
    assert [r[2] for r in got if r[0] == 8] == [0, 0] and [r[2] for r in got if r[0] == 4] == [2]
    assert run(spark, []) == []
    few = [d for d in docs if d[0] in (4, 5, 6, 7)]
    assert all(r[2] == 0 for r in run(spark, few))                # four documents, however often each repeats it


def test_a_very_long_text(spark):
    shared = "\n".join(f"shared line {n} with enough letters in it, so it counts" for n in range(30_000))
    docs = [(i, shared) for i in range(6)] + [(9, "short\n" * 100_000)]
    assert run(spark, docs) == brute(docs)


def test_other_columns_stay(spark):
    line = "a line that is long enough to be counted, in all"
    docs = spark.createDataFrame([(i, f"x\n{line}", i, "k") for i in range(6)],
                                 "doc_id bigint, text string, _row_a int, drop string")
    out = line_dedup.without_common_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        *[(i, "x", i, "k", 2, 1) for i in range(5)], (5, f"x\n{line}", 5, "k", 2, 0)]


def test_no_python_in_the_plan(spark):
    plan = line_dedup.digest(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
