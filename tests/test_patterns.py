import random
import re

from pyspark.sql import functions as F

from wirefold.functions.patterns import needed_runs
from wirefold.plans import firms

KIND = "key string, label string, aliases array<string>"


def needs(spark, patterns):
    rows = spark.createDataFrame([(p,) for p in patterns], "p string").select(
        "p", needed_runs(F.col("p")).alias("s")).collect()
    return {r.p: sorted(sorted(s) for s in r.s) for r in rows}


def test_runs_that_a_pattern_needs(spark):
    want = {
        r"\bnation 7\b": [["7"], ["nation"]], "^shared fund 3": [["3"], ["fund"], ["shared"]],
        "(acme|zen) capital": [["acme", "zen"], ["capital"]], "Acme": [["acme"]],
        "ab?c": [["a"], ["c"]], "abc+d": [["abc"], ["d"]], "(abc)?de": [["de"]], "(abc){0,2}de": [["de"]],
        "(?:big )?fund": [["fund"]], "(ac)me": [["acme"]], "one|two three": [["one", "three"]],
        "(a|)b": [["b"]], "[abc]de": [["de"]], "x.y": [["x"], ["y"]], "((a|b)c|d) cap": [["c", "d"], ["cap"]],
        # Nothing known.
        "one|[0-9]": [], "": [], r"\d+": [], "(?i)acme": [], "(?!no)acme": [], r"\Qa.b\E": [], "[a[bc]de]": [],
    }
    assert needs(spark, want) == want


def test_null_pattern_needs_nothing(spark):
    got = spark.createDataFrame([(None,)], "p string").select(needed_runs(F.col("p")).alias("s")).first()
    assert got.s == []


def made(rng, depth=0):
    """A random pattern of literals, classes, groups, alternatives and quantifiers."""
    parts = []
    for _ in range(rng.randint(1, 4)):
        k = rng.random()
        if k < 0.25 and depth < 3:
            inner = "|".join(made(rng, depth + 1) for _ in range(rng.randint(1, 3)))
            part = rng.choice(["(", "(?:"]) + inner + ")"
        elif k < 0.35:
            part = rng.choice(["[ab]", "[^c ]", ".", r"\w", r"\d"])
        else:
            part = "".join(rng.choice("abCd1 ") for _ in range(rng.randint(1, 3)))
        parts.append(part + (rng.choice(["?", "*", "+", "{0,1}", "{2}", "+?"]) if rng.random() < 0.25 else ""))
    return rng.choice(["", "", "^", r"\b"]) + "".join(parts)


def test_no_matching_text_lacks_a_needed_run(spark):
    rng = random.Random(5)
    patterns = sorted({made(rng) for _ in range(1500)})
    texts = ["".join(rng.choice("abcABCd1 ") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    hits = held = 0
    for pattern, sets in needs(spark, patterns).items():
        test = re.compile(pattern, re.I | re.A)
        for text in texts:
            if test.search(text):
                hits += 1
                held += bool(sets)
                for runs in sets:
                    assert any(r in text.lower() for r in runs), (pattern, text, runs)
    assert hits > 1000 and held > 500


def test_firms_by_pattern_equal_trying_all(spark):
    rng = random.Random(6)
    own = {f"f{i}": [made(rng) for _ in range(rng.randint(0, 3))] + ([None] if i % 9 == 0 else [])
           for i in range(40)}
    own["plain"], own["any"] = [r"\bab\b", "^cd (ab|dd)"], [r"^\d", ""]
    texts = ["".join(rng.choice("abcABCd1 ") for _ in range(rng.randint(1, 14))) for _ in range(120)] + ["", None]
    rounds = spark.createDataFrame(list(enumerate(texts + texts[:20])), "id int, investors string")
    table = spark.createDataFrame([(k, k.upper(), a) for k, a in own.items()], KIND)
    got = firms.named_firms(rounds, table)
    want = {(i, k) for i, t in enumerate(texts + texts[:20]) if t for k, aliases in own.items()
            if any(a is not None and re.search(a, t, re.I | re.A) for a in aliases)}
    rows = [(r.id, r.firm) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert firms.named_firms(rounds, table.limit(0)).count() == 0
    assert firms.named_firms(rounds.limit(0), table).count() == 0


def test_twenty_thousand_patterns_meet_texts_by_equality(spark):
    n = 20_000
    table = spark.range(n).select(
        F.concat(F.lit("f"), "id").alias("key"), F.lit("L").alias("label"), F.array(
            F.concat(F.lit("^(fund|pool) "), F.lpad(F.hex("id"), 4, "0"), F.lit(r"(st)?\b"))).alias("aliases"))
    rounds = spark.range(n).select("id", F.concat(F.lit("Pool "), F.lpad(F.hex("id"), 4, "0"), F.lit(
        "; others")).alias("investors"))
    got = firms.named_firms(rounds, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.where(F.concat(F.lit("f"), "id") == F.col("firm")).count() == n == got.count()
