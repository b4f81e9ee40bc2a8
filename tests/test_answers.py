import json
from collections import Counter

from pyspark.sql import functions as F

from wirefold.operators import labels

PACKED = "id string, batch bigint, number int"
ANSWER = "batch bigint, body string"


def packed(spark):
    return spark.createDataFrame([(f"r{b}-{n}", b, n) for b in range(6) for n in (1, 2, 3)], PACKED)


def bodies(spark):
    one = [{"i": 1, "company": "old"}, {"i": "1", "company": "new"}, "word", None, {"company": "x"},
           {"i": "two"}, {"i": 9}, {"i": 2, "company": "b"}, [1], 5]
    cut = '```json\n[{"i": 3, "company": "fenced"}]\n```'
    return spark.createDataFrame([
        (0, json.dumps(one)), (1, "no json at all"), (2, "[]"), (3, None), (4, cut),
        (5, json.dumps([{"i": 1, "company": "a"}])), (5, json.dumps([{"i": 1, "company": "b"}])),
        (5, json.dumps([{"i": 1, "company": "b"}])), (77, json.dumps([{"i": 1}])), (None, json.dumps([{"i": 1}]))], ANSWER)


def test_every_entry_is_applied_or_refused_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    judged = labels.judge_answers(packed(spark), bodies(spark))
    counts = labels.store_answers(judged, path)
    assert counts == {"read": 19, "applied": 4, "unreadable": 2, "empty": 1, "not an object": 4, "unnumbered": 2,
                      "out of range": 3, "repeated": 3}
    assert counts["read"] == sum(v for k, v in counts.items() if k != "read")
    good = labels.stored_answers(judged, path).collect()
    assert {(r.id, r.entry["company"]) for r in good} == {("r0-1", "new"), ("r0-2", "b"), ("r4-3", "fenced"), ("r5-1", "b")}
    bad = labels.stored_answers(judged, path, refused=True).collect()
    assert Counter(r.refused for r in bad) == {k: v for k, v in counts.items() if k in labels.REFUSALS}
    assert all(r.batch is None or r.refused != "out of range" or (r.batch, r.number) in {(0, 9), (77, 1)} for r in bad)
    assert {r.item for r in bad if r.refused == "not an object"} == {"word", None, "[1]", "5"}
    # Only the folder asked for is read.
    plan = labels.stored_answers(judged, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(refused" in plan


def test_applied_entries_are_those_the_labels_use(spark):
    one_each = bodies(spark).where("batch < 5")
    judged = labels.judge_answers(packed(spark), one_each).where("refused is null")
    used = labels._answered(packed(spark), one_each)
    want = sorted((r.id, r.c) for r in used.select("id", F.col("entry")["company"].alias("c")).collect())
    assert sorted((r.id, r.c) for r in judged.select("id", F.col("entry")["company"].alias("c")).collect()) == want


def test_no_answers_and_no_records(spark, tmp_path):
    none = labels.judge_answers(packed(spark), bodies(spark).limit(0))
    counts = labels.store_answers(none, str(tmp_path / "none"))
    assert counts["read"] == 0 == labels.stored_answers(none, str(tmp_path / "none")).count()
    lost = labels.judge_answers(packed(spark).limit(0), bodies(spark))
    counts = labels.store_answers(lost, str(tmp_path / "lost"))
    assert counts["applied"] == 0 and counts["read"] == 19


def test_answers_about_added_rounds_are_read_once(spark):
    """telling which raises are new asks for them several times, but no answer is parsed again."""
    none = F.lit(None).cast("string")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 10 * 86400 * 10)
    rounds = spark.range(40).select(
        "id", none.alias("company"), none.alias("stage"), none.alias("round_label"), none.alias("amount"),
        none.alias("investors"), day.alias("published_at"), F.lit(None).cast("timestamp").alias("extracted_at"),
        F.lit(False).alias("kept"))
    packed = rounds.withColumn("batch", F.floor(F.col("id") / 10)).withColumn(
        "number", (F.col("id") % 10 + 1).cast("int"))
    said = [(b, json.dumps([{"i": n, "company": f"Co {b % 2}", "round": "seed", "raise": n != 3} for n in range(1, 10)]))
            for b in range(4)]
    reads = spark.sparkContext.accumulator(0)

    def read(body):
        reads.add(1)
        return body
    answers = spark.createDataFrame(said, ANSWER).select(
        "batch", F.udf(read, "string").asNondeterministic()("body").alias("body"))
    known = spark.createDataFrame([("co 1", "Seed", "2023-11-15")], "company string, stage string, published_at string").select(
        "company", "stage", F.col("published_at").cast("timestamp").alias("published_at"))
    got = labels.apply_added_rounds(rounds, packed, answers, known, "2026-01-01").collect()
    assert reads.value == len(said)
    assert {r.id for r in got if r.kept} == {0, 3, 5, 7, 13, 15, 17}
    assert {r.id: r.company for r in got} == {i: f"Co {i // 10 % 2}" if i % 10 < 9 else None for i in range(40)}
