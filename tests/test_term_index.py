import random

from wirefold.operators import search, term_index

DOC = "id bigint, headline string, description string, company string, summary string"


def records(rng, ids):
    words = ["fund", "raise", "zepto", "ola", "plant", "émigré", "x", "2026"]

    def text():
        return rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 9)))])
    return [(i, text(), text(), text(), text()) for i in ids]


def state(spark, root, batches):
    postings, found = term_index.stored(spark, root, batches)
    return (sorted(map(tuple, postings.select("term", "id", "field", "length", "tf").collect())),
            sorted(map(tuple, found.select("term", "docs").collect())),
            tuple(term_index.totals(spark, root, batches).first()))


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng, held = random.Random(5), {}
    kept, rebuilt = str(tmp_path / "kept"), str(tmp_path / "rebuilt")
    for batch, ids in enumerate([range(40), range(20, 60), range(0, 60, 7), range(60)]):
        new = {r[0]: r for r in records(rng, ids)}
        if batch == 2:
            new = {}                                             # every seventh record goes
        before = spark.createDataFrame([held[i] for i in ids if i in held], DOC)
        term_index.apply_changes(before, spark.createDataFrame(list(new.values()), DOC), kept, batch)
        if batch == 1:                                           # run again after a failure
            term_index.apply_changes(before, spark.createDataFrame(list(new.values()), DOC), kept, batch)
        held = {i: r for i, r in held.items() if i not in ids} | new
    docs = spark.createDataFrame(list(held.values()), DOC)
    term_index.apply_changes(docs.limit(0), docs, rebuilt, 0)
    assert state(spark, kept, 4) == state(spark, rebuilt, 1)
    compacted = str(tmp_path / "compacted")
    term_index.compact(spark, kept, 4, compacted)
    assert state(spark, compacted, 1) == state(spark, kept, 4)
    want = {r.id: (round(r.score, 9), r.matched) for r in search.ranked(
        search.postings(docs, stemming=False), "zepto Emigre fund", stemming=False).collect()}
    got = {r.id: (round(r.score, 9), r.matched) for r in term_index.lookup(spark, kept, "zepto Emigre fund", 4).collect()}
    assert got == want and got
    assert term_index.lookup(spark, kept, " ?! ", 4).count() == 0
    assert term_index.lookup(spark, kept, "nowhere", 4).count() == 0


def test_a_lookup_reads_the_buckets_of_its_words(spark, tmp_path):
    root = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"word{i} shared", None, None, None) for i in range(200)], DOC)
    term_index.apply_changes(docs.limit(0), docs, root, 0)
    found = term_index.lookup(spark, root, "word7", 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "bucket" in plan.split("PartitionFilters: ")[1][:200]
    files = term_index.stored(spark, root, 1, ["word7"])[0].inputFiles()
    assert [r.id for r in found.collect()] == [7]
    assert {f.split("bucket=")[1].split("/")[0] for f in files}
    assert all("/batch=0/bucket=" in f for f in files)


def test_empty_and_odd_records(spark, tmp_path):
    root = str(tmp_path / "index")
    odd = spark.createDataFrame([(None, "lost", None, None, None), (1, "", None, " ", None),
                                 (2, "long " * 50_000, None, None, None)], DOC)
    term_index.apply_changes(odd.limit(0), odd, root, 0)
    term_index.apply_changes(odd.limit(0), odd.limit(0), root, 1)
    assert state(spark, root, 2) == ([("long", 2, "headline", 50_000, 50_000)], [("long", 1)], (1, 50_000))
    nothing = str(tmp_path / "nothing")
    term_index.apply_changes(odd.limit(0), odd.limit(0), nothing, 0)
    assert state(spark, nothing, 1) == ([], [], (0, 0)) and term_index.lookup(spark, nothing, "long", 1).count() == 0
