"""The pipeline's stages, its registered queries, and their SQL twins."""

import os

import pytest

import corpus_pipeline
from tests.compare import check
from wirefold.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")


def test_all_operators_are_registered():
    import __spark_entry__
    known = __spark_entry__.queries()
    assert "pipeline" in known and len([k for k in known if k.startswith("op")]) == 13
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


@supplied
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    diff, rows = check(spark, name, QUERIES[name], SQL[name], FOLDER)
    assert diff is None and rows > 0


@supplied
def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left, ids = docs, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, left, FOLDER)
        now = {r[0] for r in out.select("doc_id").collect()}
        assert now <= ids, name
        if name != "encoding":
            assert out.columns == docs.columns, name
            left = spark.createDataFrame(out.collect(), docs.schema)
        if name in ("personal_data", "encoding"):
            assert now == ids
        ids = now
    assert len(ids) > 50
    ran = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert ran == {r["doc_id"]: r["n_tokens"] for r in out.collect()}


def test_stages_on_odd_rows(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "x", "en", "s", 1),
                                  (3, passage, "en", "s", 5), (4, "mail a@b.cc now", "en", "s", 15),
                                  (5, "mail a@b.cc now", "en", "s", 15), (5, "mail a@b.cc now", "en", "s", 15)], kind)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "4", "None"]
    masked = corpus_pipeline.personal_data(spark, docs, str(tmp_path)).where("doc_id = 4").first()
    assert (masked["text"], masked["n_chars"]) == ("mail [EMAIL] now", 16)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
