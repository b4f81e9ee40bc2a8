"""The supplied tables read as streams of landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators import labels
from wirefold.operators.stored import Layout, Store, day
from wirefold.plans.refresh import full_refresh
from wirefold.plans.status import spend_windows as windows
from wirefold.session import checkpoint_dir
from wirefold.streaming import refresh
from wirefold.workload.base import DOC_AS_OF, DOC_SQL, Tables, doc_articles, query
from wirefold.workload.stories import STORY_SQL

SECOND = 1_000_000_000_000           # what the oracle adds to the ids of the second batch


def _scratch(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _landed(t: Tables, name: str) -> DataFrame:
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return (t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(t.folder))


def _events(t: Tables) -> DataFrame:
    return _landed(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(t: Tables, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    root = _scratch(t, name)
    writer = (stream.writeStream.outputMode(mode).trigger(availableNow=True)
              .option("checkpointLocation", f"{root}/checkpoint"))
    writer.format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once_keys(t: Tables) -> DataFrame:
    """Each user and event type once, from a stream whose lateness spans the month."""
    once = refresh.once(_events(t), ["user_id", "event_type"], "ts", "60 days")
    return _collected(t, once.select("user_id", "event_type"), "once")


@query("""SELECT w AS start, round(sum(value), 6) AS cost_usd, count(*) AS calls FROM (
  SELECT value, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR,
    date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1""")
def stream_spend_windows(t: Tables) -> DataFrame:
    """Day-long spend windows of the ledger stream, rewritten by every batch."""
    root = _scratch(t, "windows")
    ledger = _events(t).withColumnRenamed("value", "cost_usd")
    out = windows(ledger).select(F.col("w.start").alias("start"),
                                 F.round("cost_usd", 6).alias("cost_usd"), "calls")
    query = (out.writeStream.outputMode("complete").trigger(availableNow=True)
             .option("checkpointLocation", f"{root}/checkpoint")
             .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out"))
             .start())
    query.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{root}/out")


# Documents in two batches: even ids first, those of four without description; then odd ids, and again those
# of four, which are known by then and lend what they have. An id tells the place in that order.
_BATCHES_SQL = STORY_SQL.replace(DOC_SQL, DOC_SQL.replace(
    "SELECT doc_id AS id", f"SELECT doc_id % 2 * {SECOND} + doc_id AS id"))


def _two_batches(t: Tables) -> str:
    """The store after both batches, each landed as files and read as a stream."""
    root = _scratch(t, "refresh")
    rows = doc_articles(t).select(
        F.concat(F.lit("https://d.example/"), F.col("id").cast("string")).alias("url"), "source",
        "headline", "description", "published_at", F.col("id").alias("pos"))
    four = F.col("pos") % 4 == 0
    first = rows.where("pos % 2 = 0").withColumn("description", F.when(~four, F.col("description")))
    for batch, made in enumerate((first, rows.where(four | F.expr("pos % 2 = 1")))):
        made.write.parquet(f"{root}/landed/{batch}")
        refresh.run_available(
            t.spark.readStream.schema(rows.schema).parquet(f"{root}/landed/*"),
            lambda df, i: refresh.ingest_batch(df, i, root, DOC_AS_OF), f"{root}/checkpoint")
    return root


@query(_BATCHES_SQL + f""", seen AS (
  SELECT id // {SECOND} AS batch, source, CASE WHEN canonical_id IS NULL THEN 'new' ELSE 'dup' END AS o FROM told
  UNION ALL SELECT 1, source, 'known' FROM documents WHERE doc_id % 4 = 0)
SELECT batch, source, count(*) AS items_seen, count(*) FILTER (o = 'new') AS items_new,
  count(*) FILTER (o = 'dup') AS items_duplicate FROM seen GROUP BY 1, 2""")
def stream_refresh(t: Tables) -> DataFrame:
    """All documents through two ingests: known links, dedupe, tables; the read log of both."""
    stats = "source string, items_seen bigint, items_new bigint, items_duplicate bigint"
    return refresh.read_before(t.spark, _two_batches(t), "reads", 2, stats, True)


@query(_BATCHES_SQL + f""", d AS (SELECT id AS doc_id, description FROM (WITH {DOC_SQL} SELECT * FROM docs))
SELECT d.doc_id, told.story_key, told.canonical_id % {SECOND} AS canonical_doc, told.published_at,
  d.doc_id % 4 = 0 AND trim(coalesce(description, '')) <> '' AS lent,
  md5(CASE WHEN d.doc_id % 4 <> 0 OR trim(description) <> '' THEN description END) AS described
FROM told JOIN d ON d.doc_id = told.id % {SECOND}""")
def stream_stories(t: Tables) -> DataFrame:
    """The stored stories after both ingests: what each repeats and the description it has or was lent."""
    rows = refresh.stored_articles(t.spark, _two_batches(t), 2)
    first = rows.select(F.col("id").alias("canonical_id"), F.col("pos").alias("canonical_doc"))
    empty = F.coalesce(F.trim("description"), F.lit("")) == ""
    return rows.join(first, "canonical_id", "left").select(
        F.col("pos").alias("doc_id"), "story_key", "canonical_doc", "published_at",
        ((F.col("pos") % 4 == 0) & ~empty).alias("lent"), F.md5("description").alias("described"))


_STORED = ("id string, url string, source string, headline string, description string, description_origin string, "
           "published_at timestamp, ingested_at timestamp, company string, category string, summary string, "
           "enriched_at timestamp, canonical_id string, story_key string, content_hash string, feed_url string, "
           "pos bigint")


@query(_BATCHES_SQL + f""", d AS (SELECT id AS doc_id, source AS src, description FROM (WITH {DOC_SQL} SELECT * FROM docs))
SELECT d.doc_id, told.story_key, told.canonical_id % {SECOND} AS canonical_doc,
  md5(CASE WHEN d.doc_id % 4 <> 0 OR description <> '' THEN description END) AS described,
  CASE WHEN a.doc_id IS NOT NULL THEN 'Src ' || src END AS company,
  CASE WHEN a.quality = 1 THEN 'Product Launch' WHEN a.quality = 0 THEN 'Other' END AS category
FROM told JOIN d ON d.doc_id = told.id % {SECOND}
LEFT JOIN labels a ON a.doc_id = d.doc_id AND a.doc_id % 2 = 0 AND told.canonical_id IS NULL""")
def refreshed_stories(t: Tables) -> DataFrame:
    """Two refreshes of one store, of which each rewrites the days it changes: stories of even ids, then
    the rest with lent descriptions, and the label table as answers about the canonical ones of the first."""
    store = Store(t.spark, _scratch(t, "store"), {"articles": Layout(("id",), day("published_at"))})
    store.create("articles", t.spark.createDataFrame([], _STORED))
    rows = doc_articles(t).select(
        F.lit("").alias("feed_url"), F.concat(F.lit("https://d.example/"), F.col("id").cast("string")).alias("url"),
        "source", "headline", "description", "published_at", F.col("id").alias("pos"))
    four = F.col("pos") % 4 == 0
    first = rows.where("pos % 2 = 0").withColumn("description", F.when(~four, F.col("description")))

    def run(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        state, outcome = full_refresh(t.spark, {}, inputs, DOC_AS_OF, store=store, parts=("ingest", "label"))
        failed = outcome.where("error is not null").collect()            # a row for each part
        if failed:
            raise RuntimeError(f"{failed[0].part}: {failed[0].error}")
        return state
    state = run({"feed_items": first})
    packed = labels.pack(labels.pending_articles(state["articles"]), labels.ENRICH_BATCH,
                         labels.story_line(labels.ENRICH_CHARS), F.col("pos").asc())
    answer = F.to_json(F.struct(
        F.col("number").alias("i"), F.concat(F.lit(" Src "), "source", F.lit(". ")).alias("company"),
        F.when(F.col("quality") == 1, "product launch").otherwise("nonsense").alias("category")))
    answers = (packed.join(t.labels, F.col("pos") == F.col("doc_id")).groupBy("batch")
               .agg(F.to_json(F.transform(F.collect_list(answer), lambda a: F.from_json(a, "map<string,string>")))
                    .alias("body")))
    state = run({"feed_items": rows.where(four | F.expr("pos % 2 = 1")), "enrich_packed": packed,
                 "enrich_answers": answers})
    told = state["articles"]
    canonical = told.select(F.col("id").alias("canonical_id"), F.col("pos").alias("canonical_doc"))
    return told.join(canonical, "canonical_id", "left").select(
        F.col("pos").alias("doc_id"), "story_key", "canonical_doc", F.md5("description").alias("described"),
        "company", "category")
