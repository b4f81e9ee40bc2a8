"""Incremental refresh over landed files with Structured Streaming.

Every micro-batch writes to its own ``batch=<id>`` folders and reads only folders before it, so
a batch that is run again after a failure overwrites its own output and nothing else.
State that must outlive late data lives in those tables, not in operator memory. They are laid
out by what a batch asks of them, and a batch reads the partitions it asks for only:

* ``articles`` by the day a story was published (none: null), for headlines alike in time;
* ``stories``, the narrow rows of canonical stories, by the first digits of the story key, for the same
  headline at any distance in time;
* ``links`` and ``fills`` by the first digits of the url's hash, for links read before and what is lent them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions.text import content_hash, story_key, url_hash
from wirefold.functions.times import instant
from wirefold.operators.dedupe import STORY_HOURS, first_per_key, story_dedupe
from wirefold.operators.greedy import cut
from wirefold.operators.incremental import read_stats

ARTICLE = ("id string, url string, source string, headline string, description string, "
           "published_at timestamp, pos bigint, ingested_at timestamp, story_key string, "
           "content_hash string, canonical_id string, day string")
STORY = ("id string, headline string, published_at timestamp, pos bigint, ingested_at timestamp, "
         "story_key string, day string, prefix string")
LINK = "url string, described boolean, prefix string"
FILL = "url string, description string, prefix string"
DIGITS = 2           # hex digits of a hash that name a partition; one store keeps one number
SPLIT = 8            # files at most that a batch writes for one day, however hot


def once(stream: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """Each key once; state is dropped when it is older than the lateness allowed."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None],
                  checkpoint: str) -> None:
    """Hand everything that has landed to ``each``, then stop."""
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def write_batch(df: DataFrame, root: str, table: str, batch: int, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{table}/batch={batch}")


def write_prefixed(df: DataFrame, root: str, table: str, batch: int) -> None:
    """``df(..., prefix)`` with one file for every prefix: hashes spread evenly, so none is hot."""
    write_batch(df.repartition("prefix"), root, table, batch, "prefix")


def prefix(digest: Column) -> Column:
    return F.substring(digest, 1, DIGITS)


def published_day(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _asked(df: DataFrame, value: Column) -> list[str]:
    """The partitions that rows ask for: at most ``16 ** DIGITS`` prefixes, or the days of the calendar."""
    return [r.v for r in df.select(value.alias("v")).where("v is not null").distinct().collect()]


def _empty(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def read_before(spark: SparkSession, root: str, table: str, batch: int, schema: str,
                numbered: bool = False) -> DataFrame:
    """What batches before ``batch`` wrote; the folder of any later one is pruned. ``numbered``
    keeps the batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], f"{schema}, batch bigint" if numbered else schema)
    stored = spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{table}")
    earlier = stored.where(F.col("batch") < batch)
    return earlier if numbered else earlier.drop("batch")


def links_read(items: DataFrame, root: str, batch: int) -> DataFrame:
    """Stored links(url, described) under the prefixes of the ``items`` alone."""
    asked = _asked(items, prefix(url_hash("url")))
    return read_before(items.sparkSession, root, "links", batch, LINK).where(F.col("prefix").isin(asked))


def stories_near(items: DataFrame, root: str, batch: int, as_of, hours: int = STORY_HOURS) -> DataFrame:
    """Stored canonical rows that one of ``items`` may repeat: those published within ``hours`` of
    one, whole days, and those of the same story key on any other day.

    Undated items stand at ``as_of``; undated stored rows are met by their story key alone.
    """
    spark = items.sparkSession
    reach = -(-hours // 24)
    days = range(-reach, reach + 1)
    at = F.coalesce(F.col("published_at"), instant(as_of))
    asked = _asked(items, F.explode(F.array(*[F.date_format(F.date_add(F.to_date(at), d), "yyyy-MM-dd")
                                              for d in days])))
    columns = [c.split(" ")[0] for c in STORY.split(", ")][:-2]
    near = (read_before(spark, root, "articles", batch, ARTICLE)
            .where(F.col("day").isin(asked) & F.col("canonical_id").isNull()).select(*columns))
    keys = items.select(story_key("headline").alias("story_key")).distinct()
    same = (read_before(spark, root, "stories", batch, STORY)
            .where(F.col("prefix").isin(_asked(keys, prefix(F.col("story_key"))))
                   & (F.col("day").isNull() | ~F.col("day").isin(asked)))
            .join(keys, "story_key", "left_semi").select(*columns))
    return near.unionByName(same)


def ingest_batch(items: DataFrame, batch: int, root: str, as_of) -> None:
    """New items(url, source, headline, description, published_at, pos) of one micro-batch.

    Links read before are known: they only lend a description to a stored story that has none.
    The rest is deduplicated against the stored canonical stories, late rows against the
    days around their own date, and written with one read-log row per source.
    """
    items = cut(items, "landed")
    read = cut(links_read(items, root, batch), "links")
    known = items.join(read.select("url"), "url", "left_semi")
    fresh = first_per_key(items.join(read.select("url"), "url", "left_anti"), ["url"], ["pos"])
    fresh = cut(fresh.select(url_hash("url").alias("id"), "*", instant(as_of).alias("ingested_at")), "fresh")
    told = cut(story_dedupe(fresh, as_of, ["ingested_at", "pos"],
                            stored=stories_near(fresh, root, batch, as_of)), "told")
    rows = told.withColumn("content_hash", content_hash("headline", "description")).withColumn(
        "day", published_day("published_at"))
    columns = [c.split(" ")[0] for c in ARTICLE.split(", ")]
    write_batch(rows.select(*columns).repartition("day", F.pmod(F.xxhash64("id"), F.lit(SPLIT))),
                root, "articles", batch, "day")
    narrow = [c.split(" ")[0] for c in STORY.split(", ")]
    write_prefixed(rows.where("canonical_id is null").withColumn("prefix", prefix(F.col("story_key")))
                   .select(*narrow), root, "stories", batch)
    at = prefix(url_hash("url")).alias("prefix")
    write_prefixed(rows.select("url", (~_empty("description")).alias("described"), at), root, "links", batch)
    # What earlier batches lent counts as filled: the first description stays.
    offers = known.where(~_empty("description"))
    lent = read_before(items.sparkSession, root, "fills", batch, FILL).where(
        F.col("prefix").isin(_asked(offers, at)))
    lacking = read.where("not described").join(lent, "url", "left_anti").select("url")
    fills = (offers.groupBy("url").agg(F.min_by("description", "pos").alias("description"))
             .join(lacking, "url", "left_semi"))
    write_prefixed(fills.select("url", "description", at), root, "fills", batch)
    outcome = F.when(F.col("canonical_id").isNull(), "new").otherwise("duplicate")
    seen = (told.select("source", outcome.alias("outcome"))
            .unionByName(known.select("source", F.lit("known").alias("outcome"))))
    write_batch(read_stats(seen, "source").withColumn("started_at", instant(as_of)), root,
                "reads", batch)


def stored_articles(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """Articles up to ``batch`` with the descriptions later reads lent them."""
    rows = read_before(spark, root, "articles", batch, ARTICLE)
    fills = read_before(spark, root, "fills", batch, FILL, True)
    lent = fills.groupBy("url").agg(F.min_by("description", "batch").alias("lent"))
    return (rows.join(lent, "url", "left").withColumn("description", F.when(
        _empty("description"), F.coalesce("lent", "description")).otherwise(F.col("description")))
        .drop("lent", "day"))


def refresh(spark: SparkSession, parts: dict[str, Callable[[], object]]) -> DataFrame:
    """Run every part in turn; one that fails is recorded and the rest still run."""
    outcomes = []
    for name, run in parts.items():
        try:
            run()
            outcomes.append((name, None))
        except Exception as exc:  # noqa: BLE001 - one bad part must not stop the rest
            outcomes.append((name, f"{type(exc).__name__}: {exc}"[:300]))
    return spark.createDataFrame(outcomes, "part string, error string")


__all__ = ["ingest_batch", "links_read", "once", "read_before", "refresh", "run_available", "stories_near",
           "story_key", "stored_articles", "write_batch"]
