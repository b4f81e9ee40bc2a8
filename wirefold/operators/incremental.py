"""What is due, what is new, what has changed, and how reads went."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.times import instant, mentions_events

COOLDOWN_MINUTES = 10
FRESH_GRACE_MINUTES = 30
FIRST_READ_ITEMS = 20


def _hours_ago(hours) -> Column:
    return F.make_dt_interval(hours=hours if isinstance(hours, Column) else F.lit(hours))


def last_good(reads: DataFrame, *by: str) -> DataFrame:
    """The last read of each entity that did not fail."""
    return reads.where("error is null").groupBy(*by).agg(F.max("started_at").alias("last_good"))


def due(sources: DataFrame, reads: DataFrame, as_of, key: str = "source_key",
        every: str = "every_hours") -> DataFrame:
    """Sources never read, or whose last good read is older than their interval."""
    now = instant(as_of)
    good = last_good(reads, key)
    late = F.col("last_good").isNull() | (
        F.col("last_good") <= now - _hours_ago(F.col(every).cast("int")))
    return sources.join(good, key, "left").where(late)


def due_kinds(sources: DataFrame, reads: DataFrame, as_of) -> DataFrame:
    """(source_key, kind) to read: upcoming and pages on their interval, past events once."""
    now = instant(as_of)
    kinds = F.when(F.col("via") == "luma", F.array(F.lit("upcoming"), F.lit("past"))).otherwise(
        F.array(F.lit("page")))
    asked = sources.select("source_key", "every_hours", F.explode(kinds).alias("kind"))
    good = last_good(reads, "source_key", "kind")
    late = F.col("last_good") <= now - _hours_ago(F.col("every_hours").cast("int"))
    return (asked.join(good, ["source_key", "kind"], "left")
            .where(F.col("last_good").isNull() | ((F.col("kind") != "past") & late))
            .select("source_key", "kind"))


def high_watermark(sources: DataFrame, posts: DataFrame, key: str = "source_id") -> DataFrame:
    """Where each source's next read starts: a second past its newest stored post."""
    newest = posts.groupBy(key).agg(F.max("posted_at").alias("newest"))
    return sources.join(newest, key, "left").withColumn(
        "since", F.col("newest") + F.make_dt_interval(secs=F.lit(1)))


def new_posts(found: DataFrame, marks: DataFrame, key: str = "source_id",
              first: int = FIRST_READ_ITEMS) -> DataFrame:
    """Posts at or after their source's mark; a source without one gives its newest few."""
    from pyspark.sql.window import Window
    joined = found.join(marks.select(key, "since"), key)
    w = Window.partitionBy(key).orderBy(F.col("posted_at").desc_nulls_last(), "pos")
    later = joined.where("since is not null and posted_at >= since")
    opening = (joined.where("since is null").withColumn("n", F.row_number().over(w))
               .where(F.col("n") <= first).drop("n"))
    return later.unionByName(opening).drop("since")


def changed_pages(pages: DataFrame, reads: DataFrame) -> DataFrame:
    """pages(source_key, site, text) whose text differs from the last good read's.

    A firm's own site is only worth asking about when it names an event and a date.
    """
    last = (reads.where("error is null and content_hash is not null and kind = 'page'")
            .groupBy("source_key")
            .agg(F.max_by("content_hash", F.struct("started_at", "id")).alias("last_hash")))
    hashed = pages.withColumn("content_hash", F.sha1("text")).join(last, "source_key", "left")
    return (hashed.where(F.col("last_hash").isNull() | (F.col("last_hash") != F.col("content_hash")))
            .withColumn("worth_asking", ~F.col("site") | mentions_events("text"))
            .drop("last_hash"))


def read_stats(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts a read log row holds, of outcomes new / duplicate / known."""
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("items_seen"),
        F.count_if(F.col("outcome") == "new").alias("items_new"),
        F.count_if(F.col("outcome") == "duplicate").alias("items_duplicate"))


def schedule(reads: DataFrame, as_of, every_hours: int = 12, *by: str) -> DataFrame:
    """Freshness, next due time and cooldown left, per group of the run log."""
    now = instant(as_of)
    last = F.col("last_started")
    fresh = last > now - F.make_dt_interval(hours=F.lit(every_hours),
                                            mins=F.lit(-FRESH_GRACE_MINUTES))
    ready = last + F.make_dt_interval(mins=F.lit(COOLDOWN_MINUTES))
    return reads.groupBy(*by).agg(F.max("started_at").alias("last_started")).select(
        *by, "last_started", F.coalesce(fresh, F.lit(False)).alias("fresh"),
        F.coalesce(F.greatest(now, last + _hours_ago(every_hours)), now).alias("next_due"),
        F.coalesce(F.greatest(F.lit(0.0), ready.cast("double") - now.cast("double")), F.lit(0.0))
        .alias("cooldown_seconds"))
