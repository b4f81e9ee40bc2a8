"""Funding rounds from the feed, the web search and added sites as one list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import taxonomy
from wirefold.functions.times import in_days

ORIGINS = ("feed", "web", "pasted")


def feed_rounds(rounds: DataFrame, articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Rounds whose story is still a canonical Funding story."""
    stories = articles.where("canonical_id is null and category = 'Funding'").select(
        F.col("id").alias("article_id"), "published_at", "ingested_at", "source", "headline", "url")
    names = labels.select(F.col("name").alias("source"), F.col("label").alias("known_label"))
    return (rounds.join(stories, "article_id").join(names, "source", "left").select(
        F.concat(F.lit("feed-"), "id").alias("id"), F.col("id").alias("row_id"), "company", "stage",
        taxonomy.round_label("round_label").alias("round"), "amount",
        taxonomy.investors_list("investors").alias("investors"), "published_at", "ingested_at",
        "source", F.coalesce("known_label", "source").alias("source_label"), "headline", "url",
        F.lit("feed").alias("origin"), F.lit(False).alias("date_approx")))


def _kept(rows: DataFrame, origin: str, label) -> DataFrame:
    return rows.where("kept").select(
        F.concat(F.lit(f"{origin}-"), "id").alias("id"), F.col("id").alias("row_id"), "company",
        "stage", F.col("round_label").alias("round"), "amount",
        taxonomy.investors_list("investors").alias("investors"), "published_at",
        F.lit(None).cast("timestamp").alias("ingested_at"), F.lit(origin).alias("source"),
        label.alias("source_label"), "headline", "url", F.lit(origin).alias("origin"), "date_approx")


def web_rounds(rows: DataFrame) -> DataFrame:
    return _kept(rows, "web", F.col("domain"))


def added_rounds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.select(F.col("id").alias("source_id"), "label")
    return _kept(rows.join(names, "source_id", "left"), "pasted",
                 F.coalesce("label", F.lit("Your website")))


def all_rounds(*parts: DataFrame) -> DataFrame:
    """The parts put together; their place decides ties in time."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def list_order() -> list:
    """Newest first, undated last; ties as the parts came, feed rounds by arrival."""
    return [F.col("published_at").desc_nulls_last(), F.col("part"),
            F.col("ingested_at").desc_nulls_last(), F.col("row_id")]


def rounds_of(rows: DataFrame, stage: str, start=None, end=None) -> DataFrame:
    return (rows.where((F.col("stage") == stage) & in_days("published_at", start, end))
            .orderBy(*list_order()))


def stage_counts(rows: DataFrame, start=None, end=None) -> DataFrame:
    """(key, label, count) for every stage, zero where it has no round."""
    spark = rows.sparkSession
    stages = spark.createDataFrame(
        [(i, k, v) for i, (k, v) in enumerate(taxonomy.STAGE_KEYS.items())],
        "place int, key string, label string")
    counts = (rows.where(in_days("published_at", start, end)).groupBy("stage")
              .agg(F.count("*").alias("n")).withColumnRenamed("stage", "label"))
    return (stages.join(counts, "label", "left")
            .select("place", "key", "label", F.coalesce("n", F.lit(0)).alias("count"))
            .orderBy("place").drop("place"))


def pending_count(articles: DataFrame, rounds: DataFrame, added: DataFrame) -> DataFrame:
    from wirefold.operators.labels import pending_added_rounds, pending_rounds
    waiting = pending_rounds(articles, rounds).select("id").unionByName(
        pending_added_rounds(added).select("id"))
    return waiting.agg(F.count("*").alias("pending"))
