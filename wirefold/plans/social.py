"""Posts of followed accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions import taxonomy
from wirefold.functions.text import snippet
from wirefold.functions.times import in_days

HEADLINE_CHARS = 160


def posts(rows: DataFrame, sources: DataFrame, start=None, end=None) -> DataFrame:
    """Sorted posts of known accounts in the window."""
    names = sources.select(F.col("id").alias("source_id"), F.col("label").alias("account"))
    short = snippet("content")
    return (rows.where(F.col("classified_at").isNotNull() & in_days("posted_at", start, end))
            .join(names, "source_id").select(
                "id", "source_id", "account", F.when(F.col("repost"), F.col("author")).alias("author"),
                "repost", F.coalesce("kind", F.lit("Other")).alias("kind"),
                F.coalesce(F.when(F.col("headline") != "", F.col("headline")),
                           F.substring(short, 1, HEADLINE_CHARS)).alias("headline"),
                short.alias("snippet"), "company", F.col("round_label").alias("round"), "amount",
                taxonomy.investors_list("investors").alias("investors"), "posted_at", "url"))


def wanted(kind: str | None = None, include_other: bool = False) -> Column:
    kinds = (kind,) if kind else ("Funding", "News") + (("Other",) if include_other else ())
    return F.col("kind").isin(*kinds)


def listing(shown: DataFrame, source=None, kind: str | None = None,
            include_other: bool = False) -> DataFrame:
    rows = shown.where(wanted(kind, include_other))
    if source is not None:
        rows = rows.where(F.col("source_id") == source)
    return rows.orderBy(F.col("posted_at").desc_nulls_last(), F.col("id").desc())


def kind_counts(shown: DataFrame, source=None) -> DataFrame:
    """Posts of each kind for one account, or all."""
    rows = shown if source is None else shown.where(F.col("source_id") == source)
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k.lower())
                      for k in taxonomy.SOCIAL_KINDS])


def account_counts(shown: DataFrame, kind: str | None = None, include_other: bool = False
                   ) -> DataFrame:
    return (shown.where(wanted(kind, include_other)).groupBy("source_id", "account")
            .agg(F.count("*").alias("count")))


def funding_rounds(shown: DataFrame) -> DataFrame:
    """Funding posts in the shape of plans.rounds, under the stage their round's name gives."""
    label = F.when(F.col("repost") & (F.coalesce("author", F.lit("")) != ""), F.concat(
        "account", F.lit(" (repost of "), "author", F.lit(")"))).otherwise(F.col("account"))
    return shown.where("kind = 'Funding'").select(
        F.concat(F.lit("social-"), "id").alias("id"), F.col("id").alias("row_id"), "company",
        taxonomy.stage("round").alias("stage"), "round", "amount", "investors",
        F.col("posted_at").alias("published_at"), F.lit(None).cast("timestamp").alias("ingested_at"),
        F.lit("social").alias("source"), label.alias("source_label"), "headline", "url",
        F.lit("social").alias("origin"), F.lit(False).alias("date_approx"))
