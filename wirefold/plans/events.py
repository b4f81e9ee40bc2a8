"""Events split into upcoming and past, and who organises them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.times import in_days, instant
from wirefold.operators.dedupe import event_dedupe
from wirefold.plans.firms import latest_reads


def is_upcoming(as_of) -> Column:
    """Still to come or under way. A day-only event lasts its whole day."""
    end = F.coalesce("ends_at", F.when(
        F.col("date_only"), F.col("starts_at") + F.make_dt_interval(days=F.lit(1))
    ).otherwise(F.col("starts_at")))
    return end >= instant(as_of)


def shown_events(events: DataFrame, sources: DataFrame, as_of, start=None, end=None) -> DataFrame:
    """Events of known sources, one per link, registry sources before added ones."""
    known = sources.select("source_key", "source_url", "custom", "organiser_key", "organiser",
                           "via_label")
    rows = (events.where(in_days("starts_at", start, end)).join(known, "source_key")
            .withColumn("late", F.col("custom").cast("int")))
    return event_dedupe(rows, ["late"]).withColumn(
        "when", F.when(is_upcoming(as_of), "upcoming").otherwise("past")).drop("late")


def listing(shown: DataFrame, when: str, organiser: str | None = None) -> DataFrame:
    rows = shown.where(F.col("when") == when)
    if organiser:
        rows = rows.where(F.col("organiser_key") == organiser)
    start = F.col("starts_at").asc() if when == "upcoming" else F.col("starts_at").desc()
    return rows.orderBy(start, "id")


def organiser_counts(shown: DataFrame) -> DataFrame:
    """(organiser_key, organiser, upcoming, past), before an organiser is picked."""
    return (shown.groupBy("organiser_key", "organiser").pivot("when", ["upcoming", "past"])
            .count().na.fill(0, ["upcoming", "past"]))


def event_totals(shown: DataFrame, organiser: str | None = None) -> DataFrame:
    rows = shown if not organiser else shown.where(F.col("organiser_key") == organiser)
    return rows.agg(F.count_if(F.col("when") == "upcoming").alias("upcoming"),
                    F.count_if(F.col("when") == "past").alias("past"))


def source_table(sources: DataFrame, events: DataFrame, reads: DataFrame) -> DataFrame:
    counts = events.groupBy("source_key").agg(F.count("*").alias("n"))
    return (sources.join(counts, "source_key", "left")
            .join(latest_reads(reads, "source_key"), "source_key", "left")
            .withColumn("events", F.coalesce("n", F.lit(0))).drop("n"))
