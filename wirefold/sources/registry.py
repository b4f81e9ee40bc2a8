"""Registries of sources, firms and buckets, given as tables and checked before use.

They are usually small, but no plan relies on it: joins with them carry no hint, so Spark
broadcasts a registry only while its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions.text import map_of

SITE_VIAS = ("rss", "html", "sitemap", "scrape", "map")
EVENT_VIAS = ("luma", "page", "html")
VIA_LABELS = {**{v: "Firm website" for v in SITE_VIAS}, "search": "News search"}
EVENT_VIA_LABELS = {"luma": "Luma, via Apify", "page": "Website, via Firecrawl", "html": "Website"}

SOURCES = ("name string, label string, home string, strategy string, feed_url string, "
           "listing_url string, feed_depth int")
FIRMS = ("key string, label string, home string, "
         "site struct<via: string, url: string, link_pattern: string, note: string>, "
         "search string, no_site string, aliases array<string>, "
         "events array<struct<via: string, url: string, india_only: boolean, site: boolean, "
         "note: string>>, no_events string")
BUCKETS = "key string, label string, note string, categories array<string>, days int"
# The buckets readers start with.
DEFAULT_BUCKETS = (
    ("funded", "Recently funded", "Funding rounds from the last 7 days", ["Funding"], 7),
    ("policy", "Policy & regulation", "Regulators, courts and new rules, last 7 days",
     ["Policy/Regulation"], 7),
    ("market", "Market & analysis", "Results, valuations and trends, last 7 days",
     ["Market/Analysis"], 7),
)


def as_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A registry from a JSON path, a list of rows, or a DataFrame, in a fixed schema."""
    if isinstance(rows, DataFrame):
        df = rows
    elif isinstance(rows, str):
        df = spark.read.schema(schema).json(rows, multiLine=True)
    else:
        df = spark.createDataFrame(list(rows), schema)
    return df


def problems(firms: DataFrame) -> DataFrame:
    """(key, problem) of every firm entry that cannot be used."""
    site, event = F.col("site"), F.col("event")
    of_site = firms.select("key", F.when(
        site.isNull() & F.col("no_site").isNull(), "no site read and no reason").when(
        site.isNotNull() & ~F.coalesce(site["via"], F.lit("")).isin(*SITE_VIAS),
        "unknown site via").when(
        site.isNotNull() & (F.coalesce(site["url"], F.lit("")) == ""), "site read without url")
        .alias("problem"))
    of_events = firms.select("key", F.explode("events").alias("event")).select("key", F.when(
        ~F.coalesce(event["via"], F.lit("")).isin(*EVENT_VIAS)
        | (F.coalesce(event["url"], F.lit("")) == ""), "event entry needs via and url").when(
        F.coalesce(event["site"], F.lit(False)) & (event["via"] == "luma"),
        "own site read as calendar").alias("problem"))
    return of_site.unionByName(of_events).where("problem is not null")


def checked_firms(spark: SparkSession, rows) -> DataFrame:
    firms = as_table(spark, rows, FIRMS)
    bad = problems(firms).take(1)
    if bad:
        raise ValueError(f"{bad[0].key}: {bad[0].problem}")
    return firms


def firm_reads(firms: DataFrame) -> DataFrame:
    """(firm, via): the reads each firm has."""
    site = firms.where("site is not null").select(F.col("key").alias("firm"),
                                                  F.col("site.via").alias("via"))
    search = firms.where("search is not null").select(F.col("key").alias("firm"),
                                                      F.lit("search").alias("via"))
    return site.unionByName(search)


def event_sources(firms: DataFrame, added: DataFrame | None = None, hours: int = 24,
                  site_hours: int = 168) -> DataFrame:
    """The source dimension: registry calendars, then sources readers added.

    ``added(id, url, label, firm, via)``. The organiser is the firm, else the source itself.
    """
    e = F.col("e")
    registry = firms.select("key", "label", F.explode("events").alias("e")).select(
        F.concat_ws(":", "key", e["via"], F.substring(F.sha1(F.lower(F.trim(e["url"]))), 1, 8))
        .alias("source_key"), e["via"].alias("via"), e["url"].alias("source_url"), "label",
        F.col("key").alias("firm"), F.coalesce(e["india_only"], F.lit(False)).alias("india_only"),
        F.coalesce(e["site"], F.lit(False)).alias("site"), F.lit(False).alias("custom"),
        e["note"].alias("note"))
    rows = registry
    if added is not None:
        names = firms.select(F.col("key").alias("firm"), F.col("label").alias("firm_label"))
        rows = registry.unionByName(
            added.join(names, "firm", "left").select(
                F.concat(F.lit("site-"), "id").alias("source_key"), "via",
                F.col("url").alias("source_url"), F.coalesce("firm_label", "label").alias("label"),
                F.when(F.col("firm_label").isNotNull(), F.col("firm")).alias("firm"),
                F.lit(False).alias("india_only"), F.lit(False).alias("site"),
                F.lit(True).alias("custom"), F.lit(None).cast("string").alias("note")))
    label = F.when(F.col("site") & (F.col("via") == "html"), "Firm website").when(
        F.col("site"), "Firm website, via Firecrawl").otherwise(
        F.try_element_at(map_of(EVENT_VIA_LABELS), F.col("via")))
    return rows.select("*", F.coalesce("firm", "source_key").alias("organiser_key"),
                       F.col("label").alias("organiser"), label.alias("via_label"),
                       F.when(F.col("site"), site_hours).otherwise(hours).alias("every_hours"))
