"""The feed: filters, pages, facets, activity and buckets.

``articles`` has id, source, headline, description, published_at, ingested_at, company, category,
canonical_id. Partitioned by published day, the recency and day filters prune partitions.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.taxonomy import CATEGORIES
from wirefold.functions.text import col, strip
from wirefold.functions.times import indian_day, instant, reader_day
from wirefold.operators.dedupe import other_outlets

WINDOW_DAYS = 7
PAGE_LIMIT, MAX_PAGE = 30, 100


@dataclass(frozen=True)
class FilterSpec:
    categories: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    company: str | None = None
    query: str | None = None
    since_days: int | None = None
    extra: Column | None = field(default=None, compare=False)


def canonical(articles: DataFrame) -> DataFrame:
    return articles.where("canonical_id is null")


def recent(as_of, days: int, ts: str = "published_at") -> Column:
    """In the last ``days``, or undated: an undated listing is shown rather than lost."""
    since = instant(as_of) - F.make_dt_interval(days=F.lit(days))
    return F.col(ts).isNull() | (F.col(ts) >= since)


def contains(c: Column | str, words: str) -> Column:
    """Literal, case-insensitive; wildcard characters in ``words`` mean themselves."""
    return F.coalesce(F.lower(col(c)).contains(words.lower()), F.lit(False))


def matches(spec: FilterSpec, as_of, default_days: int = WINDOW_DAYS) -> Column:
    out = recent(as_of, spec.since_days or default_days)
    if spec.categories:
        out = out & F.col("category").isin(*spec.categories)
    if spec.sources:
        out = out & F.col("source").isin(*spec.sources)
    if spec.company:
        out = out & contains("company", spec.company)
    if spec.query:
        out = out & (contains("headline", spec.query) | contains("description", spec.query)
                     | contains("company", spec.query))
    return out if spec.extra is None else out & spec.extra


def feed_rows(articles: DataFrame, spec: FilterSpec, as_of) -> DataFrame:
    return canonical(articles).where(matches(spec, as_of))


def newest_first(ts: str = "published_at", *then: Column) -> list[Column]:
    return [F.col(ts).desc_nulls_last(), *then]


def _check_page(limit: int) -> None:
    """A page and its total accept the same limits; a larger one is refused, never cut."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page has 1 to {MAX_PAGE} rows")


def feed_page(articles: DataFrame, spec: FilterSpec, as_of, limit: int = PAGE_LIMIT,
              offset: int = 0) -> DataFrame:
    """One page, newest first, with the other outlets of its stories.

    Other outlets are looked up for the page's few rows only: the page is a top-k, and its
    ids filter the pointer rows before anything is grouped.
    """
    _check_page(limit)
    order = newest_first("published_at", F.col("ingested_at").desc(), F.col("id").desc())
    page = feed_rows(articles, spec, as_of).orderBy(*order).offset(offset).limit(limit)
    ids = page.select(F.col("id").alias("canonical_id"))
    pointing = articles.where("canonical_id is not null").join(
        F.broadcast(ids), "canonical_id", "left_semi")
    outlets = other_outlets(pointing, ["id"]).withColumnRenamed("canonical_id", "id")
    return (page.join(outlets, "id", "left")
            .withColumn("also_reported_by", F.coalesce(
                "also_reported_by", F.array().cast("array<string>")))
            .orderBy(*order))


def feed_total(articles: DataFrame, spec: FilterSpec, as_of, limit: int = PAGE_LIMIT,
               offset: int = 0) -> DataFrame:
    _check_page(limit)
    shown = F.least(F.greatest(F.col("total") - offset, F.lit(0)), F.lit(limit))
    return feed_rows(articles, spec, as_of).agg(F.count("*").alias("total")).withColumn(
        "has_more", F.lit(offset) + shown < F.col("total"))


def article(articles: DataFrame, article_id) -> DataFrame:
    pointing = articles.where(F.col("canonical_id") == article_id)
    outlets = other_outlets(pointing, ["id"]).withColumnRenamed("canonical_id", "id")
    return articles.where(F.col("id") == article_id).join(outlets, "id", "left")


def activity(articles: DataFrame, as_of, days: int = WINDOW_DAYS,
             offset_minutes: int = 0) -> DataFrame:
    """Stories per day of the reader's own clock."""
    since = instant(as_of) - F.make_dt_interval(days=F.lit(days))
    return (canonical(articles).where(F.col("published_at") >= since)
            .groupBy(reader_day("published_at", offset_minutes).alias("day"))
            .agg(F.count("*").alias("count")).orderBy("day"))


def facets(articles: DataFrame) -> DataFrame:
    """(facet, value, count) by category and by source in one pass, over all time."""
    rows = canonical(articles)
    facet = F.when(F.grouping("category") == 0, "category").otherwise("source")
    return (rows.groupingSets([[F.col("category")], [F.col("source")]], "category", "source")
            .agg(F.count("*").alias("count"), facet.alias("facet"))
            .select("facet", F.when(F.col("facet") == "category", F.col("category"))
                    .otherwise(F.col("source")).alias("value"), "count")
            .orderBy("facet", F.col("count").desc(), "value"))


def buckets(articles: DataFrame, definitions: DataFrame, as_of, seen: DataFrame | None = None
            ) -> DataFrame:
    """Per bucket: stories in its window, how many arrived since it was last opened, and
    the latest arrival at any time. ``seen(key, seen_at)``. A bucket is a handful of rows, so
    they meet the stories' narrow columns and are summed up at once.
    """
    defs = definitions.withColumn("category", F.explode("categories"))
    if seen is None:
        defs = defs.withColumn("seen_at", F.lit(None).cast("timestamp"))
    else:
        defs = defs.join(seen, "key", "left")
    since = instant(as_of) - F.make_dt_interval(days=F.col("days"))
    fits = F.col("published_at").isNull() | (F.col("published_at") >= since)
    counted = (canonical(articles).select("category", "published_at", "ingested_at")
               .join(defs.select("key", "category", "days", "seen_at"), "category")
               .groupBy("key").agg(
                   F.count_if(fits).alias("count"),
                   F.count_if(fits & (F.col("ingested_at") > F.col("seen_at"))).alias("new_count"),
                   F.max("ingested_at").alias("latest_ingested_at")))
    return definitions.join(counted, "key", "left").select(
        "key", "label", "note", "categories", "days",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("new_count", F.lit(0)).alias("new_count"), "latest_ingested_at")


def day_groups(articles: DataFrame) -> DataFrame:
    """Stories per Indian day with their order on the day; undated ones in a group of their own.

    One row per story and day key, not one array per day: a day may hold very many.
    """
    return articles.withColumn("day_key", F.coalesce(
        F.date_format(indian_day("published_at"), "yyyy-MM-dd"), F.lit("undated")))


def coerce_filters(raw: DataFrame, sources: list[str], body: str = "filter_json") -> DataFrame:
    """Compiled filters: known categories and sources only, sane day counts.

    Adds categories, sources, company, query, since_days and explanation.
    """
    spec = F.from_json(body, "categories array<string>, sources array<string>, company string, "
                             "query string, since_days string")
    known = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.lower(), c)])
    names = F.transform(F.coalesce(spec["categories"], F.array().cast("array<string>")),
                        lambda c: F.try_element_at(known, F.lower(strip(c))))
    allowed = F.array(*[F.lit(s) for s in sources]).cast("array<string>")
    given = F.transform(F.coalesce(spec["sources"], F.array().cast("array<string>")), strip)
    days = spec["since_days"].try_cast("int")

    def words(c: Column) -> Column:
        return F.when(strip(c) != "", strip(c))

    out = raw.select(
        "*", F.filter(names, lambda n: n.isNotNull()).alias("categories"),
        F.filter(given, lambda s: F.array_contains(allowed, s)).alias("sources"),
        words(spec["company"]).alias("company"), words(spec["query"]).alias("query"),
        F.when(days.between(1, 365), days).alias("since_days"))
    return out.withColumn("explanation", explain(
        F.col("categories"), F.col("company"), F.col("query"), F.col("sources"),
        F.col("since_days")))


def explain(categories: Column, company: Column, query: Column, sources: Column,
            days: Column) -> Column:
    """A plain sentence saying what a filter shows."""
    parts = F.concat_ws(
        ", ", F.when(F.size(categories) > 0, F.array_join(categories, " or ")),
        F.concat(F.lit("about "), company), F.concat(F.lit("matching “"), query, F.lit("”")),
        F.when(F.size(sources) > 0, F.concat(F.lit("from "), F.array_join(sources, ", "))),
        F.when(days == 1, "from today").when(
            days > 1, F.concat(F.lit("from the last "), days.cast("string"), F.lit(" days"))))
    return F.when(parts != "", F.concat(F.lit("Showing stories "), parts)).otherwise(
        "Showing everything")


def as_utc(value: dt.datetime) -> dt.datetime:
    return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
