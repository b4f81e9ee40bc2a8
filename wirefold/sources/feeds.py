"""Feed and sitemap payloads to rows.

Payload tables hold what was already collected: ``url, source, body`` and whatever else the
caller keeps. Bodies are parsed where they lie; only the parsed rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.functions.markup import COMMENT, attribute, plain_cdata, xml_field
from wirefold.functions.text import blank_to_null, col, feed_text, unescape
from wirefold.functions.times import read_time
from wirefold.functions.urls import is_web, slug_title

ITEMS_PER_READ = 30
UNDATED_SITEMAP_ITEMS = 100
CHILD_SITEMAPS = 10


def _link(block: Column) -> Column:
    plain = xml_field(block, "link")
    links = F.regexp_extract_all(block, F.lit(r"(?is)(<link\b[^>]*\shref\s*=[^>]*>)"), F.lit(1))
    main = F.filter(links, lambda t: attribute(t, "rel").isin("", "alternate"))
    guid = F.when(~block.rlike(r"""(?i)<guid\b[^>]*isPermaLink\s*=\s*["']false"""),
                  xml_field(block, "guid"))
    return F.coalesce(plain, blank_to_null(F.trim(attribute(F.get(main, F.lit(0)), "href"))), guid)


def _terms(block: Column) -> Column:
    tags = F.regexp_extract_all(
        block, F.lit(r"(?is)(<category\b[^>]*/>|<category\b[^>]*>.*?</category\s*>)"), F.lit(1))
    names = F.transform(tags, lambda t: F.coalesce(
        blank_to_null(F.trim(attribute(F.regexp_extract(t, r"(?s)^<[^>]*>", 0), "term"))),
        F.trim(unescape(F.regexp_replace(t, r"(?is)^<category\b[^>]*>|</category\s*>$", "")))))
    return F.filter(names, lambda n: n != "")


def _markup(body: str) -> Column:
    """The payload with CDATA escaped and comments gone: what is left of < is markup."""
    return F.regexp_replace(plain_cdata(body), COMMENT, "")


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """Items of RSS and Atom payloads: feed_url, pos, url, headline, description,
    published_at, source, feed_categories. Items without a link or title are left out."""
    blocks = F.regexp_extract_all(
        _markup("body"), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)\s*>"), F.lit(1))

    # Finished inside the array, so that the filter sees values and no field is read twice.
    def item(b: Column) -> Column:
        stamps = [xml_field(b, n) for n in ("pubDate", "published", "issued", "updated", "dc:date",
                                            "modified")]
        return F.struct(
            _link(b).alias("url"), feed_text(xml_field(b, "title"), 300).alias("headline"),
            feed_text(xml_field(b, "summary", "description", "content:encoded", "content")
                      ).alias("description"),
            F.coalesce(*[read_time(s, "UTC")["ts"] for s in stamps]).alias("published_at"),
            _terms(b).alias("feed_categories"))
    return (payloads.select(F.col("url").alias("feed_url"), "source",
                            F.posexplode(F.transform(blocks, item)).alias("pos", "i"))
            .select("feed_url", "source", "pos", "i.*")
            .where("url is not null and headline is not null"))


def feed_posts(payloads: DataFrame, limit: int = ITEMS_PER_READ) -> DataFrame:
    """The first ``limit`` web items of each feed, as posts."""
    w = Window.partitionBy("feed_url").orderBy("pos")
    return (parse_feeds(payloads).where(is_web("url"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("feed_url", "pos", "url", F.col("headline").alias("title"),
                    F.col("description").alias("snippet"), "published_at",
                    F.lit(False).alias("date_approx")))


def _entries(payloads: DataFrame) -> DataFrame:
    block = r"(?is)<(url|sitemap)\s*>(.*?)</(?:url|sitemap)\s*>"
    blocks = F.transform(F.regexp_extract_all(_markup("body"), F.lit(f"({block})"), F.lit(1)), lambda b: F.struct(
        F.lower(F.regexp_extract(b, block, 1)).alias("kind"), F.regexp_extract(b, block, 2).alias("in")))
    return (payloads.select("url", F.posexplode(blocks).alias("pos", "b"))
            .select(F.col("url").alias("map_url"), "pos", "b.kind", xml_field("b.in", "loc").alias("url"),
                    read_time(xml_field("b.in", "lastmod"))["ts"].alias("published_at"))
            .where("url is not null"))


def _newest(entries: DataFrame, limit: int) -> DataFrame:
    per_map = Window.partitionBy("map_url")
    order = per_map.orderBy(F.coalesce(F.col("published_at").cast("double"), F.lit(0.0)).desc(),
                            "part", "pos")
    room = F.when(F.max(F.col("published_at").isNotNull()).over(per_map), limit).otherwise(
        max(limit, UNDATED_SITEMAP_ITEMS))
    return (entries.withColumn("room", room).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= F.col("room"))
            .select("map_url", "rank", "url", slug_title("url").alias("title"), "published_at",
                    F.col("published_at").isNotNull().alias("date_approx")))


def _wanted(entries: DataFrame, pattern: str | None) -> DataFrame:
    posts = entries.where("kind = 'url'")
    return posts if not pattern else posts.where(col("url").rlike(f"(?i){pattern}"))


def sitemap_posts(payloads: DataFrame, pattern: str | None = None,
                  limit: int = ITEMS_PER_READ) -> DataFrame:
    """Posts of each sitemap, newest first. An undated map has no newest, so it keeps more."""
    return _newest(_wanted(_entries(payloads), pattern).withColumn("part", F.lit(0)), limit)


def child_sitemaps(payloads: DataFrame) -> DataFrame:
    """(map_url, rank, url) of the first child maps of each sitemap index."""
    w = Window.partitionBy("map_url").orderBy("pos")
    return (_entries(payloads).where("kind = 'sitemap'")
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= CHILD_SITEMAPS).select("map_url", "rank", "url"))


def resolve_sitemaps(maps: DataFrame, collected: DataFrame, pattern: str | None = None,
                     limit: int = ITEMS_PER_READ) -> DataFrame:
    """Posts of each map and of its collected child maps, together, newest first.

    Every part is cut to its own newest posts before the parts are put together.
    """
    own = (sitemap_posts(maps, pattern, limit).withColumn("part", F.lit(0)))
    bodies = collected.select(F.col("url").alias("child"), "body")
    kids = child_sitemaps(maps).withColumnRenamed("url", "child").join(bodies, "child")
    # One key per (map, child): a child listed by two indexes belongs to both.
    keyed = kids.select(F.to_json(F.struct("map_url", "rank")).alias("url"), "body")
    parts = sitemap_posts(keyed, pattern, limit).select(
        F.get_json_object("map_url", "$.map_url").alias("map_url"),
        F.get_json_object("map_url", "$.rank").cast("int").alias("part"),
        "rank", "url", "published_at")
    every = own.select("map_url", "part", "rank", "url", "published_at").unionByName(parts)
    order = Window.partitionBy("map_url").orderBy(
        F.coalesce(F.col("published_at").cast("double"), F.lit(0.0)).desc(), "part", "rank")
    dated = F.max(F.col("published_at").isNotNull()).over(Window.partitionBy("map_url"))
    return (every.withColumn("room", F.when(dated, limit).otherwise(UNDATED_SITEMAP_ITEMS))
            .withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= F.col("room"))
            .select("map_url", F.col("place").alias("rank"), "url", slug_title("url").alias("title"),
                    "published_at", F.col("published_at").isNotNull().alias("date_approx")))
