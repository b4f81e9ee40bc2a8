"""What is collected from sites and calendars, and the tables of sources it is read from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import markup, urls
from wirefold.operators import labels, sinks
from wirefold.plans import feed, firms
from wirefold.session import checkpoint_dir
from wirefold.sources import feeds, pages, registry
from wirefold.workload.activity import _POST_SQL, added_sites, nations_as_firms, posts
from wirefold.workload.base import ORDER_SQL, READ_SQL, Tables, order_articles, query, read_log


def _text(c: str):
    return F.col(c).cast("string")


# --- feeds and sitemaps ---------------------------------------------------------------------

@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT 'https://f.example/' || (doc_id // 100) AS feed_url, pos, 'https://d.example/' || doc_id AS url,
  'Post ' || doc_id || ' of ' || source AS title, lang AS snippet FROM d WHERE doc_id % 4 <> 1
QUALIFY row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) <= 30""")
def feed_post_rows(t: Tables) -> DataFrame:
    """A feed for every hundred documents, of which every fourth has no web link: the first thirty posts."""
    item = F.concat(F.lit("<item><title>Post "), _text("doc_id"), F.lit(" of "), "source", F.lit("</title><link>"),
                    F.when(F.col("doc_id") % 4 == 1, "ftp").otherwise("https"), F.lit("://d.example/"), _text("doc_id"),
                    F.lit("</link><description>"), "lang", F.lit("</description></item>"))
    made = (t.documents.select(F.floor(F.col("doc_id") / 100).alias("f"), F.struct("doc_id", item.alias("x")).alias("i"))
            .groupBy("f").agg(F.array_sort(F.collect_list("i")).alias("items"))
            .select(F.concat(F.lit("https://f.example/"), _text("f")).alias("url"), F.lit("s").alias("source"), F.concat(
                F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</channel></rss>"))
                .alias("body")))
    return feeds.feed_posts(made).select("feed_url", F.col("pos").cast("bigint").alias("pos"), "url", "title", "snippet")


@query("""SELECT 'https://m.example/' || (doc_id // 100) AS map_url,
  row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id DESC) AS rank, 'https://m.example/post-' || doc_id AS url,
  'Post ' || doc_id AS title, TIMESTAMP '2025-12-31 18:30:00' + to_days(CAST(doc_id % 100 AS INTEGER)) AS published_at
FROM documents WHERE doc_id % 12 < 10 QUALIFY rank <= 30""")
def sitemap_index(t: Tables) -> DataFrame:
    """An index of twelve maps for every hundred documents: the newest thirty posts of the first ten maps."""
    site, child = F.floor(F.col("doc_id") / 100).cast("string"), _text("c")
    maps = (t.documents.select(F.concat(F.lit("https://m.example/"), site).alias("url")).distinct()
            .withColumn("body", F.concat(F.lit("<sitemapindex>"), *[F.concat(
                F.lit("<sitemap><loc>"), "url", F.lit(f"/{c}.xml</loc></sitemap>")) for c in range(12)], F.lit("</sitemapindex>"))))
    day = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") % 100 * 86400), "yyyy-MM-dd")
    entry = F.concat(F.lit("<url><loc>https://m.example/post-"), _text("doc_id"), F.lit("</loc><lastmod>"), day,
                     F.lit("</lastmod></url>"))
    found = (t.documents.select(site.alias("site"), (F.col("doc_id") % 12).alias("c"), entry.alias("e"))
             .groupBy("site", "c").agg(F.array_join(F.collect_list("e"), "").alias("all"))
             .select(F.concat(F.lit("https://m.example/"), "site", F.lit("/"), child, F.lit(".xml")).alias("url"),
                     F.concat(F.lit("<urlset>"), "all", F.lit("</urlset>")).alias("body")))
    return feeds.resolve_sitemaps(maps, found).select(
        "map_url", F.col("rank").cast("bigint").alias("rank"), "url", "title", "published_at")


# --- pages ------------------------------------------------------------------------------------

@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://d.example/blog/rss' WHEN 1 THEN 'https://d.example/first.xml'
  WHEN 2 THEN 'https://d.example/atom' WHEN 3 THEN 'https://other.example/feed' END AS feed FROM documents""")
def declared_feeds(t: Tables) -> DataFrame:
    """The feed that a page declares: the one under its own path, else the first that is none of comments."""
    kind = 'type="application/rss+xml"'
    head = F.get(F.array(*[F.lit(h) for h in (
        f'<link rel="alternate" {kind} href="/all.xml"><link rel="alternate" {kind} href="/blog/rss">',
        f'<link rel="alternate" {kind} href="/first.xml"><link rel="alternate" {kind} href="/second.xml">',
        f'<link rel="alternate" {kind} title="Comments" href="/blog/c"><LINK TYPE=application/atom+xml REL="x alternate" '
        'HREF=/atom>', f"<link rel='alternate' {kind} href='https://other.example/feed'>",
        f'<link rel="alternate" type="text/html" href="/blog/en"><link rel="stylesheet" {kind} href="/blog/s">')]),
        F.col("doc_id") % 5)
    html = F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), F.coalesce(F.regexp_replace(
        "text", "[<>&]", " "), F.lit("")), F.lit("</body></html>"))
    return t.documents.select("doc_id", markup.declared_feed(html, F.lit("https://d.example/blog/?page=2")).alias("feed"))


@query("""WITH a AS (SELECT doc_id, 'https://l.example/' || (doc_id // 50) || '/' AS page_url,
    'https://l.example/an-entry-of-the-listing-' || (doc_id % 20) AS url,
    'Entry ' || doc_id || ' told by ' || source || ' at length' AS headline FROM documents WHERE doc_id % 5 = 0)
SELECT page_url, url, arg_min(headline, doc_id) AS headline FROM a WHERE length(headline) >= 25 GROUP BY ALL""")
def listing_anchors(t: Tables) -> DataFrame:
    """Listings of fifty links each: long ones at the root of the site count, each link once."""
    said = F.concat(F.lit("Entry "), _text("doc_id"), F.lit(" told by "), "source", F.lit(" at length"))
    slug = F.concat(F.lit("an-entry-of-the-listing-"), (F.col("doc_id") % 20).cast("string"))
    href = F.get(F.array(F.concat(F.lit("/"), slug), F.concat(F.lit("/deep/"), slug), F.lit("/short"), F.concat(
        F.lit("https://l.example/"), slug), F.concat(F.lit("//other.example"), slug)), F.col("doc_id") % 5)
    link = F.concat(F.lit('<a class="x" href="'), href, F.lit('"><b>'), said, F.lit("</b></a>"))
    made = (t.documents.select(F.floor(F.col("doc_id") / 50).alias("p"), F.struct("doc_id", link.alias("a")).alias("a"))
            .groupBy("p").agg(F.array_sort(F.collect_list("a")).alias("all"))
            .select(F.concat(F.lit("https://l.example/"), _text("p"), F.lit("/")).alias("url"),
                    F.array_join(F.transform("all", lambda a: a["a"]), "\n").alias("body")))
    return pages.anchor_items(made).select("page_url", "url", "headline")


# --- links ------------------------------------------------------------------------------------

@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '')
    WHEN 2 THEN url END AS url, CASE page_id % 6 WHEN 3 THEN 'not a web address' WHEN 4 THEN 'empty'
    WHEN 5 THEN 'has credentials' END AS reason, page_id % 2 = 0 AS same FROM pages""")
def links_compared(t: Tables) -> DataFrame:
    """Pasted links made absolute or refused, and each compared with another way to write it."""
    bare = F.regexp_replace("url", "^https?://", "")
    said = F.get(F.array(F.col("url"), bare, F.concat(F.lit("  "), "url", F.lit(" ")), F.lit("ftp://a.example/"), F.lit(" "),
                         F.concat(F.lit("https://me:pw@a.example/"), _text("page_id"))), (F.col("page_id") % 6).cast("int"))
    other = F.when(F.col("page_id") % 2 == 0, F.concat(F.upper("url"), F.lit("//"))).otherwise(F.concat("url", F.lit("x")))
    found = urls.normalise_url(said)
    return t.pages.select("page_id", found["url"].alias("url"), found["reason"].alias("reason"),
                          urls.same_url("url", other).alias("same"))


@query("""SELECT event_id, event_id % 5 < 4 AS calendar, event_id % 5 IN (0, 1, 3) AS readable,
  CASE event_id % 5 WHEN 0 THEN 'https://lu.ma/e' || event_id || '?k=1' WHEN 1 THEN 'https://lu.ma/e' || event_id
    WHEN 2 THEN 'https://lu.ma/calendar/e' || event_id WHEN 3 THEN 'https://www.lu.ma/e' || event_id
    ELSE 'https://calendar.example/e' || event_id END AS read_url FROM events""")
def calendar_links(t: Tables) -> DataFrame:
    """Which links are calendars that can be read, and the form the reader takes."""
    base = F.get(F.array(F.lit("http://www.luma.com/e"), F.lit("https://LUMA.com/e"), F.lit("http://luma.com/calendar/e"),
                         F.lit("https://www.lu.ma/e"), F.lit("https://calendar.example/e")), (F.col("event_id") % 5).cast("int"))
    link = F.concat(base, _text("event_id"), F.when(F.col("event_id") % 5 == 0, "?k=1").otherwise(""))
    return t.events.select("event_id", urls.is_calendar(link).alias("calendar"), urls.calendar_readable(link).alias("readable"),
                           urls.calendar_read_url(link).alias("read_url"))


# --- sources and their reads ---------------------------------------------------------------------

@query("""WITH e AS (SELECT 'n-' || n_nationkey AS firm, n_name AS label, n_nationkey AS n,
    CASE n_nationkey % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'luma' ELSE 'page' END AS via,
    'https://E.example/' || n_nationkey AS url FROM nation)
SELECT firm || ':' || via || ':' || substr(sha1(lower(url)), 1, 8) AS source_key, via, url AS source_url,
  firm AS organiser_key, label AS organiser, CASE n % 3 WHEN 0 THEN 'Firm website' WHEN 1 THEN 'Luma, via Apify'
    ELSE 'Website, via Firecrawl' END AS via_label, n % 2 = 1 AS india_only, false AS custom,
  CASE n % 3 WHEN 0 THEN 168 ELSE 24 END AS every_hours FROM e
UNION ALL SELECT 'site-' || s_suppkey, 'page', 'https://s.example/' || s_suppkey,
  CASE WHEN s_suppkey % 2 = 0 THEN 'n-' || s_nationkey ELSE 'site-' || s_suppkey END,
  CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE s_name END, 'Website, via Firecrawl', false, true, 24
FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def source_dimension(t: Tables) -> DataFrame:
    """Where events are read: a calendar or page of every nation, and the sites of suppliers, half of them tied."""
    n = F.col("n_nationkey")
    made = nations_as_firms(t).withColumn("n", F.regexp_extract("key", r"(\d+)", 1).cast("int"))
    kind = F.get(F.array(F.lit("html"), F.lit("luma"), F.lit("page")), F.col("n") % 3)
    place = F.struct(kind.alias("via"), F.concat(F.lit("https://E.example/"), _text("n")).alias("url"),
                     (F.col("n") % 2 == 1).alias("india_only"), (F.col("n") % 3 == 0).alias("site"),
                     F.lit(None).cast("string").alias("note"))
    sites = t.supplier.join(t.nation.select(n.alias("s_nationkey")), "s_nationkey").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("https://s.example/"), _text("s_suppkey")).alias("url"),
        F.col("s_name").alias("label"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "n-").otherwise("gone-"),
                                                 _text("s_nationkey")).alias("firm"), F.lit("page").alias("via"))
    return registry.event_sources(made.withColumn("events", F.array(place)).drop("n"), sites).select(
        "source_key", "via", "source_url", "organiser_key", "organiser", "via_label", "india_only", "custom", "every_hours")


@query(f"""WITH {READ_SQL}, s AS (SELECT DISTINCT source_id AS id FROM reads),
n AS (SELECT source_id AS id, count(*) AS n FROM reads WHERE kind = 'click' AND items_new > 1 GROUP BY 1),
l AS (SELECT source_id AS id, max(started_at) FILTER (kind <> 'view') AS last_read,
  arg_max(coalesce(error, ''), reads.id) FILTER (kind <> 'view') AS e FROM reads GROUP BY 1)
SELECT id, coalesce(n, 0) AS shown, last_read, nullif(e, '') AS last_error FROM s LEFT JOIN n USING (id) LEFT JOIN l USING (id)""")
def added_source_table(t: Tables) -> DataFrame:
    """Users as added sites: what each shows and how its last read went."""
    log = read_log(t)
    sites = log.select(F.col("source_id").alias("id")).distinct()
    shown = log.where("kind = 'click' and items_new > 1").select("source_id")
    return firms.added_sources(sites, shown, log.where("kind != 'view'")).select("id", "shown", "last_read", "last_error")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n
  FROM part WHERE p_size % 4 = 0 OR p_size % 5 = 0 OR p_size % 7 = 0 QUALIFY n <= 12) SELECT id, brand FROM p""")
def posts_for_pages(t: Tables) -> DataFrame:
    """Posts whose own page is to be opened, twelve a read at most: titles made from the link, no or a rough date."""
    size, link = F.col("p_size"), F.concat(F.lit("https://p.example/news/part-"), _text("p_partkey"))
    made = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), link.alias("url"),
        F.when(size % 4 == 0, urls.slug_title(link)).otherwise(F.concat(F.lit("On "), "p_name")).alias("title"),
        F.when(size % 5 != 0, F.lit("2026-01-01").cast("timestamp")).alias("published_at"), (size % 7 == 0).alias("date_approx"))
    return labels.posts_needing_page(made, "brand").select("id", "brand")


@query(f"""WITH {_POST_SQL} SELECT n_name AS "VC firm", kind AS "What", company AS "Company", 'Seed' AS "Round",
  '' AS "Amount", published_at + INTERVAL 330 MINUTE AS "Published (IST)",
  CASE origin WHEN 'added' THEN 'Added by you: ' ELSE '' END || source_label AS "Found via", company AS "Headline",
  'https://p.example' AS "Link" FROM posts JOIN nation ON firm = 'n-' || n_nationkey""")
def export_firm_posts(t: Tables) -> DataFrame:
    """All posts of firms, Other ones too, as the sheet readers get."""
    return sinks.export_firm_posts(firms.site_posts(posts(t), nations_as_firms(t), added_sites(t), include_other=True))


# --- stories ---------------------------------------------------------------------------------

@query(f"""WITH {ORDER_SQL}, one AS (SELECT min(canonical_id) AS id FROM arts WHERE canonical_id IN (SELECT id FROM arts)),
o AS (SELECT source, min(id) AS pos FROM arts WHERE canonical_id = (SELECT id FROM one) GROUP BY 1)
SELECT id, headline, source, published_at, (SELECT string_agg(source, ',' ORDER BY pos) FROM o) AS also_reported_by
FROM arts WHERE id = (SELECT id FROM one)""")
def one_article(t: Tables) -> DataFrame:
    """The first story that an order repeats, and who else reported it."""
    rows = order_articles(t)
    first = rows.join(rows.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").agg(
        F.min("canonical_id")).first()[0]
    return feed.article(rows, first).select("id", "headline", "source", "published_at", F.array_join(
        "also_reported_by", ",").alias("also_reported_by"))


@query("""SELECT event_id AS id, event_type AS kind, user_id AS source_id, ts AS started_at FROM events""")
def appended_runs(t: Tables) -> DataFrame:
    """The read log, appended day by day's halves to a table by kind, read back whole."""
    path = f"{checkpoint_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    log = read_log(t).select("id", "kind", "source_id", "started_at")
    early = F.hour("started_at") < 12
    for part in (early, ~early):
        sinks.append_rows(log.where(part), path, "kind")
    return t.spark.read.schema(log.schema).parquet(path)
