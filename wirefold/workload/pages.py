"""Pages as payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import markup, times, text, urls
from wirefold.operators import incremental
from wirefold.sources import feeds
from wirefold.workload.base import Tables, query


def _drop_sql(c: str, tags: tuple[str, ...]) -> str:
    for tag in tags:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return c


def _unescape_sql(c: str) -> str:
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"),
                       ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


def _squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_NO_COMMENT = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
_TITLE = _squeeze_sql(_unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))


@query(f"""SELECT page_id, substr({_TITLE}, 1, 300) AS title,
  CAST(NULL AS VARCHAR) AS description, CAST(NULL AS TIMESTAMP) AS published_at FROM pages""")
def page_meta(t: Tables) -> DataFrame:
    meta = markup.page_meta("html")
    return t.pages.select("page_id", markup.page_title("html").alias("title"),
                          meta["description"].alias("description"),
                          meta["published_at"].alias("published_at"))


@query(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all({_NO_COMMENT},
    '(?is)<a\\b[^>]*>.*?</a>')) AS a,
    generate_subscripts(regexp_extract_all({_NO_COMMENT}, '(?is)<a\\b[^>]*>.*?</a>'), 1) - 1 AS pos
  FROM pages)
SELECT page_id, pos, regexp_extract(url, '^(https?://[^/?#]*)', 1)
    || regexp_extract(a, 'href="([^"]*)"', 1) AS url,
  {_squeeze_sql(_unescape_sql("regexp_replace(a, '<[^>]*>', ' ', 'g')"))} AS text FROM a""")
def page_links(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", "url", F.posexplode(
        markup.anchors(F.regexp_replace("html", markup.COMMENT, ""))).alias("pos", "a"))
    return links.select("page_id", F.col("pos").cast("bigint").alias("pos"),
                        urls.join_url("url", "a.href").alias("url"), F.col("a.text").alias("text"))


_LINES = _unescape_sql("regexp_replace(" + _drop_sql(_NO_COMMENT, markup.TEXT_DROP_TAGS)
                       + ", '<[^>]*>', chr(10), 'g')")


@query(f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_LINES}, chr(10)),
  lambda l: {_squeeze_sql('l')}), lambda l: l <> ''), chr(10)) AS text FROM pages""")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", markup.page_text("html", "url").alias("text"))


_CLEAN = _squeeze_sql(_unescape_sql(
    "regexp_replace(" + _drop_sql(_NO_COMMENT, markup.CLEAN_DROP_TAGS) + ", '(?is)^.*<body[^>]*>|<[^>]*>', ' ', 'g')"))


@query(f"""SELECT page_id, length({_squeeze_sql(_TITLE + " || ' ' || " + _CLEAN)}) AS text_chars,
  false AS truncated FROM pages""")
def page_clean(t: Tables) -> DataFrame:
    clean = t.pages.select("page_id", markup.clean_page("html", "url").alias("c"))
    return clean.select("page_id", F.col("c.text_chars").cast("bigint").alias("text_chars"),
                        F.col("c.truncated").alias("truncated"))


@query(f"""SELECT page_id, CASE WHEN length(s) > 600
  THEN regexp_replace(substr(s, 1, 600), ' [^ ]*$', '') || '…' ELSE nullif(s, '') END AS text
FROM (SELECT page_id, {_squeeze_sql(_unescape_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')"))} AS s
      FROM pages)""")
def feed_text_clean(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.feed_text("html").alias("text"))


@query("""SELECT 'https://site.example/' || (page_id % 7) || '/feed' AS feed_url, page_id AS item,
  trim(regexp_replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
    '&amp;', '&'), '&quot;', '"'), '\\s+', ' ', 'g')) AS headline,
  url, TIMESTAMP '2026-01-01' + to_minutes(page_id) AS published_at FROM pages
WHERE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> ''""")
def feed_items(t: Tables) -> DataFrame:
    """Each page as a one-item feed built from its title, parsed back."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(1767225600) + F.col("page_id") * 60),
                          "EEE, dd MMM yyyy HH:mm:ss")
    item = F.concat(
        F.lit("<rss><channel><item><title><![CDATA["),
        F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("]]></title><link>"),
        F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><pubDate>"), stamp,
        F.lit(" GMT</pubDate></item></channel></rss>"))
    feed = F.concat(F.lit("https://site.example/"), (F.col("page_id") % 7).cast("string"),
                    F.lit("/feed"))
    payloads = t.pages.select(feed.alias("url"), F.col("page_id").cast("string").alias("source"),
                              item.alias("body"))
    return feeds.parse_feeds(payloads).select(
        "feed_url", F.col("source").cast("bigint").alias("item"), "headline", "url", "published_at")


@query("""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)
SELECT CAST(page_id AS VARCHAR) AS map_url, row_number() OVER (PARTITION BY page_id ORDER BY i DESC)
    AS rank, 'https://s.example' || href AS url,
  TIMESTAMP '2025-12-31 18:30:00' + to_days(CAST(i AS INTEGER)) AS published_at
FROM s WHERE href <> '' QUALIFY rank <= 30""")
def sitemap_entries(t: Tables) -> DataFrame:
    """Every page's links as a sitemap of their own, later links newer, the newest thirty kept."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    entries = F.transform(hrefs, lambda h, i: F.concat(
        F.lit("<url><loc>https://s.example"), h, F.lit("</loc><lastmod>"),
        F.date_format(F.timestamp_seconds(F.lit(1767225600) + (i + 1) * 86400), "yyyy-MM-dd"),
        F.lit("</lastmod></url>")))
    maps = t.pages.select(F.col("page_id").cast("string").alias("url"),
                          F.array_join(entries, "").alias("body"))
    return feeds.sitemap_posts(maps).select(
        "map_url", F.col("rank").cast("bigint").alias("rank"), "url", "published_at")


@query(f"""WITH p AS (SELECT page_id, starts_with(url, 'https') AS seen,
    array_to_string(list_filter(list_transform(string_split({_LINES}, chr(10)),
      lambda l: {_squeeze_sql('l')}), lambda l: l <> ''), chr(10)) AS text FROM pages)
SELECT page_id, sha1(text) AS content_hash,
  regexp_matches(text, '{times.EVENT_WORDS}') AND regexp_matches(text, '{times.ANY_DATE}')
  AS worth_asking FROM p WHERE NOT seen""")
def content_changed(t: Tables) -> DataFrame:
    """Pages whose text is not the one last read: https pages were read as they are."""
    rows = t.pages.select("page_id", "url", F.col("page_id").alias("source_key"),
                          F.lit(True).alias("site"), markup.page_text("html", "url").alias("text"))
    reads = rows.select(
        "source_key", F.col("page_id").alias("id"), F.lit("page").alias("kind"),
        F.lit(None).cast("string").alias("error"), F.lit("2024-01-01").cast("timestamp").alias("started_at"),
        F.when(F.col("url").startswith("https"), F.sha1("text")).otherwise("old").alias("content_hash"))
    return incremental.changed_pages(rows, reads).select("page_id", "content_hash", "worth_asking")


_LINE_SQL = """l AS (SELECT doc_id, regexp_replace(regexp_replace(line, '[<>&\\[\\]]', '', 'g'), '\\s+', ' ', 'g') AS line, pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""


@query(f"""WITH {_LINE_SQL}
SELECT doc_id, coalesce(string_agg(nullif(trim(line), ''), chr(10) ORDER BY pos)
  FILTER (pos % 6 IN (0, 3) AND trim(line) <> ''), '') AS text FROM l GROUP BY doc_id""")
def nested_page_text(t: Tables) -> DataFrame:
    """Documents as pages of nested menus, unclosed forms, scripts with tags and stray end tags around
    every third line."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("i"), F.regexp_replace(x, r"[<>&\[\]]", "").alias("x")))
    shown = F.transform(line, lambda s: F.when(s["i"] % 6 == 0, F.concat(F.lit("<p>"), s["x"], F.lit("</p></b>")))
                        .when(s["i"] % 6 == 1, F.concat(F.lit("<nav><ul><li>a<nav>x</nav><li>"), s["x"], F.lit("</ul></nav>")))
                        .when(s["i"] % 6 == 2, F.concat(F.lit("<div><form action=x><p>"), s["x"], F.lit("</div>")))
                        .when(s["i"] % 6 == 3, F.concat(F.lit("<SECTION>"), s["x"], F.lit("<br></SECTION>")))
                        .when(s["i"] % 6 == 4, F.concat(F.lit("<script>if (a) '<nav>' </script><!-- <nav> "), s["x"], F.lit("-->")))
                        .otherwise(F.concat(F.lit("<div><iframe/><footer><footer>f</footer><img src=y>"), s["x"], F.lit("</footer></div>"))))
    made = t.documents.select("doc_id", F.concat(F.lit("<html><body>"), F.array_join(shown, "\n")).alias("html"))
    return made.select("doc_id", markup.page_text("html", F.lit("https://d.example/")).alias("text"))


@query("""SELECT doc_id AS item, 'https://f.example/' || (doc_id % 9) AS feed_url, 'https://d.example/?a=1&d=' || doc_id AS url,
  'Story </item> ' || doc_id || ' & more' AS headline, 'about <' || source || '> &amp; ' || lang AS plain,
  TIMESTAMP '2026-01-01' + to_minutes(doc_id) AS published_at, lang || ',' || source AS categories FROM documents""")
def feed_channels(t: Tables) -> DataFrame:
    """Feeds of many items, RSS and Atom by turns: markup in CDATA, escaped twice, commented out."""
    number = F.col("doc_id").cast("string")
    stamp = F.timestamp_seconds(F.lit(1767225600) + F.col("doc_id") * 60)
    about = F.concat(F.lit("about &lt;"), "source", F.lit("&gt; &amp;amp; "), "lang")
    rss = F.concat(F.lit("<!-- <item></item> --><item><title><![CDATA[Story &lt;/item> "), number, F.lit(
        " & more]]></title><link>https://d.example/?a=1&amp;d="), number, F.lit("</link><description><![CDATA[<p>"), about, F.lit(
        "</p><b></item></b>]]></description><category>"), "lang", F.lit("</category><category><![CDATA["), "source", F.lit(
        "]]></category><pubDate>"), F.date_format(stamp, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(F.lit('<entry><title type="html">Story &amp;lt;/item> '), number, F.lit(
        ' &amp;amp; more</title><link rel="self" href="/self"/><link rel="alternate" href="https://d.example/?a=1&amp;d='), number, F.lit(
        '"/><summary type="html">'), F.replace(about, F.lit("&"), F.lit("&amp;")), F.lit('</summary><category term="'), "lang", F.lit(
        '"/><category term="'), "source", F.lit('"/><updated>'), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    kind = F.col("doc_id") % 9 % 2
    made = (t.documents.select((F.col("doc_id") % 9).alias("feed"), (F.floor(F.col("doc_id") / 90)).alias("part"), F.when(
        kind == 0, rss).otherwise(atom).alias("item"), kind.alias("kind")).groupBy("feed", "part", "kind")
        .agg(F.array_join(F.collect_list("item"), "\n").alias("items"))
        .select(F.concat(F.lit("https://f.example/"), F.col("feed").cast("string")).alias("url"), F.lit("s").alias("source"),
                F.when(F.col("kind") == 0, F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>T</title>'), "items", F.lit(
                    "</channel></rss>"))).otherwise(F.concat(F.lit("<feed><title>T</title>"), "items", F.lit("</feed>"))).alias("body")))
    return feeds.parse_feeds(made).select(
        F.regexp_extract("url", r"d=(\d+)$", 1).cast("bigint").alias("item"), "feed_url", "url", "headline",
        F.col("description").alias("plain"), "published_at", F.array_join("feed_categories", ",").alias("categories"))
