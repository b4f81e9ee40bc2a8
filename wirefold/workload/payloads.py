"""Payloads written from table rows and parsed back, each row its own payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import times
from wirefold.operators import labels
from wirefold.sources import pages, payloads, registry
from wirefold.workload.base import (DOC_AS_OF, DOC_SQL, ORDER_SQL, READ_AS_OF, Tables, doc_articles,
                                    order_articles, query)

_SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


# --- page and listing payloads ---------------------------------------------------------

def _posts_sql(raw: str) -> str:
    """Posts of a document whose lines are cards; ``raw`` is what a card says for its ``line``."""
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
r AS (SELECT doc_id, pos, {raw} AS raw FROM l WHERE line <> ''),
t AS (SELECT doc_id, pos, regexp_replace(regexp_replace(replace(regexp_replace(raw, '{times.CARD_DATE}', ' '),
  '\\', ' '), '{times.WRITTEN_DATE}', ' ', 'g'), '{times.READ_MORE}', ' ', 'g') AS title FROM r),
v AS (SELECT doc_id, pos, substr(trim({_SQ.format('title')}, ' -|·,.'), 1, 300) AS title FROM t)
SELECT doc_id, 'https://d.example/' || doc_id || '/' || pos AS url, title,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM v
WHERE length(title) >= 25 AND len(string_split(title, ' ')) >= 4 QUALIFY rank <= 30"""


def _cards(made):
    """One card for every line that is not empty; ``made(line, number)`` writes it."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.cast("string").alias("pos"), x.alias("line"))), lambda s: s["line"] != "")
    return F.array_join(F.transform(lines, lambda s: made(s["line"], s["pos"])), "\n")


@query(_posts_sql(_SQ.format("line")))
def page_posts(t: Tables) -> DataFrame:
    """Every document as a news page whose lines are links, nested menus around them."""
    def card(line, pos):
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            line = F.replace(line, F.lit(char), F.lit(name))
        return F.concat(F.lit('<li><a class="card" href="'), pos, F.lit('#top"><span>'), line, F.lit("</span> </a></li>"))
    body = F.concat(F.lit('<nav><nav><b>Menu</b></nav><a href="/menu">A menu entry with many words</a></nav><ul>'),
                    _cards(card), F.lit("</ul>"))
    made = t.documents.select(F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string"),
                                       F.lit("/")).alias("url"), body.alias("body"))
    return pages.html_posts(made).select(
        F.regexp_extract("page_url", r"(\d+)/$", 1).cast("bigint").alias("doc_id"), "url", "title",
        F.col("rank").cast("bigint").alias("rank"))


_CARD = _SQ.format(r"regexp_replace(translate(line, '[]', '()'), '(^|\s)#{1,6}\s+|\*\*|__|`|\|', ' ', 'g')")


@query(_posts_sql(f"CASE WHEN length({_CARD}) > 600 THEN regexp_replace(substr({_CARD}, 1, 600), ' [^ ]*$', '') || '…'"
                  f" ELSE {_CARD} END"))
def markdown_posts(t: Tables) -> DataFrame:
    """The same from markdown, where a card's text cannot hold brackets."""
    def card(line, pos):
        return F.concat(F.lit("* ["), F.translate(line, "[]", "()"), F.lit("]("), pos, F.lit(' "t")'))
    made = t.documents.select(
        F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string"), F.lit("/")).alias("url"),
        F.concat(F.lit("![logo](/l.png)\n"), _cards(card)).alias("body"))
    return pages.markdown_posts(made).select(
        F.regexp_extract("page_url", r"(\d+)/$", 1).cast("bigint").alias("doc_id"), "url", "title",
        F.col("rank").cast("bigint").alias("rank"))


@query("""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h,
    generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)
SELECT url, min(page_id) AS query_no, arg_min(i, page_id * 100000 + i) AS n FROM (
  SELECT page_id, i, 'https://www.s.example/' || replace(h, '/', '') AS url FROM p) GROUP BY url""")
def search_union(t: Tables) -> DataFrame:
    """Every page's links as the results of one query; a link counts where it came first."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = F.transform(hrefs, lambda h: F.struct(
        F.concat(F.lit("https://www.s.example/"), F.replace(h, F.lit("/"))).alias("url"),
        h.alias("title"), F.lit("2 days ago").alias("date")))
    made = t.pages.select(F.col("page_id").cast("string").alias("query"), F.to_json(F.struct(
        F.struct(rows.alias("news")).alias("data"))).alias("body"))
    found = pages.search_rows(made).withColumn("query_no", F.col("query").cast("bigint"))
    return pages.first_query_wins(found).select("url", "query_no", F.col("n").cast("bigint").alias("n"))


@query("""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h,
    generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS i FROM pages)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rank,
  'https://s.example/blog/' || page_id || '-' || i AS url,
  CASE WHEN i % 2 = 1 THEN page_id || ' ' || i ELSE 'Titled ' || i END AS title
FROM p QUALIFY rank <= 30""")
def listing_links(t: Tables) -> DataFrame:
    """Site listings with plain links and titled ones, social links in between."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    entry = F.transform(hrefs, lambda h, i: F.concat(
        F.lit("https://s.example/blog/"), F.col("page_id").cast("string"), F.lit("-"),
        (i + 1).cast("string")))
    said = F.transform(entry, lambda e, i: F.when(i % 2 == 0, F.concat(F.lit('"'), e, F.lit('"')))
                       .otherwise(F.concat(F.lit('{"url": "'), e, F.lit('", "title": "**Titled** '),
                                           (i + 1).cast("string"), F.lit('"}'))))
    made = t.pages.select(F.col("page_id").cast("string").alias("url"), F.concat(
        F.lit('{"links": ["https://x.com/a", "mailto:a@b",'), F.array_join(said, ","), F.lit("]}"))
        .alias("body"))
    return pages.listing_links(made).select(
        F.col("page_url").cast("bigint").alias("page_id"), F.col("rank").cast("bigint").alias("rank"),
        "url", "title")


@query(f"""WITH {DOC_SQL} SELECT id, 'https://d.example/' || id AS url,
  CASE WHEN length(s) > 300 THEN regexp_replace(substr(s, 1, 300), ' [^ ]*$', '') || '…' ELSE s END
    AS headline, date_trunc('day', published_at) - INTERVAL 330 MINUTE AS published_at FROM (
  SELECT *, {_SQ.format("replace(replace(replace(replace(regexp_replace(headline, '<[^>]+>', ' ', 'g'), '&quot;', '\"'), "
                        "'&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS s
  FROM docs) WHERE s <> ''""")
def listing_answers(t: Tables) -> DataFrame:
    """Headlines as listing answers in every wrapping seen: fenced, wrapped, cut short."""
    docs = doc_articles(t)
    row = F.to_json(F.struct("headline", F.concat(F.lit("/"), F.col("id").cast("string")).alias("url"),
                             F.date_format("published_at", "d MMM yyyy").alias("published")))
    kind = F.col("id") % 4
    body = (F.when(kind == 0, F.concat(F.lit("```json\n["), row, F.lit("]\n```")))
            .when(kind == 1, F.concat(F.lit('{"articles": ['), row, F.lit("]}")))
            .when(kind == 2, F.to_json(F.struct(F.concat(F.lit("["), row, F.lit("]")).alias("content"))))
            .otherwise(F.concat(F.lit("["), row, F.lit(', {"headline": "cut'))))
    made = docs.select(F.lit("https://d.example/").alias("url"), body.alias("body"))
    items, _ = pages.answer_items(made)
    return items.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("id"), "url",
                        "headline", "published_at")


# --- events and social posts --------------------------------------------------------------

@query("""SELECT event_id, 'https://luma.com/e' || event_id AS url, 'Meetup ' || event_id AS title,
  date_trunc('second', ts) AS starts_at, event_type = 'view' AS online, 'Pune' AS city,
  sha1('u' || user_id || chr(10) || 'https://luma.com/e' || event_id) AS uid
FROM events WHERE event_type IN ('view', 'click', 'signup') AND (event_type <> 'signup' OR user_id < 50)""")
def calendar_events(t: Tables) -> DataFrame:
    """Events as calendar rows: errors are diagnostics, purchases have no start, some are abroad."""
    body = F.to_json(F.struct(
        F.concat(F.lit("/e"), F.col("event_id").cast("string")).alias("url"),
        F.concat(F.lit(" Meetup  "), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_type") != "purchase", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("startAt"), (F.col("event_type") == "view").alias("isOnline"), F.lit("Pune").alias("city"),
        F.when(F.col("event_type") == "signup", F.when(F.col("user_id") < 50, "in").otherwise("us"))
        .otherwise("IN").alias("countryCode"),
        F.when(F.col("event_type") == "error", True).alias("_diagnostic")))
    made = t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_key"),
                           F.lit(True).alias("india_only"), body.alias("body"))
    return payloads.calendar_events(made).select(
        F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("event_id"), "url", "title",
        "starts_at", "online", "city", "uid")


@query("""WITH e AS (SELECT *, event_type = 'view' AS own FROM events WHERE event_type <> 'error')
SELECT event_id, CASE WHEN own THEN 'https://f.example/e/' || event_id ELSE 'https://f.example/events' END
    AS url, own AS own_link, 'Talk ' || event_id AS title,
  date_trunc('day', ts) - INTERVAL 330 MINUTE + CASE WHEN event_type = 'click'
    THEN INTERVAL 18 HOUR ELSE INTERVAL 0 HOUR END AS starts_at, event_type <> 'click' AS date_only
FROM e""")
def page_event_answers(t: Tables) -> DataFrame:
    """Events as a model's answer about a page: days, times, links of their own or none."""
    when = F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy-MM-dd'T18:00'")).when(
        F.col("event_type") == "view", F.date_format("ts", "d MMMM yyyy")).when(
        F.col("event_type") == "error", "to be announced").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    row = F.struct(
        F.concat(F.lit("Talk "), F.col("event_id").cast("string")).alias("title"), when.alias("start"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("e/"), F.col("event_id").cast("string")))
        .alias("url"))
    body = F.concat(F.lit('Here you go: {"note": "x", "events": ['), F.to_json(row), F.lit("]}"))
    made = t.events.select(F.col("event_id").cast("string").alias("source_key"),
                           F.lit("https://f.example/events").alias("page_url"), body.alias("body"))
    return payloads.page_events(made).select(
        F.col("source_key").cast("bigint").alias("event_id"), "url", "own_link", "title", "starts_at",
        "date_only")


@query(f"""WITH c AS (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: {_SQ.format('x')}), lambda x: x <> ''), chr(10)) AS body FROM conversations)
SELECT conv_id, turn, substr(body, 1, 4000) AS content, role AS author,
  role = 'assistant' OR turn = 4 AS repost, TIMESTAMP '2024-01-01' + to_minutes(turn) AS posted_at
FROM c WHERE role <> 'system' AND body <> ''""")
def social_payloads(t: Tables) -> DataFrame:
    """Turns as social rows: system turns are notices, assistants' are written by another account."""
    millis = (F.lit(1704067200) + F.col("turn") * 60) * 1000
    body = F.to_json(F.struct(
        F.when(F.col("role") == "system", "notice").otherwise("post").alias("type"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("content"), F.lit("https://s.example/p").alias("linkedinUrl"),
        F.struct(F.col("role").alias("name"), F.upper("role").alias("universalName")).alias("author"),
        F.when(F.col("turn") == 4, True).alias("isRepost"),
        F.struct(millis.alias("timestamp")).alias("postedAt")))
    made = t.conversations.select(F.col("conv_id").alias("source_id"), F.lit("user").alias("slug"),
                                  F.col("turn").alias("pos"), body.alias("body"))
    return payloads.social_posts(made).select(
        F.col("source_id").alias("conv_id"), F.col("pos").alias("turn"), "content", "author", "repost",
        "posted_at")


@query("""SELECT s_suppkey, 'https://www.linkedin.com/company/supplier-' || s_suppkey || '/' AS url,
  'company' AS kind, CAST(NULL AS VARCHAR) AS reason FROM supplier WHERE s_nationkey < 15
UNION ALL SELECT s_suppkey, NULL, NULL, 'single post' FROM supplier WHERE s_nationkey BETWEEN 15 AND 19
UNION ALL SELECT s_suppkey, NULL, NULL, 'not a social link' FROM supplier WHERE s_nationkey > 19""")
def social_accounts(t: Tables) -> DataFrame:
    """Pasted account links settled to one form, or why they are refused."""
    from wirefold.functions.urls import social_account
    key = F.col("s_suppkey").cast("string")
    said = (F.when(F.col("s_nationkey") < 15, F.concat(
        F.lit(" in.linkedin.com/Company/SUPPLIER-"), key, F.lit("/posts/?x=1")))
        .when(F.col("s_nationkey") < 20, F.lit("https://linkedin.com/posts/x"))
        .otherwise(F.concat(F.lit("https://s.example/in/"), key)))
    got = t.supplier.select("s_suppkey", social_account(said).alias("a"))
    return got.select("s_suppkey", "a.url", "a.kind", "a.reason")


@query("""SELECT 'n-' || n_nationkey AS key, CASE WHEN n_regionkey = 0 THEN 'unknown site via'
  WHEN n_regionkey = 1 THEN 'site read without url' WHEN n_regionkey = 2
  THEN 'no site read and no reason' END AS problem FROM nation WHERE n_regionkey < 3
UNION ALL SELECT 'n-' || n_nationkey, 'own site read as calendar' FROM nation WHERE n_regionkey = 4""")
def registry_problems(t: Tables) -> DataFrame:
    """Nations as firm entries, most with something wrong in them."""
    r = F.col("n_regionkey")
    site = F.when(r != 2, F.struct(
        F.when(r == 0, "fax").otherwise("rss").alias("via"), F.when(r != 1, "https://n.example").alias("url"),
        F.lit(None).cast("string").alias("link_pattern"), F.lit(None).cast("string").alias("note")))
    event = F.struct(F.lit("luma").alias("via"), F.lit("https://l.example").alias("url"),
                     F.lit(False).alias("india_only"), (r == 4).alias("site"),
                     F.lit("").alias("note"))
    firms = t.nation.select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("key"),
                            site.alias("site"), F.lit(None).cast("string").alias("no_site"),
                            F.array(event).alias("events"))
    return registry.problems(firms)


# --- applying answers -----------------------------------------------------------------------

def _answered(packed: DataFrame, *fields) -> DataFrame:
    """One fenced answer per batch, made of the packed rows themselves."""
    row = F.to_json(F.struct(F.col("number").alias("i"), *fields))
    return packed.groupBy("batch").agg(F.concat(
        F.lit("```json\n["), F.array_join(F.collect_list(row), ","), F.lit("]\n```")).alias("body"))


@query(f"""WITH {ORDER_SQL} SELECT id AS article_id, company, CASE source WHEN 'BUILDING' THEN 'Seed'
  WHEN 'MACHINERY' THEN 'Series A' ELSE 'Other' END AS stage,
  CASE source WHEN 'BUILDING' THEN 'Pre-Series A' WHEN 'MACHINERY' THEN 'Series A1' ELSE 'Debt' END
    AS round_label, CASE WHEN nation < 12 THEN 'Rs ' || nation || ' crore' END AS amount,
  'Nation ' || nation || '; Shared Fund' AS investors
FROM arts WHERE canonical_id IS NULL AND category = 'Funding' AND price > 100000""")
def apply_round_answers(t: Tables) -> DataFrame:
    """Rounds read from Funding stories; those already read are not asked about."""
    articles = order_articles(t)
    done = articles.where("price <= 100000").select(F.col("id").alias("article_id"))
    packed = labels.pack(labels.pending_rounds(articles, done), labels.ROUNDS_BATCH,
                         labels.story_line(labels.ROUNDS_CHARS),
                         F.col("published_at").desc_nulls_last(), F.col("id").asc())
    said = F.when(F.col("source") == "BUILDING", "pre series a").when(
        F.col("source") == "MACHINERY", "series a1").otherwise("debt")
    number = F.col("nation").cast("string")
    answers = _answered(
        packed, F.lit("undisclosed").alias("company"), F.lit("?").alias("stage"), said.alias("round"),
        F.when(F.col("nation") < 12, F.concat(F.lit("Rs "), number, F.lit(" crore."))).otherwise("n/a")
        .alias("amount"), F.array(F.concat(F.lit("Nation "), number), F.lit("Shared Fund"),
                                  F.concat(F.lit("NATION "), number)).alias("investors"))
    return labels.apply_rounds(packed, answers, READ_AS_OF).drop("extracted_at")


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 'Funding' ELSE 'Other' END AS kind,
  'Turn ' || turn AS headline, CASE WHEN role = 'user' THEN 'Seed' END AS round_label,
  CASE WHEN role = 'user' THEN 'A; B' END AS investors FROM conversations WHERE turn < 3
UNION ALL SELECT conv_id * 1000 + turn, NULL, NULL, NULL, NULL FROM conversations WHERE turn >= 3""")
def apply_social_answers(t: Tables) -> DataFrame:
    """Turns read by the model, the later ones left unanswered and so still waiting."""
    none = F.lit(None).cast("string")
    posts = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("source_id"),
        F.col("text").alias("content"), F.col("role").alias("author"), F.lit(False).alias("repost"),
        none.alias("kind"), none.alias("headline"), none.alias("company"), none.alias("round_label"),
        none.alias("amount"), none.alias("investors"), F.lit(None).cast("timestamp").alias("classified_at"))
    accounts = t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").alias("id"), F.lit("Account").alias("label"))
    packed = labels.pack(labels.pending_social_posts(posts, accounts), labels.SOCIAL_BATCH,
                         labels.social_post_line(), F.col("id").asc())
    turn = F.col("id") % 1000
    answers = _answered(
        packed.where(turn < 3), F.when(F.col("author") == "user", "investment").otherwise("chat")
        .alias("kind"), F.concat(F.lit("Turn "), turn.cast("string")).alias("headline"),
        F.lit("seed").alias("round"), F.lit("A, a and B").alias("investors"))
    return labels.apply_social_posts(posts, packed, answers, DOC_AS_OF).select(
        "id", "kind", "headline", "round_label", "investors")


@query("""SELECT p_partkey AS id, ['Investment', 'Portfolio news', 'Other'][1 + p_size % 3] AS kind,
  p_name AS company, 'Series B' AS round_label FROM part""")
def apply_firm_answers(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    posts = t.part.select(
        F.col("p_partkey").alias("id"), F.lit("f").alias("firm"), F.col("p_name").alias("title"),
        F.col("p_type").alias("snippet"), none.alias("kind"), none.alias("headline"),
        none.alias("company"), none.alias("round_label"), none.alias("amount"), "p_size",
        F.lit(None).cast("timestamp").alias("classified_at"))
    packed = labels.pack(
        labels.pending_firm_posts(posts).withColumn("firm_label", F.lit("Firm")), labels.FIRM_BATCH,
        labels.firm_post_line(), F.col("id").asc())
    said = F.get(F.array(F.lit("investments"), F.lit("PORTFOLIO"), F.lit("essay")), F.col("p_size") % 3)
    answers = _answered(packed, said.alias("kind"), F.col("title").alias("company"),
                        F.lit("SERIES  b").alias("round"))
    return labels.apply_firm_posts(posts, packed, answers, DOC_AS_OF).select(
        "id", "kind", "company", "round_label")


@query(f"""WITH RECURSIVE {ORDER_SQL}, r AS (
  SELECT id, company AS k, epoch(published_at) AS t FROM arts WHERE category = 'Funding'),
pick AS (
  SELECT k, min(id) AS id, list_value(arg_min(t, id)) AS kept FROM r WHERE t IS NOT NULL GROUP BY k
  UNION ALL
  SELECT p.k, min(r.id), list_append(any_value(p.kept), arg_min(r.t, r.id))
  FROM pick p JOIN r ON r.k = p.k AND r.id > p.id AND r.t IS NOT NULL
    AND len(list_filter(p.kept, lambda x: abs(x - r.t) <= 1209600)) = 0
  GROUP BY p.k, p.id),
first AS (SELECT min(id) AS id, arg_min(coalesce(t, -1), id) AS t FROM r GROUP BY k)
SELECT id, company, 'Seed' AS stage, id IN (SELECT id FROM pick) OR id IN (SELECT id FROM first WHERE t = -1) AS kept
FROM arts""")
def apply_added_answers(t: Tables) -> DataFrame:
    """Orders as added-site posts: answered, and kept when their raise is new."""
    none = F.lit(None).cast("string")
    rows = order_articles(t).select(
        "id", "company", F.lit(1).alias("source_id"), "headline", F.col("description").alias("snippet"),
        "published_at", F.col("category").alias("said"), none.alias("stage"), none.alias("round_label"),
        none.alias("amount"), none.alias("investors"), F.lit(None).cast("timestamp").alias("extracted_at"),
        F.lit(False).alias("kept"))
    posts = rows.drop("said").withColumn("company", none)
    packed = labels.pack(labels.pending_added_rounds(rows).withColumn("description", F.col("snippet")),
                         labels.ADDED_BATCH, labels.story_line(labels.ROUNDS_CHARS), F.col("id").asc())
    answers = _answered(packed, F.col("company").alias("company"), F.lit("Seed").alias("stage"),
                        F.lit("seed").alias("round"), (F.col("said") == "Funding").alias("raise"))
    known = rows.where("said = 'Other'").withColumn("stage", F.lit("Series A"))
    return labels.apply_added_rounds(posts, packed, answers, known, DOC_AS_OF).select(
        "id", "company", "stage", "kept")


@query(f"""WITH {DOC_SQL} SELECT id, CASE WHEN description IS NULL OR published_at IS NULL
    THEN CASE WHEN length('Meta about ' || id) > coalesce(length(description), 0)
      THEN 'Meta about ' || id ELSE description END ELSE description END AS description,
  coalesce(published_at, TIMESTAMP '2026-01-02 00:00:00') AS published_at FROM docs""")
def apply_page_metadata(t: Tables) -> DataFrame:
    """Stories short of a description or date take them from their page."""
    from wirefold.functions.markup import page_meta
    none = F.lit(None)
    rows = doc_articles(t).select(
        "id", F.col("id").cast("string").alias("url"), "description", "published_at",
        none.cast("bigint").alias("canonical_id"), none.cast("string").alias("description_origin"))
    html = F.concat(F.lit('<head><meta property="og:description" content=" Meta  about '), F.col("url"),
                    F.lit('"><meta name="pubdate" content="2026-01-02T05:30:00+05:30"></head>'))
    meta = labels.pending_descriptions(rows).select("url", page_meta(html).alias("m")).select(
        "url", "m.description", "m.published_at")
    return labels.apply_page_meta(rows, meta).select("id", "description", "published_at")
