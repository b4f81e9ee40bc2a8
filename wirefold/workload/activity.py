"""Firms, events and followed accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators import labels, sinks
from wirefold.plans import events, firms, rounds, social
from wirefold.sources.registry import FIRMS, as_table
from wirefold.workload.base import ORDER_SQL, Tables, query, read_log
from wirefold.workload.rounds import funding, searched


def nations_as_firms(t: Tables) -> DataFrame:
    """Nations as the firm registry: known by number, as investors name them."""
    number = F.col("n_nationkey").cast("string")
    made = t.nation.select(
        F.concat(F.lit("n-"), number).alias("key"), F.col("n_name").alias("label"),
        F.lit("https://n.example").alias("home"),
        F.from_json(F.lit('{"via": "rss", "url": "https://n.example/feed"}'),
                    "via string, url string, link_pattern string, note string").alias("site"),
        F.when(F.col("n_nationkey") < 5, "search").alias("search"),
        F.lit(None).cast("string").alias("no_site"),
        F.array(F.concat(F.lit(r"\bnation "), number, F.lit(r"\b")),
                F.concat(F.lit("^shared fund "), number)).alias("aliases"),
        F.array().cast("array<struct<via:string,url:string,india_only:boolean,site:boolean,"
                       "note:string>>").alias("events"), F.lit(None).cast("string").alias("no_events"))
    return as_table(t.spark, made, FIRMS)


def news(t: Tables) -> DataFrame:
    articles, made = funding(t)
    labels = t.spark.createDataFrame([], "name string, label string")
    return rounds.all_rounds(rounds.feed_rounds(made, articles, labels),
                             rounds.web_rounds(searched(t)))


def posts(t: Tables) -> DataFrame:
    """Suppliers' parts as posts of their nation: reviewed, some of them Other."""
    kind = F.get(F.array(F.lit("Investment"), F.lit("Portfolio news"), F.lit("Other")),
                 F.col("p_size") % 3)
    firm = F.concat(F.lit("n-"), (F.col("p_size") % 25).cast("string"))
    return t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "pasted-1")
        .when(F.col("p_type") == "SMALL", "gone").otherwise(firm).alias("firm"),
        F.when(F.col("p_type") == "LARGE", "search").otherwise("rss").alias("via"),
        F.lit("https://p.example").alias("url"), F.col("p_name").alias("title"),
        F.lit("").alias("headline"), F.col("p_name").alias("company"),
        F.lit("Seed").alias("round_label"), F.lit(None).cast("string").alias("amount"),
        kind.alias("kind"), F.timestamp_seconds(
            F.lit(915148800) + F.col("p_partkey") * 86400).alias("published_at"),
        F.lit(False).alias("date_approx"), F.lit("1999-01-01").cast("timestamp").alias("classified_at"))


def added_sites(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(1, "https://www.site.example/x", "A site", "n-3")],
                                   "id long, url string, label string, firm string")


@query(f"""WITH {ORDER_SQL}, t AS (
  SELECT 'feed-' || id AS id, 'Nation ' || nation || '; Shared Fund' AS investors FROM arts
  WHERE canonical_id IS NULL AND category = 'Funding' AND price > 100000
  UNION ALL SELECT 'web-' || ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey), 'Nation ' || l_linenumber
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')
SELECT t.id, 'n-' || n_nationkey AS firm FROM t JOIN nation
ON regexp_matches(investors, '(?i)(\\bnation ' || n_nationkey || '\\b)|(^shared fund ' || n_nationkey || ')')
""")
def firm_alias_join(t: Tables) -> DataFrame:
    return firms.named_firms(news(t), nations_as_firms(t), F.array_join("investors", "; ")).select(
        "id", "firm")


_POST_SQL = """posts AS (SELECT p_partkey AS id,
  CASE p_type WHEN 'PROMO' THEN 'n-3' ELSE 'n-' || (p_size % 25) END AS firm,
  CASE p_type WHEN 'PROMO' THEN 'added' WHEN 'LARGE' THEN 'search' ELSE 'site' END AS origin,
  CASE p_type WHEN 'PROMO' THEN 'site.example' WHEN 'LARGE' THEN 'News search'
    ELSE 'Firm website' END AS source_label,
  ['Investment', 'Portfolio news', 'Other'][1 + p_size % 3] AS kind, p_name AS company,
  TIMESTAMP '1999-01-01' + to_days(CAST(p_partkey AS INTEGER)) AS published_at
  FROM part WHERE p_type <> 'SMALL')"""


@query(f"""WITH {_POST_SQL} SELECT 'site-' || id AS id, firm, n_name AS firm_label, kind, company,
  published_at, origin, source_label FROM posts JOIN nation ON firm = 'n-' || n_nationkey
  WHERE kind <> 'Other'""")
def firm_posts(t: Tables) -> DataFrame:
    return firms.site_posts(posts(t), nations_as_firms(t), added_sites(t)).select(
        "id", "firm", "firm_label", "kind", "company", "published_at", "origin", "source_label")


@query(f"WITH {_POST_SQL} SELECT count(*) FILTER (kind = 'Other') AS hidden_other FROM posts")
def hidden_other(t: Tables) -> DataFrame:
    return firms.hidden_other(posts(t), nations_as_firms(t), added_sites(t))


def _deals_sql(sites: str) -> str:
    """``shown``: all posts and rounds, one row per deal. ``sites``: SQL for the posts of parts of type SMALL."""
    return f"""{ORDER_SQL}, {_POST_SQL}, st(source, stage) AS (VALUES ('BUILDING', 1), ('MACHINERY', 1),
  ('AUTOMOBILE', 1), ('HOUSEHOLD', 1), ('FURNITURE', 1)),
own AS (SELECT 'site-' || id AS id, id AS row_id, firm, n_name AS firm_label, kind, company, 'Seed' AS round,
    published_at, origin, source_label FROM posts JOIN nation ON firm = 'n-' || n_nationkey WHERE kind <> 'Other'
  {sites}),
told AS (SELECT 'news-' || id AS id, id AS row_id, company, 'Pre-Seed' AS round, published_at, source AS source_label,
    'Nation ' || nation || '; Shared Fund' AS investors FROM arts JOIN st USING (source)
    WHERE canonical_id IS NULL AND category = 'Funding' AND price > 100000
  UNION ALL SELECT 'web-' || ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey),
    (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey, 'Supplier ' || l_suppkey, 'Seed', l_shipdate, 'news.example',
    'Nation ' || l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
every AS (SELECT *, CASE origin WHEN 'site' THEN 1 WHEN 'added' THEN 2 ELSE 3 END AS place FROM own
  UNION ALL SELECT id || '-n-' || n_nationkey, row_id, 'n-' || n_nationkey, n_name, 'Investment', company, round,
    published_at, 'news', source_label, 4 FROM told JOIN nation ON regexp_matches(investors,
    '(?i)(\\bnation ' || n_nationkey || '\\b)|(^shared fund ' || n_nationkey || ')')),
r AS (SELECT id, firm, lower(trim(company)) AS k, epoch(published_at) AS t,
  row_number() OVER (PARTITION BY firm, lower(trim(company)) ORDER BY place, row_id, id) AS n FROM every),
pick AS (SELECT firm, k, 1::BIGINT AS n, list_value(coalesce(t, -1)) AS kept FROM r WHERE n = 1
  UNION ALL SELECT p.firm, p.k, min(r.n), list_append(any_value(p.kept), arg_min(r.t, r.n))
  FROM pick p JOIN r ON r.firm = p.firm AND r.k = p.k AND r.n > p.n AND r.t IS NOT NULL AND p.kept[1] <> -1
    AND len(list_filter(p.kept, lambda x: abs(x - r.t) <= 1209600)) = 0 GROUP BY p.firm, p.k, p.n),
shown AS (SELECT every.* FROM every JOIN r USING (id, firm) JOIN pick USING (firm, k, n))"""


_ROWS_SQL = f"""WITH RECURSIVE {_deals_sql('')} SELECT id, firm, firm_label, kind, company, round, published_at, origin,
  source_label FROM shown WHERE published_at >= TIMESTAMP '1999-02-28 18:30:00'
  AND published_at < TIMESTAMP '2000-08-31 18:30:00'"""
_ROWS = ("id", "firm", "firm_label", "kind", "company", "round", "published_at", "origin", "source_label")


def _activity(t: Tables, firm: str | None = None) -> DataFrame:
    registry, added = nations_as_firms(t), added_sites(t)
    own = firms.site_posts(posts(t), registry, added)
    return firms.firm_activity(own, firms.news_posts(news(t), registry), "1999-03-01", "2000-08-31",
                               firm=firms.checked_firm(firm, registry, added)).select(*_ROWS)


@query(_ROWS_SQL)
def firm_activity(t: Tables) -> DataFrame:
    """Posts and rounds of all firms, one row per deal."""
    return _activity(t)


@query(_ROWS_SQL + " AND firm = 'n-3'")
def firm_activity_picked(t: Tables) -> DataFrame:
    """The rows of one firm, picked after deals were merged."""
    return _activity(t, "n-3")


_OWN_SITE = """UNION ALL SELECT 'site-' || p_partkey, p_partkey, 'pasted-2', 'Own site',
    ['Investment', 'Portfolio news', 'Other'][1 + p_size % 3], p_name, 'Seed',
    TIMESTAMP '1999-01-01' + to_days(CAST(p_partkey AS INTEGER)), 'added', 'own.example'
  FROM part WHERE p_type = 'SMALL' AND p_size % 3 <> 2"""


@query(f"""WITH RECURSIVE {_deals_sql(_OWN_SITE)}, reads AS (SELECT user_id, event_id AS id, ts,
    CASE event_type WHEN 'view' THEN 'search' ELSE 'rss' END AS via,
    CASE event_type WHEN 'error' THEN 'code' ELSE '' END AS error FROM events),
last AS (SELECT 'n-' || (user_id % 25) AS firm, via, arg_max(ts, id) AS last_read, arg_max(error, id) AS last_error
  FROM reads GROUP BY ALL),
site AS (SELECT user_id, arg_max(ts, id) AS last_read, arg_max(error, id) AS last_error FROM reads
  WHERE user_id IN (1, 2) GROUP BY 1),
ways AS (SELECT firm, label, 'https://n.example' AS home, read_label, last_read, last_error FROM
    (SELECT 'n-' || n_nationkey AS firm, n_name AS label, 'rss' AS via, 'own website feed' AS read_label FROM nation
      UNION ALL SELECT 'n-' || n_nationkey, n_name, 'search', 'news search, via Firecrawl' FROM nation WHERE n_nationkey < 5)
    LEFT JOIN last USING (firm, via)
  UNION ALL SELECT 'n-3', n_name, 'https://n.example', 'added by you, from its feed', site.last_read, site.last_error
    FROM nation LEFT JOIN site ON user_id = 1 WHERE n_nationkey = 3
  UNION ALL SELECT 'pasted-2', 'Own site', 'https://own.example/x', 'added by you, from its news page', site.last_read,
    site.last_error FROM (SELECT 2 AS u) LEFT JOIN site ON user_id = u),
n AS (SELECT firm, count(*) AS count FROM shown GROUP BY 1)
SELECT firm, label, home, read_label, coalesce(count, 0) AS count, last_read, nullif(last_error, '') AS last_error
FROM ways LEFT JOIN n USING (firm)""")
def firm_list(t: Tables) -> DataFrame:
    """Every firm with its merged rows and the health of its reads: sites readers added are reads of the firm
    they are tied to, or firms of their own."""
    registry, reads = nations_as_firms(t), read_log(t).withColumn(
        "error", F.when(F.col("error").isNotNull(), "code")).withColumn(
        "firm", F.concat(F.lit("n-"), (F.col("source_id") % 25).cast("string"))).withColumn(
        "via", F.when(F.col("kind") == "view", "search").otherwise("rss"))
    sites = t.spark.createDataFrame(
        [(1, "https://www.site.example/x", "A site", "n-3", "rss"), (2, "https://own.example/x", "Own site", None, "html")],
        "id long, url string, label string, firm string, via string")
    mine = posts(t).withColumn("firm", F.when(F.col("firm") == "gone", "pasted-2").otherwise(F.col("firm")))
    own = firms.site_posts(mine, registry, sites)
    rows = firms.firm_activity(own, firms.news_posts(news(t), registry))
    shown = own.where("firm = 'pasted-2'").select(F.lit(2).alias("source_id"))
    return firms.firm_counts(rows, registry, reads, firms.added_sources(sites, shown, reads)).select(
        "firm", "label", "home", "read_label", "count", "last_read", "last_error")


@query(f"""WITH {_POST_SQL}, reads AS (SELECT 'n-' || (user_id % 25) AS firm,
    CASE event_type WHEN 'view' THEN 'search' ELSE 'rss' END AS via, event_id AS id, ts,
    CASE event_type WHEN 'error' THEN 'code' END AS error FROM events),
last AS (SELECT firm, via, arg_max(ts, id) AS last_read,
    arg_max(coalesce(error, ''), id) AS last_error FROM reads GROUP BY ALL),
ways AS (SELECT 'n-' || n_nationkey AS firm, n_name AS label, 'rss' AS via FROM nation
  UNION ALL SELECT 'n-' || n_nationkey, n_name, 'search' FROM nation WHERE n_nationkey < 5),
n AS (SELECT firm, count(*) AS count FROM posts WHERE kind <> 'Other' GROUP BY 1)
SELECT firm, label, via, via = 'rss' AS is_site, coalesce(count, 0) AS count, last_read,
  nullif(last_error, '') AS last_error
FROM ways LEFT JOIN n USING (firm) LEFT JOIN last USING (firm, via)""")
def firm_activity_counts(t: Tables) -> DataFrame:
    registry = nations_as_firms(t)
    own = firms.site_posts(posts(t), registry, added_sites(t))
    reads = read_log(t).select(
        F.concat(F.lit("n-"), (F.col("source_id") % 25).cast("string")).alias("firm"),
        F.when(F.col("kind") == "view", "search").otherwise("rss").alias("via"), "id", "started_at",
        F.when(F.col("error").isNotNull(), "code").alias("error"))
    return firms.firm_counts(own, registry, reads).select(
        "firm", "label", "via", "is_site", "count", "last_read", "last_error")


# --- events --------------------------------------------------------------------------------

def listed_events(t: Tables) -> DataFrame:
    """Views and clicks as events of the user's page: views last the day, some share a link."""
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("site-"), F.col("user_id").cast("string"))
        .alias("source_key"), F.concat(F.lit("https://e.example/"), k, F.lit("/"),
                                       F.floor("value").cast("string")).alias("url"),
        F.col("event_type").alias("title"), F.col("ts").alias("starts_at"),
        F.when(F.col("event_type") == "click", F.col("ts") + F.make_dt_interval(hours=F.lit(6)))
        .alias("ends_at"), (F.col("event_type") == "view").alias("date_only"),
        F.lit("Pune").alias("city"), F.lit(None).cast("string").alias("venue"),
        F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "view", False)
        .alias("online"))


def event_pages(t: Tables) -> DataFrame:
    """Users as event sources; the first hundred stand for the registry."""
    number = F.col("user_id").cast("string")
    return t.events.select("user_id").distinct().select(
        F.concat(F.lit("site-"), number).alias("source_key"), F.lit("luma").alias("via"),
        F.concat(F.lit("https://e.example/"), number, F.lit("/0/")).alias("source_url"),
        (F.col("user_id") >= 100).alias("custom"),
        F.concat(F.lit("org-"), (F.col("user_id") % 7).cast("string")).alias("organiser_key"),
        F.concat(F.lit("Org "), (F.col("user_id") % 7).cast("string")).alias("organiser"),
        F.lit("Website").alias("via_label"), F.lit(24).alias("every_hours"))


_EVENT_SQL = """ev AS (
  SELECT event_id AS id, user_id AS u, event_type AS title, ts AS starts_at,
    'https://e.example/' || json_extract_string(props, '$.k') || '/' || CAST(floor(value) AS BIGINT) AS url,
    CASE event_type WHEN 'click' THEN ts + INTERVAL 6 HOUR WHEN 'view' THEN ts + INTERVAL 1 DAY
      ELSE ts END AS until FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY url, own ORDER BY u >= 100, id) AS n FROM (
  SELECT *, url <> 'https://e.example/' || u || '/0' AS own FROM ev)),
shown AS (SELECT *, CASE WHEN until >= TIMESTAMP '2024-01-15 12:00:00' THEN 'upcoming' ELSE 'past' END AS w
  FROM r WHERE NOT own OR n = 1)"""


def shown(t: Tables) -> DataFrame:
    return events.shown_events(listed_events(t), event_pages(t), F.lit("2024-01-15 12:00:00").cast(
        "timestamp"))


@query(f"""WITH {_EVENT_SQL} SELECT id, title, starts_at, w AS "when",
  'org-' || (u % 7) AS organiser_key FROM shown""")
def upcoming_past_split(t: Tables) -> DataFrame:
    return shown(t).select("id", "title", "starts_at", "when", "organiser_key")


@query(f"""WITH {_EVENT_SQL} SELECT 'org-' || (u % 7) AS organiser_key, 'Org ' || (u % 7) AS organiser,
  count(*) FILTER (w = 'upcoming') AS upcoming, count(*) FILTER (w = 'past') AS past FROM shown GROUP BY 1, 2""")
def organiser_counts(t: Tables) -> DataFrame:
    return events.organiser_counts(shown(t))


@query(f"""WITH {_EVENT_SQL} SELECT 'Org ' || (u % 7) AS "Organiser", title AS "Event",
  starts_at + INTERVAL 330 MINUTE AS "Starts (IST)",
  CASE WHEN title = 'click' THEN until + INTERVAL 330 MINUTE END AS "Ends (IST)", 'Pune' AS "City",
  '' AS "Venue", CASE title WHEN 'signup' THEN 'Online' WHEN 'view' THEN 'In person' ELSE '' END
    AS "Format", 'Website' AS "Found via", url AS "Link" FROM shown WHERE w = 'upcoming'""")
def export_events(t: Tables) -> DataFrame:
    return sinks.export_events(events.listing(shown(t), "upcoming"))


@query("""WITH e AS (SELECT user_id, count(*) AS events, arg_max(ts, event_id) AS last_read,
    arg_max(CASE event_type WHEN 'error' THEN 'code ' || json_extract_string(props, '$.k')
      ELSE '' END, event_id) AS last_error FROM events GROUP BY 1)
SELECT 'site-' || user_id AS source_key, events, last_read, nullif(last_error, '') AS last_error
FROM e""")
def event_source_table(t: Tables) -> DataFrame:
    reads = read_log(t).withColumn("source_key", F.concat(
        F.lit("site-"), F.col("source_id").cast("string")))
    return events.source_table(event_pages(t), listed_events(t), reads).select(
        "source_key", "events", "last_read", "last_error")


# --- followed accounts ----------------------------------------------------------------------

def account_posts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as posts of their conversation; assistant turns are reposts."""
    kind = F.get(F.array(F.lit("Funding"), F.lit("News"), F.lit("Other"), F.lit(None)),
                 (F.col("turn") % 4).cast("int"))
    made = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("source_id"),
        F.col("text").alias("content"), F.col("role").alias("author"),
        (F.col("role") == "assistant").alias("repost"), kind.alias("kind"), F.lit("").alias("headline"),
        F.lit("Acme").alias("company"), F.when(F.col("role") == "user", "Series A").alias("round_label"),
        F.lit(None).cast("string").alias("amount"), F.lit("A; B").alias("investors"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600).alias("posted_at"),
        F.concat(F.lit("https://s.example/"), F.col("conv_id").cast("string")).alias("url"),
        F.lit("2024-02-01").cast("timestamp").alias("classified_at"))
    accounts = t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").alias("id"), F.concat(F.lit("Account "), F.col("conv_id").cast("string"))
        .alias("label"))
    return made, accounts


_SOCIAL_SQL = """p AS (SELECT conv_id * 1000 + turn AS id, conv_id, role, turn,
  coalesce(['Funding', 'News', 'Other', NULL][1 + turn % 4], 'Other') AS kind,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) AS posted_at FROM conversations),
q AS (SELECT *, CASE WHEN length(flat) > 400 THEN
  regexp_replace(substr(flat, 1, 400), ' [^ ]*$', '') || '…' ELSE flat END AS snippet FROM p
  WHERE posted_at >= TIMESTAMP '2024-01-01 18:30:00' AND posted_at < TIMESTAMP '2024-01-05 18:30:00')"""


def social_shown(t: Tables) -> DataFrame:
    made, accounts = account_posts(t)
    return social.posts(made, accounts, "2024-01-02", "2024-01-05")


@query(f"""WITH {_SOCIAL_SQL} SELECT id, 'Account ' || conv_id AS account,
  CASE role WHEN 'assistant' THEN role END AS author, kind, substr(snippet, 1, 160) AS headline,
  snippet, posted_at FROM q WHERE kind IN ('Funding', 'News')""")
def social_posts(t: Tables) -> DataFrame:
    return social.listing(social_shown(t)).select(
        "id", "account", "author", "kind", "headline", "snippet", "posted_at")


@query(f"""WITH {_SOCIAL_SQL} SELECT count(*) FILTER (kind = 'Funding') AS funding,
  count(*) FILTER (kind = 'News') AS news, count(*) FILTER (kind = 'Other') AS other FROM q""")
def social_posts_counts(t: Tables) -> DataFrame:
    return social.kind_counts(social_shown(t))


@query(f"""WITH {_SOCIAL_SQL} SELECT conv_id AS source_id, 'Account ' || conv_id AS account,
  count(*) AS count FROM q WHERE kind = 'Funding' GROUP BY 1""")
def social_account_counts(t: Tables) -> DataFrame:
    return social.account_counts(social_shown(t), "Funding")


@query(f"""WITH {_SOCIAL_SQL} SELECT 'social-' || id AS id,
  CASE role WHEN 'user' THEN 'Series A' ELSE 'Other' END AS stage,
  'Account ' || conv_id || CASE role WHEN 'assistant' THEN ' (repost of assistant)' ELSE '' END
    AS source_label FROM q WHERE kind = 'Funding'""")
def social_funding(t: Tables) -> DataFrame:
    return social.funding_rounds(social_shown(t)).select("id", "stage", "source_label")


@query(f"""WITH {_SOCIAL_SQL} SELECT count(*) FILTER (kind = 'Funding') AS funding,
  count(*) FILTER (kind = 'News') AS news, count(*) FILTER (kind = 'Other') AS other FROM q WHERE conv_id = 30""")
def social_kinds_of_account(t: Tables) -> DataFrame:
    """The same counts once an account is picked."""
    return social.kind_counts(social_shown(t), source=30)


@query("""WITH o AS (SELECT conv_id, arg_min(role || '-' || turn, turn) AS own FROM conversations
  WHERE role <> 'assistant' GROUP BY 1), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 AND own IS NOT NULL THEN own ELSE 'Account ' || conv_id END AS label,
  conv_id % 2 = 0 AND own IS NULL AS label_auto FROM a LEFT JOIN o USING (conv_id)""")
def account_names(t: Tables) -> DataFrame:
    """Accounts of even id were named after their link and take the name their first own post gives."""
    made, accounts = account_posts(t)
    posts = made.withColumn("pos", F.col("id") % 1000).withColumn("author", F.concat_ws("-", "author", F.col(
        "pos").cast("string")))
    sources = accounts.withColumn("label_auto", F.col("id") % 2 == 0)
    return labels.name_from_posts(sources, posts)
