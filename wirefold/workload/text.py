"""Scalar functions over whole documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import money, taxonomy, text, times, urls
from wirefold.workload.base import (DOC_SQL, READ_AS_OF, Tables, doc_articles, numbers_sql, query,
                                    story_key_sql, tokens_sql)


@query(f"""SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens,
  len({tokens_sql('text')}) AS n FROM documents""")
def headline_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.tokens("text"), " ").alias("tokens"),
                              F.size(text.tokens("text")).cast("bigint").alias("n"))


@query(f"""SELECT doc_id, array_to_string({numbers_sql('text')}, ' ') AS numbers,
  array_to_string(list_filter({numbers_sql('text')}, lambda w: NOT (length(w) = 4
    AND CAST(w AS DOUBLE) BETWEEN 1900 AND 2100)), ' ') AS figures FROM documents""")
def numeric_signature(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.numbers("text"), " ").alias("numbers"),
                              F.array_join(text.figures("text"), " ").alias("figures"))


@query(f"""WITH {DOC_SQL} SELECT id, {story_key_sql('headline')} AS story_key,
  sha1(headline || chr(10) || coalesce(description, '')) AS content_hash,
  sha1(lower(trim(headline))) AS phrase_hash FROM docs""")
def story_keys(t: Tables) -> DataFrame:
    return doc_articles(t).select(
        "id", text.story_key("headline").alias("story_key"),
        text.content_hash("headline", "description").alias("content_hash"),
        text.phrase_hash("headline").alias("phrase_hash"))


@query(f"""WITH {DOC_SQL}, s AS (
  SELECT id, headline AS h, {tokens_sql('headline')} AS a, {tokens_sql('description')} AS b,
    regexp_matches(headline, '{text.ROUNDUP}') AS h_round,
    regexp_matches(coalesce(description, ''), '{text.ROUNDUP}') AS d_round,
    list_filter(list_transform(regexp_split_to_array(headline, '[;|]'), lambda c: {tokens_sql('c')}),
      lambda c: len(c) >= 3) AS h_parts,
    list_filter(list_transform(regexp_split_to_array(coalesce(description, ''), '[;|]'),
      lambda c: {tokens_sql('c')}), lambda c: len(c) >= 3) AS d_parts
  FROM docs WHERE description IS NOT NULL),
m AS (SELECT *, len(list_intersect(a, b)) AS shared, len(a) AS na, len(b) AS nb FROM s),
g AS (SELECT *, CASE WHEN na >= nb THEN h_round OR (len(h_parts) >= 2 AND len(list_filter(h_parts,
    lambda c: nb = 0 OR len(list_intersect(c, b)) / least(len(c), nb) < 0.25)) > 0)
  ELSE d_round OR (len(d_parts) >= 2 AND len(list_filter(d_parts,
    lambda c: na = 0 OR len(list_intersect(c, a)) / least(len(c), na) < 0.25)) > 0) END AS multi FROM m)
SELECT id, multi, CASE WHEN na = 0 OR nb = 0 THEN 0.0
  WHEN multi OR least(na, nb) < 4 THEN round(shared / (na + nb - shared), 9)
  ELSE round(greatest(shared / (na + nb - shared), shared / least(na, nb)), 9) END AS similarity
FROM g""")
def headline_pairs_similarity(t: Tables) -> DataFrame:
    """Each document's headline against the rest of it: as many pairs as documents."""
    rows = doc_articles(t).where("description is not null").select(
        "id", text.headline_profile("headline").alias("a"),
        text.headline_profile("description").alias("b"))
    return rows.select("id", text.guarded(F.col("a"), F.col("b")).alias("multi"),
                       F.round(text.profile_similarity(F.col("a"), F.col("b")), 9)
                       .alias("similarity"))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 400
  THEN regexp_replace(substr(s, 1, 400), ' [^ ]*$', '') || '…' ELSE s END AS snippet,
  CASE WHEN s IN ('', 'null') THEN NULL ELSE substr(trim(s, ' .,;'), 1, 120) END AS label
FROM f""")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.snippet("text").alias("snippet"),
                              text.label_text("text", 120).alias("label"))


_RAW = ["Pre-Seed", "seed", "SERIES A", "series b1", "angel round", "Bridge", "other", "Series C", ""]
_RAW_SQL = "[" + ",".join(f"'{v}'" for v in _RAW) + "]"
_KEY = "replace(replace(lower(trim({})), '-', ''), ' ', '')"


def _stage_sql(c: str) -> str:
    k = _KEY.format(c)
    return (f"CASE WHEN {k} IN ('other') THEN 'Other' WHEN {k} = 'seed' OR {k} = 'bridge' "
            f"OR starts_with({k}, 'preseriesa') THEN 'Seed' WHEN starts_with({k}, 'preseed') "
            f"OR starts_with({k}, 'angel') THEN 'Pre-Seed' WHEN starts_with({k}, 'seriesa') "
            f"THEN 'Series A' WHEN starts_with({k}, 'seriesb') THEN 'Series B' END")


@query(f"""WITH r AS (SELECT p_partkey, {_RAW_SQL}[1 + p_partkey % 9] AS v,
    {_RAW_SQL}[1 + p_size % 9] AS l FROM part)
SELECT p_partkey, coalesce({_stage_sql('v')}, {_stage_sql('l')}, 'Other') AS stage FROM r""")
def stage_coerce(t: Tables) -> DataFrame:
    raw = F.array(*[F.lit(v) for v in _RAW])
    return t.part.select("p_partkey", taxonomy.stage(
        F.get(raw, (F.col("p_partkey") % 9).cast("int")),
        F.get(raw, F.col("p_size") % 9)).alias("stage"))


@query("""SELECT p_partkey, 'Pre-' || upper(p_type[1]) || lower(p_type[2:]) || ' Series '
  || CASE WHEN p_size < 27 THEN upper(chr(97 + p_size % 26)) ELSE 'IPO' END AS round
FROM part""")
def round_tidy(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("pre  "), F.upper("p_type"), F.lit(" series "), F.when(
        F.col("p_size") < 27, F.char(97 + F.col("p_size") % 26)).otherwise("ipo"))
    return t.part.select("p_partkey", taxonomy.round_label(raw).alias("round"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS p, p_brand FROM part)
SELECT p_partkey, CASE WHEN p[1] = p[2] THEN p[1] ELSE p[1] || '; ' || p[2] END || '; ' || p_brand
  AS investors FROM w""")
def investors_clean(t: Tables) -> DataFrame:
    said = F.concat(F.regexp_replace("p_name", " ", ", "), F.lit("; n/a and "), F.col("p_brand"), F.lit(". , undisclosed;"), F.lower("p_brand"))
    return t.part.select("p_partkey", taxonomy.investors_text(
        taxonomy.split_investors(said)).alias("investors"))


@query("""SELECT event_type, count(*) AS n,
  CASE event_type WHEN 'purchase' THEN 'Funding' WHEN 'signup' THEN 'Hiring/Layoffs'
       WHEN 'view' THEN 'M&A' ELSE 'Other' END AS category,
  CASE event_type WHEN 'purchase' THEN 'Funding' WHEN 'signup' THEN 'News' ELSE 'Other' END AS kind
FROM events GROUP BY 1""")
def category_coerce(t: Tables) -> DataFrame:
    said = (F.when(F.col("event_type") == "purchase", " FUNDING").when(
        F.col("event_type") == "signup", "hiring layoffs").when(
        F.col("event_type") == "view", "m & a").otherwise(F.col("event_type")))
    kind = F.when(F.col("event_type") == "purchase", "Investment ").when(
        F.col("event_type") == "signup", "news").otherwise("chatter")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).select(
        "event_type", "n", taxonomy.category(said).alias("category"),
        taxonomy.social_kind(kind).alias("kind"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\\.', '')
    AS domain,
  sha1(lower(trim(url))) AS url_hash,
  CASE WHEN s = '' THEN '' ELSE upper(s[1]) || s[2:] END AS slug FROM (
    SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(
      url, '^https?://[^/?#]*([^?#]*?)/*(?:[?#].*)?$', 1), '^.*/', ''), '\\.html?$', '')) AS s
    FROM pages)""")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.domain("url").alias("domain"),
                          text.url_hash("url").alias("url_hash"), urls.slug_title("url").alias("slug"))


@query("""SELECT event_id,
  date_trunc('day', ts) - INTERVAL 330 MINUTE AS written,
  date_trunc('minute', ts) - INTERVAL 330 MINUTE AS clocked,
  date_trunc('second', ts) AS stamped,
  TIMESTAMP '2024-01-31' - to_hours(CAST(1 + floor(value) AS BIGINT)) AS relative,
  date_trunc('day', ts) - INTERVAL 330 MINUTE AS event_day FROM events""")
def times_parsed(t: Tables) -> DataFrame:
    def shown(fmt: str):
        return F.date_format("ts", fmt)
    ago = F.concat((1 + F.floor("value")).cast("string"), F.lit(" hours ago"))
    return t.events.select(
        "event_id", times.read_time(shown("MMM d, yyyy"))["ts"].alias("written"),
        times.event_time(shown("d MMMM yyyy h:mm a"))["ts"].alias("clocked"),
        times.read_time(F.concat(shown("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))["ts"]
        .alias("stamped"),
        times.published_time(ago, READ_AS_OF)["ts"].alias("relative"),
        times.event_time(shown("yyyy-MM-dd"))["ts"].alias("event_day"))


@query("""WITH c AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(floor(value * 100) AS BIGINT) AS tin FROM events)
SELECT event_id, round(CASE WHEN event_type = 'view' THEN (tin * 0.15 + k * 0.6) / 1000000
  ELSE (tin * 3.0 + k * 15.0) / 1000000 END, 9) AS cost_usd,
  CAST(round(CASE WHEN k = 0 THEN 0.00105 ELSE k * 0.002 + 0.00005 END, 6) AS DOUBLE) AS social_usd,
  CAST(round(k * 0.002125 + 0.001, 6) AS DOUBLE) AS calendar_usd FROM c""")
def call_costs(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select("event_id", "event_type", k.alias("k"),
                           F.floor(F.col("value") * 100).alias("tin"))
    return rows.select(
        "event_id", F.round(money.cost("event_type", "tin", "k", {"view": money.CHEAP}), 9)
        .alias("cost_usd"), money.social_charge("k").alias("social_usd"),
        money.calendar_charge("k").alias("calendar_usd"))
