"""Deduplication over documents, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import text
from wirefold.functions.taxonomy import WANTED_STAGES
from wirefold.operators import dedupe
from wirefold.workload.base import (DOC_AS_OF, DOC_SQL, ORDER_SQL, Tables, doc_articles,
                                    numbers_sql, order_articles, query, story_key_sql, tokens_sql)


# Facts of every headline, then the rule for a pair: both as sets of words. ``m`` says whether the longer
# of two headlines covers something the other does not.
HEADLINE_SQL = f"""facts AS MATERIALIZED (SELECT id, source, company, category, published_at AS at, headline,
    {tokens_sql('headline')} AS w, {numbers_sql('headline')} AS nums, {story_key_sql('headline')} AS k,
    list_filter({numbers_sql('headline')}, lambda x: NOT (length(x) = 4
      AND x::BIGINT BETWEEN 1900 AND 2100)) AS figs,
    regexp_matches(headline, '{text.ROUNDUP}') AS roundup,
    list_filter(list_transform(regexp_split_to_array(headline, '[;|]'), lambda c: {tokens_sql('c')}),
      lambda c: len(c) >= 3) AS parts FROM base)"""


def _guard_sql(long: str, short: str) -> str:
    return (f"({long}.roundup OR (len({long}.parts) >= 2 AND len(list_filter({long}.parts, lambda c: "
            f"len({short}.w) = 0 OR len(list_intersect(c, {short}.w)) / least(len(c), len({short}.w)) < 0.25)) > 0))")


# ``a`` is the earlier row: it counts as the longer one in a tie.
PAIR_SQL = f"""CASE WHEN len(a.w) >= len(b.w) THEN {_guard_sql('a', 'b')} ELSE {_guard_sql('b', 'a')} END AS m,
    len(list_intersect(a.w, b.w)) AS common, least(len(a.w), len(b.w)) AS small"""
SCORE_SQL = """CASE WHEN common = 0 THEN 0 WHEN m OR small < 4 THEN common / (la + lb - common)
    ELSE greatest(common / (la + lb - common), common / small) END"""

# One walk over all rows in order: ``kept`` holds what stays, a row looks for its best match there.
STORY_SQL = f"""WITH RECURSIVE {DOC_SQL}, base AS (SELECT *, NULL AS company, NULL AS category FROM docs),
{HEADLINE_SQL},
near AS MATERIALIZED (SELECT b.id AS new, a.id AS old, a.k = b.k AS same, len(a.w) AS la, len(b.w) AS lb, {PAIR_SQL},
    a.nums = b.nums AND a.at IS NOT NULL AND abs(epoch(a.at)
      - epoch(coalesce(b.at, TIMESTAMP '{DOC_AS_OF}'))) <= 259200 AS close
  FROM facts a JOIN facts b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0
    AND (a.k = b.k OR len(list_intersect(a.w, b.w)) > 0)),
fit AS MATERIALIZED (SELECT new, old, CASE WHEN same THEN 2 ELSE {SCORE_SQL} END AS worth FROM near
  WHERE same OR (close AND {SCORE_SQL} >= 0.6)),
asks AS MATERIALIZED (SELECT new, row_number() OVER (ORDER BY new) AS n,
  list({{'o': old, 'l': worth}} ORDER BY worth DESC, old) AS olds FROM fit GROUP BY new),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS canonical_id, []::BIGINT[] AS gone
  UNION ALL
  SELECT n, id, canonical_id, CASE WHEN canonical_id IS NULL THEN gone ELSE list_append(gone, id) END
  FROM (SELECT a.n, a.new AS id, w.gone, (list_filter(a.olds, lambda x: NOT list_contains(w.gone, x.o)))[1].o
    AS canonical_id FROM walk w JOIN asks a ON a.n = w.n + 1)),
told AS (SELECT f.id, f.source, f.headline, f.at AS published_at, f.k AS story_key, w.canonical_id
  FROM facts f LEFT JOIN walk w ON w.id = f.id)"""


@query(STORY_SQL + """
SELECT id, source, story_key, canonical_id FROM told""")
def story_dedupe(t: Tables) -> DataFrame:
    """Headline dedupe of every document, by key and by similarity within 72 hours."""
    return dedupe.story_dedupe(doc_articles(t), DOC_AS_OF, ["id"]).select(
        "id", "source", "story_key", "canonical_id")


@query(STORY_SQL + """, p AS (SELECT canonical_id AS id, source, min(id) AS pos FROM told
  WHERE canonical_id IS NOT NULL GROUP BY ALL),
o AS (SELECT id, string_agg(source, ',' ORDER BY pos) AS s FROM p GROUP BY id)
SELECT told.id, source, headline, published_at, coalesce(s, '') AS also_reported_by
FROM told LEFT JOIN o USING (id) WHERE canonical_id IS NULL""")
def feed_after_dedupe(t: Tables) -> DataFrame:
    """Stories with how many outlets told them: dedupe, then the outlets of each."""
    rows = dedupe.story_dedupe(doc_articles(t), DOC_AS_OF, ["id"])
    outlets = dedupe.other_outlets(rows, ["id"]).withColumnRenamed("canonical_id", "id")
    return rows.where("canonical_id is null").join(outlets, "id", "left").select(
        "id", "source", "headline", "published_at",
        F.coalesce(F.array_join("also_reported_by", ","), F.lit("")).alias("also_reported_by"))


@query(f"""WITH {DOC_SQL}, k AS (SELECT id, source, len({tokens_sql('headline')}) AS n,
    {story_key_sql('headline')} AS story_key FROM docs)
SELECT id, story_key, CASE WHEN n > 0 AND min(id) OVER (PARTITION BY story_key, n > 0) < id
  THEN min(id) OVER (PARTITION BY story_key, n > 0) END AS canonical_id FROM k""")
def exact_story_dups(t: Tables) -> DataFrame:
    """The first branch alone: rows sharing a story key point at the first of them."""
    rows = doc_articles(t).select("id", text.story_key("headline").alias("story_key"),
                                  (F.size(text.tokens("headline")) > 0).alias("named"))
    first = rows.where("named").groupBy("story_key").agg(F.min("id").alias("first"))
    return rows.join(first, "story_key", "left").select(
        "id", "story_key", F.when(F.col("named") & (F.col("first") < F.col("id")), F.col("first"))
        .alias("canonical_id"))


@query(f"""WITH {DOC_SQL}, k AS (SELECT id, source, {story_key_sql('headline')} AS story_key
    FROM docs WHERE len({tokens_sql('headline')}) > 0),
p AS (SELECT *, min(id) OVER (PARTITION BY story_key) AS canonical_id FROM k),
f AS (SELECT canonical_id, source, min(id) AS pos FROM p WHERE id <> canonical_id GROUP BY ALL)
SELECT canonical_id, string_agg(source, ',' ORDER BY pos) AS also_reported_by FROM f GROUP BY 1""")
def other_outlets(t: Tables) -> DataFrame:
    rows = exact_story_dups(t).join(doc_articles(t).select("id", "source"), "id")
    return dedupe.other_outlets(rows, ["id"]).select(
        "canonical_id", F.array_join("also_reported_by", ",").alias("also_reported_by"))


@query(f"""WITH RECURSIVE {DOC_SQL}, base AS (SELECT *, split_part(headline, ' ', 1) AS company, lang AS category
  FROM docs), {HEADLINE_SQL},
near AS MATERIALIZED (SELECT b.id AS new, a.id AS old, len(a.w) AS la, len(b.w) AS lb, b.figs AS bf, {PAIR_SQL}
  FROM facts a JOIN facts b ON lower(trim(a.company)) = lower(trim(b.company)) AND a.category = b.category
    AND (a.at, a.id) < (b.at, b.id) AND epoch(b.at) - epoch(a.at) <= 172800
    AND NOT (len(a.figs) > 0 AND len(b.figs) > 0 AND len(list_intersect(a.figs, b.figs)) = 0)),
asks AS MATERIALIZED (SELECT new, row_number() OVER (ORDER BY new) AS n, list(old ORDER BY old) AS olds FROM near
  WHERE NOT m AND (len(bf) > 0 OR {SCORE_SQL} >= 0.25) GROUP BY new),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS canonical_id, []::BIGINT[] AS gone
  UNION ALL
  SELECT n, id, canonical_id, CASE WHEN canonical_id IS NULL THEN gone ELSE list_append(gone, id) END
  FROM (SELECT a.n, a.new AS id, w.gone, (list_filter(a.olds, lambda x: NOT list_contains(w.gone, x)))[1]
    AS canonical_id FROM walk w JOIN asks a ON a.n = w.n + 1))
SELECT id, canonical_id FROM walk WHERE canonical_id IS NOT NULL""")
def company_dedupe(t: Tables) -> DataFrame:
    """Second pass over documents: the headline's first word stands for the company."""
    rows = doc_articles(t).select(
        "id", F.substring_index("headline", " ", 1).alias("company"), F.col("lang").alias("category"),
        "headline", "published_at", F.lit(None).cast("bigint").alias("canonical_id"))
    return dedupe.company_dedupe(rows)


@query(f"""WITH RECURSIVE {DOC_SQL}, p AS (SELECT id, CASE WHEN id % 7 > 0 AND id > id % 5 THEN id - 1 - id % 5 END
    AS up FROM docs),
walk AS (SELECT id, id AS here, up, 0 AS steps FROM p UNION ALL
  SELECT walk.id, p.id, p.up, steps + 1 FROM walk JOIN p ON p.id = walk.up)
SELECT id, arg_max(here, steps) AS root_id FROM walk GROUP BY id""")
def story_roots(t: Tables) -> DataFrame:
    """Roots of pointers that grew over many refreshes: chains as long as the ids allow."""
    rows = doc_articles(t).select("id", F.when((F.col("id") % 7 > 0) & (F.col("id") > F.col("id") % 5), F.col(
        "id") - 1 - F.col("id") % 5).alias("canonical_id"))
    return dedupe.resolve_roots(rows).select("id", "root_id")


def _deals(t: Tables) -> DataFrame:
    return order_articles(t).select(
        "id", F.col("source").alias("firm"), "company", "published_at", "category")


@query(f"""WITH RECURSIVE {ORDER_SQL}, r AS (
  SELECT id, company AS k, epoch(published_at) AS t FROM arts),
pick AS (
  SELECT k, min(id) AS id, list_value(arg_min(coalesce(t, -1), id)) AS kept FROM r GROUP BY k
  UNION ALL
  SELECT p.k, min(r.id) AS id,
    list_append(any_value(p.kept), arg_min(coalesce(r.t, -1), r.id)) AS kept
  FROM pick p JOIN r ON r.k = p.k AND r.id > p.id AND r.t IS NOT NULL AND p.kept[1] <> -1
    AND len(list_filter(p.kept, lambda x: abs(x - r.t) <= 1209600)) = 0
  GROUP BY p.k, p.id)
SELECT id, k AS company FROM pick""")
def deal_dedupe(t: Tables) -> DataFrame:
    """One order per customer and fortnight; undated orders match any date."""
    return dedupe.deal_dedupe(_deals(t), ["id"]).select("id", "company")


@query(f"""WITH {ORDER_SQL}
SELECT r.id FROM arts r WHERE r.canonical_id IS NULL AND EXISTS (
  SELECT 1 FROM arts f WHERE f.canonical_id IS NOT NULL AND f.company = r.company
    AND f.category = r.category
    AND f.published_at BETWEEN r.published_at - INTERVAL 14 DAY AND r.published_at + INTERVAL 14 DAY)
""")
def round_known_range_semi(t: Tables) -> DataFrame:
    rows = order_articles(t).withColumn("stage", F.col("category"))
    return dedupe.round_known(rows.where("canonical_id is null and stage is not null"), rows.where(
        "canonical_id is not null and stage is not null")).select("id")


@query(f"""WITH {ORDER_SQL}, s AS (SELECT *, CASE category WHEN 'Funding' THEN 'Seed'
    WHEN 'Other' THEN 'Series A' ELSE 'Other' END AS stage FROM arts),
q AS (SELECT * FROM s WHERE canonical_id IS NULL), k AS (SELECT * FROM s WHERE canonical_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY company, stage, published_at IS NULL ORDER BY id) AS n FROM q)
SELECT stage, outcome, count(*) AS n FROM (
  SELECT stage, CASE WHEN stage = 'Other' THEN 'not a round' WHEN published_at IS NULL THEN 'outside range'
    WHEN n > 1 OR EXISTS (SELECT 1 FROM k WHERE k.company = o.company AND k.stage = o.stage
      AND k.published_at BETWEEN o.published_at - INTERVAL 14 DAY AND o.published_at + INTERVAL 14 DAY)
    THEN 'duplicate' ELSE 'added' END AS outcome FROM o) GROUP BY ALL""")
def search_round_outcomes(t: Tables) -> DataFrame:
    stage = F.when(F.col("category") == "Funding", "Seed").when(
        F.col("category") == "Other", "Series A").otherwise("Other")
    rows = order_articles(t).withColumn("stage", stage)
    admitted = dedupe.admit_search_rounds(
        rows.where("canonical_id is null"), rows.where("canonical_id is not null"), ["id"],
        WANTED_STAGES)
    return dedupe.outcome_counts(admitted, "stage")


@query(f"""WITH RECURSIVE {ORDER_SQL}, s AS (SELECT *, epoch(published_at) AS t FROM arts WHERE category IS NOT NULL),
k AS (SELECT * FROM s WHERE canonical_id IS NOT NULL),
q AS (SELECT id, company, category, t FROM s WHERE canonical_id IS NULL AND NOT EXISTS (
  SELECT 1 FROM k WHERE k.company = s.company AND k.category = s.category
    AND (s.t IS NULL OR abs(k.t - s.t) <= 1209600))),
pick AS (
  SELECT company, category, min(id) AS id, list_value(arg_min(coalesce(t, -1), id)) AS kept FROM q GROUP BY ALL
  UNION ALL
  SELECT p.company, p.category, min(q.id) AS id, list_append(any_value(p.kept), arg_min(q.t, q.id)) AS kept
  FROM pick p JOIN q ON q.company = p.company AND q.category = p.category AND q.id > p.id AND q.t IS NOT NULL
    AND len(list_filter(p.kept, lambda x: x <> -1 AND abs(x - q.t) <= 1209600)) = 0
  GROUP BY p.company, p.category, p.id)
SELECT id, company, category AS stage FROM pick""")
def added_round_dedupe(t: Tables) -> DataFrame:
    """Orders as rounds from added sites, kept when new to their company and category."""
    rows = order_articles(t).withColumn("stage", F.col("category"))
    return dedupe.admit_added_rounds(
        rows.where("canonical_id is null and stage is not null"),
        rows.where("canonical_id is not null and stage is not null")).select("id", "company", "stage")


@query("""WITH p AS (SELECT page_id AS id, url, regexp_replace(url, '[?#].*$', '') AS link,
    regexp_extract(url, '^https?://[^/]*', 0) AS page FROM pages)
SELECT min(id) AS id, lower(regexp_replace(link, '/+$', '')) AS link FROM p
WHERE lower(regexp_replace(link, '/+$', '')) <> lower(page) GROUP BY 2
UNION ALL SELECT id, lower(regexp_replace(link, '/+$', '')) FROM p
WHERE lower(regexp_replace(link, '/+$', '')) = lower(page)""")
def event_link_dedupe(t: Tables) -> DataFrame:
    rows = t.pages.select(F.col("page_id").alias("id"),
                          F.regexp_replace("url", "[?#].*$", "").alias("url"),
                          F.regexp_extract("url", "^https?://[^/]*", 0).alias("source_url"))
    return dedupe.event_dedupe(rows, []).select(
        "id", F.lower(F.regexp_replace("url", "/+$", "")).alias("link"))


@query("""SELECT p_partkey, p_name AS url FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
  AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)""")
def unseen_urls(t: Tables) -> DataFrame:
    rows = t.part.withColumn("url", F.col("p_partkey").cast("string"))
    key = F.col("l_partkey").cast("string").alias("url")
    return dedupe.unseen_urls(
        rows, t.lineitem.where("l_quantity > 49").select(key),
        t.lineitem.where("l_quantity < 2").select(key)).select(
        "p_partkey", F.col("p_name").alias("url"))
