"""Feed queries over orders seen as stories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators.dedupe import other_outlets
from wirefold.plans import feed
from wirefold.sources.registry import BUCKETS, DEFAULT_BUCKETS, as_table
from wirefold.workload.base import AS_OF, ORDER_SQL, Tables, order_articles, query

SPEC = feed.FilterSpec(sources=("BUILDING", "MACHINERY"), query="customer#", since_days=365)
SPEC_SQL = """canonical_id IS NULL AND source IN ('BUILDING', 'MACHINERY')
  AND (published_at IS NULL OR published_at >= TIMESTAMP '2000-08-01')
  AND (contains(lower(headline), 'customer#') OR contains(lower(description), 'customer#')
       OR contains(lower(company), 'customer#'))"""


@query(f"""WITH {ORDER_SQL}, page AS (
  SELECT * FROM arts WHERE {SPEC_SQL}
  ORDER BY published_at DESC NULLS LAST, ingested_at DESC, id DESC LIMIT 30 OFFSET 30),
first_seen AS (SELECT canonical_id, source, min(id) AS pos FROM arts
               WHERE canonical_id IS NOT NULL GROUP BY ALL),
outlets AS (SELECT canonical_id, string_agg(source, ',' ORDER BY pos) AS s
            FROM first_seen GROUP BY 1)
SELECT id, headline, company, category, source, published_at, coalesce(s, '') AS also_reported_by
FROM page LEFT JOIN outlets ON page.id = outlets.canonical_id""")
def feed_page(t: Tables) -> DataFrame:
    page = feed.feed_page(order_articles(t), SPEC, AS_OF, limit=30, offset=30)
    return page.select("id", "headline", "company", "category", "source", "published_at",
                       F.array_join("also_reported_by", ",").alias("also_reported_by"))


@query(f"""WITH {ORDER_SQL}, n AS (SELECT count(*) AS total FROM arts WHERE {SPEC_SQL})
SELECT total, 30 + least(greatest(total - 30, 0), 30) < total AS has_more FROM n""")
def feed_total(t: Tables) -> DataFrame:
    return feed.feed_total(order_articles(t), SPEC, AS_OF, limit=30, offset=30)


@query(f"""WITH {ORDER_SQL}
SELECT 'category' AS facet, category AS value, count(*) AS count FROM arts
WHERE canonical_id IS NULL GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM arts WHERE canonical_id IS NULL GROUP BY 2""")
def feed_facets(t: Tables) -> DataFrame:
    return feed.facets(order_articles(t))


@query(f"""WITH {ORDER_SQL}
SELECT CAST(published_at - INTERVAL 90 MINUTE AS DATE) AS day, count(*) AS count FROM arts
WHERE canonical_id IS NULL AND published_at >= TIMESTAMP '2000-08-01' GROUP BY 1""")
def feed_activity_tz(t: Tables) -> DataFrame:
    return feed.activity(order_articles(t), AS_OF, 365, offset_minutes=-90)


@query(f"""WITH {ORDER_SQL}
SELECT id, category, source, company, published_at FROM arts
WHERE canonical_id IS NULL AND category IN ('Funding', 'Market/Analysis')
  AND contains(lower(company), '#00000000')
  AND (published_at IS NULL OR published_at >= TIMESTAMP '2000-08-01')""")
def filter_spec_apply(t: Tables) -> DataFrame:
    spec = feed.FilterSpec(categories=("Funding", "Market/Analysis"), company="#00000000",
                           since_days=365)
    return feed.feed_rows(order_articles(t), spec, AS_OF).select(
        "id", "category", "source", "company", "published_at")


@query("""WITH raw AS (
  SELECT c_custkey, c_mktsegment, c_name,
    CASE c_nationkey % 4 WHEN 0 THEN 'Funding' WHEN 1 THEN 'M&A' WHEN 2 THEN NULL
         ELSE 'Other' END AS cat FROM customer)
SELECT c_custkey, coalesce(cat, '') AS categories,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '' END AS sources,
  c_name AS company,
  CASE WHEN c_custkey BETWEEN 1 AND 365 THEN CAST(c_custkey AS INTEGER) END AS since_days,
  'Showing stories ' || concat_ws(', ', cat, 'about ' || c_name,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'from ' || c_mktsegment END,
    CASE WHEN c_custkey = 1 THEN 'from today' WHEN c_custkey BETWEEN 2 AND 365
         THEN 'from the last ' || c_custkey || ' days' END) AS explanation
FROM raw""")
def filter_coerce(t: Tables) -> DataFrame:
    names = F.array(F.lit("FUNDING"), F.lit(" m&a "), F.lit("made up"), F.lit("other"))
    raw = t.customer.select("c_custkey", F.to_json(F.struct(
        F.array(F.get(names, F.col("c_nationkey") % 4)).alias("categories"),
        F.array("c_mktsegment").alias("sources"),
        F.concat(F.lit(" "), "c_name").alias("company"), F.lit(" ").alias("query"),
        F.col("c_custkey").alias("since_days"))).alias("filter_json"))
    out = feed.coerce_filters(raw, ["BUILDING", "MACHINERY"])
    return out.select("c_custkey", F.array_join("categories", ",").alias("categories"),
                      F.array_join("sources", ",").alias("sources"), "company", "since_days",
                      "explanation")


@query(f"""WITH {ORDER_SQL}, b(key, category) AS (
  VALUES ('funded', 'Funding'), ('policy', 'Policy/Regulation'), ('market', 'Market/Analysis'))
SELECT key, count(*) FILTER (published_at IS NULL OR published_at >= TIMESTAMP '2001-07-25') AS count,
  count(*) FILTER ((published_at IS NULL OR published_at >= TIMESTAMP '2001-07-25')
           AND key = 'funded' AND ingested_at > TIMESTAMP '2001-07-28') AS new_count,
  max(ingested_at) AS latest_ingested_at
FROM b JOIN arts USING (category) WHERE canonical_id IS NULL GROUP BY key""")
def buckets(t: Tables) -> DataFrame:
    seen = t.spark.sql("SELECT 'funded' AS key, TIMESTAMP '2001-07-28' AS seen_at")
    return feed.buckets(order_articles(t), as_table(t.spark, DEFAULT_BUCKETS, BUCKETS), AS_OF,
                        seen).select("key", "count", "new_count", "latest_ingested_at")


@query(f"""WITH {ORDER_SQL}
SELECT coalesce(strftime(ingested_at + INTERVAL 330 MINUTE, '%Y-%m-%d'), 'undated') AS day_key,
  count(*) AS stories FROM arts WHERE canonical_id IS NULL GROUP BY 1""")
def day_groups(t: Tables) -> DataFrame:
    rows = feed.canonical(order_articles(t)).withColumn("published_at", F.col("ingested_at"))
    return feed.day_groups(rows).groupBy("day_key").agg(F.count("*").alias("stories"))


@query(f"""WITH {ORDER_SQL}, first_seen AS (
  SELECT canonical_id, source, min(id) AS pos FROM arts
  WHERE canonical_id IS NOT NULL GROUP BY ALL)
SELECT canonical_id, string_agg(source, ',' ORDER BY pos) AS also_reported_by
FROM first_seen GROUP BY 1""")
def order_outlets(t: Tables) -> DataFrame:
    return other_outlets(order_articles(t), ["id"]).select(
        "canonical_id", F.array_join("also_reported_by", ",").alias("also_reported_by"))


@query(f"""WITH {ORDER_SQL}
SELECT count(*) AS total, count(*) FILTER (canonical_id IS NULL) AS canonical,
  count(*) FILTER (canonical_id IS NOT NULL) AS deduped, max(published_at) AS newest_published FROM arts""")
def corpus_totals(t: Tables) -> DataFrame:
    from wirefold.plans.status import corpus_totals as totals
    return totals(order_articles(t))
