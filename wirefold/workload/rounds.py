"""Funding rounds: urgent orders as the feed's, returned lines as searched, parts as added ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.operators import sinks
from wirefold.plans import rounds
from wirefold.workload.base import ORDER_SQL, Tables, order_articles, query

START, END = "1999-03-01", "1999-08-31"
STAGE_OF = {"BUILDING": "Pre-Seed", "MACHINERY": "Seed", "AUTOMOBILE": "Series A",
            "HOUSEHOLD": "Series B", "FURNITURE": "Other"}


def funding(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(articles, rounds): a round for every Funding order over 100,000."""
    articles = order_articles(t)
    stage = F.lit(None).cast("string")
    for source, name in STAGE_OF.items():
        stage = F.when(F.col("source") == source, F.lit(name)).otherwise(stage)
    made = articles.where("category = 'Funding' and price > 100000").select(
        "id", F.col("id").alias("article_id"), "company", stage.alias("stage"),
        F.lit("pre seed").alias("round_label"), F.lit(None).cast("string").alias("amount"),
        F.concat(F.lit("Nation "), F.col("nation").cast("string"), F.lit("; Shared Fund"))
        .alias("investors"))
    return articles, made


def searched(t: Tables) -> DataFrame:
    stage = F.get(F.array(*[F.lit(s) for s in STAGE_OF.values()]), F.col("l_linenumber") % 5)
    return t.lineitem.where("l_returnflag = 'R'").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("id"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("company"),
        stage.alias("stage"), F.lit("Seed").alias("round_label"),
        F.lit("Rs 5 crore").alias("amount"),
        F.concat(F.lit("Nation "), F.col("l_linenumber").cast("string")).alias("investors"),
        F.col("l_shipdate").alias("published_at"), F.lit("news.example").alias("domain"),
        F.lit("headline").alias("headline"), F.lit("https://n.example").alias("url"),
        F.lit(True).alias("date_approx"), (F.col("l_linestatus") == "F").alias("kept"))


def added(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(rounds, sites): brands are the sites; parts have no date."""
    sites = t.part.select("p_brand").distinct().select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("id"),
        F.col("p_brand").alias("label"), F.lower("p_brand").alias("url"))
    made = t.part.select(
        F.col("p_partkey").alias("id"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint").alias("source_id"),
        F.col("p_name").alias("company"),
        F.get(F.array(*[F.lit(s) for s in STAGE_OF.values()]), F.col("p_size") % 5).alias("stage"),
        F.lit("Seed").alias("round_label"), F.lit("").alias("amount"), F.lit("").alias("investors"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit("part").alias("headline"),
        F.lit("https://p.example").alias("url"), F.lit(False).alias("date_approx"),
        (F.col("p_size") > 25).alias("kept"),
        F.when(F.col("p_retailprice") < 1000, F.lit(None).cast("timestamp"))
        .otherwise(F.lit("2001-01-01").cast("timestamp")).alias("extracted_at"))
    return made, sites


def everything(t: Tables) -> DataFrame:
    articles, made = funding(t)
    rows, sites = added(t)
    labels = t.spark.createDataFrame([("BUILDING", "Building News")], "name string, label string")
    return rounds.all_rounds(rounds.feed_rounds(made, articles, labels),
                             rounds.web_rounds(searched(t)), rounds.added_rounds(rows, sites))


ROUND_SQL = f"""{ORDER_SQL}, st(source, stage) AS (VALUES ('BUILDING', 'Pre-Seed'),
  ('MACHINERY', 'Seed'), ('AUTOMOBILE', 'Series A'), ('HOUSEHOLD', 'Series B'), ('FURNITURE', 'Other')),
rounds AS (
  SELECT 'feed-' || id AS id, company, stage, 'Pre-Seed' AS round, NULL AS amount,
    'Nation ' || nation || ', Shared Fund' AS investors, published_at,
    CASE source WHEN 'BUILDING' THEN 'Building News' ELSE source END AS source_label,
    headline, url, 'feed' AS origin
  FROM arts JOIN st USING (source)
  WHERE canonical_id IS NULL AND category = 'Funding' AND price > 100000
  UNION ALL
  SELECT 'web-' || ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey), 'Supplier ' || l_suppkey,
    ['Pre-Seed', 'Seed', 'Series A', 'Series B', 'Other'][1 + l_linenumber % 5], 'Seed',
    'Rs 5 crore', 'Nation ' || l_linenumber, l_shipdate, 'news.example', 'headline',
    'https://n.example', 'web'
  FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
  UNION ALL
  SELECT 'pasted-' || p_partkey, p_name,
    ['Pre-Seed', 'Seed', 'Series A', 'Series B', 'Other'][1 + p_size % 5], 'Seed', '', '', NULL,
    p_brand, 'part', 'https://p.example', 'pasted' FROM part WHERE p_size > 25)"""
_IN_DAYS = """published_at >= TIMESTAMP '1999-02-28 18:30:00'
  AND published_at < TIMESTAMP '1999-08-31 18:30:00'"""


@query(f"""WITH {ROUND_SQL} SELECT id, company, round, amount, investors, published_at,
  source_label, origin FROM rounds WHERE stage = 'Series A'""")
def rounds_by_stage(t: Tables) -> DataFrame:
    return rounds.rounds_of(everything(t), "Series A").select(
        "id", "company", "round", "amount", F.array_join("investors", ", ").alias("investors"),
        "published_at", "source_label", "origin")


@query(f"""WITH {ROUND_SQL} SELECT k.key, k.label, count(r.id) AS count
FROM (VALUES ('pre-seed', 'Pre-Seed'), ('seed', 'Seed'), ('series-a', 'Series A'),
  ('series-b', 'Series B'), ('other', 'Other')) k(key, label)
LEFT JOIN (SELECT * FROM rounds WHERE {_IN_DAYS}) r ON r.stage = k.label GROUP BY 1, 2""")
def stage_counts(t: Tables) -> DataFrame:
    return rounds.stage_counts(everything(t), START, END)


@query(f"""WITH {ORDER_SQL} SELECT (SELECT count(*) FROM arts WHERE canonical_id IS NULL
  AND category = 'Funding' AND price <= 100000) + (SELECT count(*) FROM part
  WHERE p_retailprice < 1000) AS pending""")
def pending_rounds(t: Tables) -> DataFrame:
    articles, made = funding(t)
    return rounds.pending_count(articles, made, added(t)[0])


@query(f"""WITH {ROUND_SQL} SELECT company AS "Company", stage AS "Stage", round AS "Round",
  investors AS "Investors", coalesce(nullif(amount, ''), 'Undisclosed') AS "Amount",
  published_at + INTERVAL 330 MINUTE AS "Published (IST)", source_label AS "Source",
  CASE origin WHEN 'feed' THEN 'News feed' WHEN 'web' THEN 'Web search' ELSE 'Your website' END
    AS "Found via", headline AS "Headline", url AS "Link" FROM rounds""")
def export_rounds(t: Tables) -> DataFrame:
    return sinks.export_rounds(everything(t))
