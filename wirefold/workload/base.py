"""Registering queries, and the supplied tables seen as stories, reads and posts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions.text import STOPWORDS
from wirefold.session import CONF, spread

AS_OF = dt.datetime(2001, 8, 1)            # "now" for the order stories
READ_AS_OF = dt.datetime(2024, 1, 31)      # "now" for the read log
DOC_AS_OF = dt.datetime(2026, 1, 31)       # "now" for the document stories
TEXT_TABLES = ("documents", "pages", "conversations")
QUERIES: dict[str, Query] = {}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Tables:
    """The supplied parquet tables; instants are read as UTC."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXT_TABLES:
            df = spread(df)
        return df.select(*[F.col(f.name).cast("timestamp") if isinstance(
            f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None):
    """Register a function of Tables as a query named after it."""
    def register(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key, value in CONF.items():
                if key.startswith("spark.sql."):
                    spark.conf.set(key, value)
            out = fn(Tables(spark, folder))
            return out.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
                                if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
                                for f in out.schema.fields])
        QUERIES[fn.__name__] = Query(run, sql)
        return fn
    return register


# --- documents as stories ------------------------------------------------------------

def doc_articles(t: Tables) -> DataFrame:
    """First line as headline, the whole rest as description. ``src0`` gives no dates."""
    line = F.instr("text", "\n")
    return t.documents.select(
        F.col("doc_id").alias("id"), "source", "lang",
        F.substring_index("text", "\n", 1).alias("headline"),
        F.when(line > 0, F.expr("substring(text, instr(text, '\n') + 1)")).alias("description"),
        F.when(F.col("source") != "src0", F.timestamp_seconds(
            F.lit(1767225600) + F.col("doc_id") * 60)).alias("published_at"))


DOC_SQL = """docs AS (
  SELECT doc_id AS id, source, lang, split_part(text, chr(10), 1) AS headline,
         CASE WHEN strpos(text, chr(10)) > 0
              THEN substr(text, strpos(text, chr(10)) + 1) END AS description,
         CASE WHEN source <> 'src0'
              THEN TIMESTAMP '2026-01-01' + to_minutes(doc_id) END AS published_at
  FROM documents)"""

STOP_SQL = "[" + ",".join(f"'{w}'" for w in sorted(STOPWORDS)) + "]"


def tokens_sql(c: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), "
            f"lambda w: (length(w) > 2 OR regexp_full_match(w, '[0-9]+')) "
            f"AND NOT list_contains({STOP_SQL}, w))))")


def numbers_sql(c: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), "
            f"lambda w: regexp_full_match(w, '[0-9]+'))))")


def story_key_sql(c: str) -> str:
    return (f"sha1(CASE WHEN len({tokens_sql(c)}) > 0 "
            f"THEN array_to_string(list_slice({tokens_sql(c)}, 1, 8), ' ') "
            f"ELSE substr(lower(trim({c})), 1, 50) END)")


# --- orders as stories -----------------------------------------------------------------

CATEGORY_OF = {"1-URGENT": "Funding", "2-HIGH": "Policy/Regulation", "3-MEDIUM": "Market/Analysis",
               "5-LOW": "Other"}


def order_articles(t: Tables) -> DataFrame:
    """Orders with their customer as company. Partly filled orders repeat the order before."""
    category = F.lit(None).cast("string")
    for priority, name in CATEGORY_OF.items():
        category = F.when(F.col("o_orderpriority") == priority, F.lit(name)).otherwise(category)
    who = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment",
                            "c_nationkey")
    return t.orders.join(who, "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("source"),
        F.concat(F.col("c_name"), F.lit(" books order "), F.col("o_orderkey").cast("string"))
        .alias("headline"),
        F.concat(F.lit("Priority "), F.col("o_orderpriority")).alias("description"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 20000), None)
        .otherwise(F.col("o_orderdate")).alias("published_at"),
        (F.col("o_orderdate") + F.make_dt_interval(mins=F.col("o_custkey").cast("int")))
        .alias("ingested_at"),
        F.col("c_name").alias("company"), category.alias("category"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") > 0),
               F.col("o_orderkey") - 1).alias("canonical_id"),
        F.concat(F.lit("https://orders.example/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("c_nationkey").alias("nation"), F.col("o_totalprice").alias("price"))


ORDER_SQL = """arts AS (
  SELECT o_orderkey AS id, c_mktsegment AS source,
         c_name || ' books order ' || o_orderkey AS headline,
         'Priority ' || o_orderpriority AS description,
         CASE WHEN o_orderstatus = 'P' AND o_totalprice < 20000 THEN NULL
              ELSE o_orderdate END AS published_at,
         o_orderdate + to_minutes(o_custkey) AS ingested_at, c_name AS company,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Funding' WHEN '2-HIGH' THEN 'Policy/Regulation'
              WHEN '3-MEDIUM' THEN 'Market/Analysis' WHEN '5-LOW' THEN 'Other' END AS category,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey > 0 THEN o_orderkey - 1 END AS canonical_id,
         'https://orders.example/' || o_orderkey AS url, c_nationkey AS nation,
         o_totalprice AS price
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


# --- events as a read log ----------------------------------------------------------------

def read_log(t: Tables) -> DataFrame:
    """Every event is a read of the user's source: errors failed, ``value`` is what it cost."""
    k = F.get_json_object("props", "$.k").cast("int")
    seen = F.floor("value").cast("int")
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_type").alias("kind"), F.col("ts").alias("started_at"),
        seen.alias("items_seen"), F.least(seen, k).alias("items_new"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("code "), k.cast("string")))
        .alias("error"), F.col("value").alias("cost_usd"))


READ_SQL = """reads AS (
  SELECT event_id AS id, user_id AS source_id, 'user-' || user_id AS source, event_type AS kind,
         ts AS started_at, CAST(floor(value) AS INTEGER) AS items_seen,
         least(CAST(floor(value) AS INTEGER),
               CAST(json_extract_string(props, '$.k') AS INTEGER)) AS items_new,
         CASE WHEN event_type = 'error' THEN 'code ' || json_extract_string(props, '$.k') END AS error,
         value AS cost_usd
  FROM events)"""
