"""The read log and the ledger: health, spend, what is due, and table upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import times
from wirefold.operators import dedupe, incremental, sinks
from wirefold.operators.greedy import cut
from wirefold.operators.stored import Store
from wirefold.plans import firms
from wirefold.plans import status as health
from wirefold.plans.refresh import LAYOUTS
from wirefold.session import checkpoint_dir
from wirefold.workload.activity import event_pages
from wirefold.workload.base import (ORDER_SQL, READ_AS_OF, READ_SQL, Tables, order_articles, query,
                                    read_log)


def sources(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name")
                           ).distinct()


def ledger(t: Tables) -> DataFrame:
    return t.events.select("ts", F.col("event_type").alias("feature"),
                           (F.col("value") / 10000).alias("cost_usd"))


@query(f"""WITH {READ_SQL} SELECT source, kind, max(started_at) AS last_read,
  arg_max(coalesce(error, ''), id) AS last_error FROM reads GROUP BY ALL""")
def latest_read_per_source(t: Tables) -> DataFrame:
    return firms.latest_reads(read_log(t), "source", "kind").withColumn(
        "last_error", F.coalesce("last_error", F.lit("")))


@query(f"""WITH {READ_SQL}, {ORDER_SQL} SELECT (SELECT count(*) FROM arts) AS total,
  (SELECT count(*) FROM arts WHERE canonical_id IS NULL) AS canonical,
  (SELECT count(*) FROM arts WHERE canonical_id IS NOT NULL) AS deduped,
  (SELECT max(published_at) FROM arts) AS newest_published, max(started_at) AS last_refresh,
  round((epoch(TIMESTAMP '2024-01-31') - epoch(max(started_at))) / 3600, 1) AS hours_since_refresh
FROM reads""")
def status(t: Tables) -> DataFrame:
    return health.status(order_articles(t), read_log(t), READ_AS_OF)


@query(f"""WITH {READ_SQL} SELECT source AS name, max(started_at) AS last_run,
  arg_max(items_seen, id) AS items_seen, arg_max(items_new, id) AS items_new,
  nullif(arg_max(coalesce(error, ''), id), '') AS error,
  arg_max(items_seen > 0 AND items_new = items_seen, id) AS window_overflowed
FROM reads GROUP BY 1""")
def source_health(t: Tables) -> DataFrame:
    return health.source_health(sources(t), read_log(t))


@query(f"""WITH {READ_SQL}, f AS (SELECT source, min(id) AS first FROM reads GROUP BY 1)
SELECT id, source, started_at FROM reads JOIN f USING (source)
WHERE items_seen > 0 AND items_new = items_seen AND id <> first""")
def overflow_runs(t: Tables) -> DataFrame:
    return health.overflow_runs(read_log(t)).select("id", "source", "started_at")


@query(f"""WITH {READ_SQL}, g AS (SELECT source_id, max(started_at) AS last_good FROM reads
  WHERE error IS NULL GROUP BY 1)
SELECT 'site-' || source_id AS source_key, last_good FROM g
WHERE last_good <= TIMESTAMP '2024-01-30'""")
def source_due(t: Tables) -> DataFrame:
    reads = read_log(t).withColumn("source_key", F.concat(F.lit("site-"), F.col("source_id").cast("string")))
    return incremental.due(event_pages(t), reads, READ_AS_OF).select("source_key", "last_good")


@query(f"""WITH {READ_SQL}, k(kind, as_kind) AS (VALUES ('view', 'upcoming'), ('click', 'past')),
s AS (SELECT DISTINCT source_id FROM reads),
g AS (SELECT source_id, as_kind, max(started_at) AS g FROM reads JOIN k USING (kind) GROUP BY ALL)
SELECT 'site-' || source_id AS source_key, as_kind AS kind FROM s CROSS JOIN k
LEFT JOIN g USING (source_id, as_kind)
WHERE g IS NULL OR (as_kind = 'upcoming' AND g <= TIMESTAMP '2024-01-30')""")
def due_kinds(t: Tables) -> DataFrame:
    kind = F.when(F.col("kind") == "view", "upcoming").when(F.col("kind") == "click", "past")
    reads = read_log(t).withColumn("kind", kind).where("kind is not null").withColumn(
        "source_key", F.concat(F.lit("site-"), F.col("source_id").cast("string")))
    return incremental.due_kinds(event_pages(t), reads, READ_AS_OF)


@query(f"""WITH {READ_SQL} SELECT kind, max(started_at) AS last_started,
  max(started_at) > TIMESTAMP '2024-01-30 12:30:00' AS fresh,
  greatest(TIMESTAMP '2024-01-31', max(started_at) + INTERVAL 12 HOUR) AS next_due FROM reads
GROUP BY 1""")
def read_schedule(t: Tables) -> DataFrame:
    return incremental.schedule(read_log(t), READ_AS_OF, 12, "kind").drop("cooldown_seconds")


@query(f"""WITH {READ_SQL}, m AS (SELECT source_id, max(started_at) + INTERVAL 1 SECOND AS since FROM reads
  WHERE started_at < TIMESTAMP '2024-01-20' AND source_id < 100 GROUP BY 1),
f AS (SELECT r.*, since, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC) AS n
  FROM reads r LEFT JOIN m USING (source_id))
SELECT id, source_id FROM f WHERE started_at >= since OR (since IS NULL AND n <= 20)""")
def new_posts_since(t: Tables) -> DataFrame:
    """Accounts up to 100 were read until the 20th; the others give their newest twenty."""
    rows = read_log(t).withColumn("posted_at", F.col("started_at")).withColumn("pos", F.col("id"))
    stored = rows.where("posted_at < timestamp'2024-01-20' and source_id < 100")
    marks = incremental.high_watermark(rows.select("source_id").distinct(), stored)
    return incremental.new_posts(rows, marks).select("id", "source_id")


_COST = "CAST(value / 10000 AS DECIMAL(28, 9))"


@query(f"""WITH s AS (SELECT CAST(sum({_COST}) AS DOUBLE) AS total, count(*) AS calls,
  CAST(sum({_COST}) FILTER (ts >= TIMESTAMP '2024-01-30') AS DOUBLE) AS today FROM events)
SELECT round(total, 6) AS total_usd, round(today, 6) AS last_24h_usd, calls,
  round(greatest(0.0, 7.0 - total), 6) AS remaining_total, round(greatest(0.0, 0.5 - today), 6)
  AS remaining_today, round(least(greatest(0.0, 7.0 - total), greatest(0.0, 0.5 - today)), 6)
  AS headroom, least(greatest(0.0, 7.0 - total), greatest(0.0, 0.5 - today)) <= 0 AS exhausted
FROM s""")
def spend_snapshot(t: Tables) -> DataFrame:
    s = health.spend(ledger(t), READ_AS_OF)
    return s.select(*[F.round(c, 6).alias(c) if c not in ("calls", "exhausted") else F.col(c)
                      for c in s.columns])


@query(f"""SELECT event_type AS feature, count(*) AS calls,
  round(CAST(sum({_COST}) AS DOUBLE), 6) AS cost_usd FROM events GROUP BY 1""")
def spend_by_feature(t: Tables) -> DataFrame:
    return health.spend_by_feature(ledger(t)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("""SELECT w AS start, round(sum(value / 10000), 6) AS cost_usd, count(*) AS calls FROM (
  SELECT value, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR,
    date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY 1""")
def spend_windows(t: Tables) -> DataFrame:
    return health.spend_windows(ledger(t)).select(
        F.col("w.start").alias("start"), F.round("cost_usd", 6).alias("cost_usd"), "calls")


@query(f"""WITH f AS (SELECT event_type, count(*) AS n, CAST(sum({_COST}) AS DOUBLE) AS c FROM events
  GROUP BY 1), s AS (SELECT CAST(sum({_COST}) AS DOUBLE) AS total, count(*) AS calls,
  CAST(sum({_COST}) FILTER (ts >= TIMESTAMP '2024-01-30') AS DOUBLE) AS today FROM events)
SELECT 0 AS line_no, 'LLM spend' AS line UNION ALL
SELECT 1, printf('  total     $%.6f of $7.00  (%.1f%% used, $%.4f left)', total, 100 * total / 7.0,
  greatest(0.0, 7.0 - total)) FROM s UNION ALL
SELECT 2, printf('  last 24h  $%.6f of $0.50  ($%.4f left)', today, greatest(0.0, 0.5 - today)) FROM s
UNION ALL SELECT 3, printf('  calls     %d', calls) FROM s UNION ALL
SELECT CAST(3 + row_number() OVER (ORDER BY c DESC) AS INTEGER),
  printf('  %-26s %7d %12s', event_type, n, printf('$%.6f', c)) FROM f""")
def spend_report(t: Tables) -> DataFrame:
    return health.spend_report(ledger(t), READ_AS_OF)


@query(f"""WITH {READ_SQL}, r AS (SELECT source, count(*) AS reads, CAST(sum(items_new) AS BIGINT) AS new,
  count(error) AS failed, round(sum(cost_usd), 6) AS cost_usd,
  max(started_at) FILTER (error IS NULL) AS last_success FROM reads GROUP BY 1)
SELECT *, 'Refreshed: ' || new || ' new' || CASE WHEN new = 1 THEN ' post' ELSE ' posts' END || ' from ' || reads
  || CASE WHEN reads = 1 THEN ' read' ELSE ' reads' END
  || CASE WHEN failed > 0 THEN '; ' || failed || ' failed' ELSE '' END || '.' AS summary
FROM r""")
def refresh_totals(t: Tables) -> DataFrame:
    totals = health.refresh_totals(read_log(t), "source")
    return health.refresh_summary(totals).withColumn("cost_usd", F.round("cost_usd", 6))


_UPSERT_SQL = """WITH c AS (SELECT user_id AS uid, max_by(value, event_id) AS value, min(ts) AS found_at FROM events
    WHERE event_type = 'click' GROUP BY 1),
i AS (SELECT user_id AS uid, max_by(value, event_id) AS value FROM events WHERE event_type = 'view'
    GROUP BY 1)
SELECT coalesce(c.uid, i.uid) AS uid, coalesce(i.value, c.value) AS value,
  CASE WHEN c.uid IS NULL THEN TIMESTAMP '2024-01-31' ELSE found_at END AS found_at,
  CASE WHEN i.uid IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE found_at END AS updated_at
FROM c FULL OUTER JOIN i ON c.uid = i.uid"""


def _clicks_and_views(t: Tables) -> tuple[DataFrame, DataFrame]:
    newest = F.max_by("value", "event_id").alias("value")
    known = (t.events.where("event_type = 'click'")
             .groupBy(F.col("user_id").alias("uid")).agg(newest, F.min("ts").alias("found_at"))
             .withColumn("updated_at", F.col("found_at")))
    incoming = (t.events.where("event_type = 'view'")
                .groupBy(F.col("user_id").alias("uid")).agg(newest))
    return known, incoming


@query(_UPSERT_SQL)
def upsert_events(t: Tables) -> DataFrame:
    return sinks.upsert(*_clicks_and_views(t), "uid", READ_AS_OF)


@query(_UPSERT_SQL)
def upsert_stored(t: Tables) -> DataFrame:
    """The same into a stored table, of which the days of changed and new rows are rewritten."""
    known, incoming = _clicks_and_views(t)
    store = Store(t.spark, f"{checkpoint_dir(t.spark)}/upsert-{uuid.uuid4().hex}", {"events": LAYOUTS["events"]})
    store.create("events", known)
    held = store.read("events").join(incoming.select("uid"), "uid", "left_semi").select(known.columns)
    store.merge("events", cut(sinks.upsert(held, incoming, "uid", READ_AS_OF), "upserted"))
    return store.read("events")


@query("""SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders o
WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_orderstatus <> 'O'
  AND f.o_custkey = o.o_custkey AND f.o_orderpriority = o.o_orderpriority) GROUP BY 1, 2""")
def insert_if_new(t: Tables) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    rows = t.orders.select(*keys, "o_orderkey", "o_orderstatus")
    new = sinks.insert_new(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus != 'O'"), keys,
                           ["o_orderkey"])
    return new.drop("o_orderstatus")


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''),
  'n' || c_nationkey) AS segment FROM customer""")
def fill_if_empty(t: Tables) -> DataFrame:
    held = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(
        F.col("c_mktsegment")).alias("segment"))
    offer = t.customer.select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
                              .alias("segment"))
    return sinks.fill_empty(held, offer, "c_custkey", "segment")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def purge_source(t: Tables) -> DataFrame:
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))
    return sinks.purge(gone, {"orders": (t.orders, "o_custkey")})["orders"].select(
        "o_orderkey", "o_custkey")


@query(f"""WITH {READ_SQL} SELECT source, count(*) AS items_seen, count(*) FILTER (kind IN ('view', 'click')) AS
  items_new, count(*) FILTER (kind = 'purchase') AS items_duplicate FROM reads GROUP BY 1""")
def read_stats(t: Tables) -> DataFrame:
    outcome = F.when(F.col("kind").isin("view", "click"), "new").when(
        F.col("kind") == "purchase", "duplicate").otherwise("known")
    return incremental.read_stats(read_log(t).withColumn("outcome", outcome), "source")


@query("""SELECT event_type, arg_min(event_id, ts) AS event_id, min(ts) AS ts FROM events GROUP BY 1""")
def first_per_key(t: Tables) -> DataFrame:
    return dedupe.first_per_key(t.events, ["event_type"], ["ts", "event_id"]).select(
        "event_type", "event_id", "ts")


@query("""WITH h AS (SELECT event_id AS id, (epoch(TIMESTAMP '2024-01-31') - epoch(ts)) / 3600 AS h FROM events)
SELECT id, CASE WHEN h < 1 THEN 'read just now' WHEN h < 48 THEN 'read ' || CAST(round(h) AS INTEGER) || 'h ago'
    ELSE 'read ' || CAST(round(h / 24) AS INTEGER) || ' days ago' END AS read_text,
  CASE WHEN h < 1 THEN 'Refreshed ' || greatest(1, CAST(round(h * 60) AS INTEGER)) || ' min ago'
    WHEN h < 24 THEN 'Refreshed ' || CAST(round(h) AS INTEGER) || 'h ago'
    ELSE 'Refreshed ' || CAST(floor(h / 24) AS INTEGER) || ' day' || CASE WHEN floor(h / 24) > 1 THEN 's' ELSE '' END
      || ' ago (expected every 6h)' END AS refreshed FROM h""")
def read_ages(t: Tables) -> DataFrame:
    """How long ago every read was, in words."""
    return t.events.select(F.col("event_id").alias("id"), times.read_ago("ts", READ_AS_OF).alias("read_text"),
                           times.refreshed_ago("ts", READ_AS_OF, 6).alias("refreshed"))


_DAY_SQL = f"""{READ_SQL}, d AS (SELECT CAST(started_at AS DATE) AS day, count(*) FILTER (kind <> 'signup') AS reads,
  CAST(sum(items_new) FILTER (kind = 'view') % 3 AS BIGINT) AS new, count(error) AS failed,
  count(*) FILTER (kind = 'signup') AS skipped, count(*) FILTER (kind = 'purchase') % 4 AS few,
  list_sort(list_distinct(list(source) FILTER (error IS NOT NULL))) AS unread FROM reads GROUP BY 1)"""


@query(f"""WITH {_DAY_SQL} SELECT day,
  'Refreshed: ' || new || ' new ' || CASE new WHEN 1 THEN 'story' ELSE 'stories' END
    || CASE WHEN few > 0 THEN ', ' || few || ' funding ' || CASE few WHEN 1 THEN 'round' ELSE 'rounds' END || ' read'
      ELSE '' END || ', ' || skipped || ' new VC firm posts'
    || CASE WHEN few > 1 THEN ', ' || failed || ' new from the websites you added' ELSE '' END
    || ', ' || new || ' new ' || CASE new WHEN 1 THEN 'event' ELSE 'events' END
    || CASE WHEN few > 2 THEN ', ' || new || ' new LinkedIn ' || CASE new WHEN 1 THEN 'post' ELSE 'posts' END ELSE '' END
    || CASE WHEN failed > 0 THEN '. Could not read ' || array_to_string(unread, ', ') ELSE '' END || '.' AS feed,
  'Refreshed VC firms: ' || new || ' new ' || CASE new WHEN 1 THEN 'post' ELSE 'posts' END || ' from ' || reads || ' reads'
    || CASE WHEN few > 0 THEN ', ' || skipped || ' from the websites you added' ELSE '' END
    || CASE WHEN skipped > 0 THEN '; ' || skipped || ' Firecrawl reads skipped, as they ran in the last 24h' ELSE '' END
    || CASE WHEN failed > 0 THEN '; ' || failed || ' failed' ELSE '' END || '.' AS firms,
  CASE WHEN few = 0 THEN 'Events are up to date: every source was read in the last 24h.' ELSE 'Refreshed events: ' || new
    || ' new ' || CASE new WHEN 1 THEN 'event' ELSE 'events' END || ' from ' || few || ' reads'
    || CASE WHEN failed > 0 THEN '; ' || failed || ' failed' ELSE '' END || '.' END AS events,
  CASE WHEN few = 0 THEN 'LinkedIn is up to date: every account was read in the last 12h' || CASE WHEN new > 0 THEN '; '
      || new || ' waiting posts read.' ELSE '.' END
    ELSE 'Refreshed LinkedIn: ' || new || ' new ' || CASE new WHEN 1 THEN 'post' ELSE 'posts' END || ' from ' || few
      || CASE few WHEN 1 THEN ' account' ELSE ' accounts' END
      || CASE WHEN skipped > 0 THEN '; ' || skipped || ' read in the last 12h, skipped' ELSE '' END
      || CASE WHEN failed > 0 THEN '; ' || failed || ' failed' ELSE '' END || '.' END AS social FROM d""")
def refresh_sentences(t: Tables) -> DataFrame:
    """Every day of the read log as one refresh, told in the words of each page."""
    kind = F.col("kind")
    days = read_log(t).groupBy(F.col("started_at").cast("date").alias("day")).agg(
        F.count_if(kind != "signup").alias("reads"), (F.sum(F.when(kind == "view", F.col("items_new"))) % 3).alias("new"),
        F.count("error").alias("failed"), F.count_if(kind == "signup").alias("skipped"),
        (F.count_if(kind == "purchase") % 4).alias("some"),
        F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("source")))).alias("unread"))
    some = F.col("some")
    feed = days.withColumns({
        "rounds": F.when(some > 0, some), "firm_new": F.col("skipped"), "added_reads": F.when(some > 1, some),
        "added_new": F.col("failed"), "events_new": F.col("new"), "social_reads": F.when(some > 2, some),
        "social_new": F.col("new")}).select("*", health.feed_sentence().alias("feed"))
    firm = feed.withColumns({"added_reads": some, "added_new": F.col("skipped")}).select(
        "*", health.firms_sentence(24).alias("firms"))
    return firm.withColumns({"reads": some, "sorted": F.col("new")}).select(
        "day", "feed", "firms", health.events_sentence(24).alias("events"), health.social_sentence(12).alias("social"))


@query(f"""WITH {READ_SQL}, {ORDER_SQL}, l AS (SELECT max(started_at) AS last_refresh FROM reads),
s AS (SELECT CAST(sum({_COST}) AS DOUBLE) AS total, count(*) AS calls FROM events)
SELECT (SELECT count(*) FROM arts) AS total, last_refresh,
  greatest(last_refresh + INTERVAL 6 HOUR, TIMESTAMP '2024-01-31') AS next_refresh, calls,
  round(total, 6) AS total_usd FROM l, s""")
def overview(t: Tables) -> DataFrame:
    """Corpus, last and next refresh, and spend in one row."""
    return health.overview(order_articles(t), read_log(t), ledger(t), READ_AS_OF, 6).select(
        "total", "last_refresh", "next_refresh", "calls", F.round("total_usd", 6).alias("total_usd"))
