"""Health of sources, spend, and the summaries of a refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.functions import money
from wirefold.functions.times import instant


def overflowed():
    """Every item of a read was new, so older ones may have been missed."""
    return (F.col("items_seen") > 0) & (F.col("items_new") == F.col("items_seen"))


def source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with its latest run."""
    last = runs.groupBy("source").agg(F.max_by(
        F.struct("started_at", "items_seen", "items_new", "error"), F.struct("started_at", "id"))
        .alias("r")).select("source", "r.*")
    return sources.join(last.withColumnRenamed("source", "name"), "name", "left").select(
        *sources.columns, F.col("started_at").alias("last_run"),
        F.coalesce("items_seen", F.lit(0)).alias("items_seen"),
        F.coalesce("items_new", F.lit(0)).alias("items_new"), "error",
        F.coalesce(overflowed(), F.lit(False)).alias("window_overflowed"))


def overflow_runs(runs: DataFrame, ignore_first: bool = True) -> DataFrame:
    """Runs that may have lost stories; a source's first run is all new and says nothing."""
    rows = runs.where(overflowed())
    if ignore_first:
        first = runs.groupBy("source").agg(F.min(F.struct("started_at", "id")).alias("f"))
        rows = rows.join(first, "source").where(F.struct("started_at", "id") > F.col("f")).drop("f")
    return rows


def status(articles: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    corpus = corpus_totals(articles)
    last = runs.agg(F.max("started_at")).scalar()
    hours = (instant(as_of).cast("double") - F.col("last_refresh").cast("double")) / 3600
    return corpus.withColumn("last_refresh", last).withColumn("hours_since_refresh", F.round(hours, 1))


def corpus_totals(articles: DataFrame) -> DataFrame:
    canonical = F.count_if(F.col("canonical_id").isNull())
    return articles.agg(F.count("*").alias("total"), canonical.alias("canonical"),
                        (F.count("*") - canonical).alias("deduped"),
                        F.max("published_at").alias("newest_published"))


def spend(ledger: DataFrame, as_of, total_cap: float = money.TOTAL_CAP,
          daily_cap: float = money.DAILY_CAP) -> DataFrame:
    """One row: spent, spent in the last 24 hours, what is left under both caps.

    Sums are decimal, so the result does not depend on how the ledger is partitioned.
    """
    cost = F.col("cost_usd").cast("decimal(28,9)")
    since = instant(as_of) - F.make_dt_interval(hours=F.lit(24))
    sums = ledger.agg(
        F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("total_usd"),
        F.coalesce(F.sum(F.when(F.col("ts") >= since, cost)), F.lit(0)).cast("double")
        .alias("last_24h_usd"), F.count("*").alias("calls"))
    left = sums.withColumn("remaining_total", F.greatest(
        F.lit(0.0), F.lit(total_cap) - F.col("total_usd"))).withColumn(
        "remaining_today", F.greatest(F.lit(0.0), F.lit(daily_cap) - F.col("last_24h_usd")))
    return left.withColumn("headroom", F.least("remaining_total", "remaining_today")).withColumn(
        "exhausted", F.col("headroom") <= 0)


def spend_by_feature(ledger: DataFrame) -> DataFrame:
    return (ledger.groupBy("feature").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("cost_usd").cast("decimal(28,9)")).cast("double").alias("cost_usd"))
        .orderBy(F.col("cost_usd").desc(), "feature"))


def spend_windows(ledger: DataFrame, size: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Spend of sliding day-long windows; works on a batch or a watermarked stream."""
    return ledger.groupBy(F.window("ts", size, slide).alias("w")).agg(
        F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))


def spend_report(ledger: DataFrame, as_of) -> DataFrame:
    """(line_no, line): the spend report as text, a line per feature below the totals."""
    s = spend(ledger, as_of)
    w = Window.orderBy(F.col("cost_usd").desc(), "feature")
    used = F.lit(100.0) * F.col("total_usd") / money.TOTAL_CAP
    head = s.select(F.posexplode(F.array(
        F.lit("LLM spend"),
        F.format_string(f"  total     $%.6f of ${money.TOTAL_CAP:.2f}  (%.1f%% used, $%.4f left)",
                        "total_usd", used, "remaining_total"),
        F.format_string(f"  last 24h  $%.6f of ${money.DAILY_CAP:.2f}  ($%.4f left)",
                        "last_24h_usd", "remaining_today"),
        F.format_string("  calls     %d", "calls"))).alias("line_no", "line"))
    # One row per feature name, so the ranking window is tiny.
    body = spend_by_feature(ledger).select(
        (F.row_number().over(w) + 3).alias("line_no"),
        F.format_string("  %-26s %7d %12s", "feature", "calls",
                        F.format_string("$%.6f", "cost_usd")).alias("line"))
    return head.unionByName(body).orderBy("line_no")


def refresh_totals(reads: DataFrame, *by: str) -> DataFrame:
    """New rows, failures and paid totals of the reads of one refresh."""
    return reads.groupBy(*by).agg(
        F.count("*").alias("reads"), F.sum("items_new").alias("new"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.sum(F.col("cost_usd").cast("decimal(28,9)")).cast("double").alias("cost_usd"),
        F.max(F.when(F.col("error").isNull(), F.col("started_at"))).alias("last_success"))


def refresh_summary(totals: DataFrame, what: str = "post") -> DataFrame:
    """A sentence per row of refresh_totals."""
    def plural(c: str, word: str):
        return F.when(F.col(c) == 1, word).otherwise(f"{word}s")
    text = F.concat(F.format_string("Refreshed: %d new %s from %d %s", "new", plural("new", what),
                                    "reads", plural("reads", "read")),
                    F.when(F.col("failed") > 0, F.format_string("; %d failed", "failed"))
                    .otherwise(""), F.lit("."))
    return totals.withColumn("summary", text)


# --- what a refresh by hand did, in a sentence ------------------------------------------------
# The wording of the sentences.

def _noun(c: str, one: str, many: str) -> Column:
    return F.when(F.col(c) == 1, one).otherwise(many)


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _when(cond: Column, *parts: Column | str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), _said(*parts)).otherwise(F.lit(""))


def _failed() -> Column:
    return _when(F.col("failed") > 0, "; ", F.col("failed"), " failed")


def _new(one: str, many: str) -> tuple[Column | str, ...]:
    return F.col("new"), " new ", _noun("new", one, many)


def feed_sentence() -> Column:
    """Over new, rounds, firm_new, added_reads, added_new, events_new, social_reads, social_new and the
    array ``unread`` of sources. A part that did not run is null (its reads 0 or null)."""
    c = F.col
    return _said(
        "Refreshed: ", *_new("story", "stories"),
        _when(c("rounds").isNotNull(), ", ", c("rounds"), " funding ", _noun("rounds", "round", "rounds"), " read"),
        _when(c("firm_new").isNotNull(), ", ", c("firm_new"), " new VC firm posts"),
        _when(c("added_reads") > 0, ", ", c("added_new"), " new from the websites you added"),
        _when(c("events_new").isNotNull(), ", ", c("events_new"), " new ", _noun("events_new", "event", "events")),
        _when(c("social_reads") > 0, ", ", c("social_new"), " new LinkedIn ", _noun("social_new", "post", "posts")),
        _when(F.size("unread") > 0, ". Could not read ", F.array_join("unread", ", ")), ".")


def firms_sentence(hours: int) -> Column:
    """Over new, reads, added_reads, added_new, skipped, failed; paid reads are ``hours`` apart."""
    c = F.col
    return _said(
        "Refreshed VC firms: ", *_new("post", "posts"), " from ", c("reads"), " reads",
        _when(c("added_reads") > 0, ", ", c("added_new"), " from the websites you added"),
        _when(c("skipped") > 0, "; ", c("skipped"), f" Firecrawl reads skipped, as they ran in the last {hours}h"),
        _failed(), ".")


def events_sentence(hours: int) -> Column:
    """Over new, reads, failed."""
    return F.when(F.col("reads") == 0, f"Events are up to date: every source was read in the last {hours}h.").otherwise(
        _said("Refreshed events: ", *_new("event", "events"), " from ", F.col("reads"), " reads", _failed(), "."))


def social_sentence(hours: int) -> Column:
    """Over new, reads (one per account), skipped, failed and ``sorted``, the waiting posts that were read."""
    c = F.col
    idle = _said(f"LinkedIn is up to date: every account was read in the last {hours}h",
                 F.when(c("sorted") > 0, _said("; ", c("sorted"), " waiting posts read.")).otherwise("."))
    return F.when(c("reads") == 0, idle).otherwise(_said(
        "Refreshed LinkedIn: ", *_new("post", "posts"), " from ", c("reads"), " ", _noun("reads", "account", "accounts"),
        _when(c("skipped") > 0, "; ", c("skipped"), f" read in the last {hours}h, skipped"), _failed(), "."))


def overview(articles: DataFrame, runs: DataFrame, ledger: DataFrame, as_of, every_hours: int) -> DataFrame:
    """One row: the corpus, the last and the next refresh, and the spend."""
    due = F.col("last_refresh") + F.make_dt_interval(hours=F.lit(every_hours))
    # Both sides are one row.
    return (status(articles, runs, as_of).withColumn("next_refresh", F.greatest(due, instant(as_of)))
            .join(F.broadcast(spend(ledger, as_of))))
