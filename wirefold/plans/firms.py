"""What firms do: their own posts and the rounds that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.patterns import needed_runs
from wirefold.functions.text import map_of
from wirefold.functions.times import in_days
from wirefold.functions.urls import domain
from wirefold.operators.dedupe import deal_dedupe
from wirefold.operators.greedy import cut
from wirefold.sources.registry import SITE_VIAS, VIA_LABELS, firm_reads

PIECE = 4         # letters of a run by which texts and aliases meet
SALTS = 32        # keys that the texts of a common piece are spread over
ORIGINS = ("site", "added", "search", "news")     # also who wins when a deal is seen twice
# Labels of the reads.
READ_LABELS = {
    "rss": "own website feed", "html": "own website news page", "sitemap": "own website sitemap",
    "scrape": "own website, via Firecrawl", "map": "own website, via Firecrawl",
    "search": "news search, via Firecrawl"}

ADDED_LABELS = {"rss": "its feed", "html": "its news page", "scrape": "its page, via Firecrawl"}


def alias_keys(firms: DataFrame) -> DataFrame:
    """(firm, firm_label, alias, piece): every alias with pieces of text, one of which it needs.

    Of the sets of runs that an alias needs (patterns.needed_runs) the one with the longest, then rarest
    beginnings among all aliases is taken; a piece is the first PIECE letters of a run. An alias that needs no
    run at all has the empty piece, which is in every text.
    """
    alias = firms.select(F.col("key").alias("firm"), F.col("label").alias("firm_label"),
                         F.explode("aliases").alias("alias")).where("alias is not null").distinct()
    sets = F.transform(needed_runs(F.col("alias")), lambda runs: F.array_distinct(
        F.transform(runs, lambda r: F.substring(r, 1, PIECE))))
    owned = alias.select("*", F.posexplode(F.when(F.size(sets) > 0, sets).otherwise(
        F.array(F.array(F.lit(""))))).alias("n_set", "pieces"))
    single = owned.select("firm", "firm_label", "alias", "n_set", F.explode("pieces").alias("piece"))
    often = single.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    key = ["firm", "firm_label", "alias"]
    best = (single.join(often, "piece").groupBy(*key, "n_set")
            .agg(F.min(F.length("piece")).alias("short"), F.sum("n").alias("n"), F.collect_list("piece").alias("pieces"))
            .groupBy(*key).agg(F.min(F.struct(-F.col("short"), "n", "n_set", "pieces"))["pieces"].alias("pieces")))
    return best.select(*key, F.explode("pieces").alias("piece"))


def named_firms(rounds: DataFrame, firms: DataFrame, text: Column | str = "investors") -> DataFrame:
    """One row per round and firm its investors name. Null aliases and null or empty texts name nobody.

    The distinct investor texts meet the aliases on a piece that the alias needs, by an equality
    join, and only those pairs are tried. Pieces under three letters, and the empty one of aliases that need no
    letters, are common in texts: their texts are spread over SALTS keys, each with the aliases.
    """
    text = F.col(text) if isinstance(text, str) else text
    named = rounds.withColumn("_text", text).where("_text is not null and _text != ''")
    texts = named.select("_text").distinct()
    aliases = cut(alias_keys(firms), "aliases")
    sizes = [r.n for r in aliases.select(F.length("piece").alias("n")).distinct().collect()]   # PIECE + 1 at most
    low = F.lower("_text")

    def cuts(size: int) -> Column:
        if size == 0:
            return F.array(F.lit(""))
        made = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1))),
                           lambda i: F.substr(low, i, F.lit(size)))
        return F.filter(F.array_distinct(made), lambda g: g.rlike(f"^[a-z0-9]{{{size}}}$"))
    common = F.length("piece") < 3
    asked = (texts.select("_text", F.explode(F.concat(*[cuts(n) for n in sizes] or [F.array().cast("array<string>")]))
                          .alias("piece"))
             .withColumn("salt", F.when(common, F.pmod(F.xxhash64("_text"), F.lit(SALTS))).otherwise(0)))
    posted = aliases.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(common, SALTS - 1)
                                                            .otherwise(0).cast("bigint"))))
    tried = F.expr("_text rlike concat('(?i)(?:', alias, ')')")
    hits = asked.join(posted, ["piece", "salt"]).where(tried).select("_text", "firm", "firm_label")
    return named.join(hits.distinct(), "_text").drop("_text")


def site_posts(posts: DataFrame, firms: DataFrame, added: DataFrame, include_other: bool = False
               ) -> DataFrame:
    """Sorted posts under the firm they are shown as. Posts of unknown firms are left out.

    ``added(id, url, label, firm)``: sites readers added; a post of one belongs to its tied firm,
    else to the site itself.
    """
    known = firms.select(F.col("key").alias("f_key"), F.col("label").alias("f_label"))
    sites = added.select(F.concat(F.lit("pasted-"), "id").alias("firm"),
                         F.col("url").alias("a_url"), F.col("label").alias("a_label"),
                         F.col("firm").alias("tied"))
    owner = known.select(F.col("f_key").alias("tied"), F.col("f_label").alias("tied_label"))
    sites = sites.join(owner, "tied", "left")
    joined = (posts.where("classified_at is not null")
              .join(sites, "firm", "left")
              .join(known, F.col("firm") == F.col("f_key"), "left"))
    is_added, tied = F.col("a_url").isNotNull(), F.col("tied_label").isNotNull()
    origin = F.when(is_added, "added").when(F.col("via").isin(*SITE_VIAS), "site").otherwise("search")
    label = F.when(is_added, domain("a_url")).otherwise(
        F.coalesce(F.try_element_at(map_of(VIA_LABELS), F.col("via")), F.col("via")))
    rows = joined.where(is_added | F.col("f_key").isNotNull())
    if not include_other:
        rows = rows.where(F.coalesce("kind", F.lit("Other")) != "Other")
    return rows.select(
        F.concat(F.lit("site-"), "id").alias("id"), F.col("id").alias("row_id"),
        F.when(is_added & tied, F.col("tied")).otherwise(F.col("firm")).alias("firm"),
        F.when(is_added, F.coalesce("tied_label", "a_label")).otherwise(F.col("f_label"))
        .alias("firm_label"),
        F.coalesce("kind", F.lit("Other")).alias("kind"),
        F.coalesce(F.when(F.col("headline") != "", F.col("headline")), "title").alias("headline"),
        "company", F.col("round_label").alias("round"), "amount", "published_at", "date_approx",
        "url", origin.alias("origin"), label.alias("source_label"))


def hidden_other(posts: DataFrame, firms: DataFrame, added: DataFrame) -> DataFrame:
    """Posts sorted as Other, counted before any date window or merging."""
    return (site_posts(posts, firms, added, include_other=True)
            .agg(F.count_if(F.col("kind") == "Other").alias("hidden_other")))


def news_posts(rounds: DataFrame, firms: DataFrame) -> DataFrame:
    """Rounds (as plans.rounds lists them) that name a firm, as posts of that firm."""
    text = F.array_join("investors", "; ")
    hits = named_firms(rounds, firms, text)
    prefix = F.when(F.col("origin") == "feed", "news-").otherwise("web-")
    return hits.select(
        F.concat(prefix, F.col("row_id").cast("string"), F.lit("-"), "firm").alias("id"),
        "row_id", "firm", "firm_label", F.lit("Investment").alias("kind"), "headline", "company",
        "round", "amount", "published_at", "date_approx", "url", F.lit("news").alias("origin"),
        "source_label")


def checked_firm(firm: str | None, firms: DataFrame, added: DataFrame) -> str | None:
    """``firm`` if it is the key of a tracked firm or of an added site, None if none is picked."""
    if not firm:
        return None
    known = firms.select("key").unionByName(added.select(F.concat(F.lit("pasted-"), "id").alias("key")))
    if known.where(F.col("key") == firm).isEmpty():
        raise ValueError(f"unknown firm {firm!r}")
    return firm


def firm_activity(posts: DataFrame, news: DataFrame, start=None, end=None,
                  origin: str | None = None, firm: str | None = None) -> DataFrame:
    """All rows of all firms, one per deal, newest first, or those of one firm (checked_firm).

    Deals are merged before the window and origin filters, so what wins does not depend
    on what is looked at; the firm is picked last.
    """
    if origin and origin not in ORIGINS:
        raise ValueError("origin is site, added, search or news")
    place = F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin"))
    # Written once: merging reads the rows three times, and each would look for firms in all investor texts.
    rows = cut(posts.unionByName(news).withColumn("place", place), "firm-rows")
    kept = deal_dedupe(rows, ["place", "row_id"])
    shown = kept.where(in_days("published_at", start, end))
    if origin:
        shown = shown.where(F.col("origin") == origin)
    if firm:
        shown = shown.where(F.col("firm") == firm)
    return shown.orderBy(F.col("published_at").desc_nulls_last(), "place", "row_id", "id")


def latest_reads(reads: DataFrame, *by: str) -> DataFrame:
    """Each entity's last read: the highest id."""
    return reads.groupBy(*by).agg(F.max_by(F.struct("started_at", "error"), "id").alias("r")).select(
        *by, F.col("r.started_at").alias("last_read"), F.col("r.error").alias("last_error"))


def firm_counts(activity: DataFrame, firms: DataFrame, reads: DataFrame, added: DataFrame | None = None
                ) -> DataFrame:
    """Every firm and read with the firm's row count (taken before a firm is picked) and health.

    ``added``: the sites that readers added, as added_sources gives them. One tied to a tracked firm is a
    further read of it, any other is listed as a firm of its own.
    """
    counts = activity.groupBy("firm").agg(F.count("*").alias("n"))
    ways = firm_reads(firms).withColumn("is_site", F.col("via").isin(*SITE_VIAS)).withColumn(
        "read_label", F.try_element_at(map_of(READ_LABELS), F.col("via")))
    health = ways.join(latest_reads(reads, "firm", "via"), ["firm", "via"], "left")
    listed = firms.select(F.col("key").alias("firm"), "label", "home", "no_site")
    if added is not None:
        sites = added.join(firms.select(F.col("key").alias("tied")), F.col("firm") == F.col("tied"), "left").select(
            F.coalesce("tied", F.concat(F.lit("pasted-"), "id")).alias("firm"), "label", F.col("url").alias("home"),
            F.col("tied").isNull().alias("own"), "via", F.lit(True).alias("is_site"),
            F.concat(F.lit("added by you, from "), F.coalesce(
                F.try_element_at(map_of(ADDED_LABELS), F.col("via")), F.col("via"))).alias("read_label"),
            "last_read", "last_error")
        health = health.unionByName(sites.select(health.columns))
        listed = listed.unionByName(sites.where("own").select("firm", "label", "home", F.lit(None).cast("string").alias("no_site")))
    return (listed.join(counts, "firm", "left").join(health, "firm", "left")
            .withColumn("count", F.coalesce("n", F.lit(0))).drop("n"))


def added_sources(sources: DataFrame, shown: DataFrame, reads: DataFrame) -> DataFrame:
    """Added sites with how much each shows and its last read. ``shown(source_id)``: one row each."""
    counts = shown.groupBy("source_id").agg(F.count("*").alias("n"))
    last = latest_reads(reads, "source_id")
    return (sources.withColumn("source_id", F.col("id")).join(counts, "source_id", "left")
            .join(last, "source_id", "left")
            .withColumn("shown", F.coalesce("n", F.lit(0))).drop("n", "source_id"))
