"""One whole refresh: every part in order, each over the tables the parts before it left.

``state`` holds the stored tables, ``inputs`` what was collected since the last refresh. Parts
without input are skipped; a part that fails is recorded, leaves its tables as they
were, and does not stop the rest.

A part hands over the rows it changed or added, whole, and they are merged by key: into the tables at hand, or
into a Store, where only the partitions of these rows are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.functions.markup import page_meta
from wirefold.functions.text import content_hash, label_text, url_hash
from wirefold.functions.times import instant
from wirefold.operators import dedupe, labels, search, sinks
from wirefold.operators.greedy import cut
from wirefold.operators.stored import Layout, Store, day, differing, hashed, replaced
from wirefold.sources import feeds, payloads
from wirefold.streaming.refresh import refresh

Tables = dict[str, DataFrame]
LAYOUTS = {
    "articles": Layout(("id",), day("ingested_at")), "rounds": Layout(("article_id",), day("extracted_at")),
    "firm_posts": Layout(("id",), hashed("id")), "added_rounds": Layout(("id",), hashed("id")),
    "events": Layout(("uid",), day("found_at")),
    "social_posts": Layout(("source_id", "post_id"), day("posted_at")),
    "chunks": Layout(("article_id", "chunk_index"), hashed("article_id"))}


def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``; those they lack are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in like.schema.fields])


def _differing(name: str, after: DataFrame, before: DataFrame) -> Tables:
    return {name: differing(after, before, LAYOUTS[name].key)}


def ingest(state: Tables, inputs: Tables, as_of) -> Tables:
    """New feed items, given as payloads or read already (``feed_items``): known links lend
    descriptions, the rest is deduplicated and added."""
    items = cut(inputs["feed_items"] if "feed_items" in inputs else feeds.parse_feeds(inputs["feed_payloads"]), "items")
    articles = state["articles"]
    offers = (items.where("description != ''").groupBy("url")
              .agg(F.min_by("description", F.struct("feed_url", "pos")).alias("description")))
    lacking = articles.where("coalesce(description, '') = ''").join(offers.select("url"), "url", "left_semi")
    filled = sinks.fill_empty(lacking, offers, "url", "description").withColumn("description_origin", F.lit("feed"))
    fresh = sinks.insert_new(items, articles, ["url"], ["feed_url", "pos"]).select(
        url_hash("url").alias("id"), "*", instant(as_of).alias("ingested_at"))
    stored = articles.where("canonical_id is null")
    for name, kind in (("feed_url", "string"), ("pos", "int")):      # a store may keep where an item stood
        if name not in stored.columns:
            stored = stored.withColumn(name, F.lit("" if kind == "string" else 0).cast(kind))
    told = dedupe.story_dedupe(fresh, as_of, ["ingested_at", "feed_url", "pos"], stored=stored)
    made = told.withColumn("content_hash", content_hash("headline", "description")).withColumn(
        "description_origin", F.when(F.col("description").isNotNull(), "feed"))
    return {"articles": filled.select(articles.columns).unionByName(_shaped(made, articles))}


def describe(state: Tables, inputs: Tables, as_of) -> Tables:
    """pages(url, body) of stories short of a description or date."""
    meta = inputs["pages"].select("url", page_meta("body").alias("m")).select(
        "url", "m.description", "m.published_at")
    asked = state["articles"].join(meta.select("url"), "url", "left_semi").select(state["articles"].columns)
    return _differing("articles", labels.apply_page_meta(asked, meta), asked)


def label(state: Tables, inputs: Tables, as_of) -> Tables:
    packed = inputs["enrich_packed"]
    asked = state["articles"].join(packed.select("id"), "id", "left_semi").select(state["articles"].columns)
    return _differing("articles", labels.apply_enrichment(asked, packed, inputs["enrich_answers"], as_of), asked)


def merge_by_company(state: Tables, inputs: Tables, as_of, touched: DataFrame | None = None) -> Tables:
    """``touched``: ids of new and changed stories; without it all are compared."""
    articles = state["articles"]
    merged = dedupe.company_dedupe(articles, changed=touched).withColumnRenamed("canonical_id", "merged")
    return {"articles": articles.join(merged, "id").withColumn("canonical_id", F.col("merged"))
            .select(articles.columns)}


def read_rounds(state: Tables, inputs: Tables, as_of) -> Tables:
    got = labels.apply_rounds(inputs["round_packed"], inputs["round_answers"], as_of)
    new = got.join(state["rounds"].select("article_id"), "article_id", "left_anti")
    return {"rounds": _shaped(new.withColumn("id", F.col("article_id")), state["rounds"])}


def _new_posts(found: DataFrame, known: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(posts of links not seen before under their owner, known posts that now have a date)."""
    first = dedupe.first_per_key(found, [owner, "url"], ["pos"])
    new = (first.join(known.select(owner, "url"), [owner, "url"], "left_anti")
           .withColumn("id", F.sha1(F.concat_ws("|", F.col(owner).cast("string"), "url")))
           .withColumn("snippet", label_text("snippet", 400)))
    dates = (found.where("published_at is not null").groupBy(owner, "url")
             .agg(F.min_by(F.struct("published_at", "date_approx"), "pos").alias("f")))
    dated = known.where("published_at is null").join(dates, [owner, "url"]).withColumn(
        "published_at", F.col("f.published_at")).withColumn("date_approx", F.col("f.date_approx"))
    return new, dated.select(known.columns)


def read_firms(state: Tables, inputs: Tables, as_of) -> Tables:
    """firm_found(firm, via, url, title, snippet, published_at, date_approx, pos): posts of firms, once per
    firm and link. Known ones without a date take one that was found; new ones are filled from their own
    pages (post_pages), and posts answered (firm_packed, firm_answers) get their kind."""
    known = state["firm_posts"]
    new, dated = _new_posts(inputs["firm_found"], known, "firm")
    new = cut(new, "posts")
    added = _shaped(new, known)
    if "post_pages" in inputs:
        # The first of a read are opened, in the order in which they were found.
        found = new.select(F.struct("pos", F.col("id").alias("key")).alias("id"), "url", "title", "published_at",
                           "date_approx", F.concat_ws("|", "firm", "via").alias("read"))
        needing = labels.posts_needing_page(found, "read").withColumn("id", F.col("id.key"))
        added = labels.apply_post_pages(added, needing, inputs["post_pages"])
    changed = dated.unionByName(added)
    if "firm_answers" not in inputs:
        return {"firm_posts": changed}
    packed = inputs["firm_packed"]
    asked = known.join(packed.select("id"), "id", "left_semi").select(known.columns)
    rows = replaced(asked, cut(changed, "posts"), LAYOUTS["firm_posts"].key)
    return _differing("firm_posts", labels.apply_firm_posts(rows, packed, inputs["firm_answers"], as_of), asked)


def read_added(state: Tables, inputs: Tables, as_of) -> Tables:
    """added_found(source_id, url, title, ...): posts of sites that readers added, as read_firms takes them. Those
    answered (added_packed, added_answers) are kept when they tell a round that no story, search or earlier
    site told."""
    known = state["added_rounds"]
    new, _ = _new_posts(inputs["added_found"], known, "source_id")
    added = _shaped(new.withColumn("headline", F.col("title")).withColumn("kept", F.lit(False)), known)
    if "added_answers" not in inputs:
        return {"added_rounds": added}
    dates = state["articles"].select(F.col("id").alias("article_id"), "published_at")
    told = state["rounds"].select("article_id", "company", "stage").join(dates, "article_id").drop("article_id")
    if "web_rounds" in state:
        told = told.unionByName(state["web_rounds"].where("kept").select("company", "stage", "published_at"))
    rows = known.unionByName(cut(added, "added"))
    return _differing("added_rounds", labels.apply_added_rounds(
        rows, inputs["added_packed"], inputs["added_answers"], told, as_of), known)


def read_events(state: Tables, inputs: Tables, as_of) -> Tables:
    """Calendar rows, and the sources they come from (source_key, via, firm) if given: an event keeps
    how it was found first and takes its source's present firm."""
    found = payloads.calendar_events(inputs["event_rows"])
    last = dedupe.first_per_key(found, ["uid"], ["starts_at", "title"])
    if "event_sources" in inputs:
        last = last.join(inputs["event_sources"].select("source_key", "via", "firm"), "source_key", "left")
    if dict(state["events"].dtypes).get("id") == "string":
        last = last.withColumn("id", F.col("uid"))
    last = cut(last, "events")
    known = state["events"].join(last.select("uid"), "uid", "left_semi").select(state["events"].columns)
    return {"events": sinks.upsert(known, last, "uid", as_of)}


def read_social(state: Tables, inputs: Tables, as_of) -> Tables:
    found = payloads.social_posts(inputs["social_rows"])
    known = state["social_posts"]
    new = sinks.insert_new(found, known, ["source_id", "post_id"], ["pos"])
    return {"social_posts": _shaped(new, known)}


def repair_chunks(state: Tables, inputs: Tables, as_of, touched: DataFrame | None = None) -> Tables:
    """Passages that no longer quote their story, of the ``touched`` stories or of all."""
    articles = state["articles"]
    if touched is not None:
        articles = articles.join(touched, "id", "left_semi")
    return {"chunks": _shaped(search.drifted_chunks(articles, state["chunks"]), state["chunks"])}


PARTS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "ingest": (ingest, ("feed_payloads",)), "describe": (describe, ("pages",)),
    "label": (label, ("enrich_packed", "enrich_answers")), "company": (merge_by_company, ()),
    "rounds": (read_rounds, ("round_packed", "round_answers")), "firms": (read_firms, ("firm_found",)),
    "added": (read_added, ("added_found",)), "events": (read_events, ("event_rows",)),
    "social": (read_social, ("social_rows",)), "chunks": (repair_chunks, ()),
}
NARROWED = ("company", "chunks")         # parts that can look at changed stories only


def full_refresh(spark: SparkSession, state: Tables, inputs: Tables, as_of, only_changed: bool = False,
                 store: Store | None = None, parts: tuple[str, ...] = tuple(PARTS)) -> tuple[Tables, DataFrame]:
    """(tables after the refresh, outcome of each part that ran).

    With a ``store`` its tables are the state, and ``state`` adds those that no part changes. ``only_changed``: the
    company pass and the passages look at the stories that this refresh changed; when one of the two failed,
    the next refresh is to look at all.
    """
    state = dict(state)
    if store:
        state.update({name: store.read(name) for name in store.schemas})
    touched: list[DataFrame] = []

    def keep(name: str, changed: DataFrame) -> None:
        changed = cut(changed, name)
        if store:
            store.merge(name, changed)
            state[name] = store.read(name)
        else:
            state[name] = cut(replaced(state[name], changed, LAYOUTS[name].key), name)
        if name == "articles":
            touched.append(changed.select("id"))

    def runner(name: str, part: Callable) -> Callable[[], None]:
        def run() -> None:
            narrow = {}
            if only_changed and name in NARROWED:
                none = state["articles"].select("id").limit(0)
                narrow["touched"] = reduce(DataFrame.unionByName, touched, none).distinct()
            for table, changed in part(state, inputs, as_of, **narrow).items():
                keep(table, changed)
        return run

    def ready(needs: tuple[str, ...]) -> bool:
        return all(n in inputs or (n == "feed_payloads" and "feed_items" in inputs) for n in needs)

    own = {"company": "articles", "chunks": "chunks"}            # parts without input need their table
    todo = {name: runner(name, part) for name, (part, needs) in PARTS.items()
            if name in parts and ready(needs) and (name not in own or own[name] in state)}
    return state, refresh(spark, todo)
