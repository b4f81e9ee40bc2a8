import datetime as dt
import json
import os

from pyspark.sql import functions as F

from tests.test_plans import ARTICLES, AS_OF, day, story
from wirefold.functions.text import url_hash
from wirefold.operators.stored import Layout, Store, differing
from wirefold.plans import refresh

POSTS = ("id string, firm string, via string, url string, title string, snippet string, headline string, "
         "company string, round_label string, amount string, kind string, published_at timestamp, "
         "date_approx boolean, classified_at timestamp")
FOUND = ("firm string, via string, url string, title string, snippet string, published_at timestamp, "
         "date_approx boolean, pos int")
ROUNDS = ("id string, source_id int, url string, headline string, snippet string, company string, stage string, "
          "round_label string, amount string, investors string, published_at timestamp, date_approx boolean, "
          "extracted_at timestamp, kept boolean")


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def articles_of(spark, rows):
    """Stories whose ids are those of their links, as an ingest makes them."""
    return spark.createDataFrame(rows, ARTICLES).withColumn("id", url_hash("url"))


def test_merge_rewrites_the_partitions_of_changed_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": Layout(("k",), "cast(k % 4 as string)")})
    store.create("t", spark.range(20).selectExpr("id as k", "'old' as v"))
    before = files(tmp_path)
    assert store.merge("t", spark.createDataFrame([(1, "new"), (21, "more")], "k long, v string")) == ["1"]
    rows = {r.k: r.v for r in store.read("t").collect()}
    assert len(rows) == 21 and rows[1] == "new" and rows[21] == "more" and rows[5] == "old" and rows[2] == "old"
    gone = before - files(tmp_path)
    assert gone and all("place=1/" in f for f in gone)
    assert store.merge("t", spark.createDataFrame([], "k long, v string")) == []
    plan = store.read("t", ["2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(place" in plan
    assert sorted(r.k for r in store.read("t", ["2"]).collect()) == [2, 6, 10, 14, 18]


def test_differing_rows(spark):
    was = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "k int, v string")
    now = spark.createDataFrame([(1, None), (2, "c"), (3, None), (4, None)], "k int, v string")
    assert sorted(r.k for r in differing(now, was, ("k",)).collect()) == [2, 3, 4]


def test_a_refresh_of_one_day_rewrites_that_day(spark, tmp_path):
    held = [story(i, day(i), headline=f"Number {i} of wholly separate tales {i}{i}", description=None if i < 4 else "long",
                  company=None)[:7] + (day(i),) + (None,) * 7 for i in range(1, 9)]
    store = Store(spark, str(tmp_path / "store"), refresh.LAYOUTS)
    rows = articles_of(spark, held)
    store.create("articles", rows)
    store.create("chunks", spark.createDataFrame([], "article_id string, chunk_index int, text string"))
    items = "feed_url string, source string, pos int, url string, headline string, description string, published_at timestamp"
    found = spark.createDataFrame([("f", "s", 0, "https://n.co/2", "Number 2", "Lent to the second", day(2)),
                                   ("f", "s", 1, "https://n.co/5", "Number 5", "Not needed", day(5)),
                                   ("f", "s", 2, "https://n.co/90", "Fresh story about nothing else", None, day(0))], items)
    state, outcome = refresh.full_refresh(spark, {}, {"feed_items": found}, AS_OF, only_changed=True, store=store)
    assert [r.error for r in outcome.collect()] == [None] * 3
    assert store.rewritten["articles"] == sorted([f"{day(2):%Y-%m-%d}", f"{AS_OF:%Y-%m-%d}"])
    got = {r.url: r for r in state["articles"].collect()}
    assert got["https://n.co/2"].description == "Lent to the second" and len(got) == 9
    assert got["https://n.co/5"].description == "long"
    assert got["https://n.co/90"].story_key and got["https://n.co/90"].ingested_at == AS_OF
    assert state["chunks"].count() == 2                      # the passages of the two stories
    plain, _ = refresh.full_refresh(spark, {"articles": rows, "chunks": state["chunks"].limit(0)},
                                    {"feed_items": found}, AS_OF)
    assert sorted(map(str, plain["articles"].collect())) == sorted(map(str, got.values()))
    assert plain["chunks"].count() == 9                      # all stories looked at


def test_firm_posts(spark):
    known = spark.createDataFrame([("a", "f", "rss", "u1", "One", None, None, None, None, None, None, None, None, None)],
                                  POSTS)
    found = spark.createDataFrame([
        ("f", "rss", "u1", "One again", None, day(1), False, 0), ("f", "rss", "u2", "Two", " a  b ", day(2), False, 1),
        ("f", "rss", "u2", "Two later", None, day(3), False, 2), ("g", "html", "https://g.co/big-news", "Big news", None,
                                                                 None, None, 0)], FOUND)
    pages = spark.createDataFrame([("https://g.co/big-news", "The big news", "What it says", day(4))],
                                  "url string, page_title string, description string, published_at timestamp")
    packed = spark.createDataFrame([("a", 0, 1)], "id string, batch long, number int")
    answers = spark.createDataFrame([(0, json.dumps([{"i": 1, "kind": "Investment", "company": "Acme"}]))],
                                    "batch long, body string")
    inputs = {"firm_found": found, "post_pages": pages, "firm_packed": packed, "firm_answers": answers}
    state, outcome = refresh.full_refresh(spark, {"firm_posts": known}, inputs, AS_OF)
    assert [(r.part, r.error) for r in outcome.collect()] == [("firms", None)]
    rows = {r.url: r for r in state["firm_posts"].collect()}
    assert len(rows) == 3 and rows["u1"].published_at == day(1) and rows["u1"].title == "One"
    assert (rows["u1"].kind, rows["u1"].company, rows["u1"].classified_at) == ("Investment", "Acme", AS_OF)
    assert (rows["u2"].title, rows["u2"].snippet, rows["u2"].kind) == ("Two", "a b", None)
    big = rows["https://g.co/big-news"]
    assert (big.title, big.published_at, big.snippet) == ("The big news", day(4), "What it says")
    again, _ = refresh.full_refresh(spark, state, inputs, AS_OF)
    assert sorted(map(str, again["firm_posts"].collect())) == sorted(map(str, rows.values()))


def test_added_sites_keep_rounds_that_nobody_told(spark):
    state = {
        "articles": spark.createDataFrame([story(1, day(3))], ARTICLES),
        "rounds": spark.createDataFrame([("1", "1", "Acme", "Seed")], "id string, article_id string, company string, stage string"),
        "added_rounds": spark.createDataFrame([("x", 7, "u0", "Old"), ("y", 7, "u9", "Later")],
                                              "id string, source_id int, url string, headline string")}
    state["added_rounds"] = state["added_rounds"].select("*", *[
        F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in ROUNDS.split(", ")[4:-1]], F.lit(False).alias("kept")
    ).withColumn("published_at", F.lit(day(1)))
    found = spark.createDataFrame([(7, "u0", "Old", None, day(1), False, 0), (7, "u2", "New", None, day(1), False, 1)],
                                  FOUND.replace("firm string, via string", "source_id int"))
    packed = spark.createDataFrame([("x", 0, 1), ("y", 0, 2)], "id string, batch long, number int")
    said = [{"i": 1, "raise": True, "company": "ACME", "round": "Seed"}, {"i": 2, "raise": True, "company": "Beta", "round": "Seed"}]
    answers = spark.createDataFrame([(0, json.dumps(said))], "batch long, body string")
    after, outcome = refresh.full_refresh(
        spark, state, {"added_found": found, "added_packed": packed, "added_answers": answers}, AS_OF, parts=("added",))
    assert [r.error for r in outcome.collect()] == [None]
    rows = {r.url: r for r in after["added_rounds"].collect()}
    assert {u: r.kept for u, r in rows.items()} == {"u0": False, "u9": True, "u2": False}
    assert rows["u9"].company == "Beta" and rows["u2"].headline == "New" and rows["u2"].extracted_at is None


def test_new_events_name_their_source(spark):
    kind = ("id string, uid string, source_key string, via string, firm string, url string, title string, "
            "starts_at timestamp, found_at timestamp, updated_at timestamp, city string")
    body = json.dumps({"url": "https://lu.ma/x", "name": "Demo day", "startAt": "2026-10-01T10:00:00Z", "city": "Pune"})
    rows = spark.createDataFrame([("k", False, body)], "source_key string, india_only boolean, body string")
    sources = spark.createDataFrame([("k", "luma", "f")], "source_key string, via string, firm string")
    inputs = {"event_rows": rows, "event_sources": sources}
    state, outcome = refresh.full_refresh(spark, {"events": spark.createDataFrame([], kind)}, inputs, AS_OF)
    assert [r.error for r in outcome.collect()] == [None]
    first = state["events"].first()
    assert (first.via, first.firm, first.id, first.city, first.found_at) == ("luma", "f", first.uid, "Pune", AS_OF)
    moved = {"event_rows": rows.withColumn("body", F.lit(body.replace("Pune", "Goa"))),
             "event_sources": sources.withColumn("firm", F.lit("g")).withColumn("via", F.lit("page"))}
    later = AS_OF + dt.timedelta(days=1)
    second = refresh.full_refresh(spark, state, moved, later)[0]["events"].collect()
    assert [(r.via, r.firm, r.id, r.city, r.found_at, r.updated_at) for r in second] == [
        ("luma", "g", first.uid, "Goa", AS_OF, later)]
