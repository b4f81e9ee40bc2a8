"""Expressions that are evaluated once, however often their value is used."""

import datetime as dt

from pyspark.sql import functions as F

from wirefold.functions import taxonomy, times
from wirefold.operators import search, term_index
from wirefold.sources import feeds, payloads


def said(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_investors_are_cleaned_once(spark):
    df = spark.createDataFrame([("A, a; n/a and B",)], "s string").select(
        taxonomy.investors_text(taxonomy.split_investors("s")).alias("i"))
    assert said(df, "not disclosed") == 1
    assert df.first().i == "A; B"


def test_times_of_page_events_are_read_once(spark):
    rows = [("k", "https://f.example/e", '[{"title": "T", "start": "5 March 2026 6:30 pm"}, {"title": "U", "start": "soon"}]')]
    df = payloads.page_events(spark.createDataFrame(rows, "source_key string, page_url string, body string"))
    assert said(df, "d MMM yyyy HH:mm:ss") == 2                 # start and end
    assert [(r.title, r.starts_at, r.date_only) for r in df.collect()] == [("T", dt.datetime(2026, 3, 5, 13, 0), False)]


def test_fields_of_feed_items_are_read_once(spark):
    body = "<rss><item><title>A &amp; B</title><link>https://d.example/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item></rss>"
    df = feeds.parse_feeds(spark.createDataFrame([("u", "s", body)], "url string, source string, body string"))
    assert said(df, "isPermaLink") == 1
    assert [(r.headline, r.published_at) for r in df.collect()] == [("A & B", dt.datetime(2026, 1, 5, 10))]


def test_every_written_form_is_still_read(spark):
    forms = ["5 Jan 2026", "Jan 5, 2026", "5 Jan 2026 10:20:30", "5 Jan 2026 10:20", "5 Jan 2026 1:20 pm", "5 Jan 2026 1:20PM",
             "5 Jan 2026 1 pm", "5 Jan 2026 1pm", "Mon, 05 Jan 2026 10:20:30 GMT", "soon", "", "5 Jan", "5 Jan 2026 25:00"]
    df = spark.createDataFrame([(f,) for f in forms], "s string").select(times.read_time("s", "UTC")["ts"].alias("ts"))
    day = dt.datetime(2026, 1, 5)
    at = [day, day, day.replace(hour=10, minute=20, second=30), day.replace(hour=10, minute=20), day.replace(hour=13, minute=20),
          day.replace(hour=13, minute=20), day.replace(hour=13), day.replace(hour=13), day.replace(hour=10, minute=20, second=30),
          None, None, None, None]
    assert [r.ts for r in df.collect()] == at
    title = spark.createDataFrame([("One Jan 5, 2026 two Read  more about 5 mins read",), ("A year 2026 stays, MIN read more",)], "s string")
    assert [r[0] for r in title.select(times.tidy_title(F.col("s"))).collect()] == ["One two Read more about", "A year 2026 stays, MIN"]


def test_words_are_counted_and_stemmed_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "Reads reading b a b", None), (2, "", "things")], "id long, headline string, description string")
    for stemming, want in ((True, {(1, "headline", "read", 2), (1, "headline", "b", 2), (1, "headline", "a", 1), (2, "description", "thing", 1)}),
                           (False, {(1, "headline", "reads", 1), (1, "headline", "reading", 1), (1, "headline", "b", 2),
                                    (1, "headline", "a", 1), (2, "description", "things", 1)})):
        df = search.postings(docs, ("headline", "description"), stemming)
        assert said(df, "Join") == 0 and said(df, "Aggregate") == 0
        assert {tuple(r) for r in df.select("id", "field", "term", "tf").collect()} == want
    assert said(term_index.counted(docs, ("headline", "description")), "Aggregate") == 0
