import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wirefold.operators import incremental, labels, search, sinks
from wirefold.operators.numbering import number_rows, running_sum
from wirefold.plans import events, feed, firms, refresh, rounds, social, status
from wirefold.sources import registry

AS_OF = dt.datetime(2026, 9, 25, 12)
ARTICLES = ("id string, url string, source string, headline string, description string, "
            "description_origin string, published_at timestamp, ingested_at timestamp, company string, "
            "category string, summary string, enriched_at timestamp, canonical_id string, "
            "story_key string, content_hash string")


def day(n, h=0):
    return AS_OF - dt.timedelta(days=n, hours=h)


def story(i, published, category="Funding", canonical=None, source="a", company="Acme", headline=None,
          description="A long enough description of the story in question"):
    return (str(i), f"https://n.co/{i}", source, headline or f"Acme story {i}", description, "feed",
            published, day(0, i), company, category, None, None, canonical, None, None)


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame([
        story(1, day(1)), story(2, day(2), source="b"), story(3, None), story(4, day(30)),
        story(5, day(1), canonical="1", source="c"), story(6, day(1), "Other"),
        story(7, day(3), "Policy/Regulation"), story(8, day(1), canonical="1", source="b"),
    ], ARTICLES).cache()


def test_bucket_counts_equal_feed_totals(spark, articles):
    defs = registry.as_table(spark, registry.DEFAULT_BUCKETS, registry.BUCKETS)
    got = {r.key: r for r in feed.buckets(articles, defs, AS_OF).collect()}
    for key, category in (("funded", "Funding"), ("policy", "Policy/Regulation")):
        total = feed.feed_total(articles, feed.FilterSpec(categories=(category,)), AS_OF).first()
        assert got[key]["count"] == total.total
    assert (got["funded"]["count"], got["market"]["count"]) == (3, 0)


def test_feed_page_order_and_outlets(articles):
    page = feed.feed_page(articles, feed.FilterSpec(), AS_OF, limit=10).collect()
    assert [r.id for r in page] == ["1", "6", "2", "7", "3"]        # undated last
    assert page[0].also_reported_by == ["c", "b"]
    assert feed.feed_total(articles, feed.FilterSpec(), AS_OF, limit=2).first().has_more
    for refused in (0, feed.MAX_PAGE + 1):
        with pytest.raises(ValueError):
            feed.feed_page(articles, feed.FilterSpec(), AS_OF, limit=refused)
        with pytest.raises(ValueError):
            feed.feed_total(articles, feed.FilterSpec(), AS_OF, limit=refused)
    wild = feed.FilterSpec(company="%")                              # no wildcard meaning
    assert feed.feed_rows(articles, wild, AS_OF).count() == 0
    assert feed.article(articles, "1").first().also_reported_by == ["c", "b"]
    groups = {r.id: r.day_key for r in feed.day_groups(articles).collect()}
    assert groups["3"] == "undated" and groups["1"] == "2026-09-24"


def test_indian_day_bounds(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2026, 9, 23, 18, 29, 59)),
                                  (2, dt.datetime(2026, 9, 23, 18, 30)),
                                  (3, dt.datetime(2026, 9, 24, 18, 29)), (4, None)],
                                 "id int, ts timestamp")
    from wirefold.functions.times import in_days
    assert [r.id for r in rows.where(in_days("ts", "2026-09-24", "2026-09-24")).collect()] == [2, 3]
    assert rows.where(in_days("ts")).count() == 4
    with pytest.raises(ValueError):
        in_days("ts", "2026-09-25", "2026-09-24")


def test_rounds_merge_ties_and_export(spark, articles):
    made = spark.createDataFrame([("1", "1", "Acme", "Seed", "seed", None, "A; B"),
                                  ("5", "5", "Dup", "Seed", "seed", None, None)],
                                 "id string, article_id string, company string, stage string, "
                                 "round_label string, amount string, investors string")
    web = spark.createDataFrame([("9", "Web", "Seed", "Seed", "$1", None, day(1), "w.co", "h", "u", True,
                                  True), ("10", "No", "Seed", "Seed", "", None, day(1), "w.co", "h", "u",
                                          True, False)],
                                "id string, company string, stage string, round_label string, amount string,"
                                "investors string, published_at timestamp, domain string, headline string,"
                                "url string, date_approx boolean, kept boolean")
    names = spark.createDataFrame([("a", "Outlet A")], "name string, label string")
    rows = rounds.all_rounds(rounds.feed_rounds(made, articles, names), rounds.web_rounds(web))
    got = rounds.rounds_of(rows, "Seed").collect()
    assert [r.id for r in got] == ["feed-1", "web-9"]               # a tie keeps the feed first
    assert got[0].source_label == "Outlet A" and got[0].investors == ["A", "B"]
    counts = {r.key: r["count"] for r in rounds.stage_counts(rows).collect()}
    assert counts == {"pre-seed": 0, "seed": 2, "series-a": 0, "series-b": 0, "other": 0}
    out = sinks.export_rounds(rows).orderBy("Found via").collect()
    assert len(out) == len(got) and out[0]["Amount"] == "Undisclosed"


def test_pack_numbers_every_row_once(spark):
    rows = spark.range(0, 1003, 1, 7).withColumn("headline", F.concat(F.lit("h"), "id")).withColumn(
        "description", F.lit(None).cast("string"))
    packed = labels.pack(rows, 30, labels.story_line(200), F.col("id").desc())
    got = packed.orderBy("batch", "number").collect()
    assert [r.id for r in got] == list(range(1002, -1, -1))
    assert [(r.batch, r.number) for r in got] == [(i // 30, i % 30 + 1) for i in range(1003)]
    first = labels.prompts(packed, "Head").where("batch = 0").first()
    assert first.prompt.startswith("Head\n[1] h1002\n[2] h1001\n") and first.records == 30
    n = number_rows(rows, F.col("id"))
    s = running_sum(n, "n", F.col("id") * F.lit(0.1), "run", block=10).orderBy("n").collect()
    assert all(abs(r.run - 0.1 * r.n * (r.n + 1) / 2) < 1e-6 for r in s)


def packed_of(articles):
    return labels.pack(labels.pending_articles(articles), 2, labels.story_line(200), F.col("id").asc())


def answers_of(spark, bodies):
    return spark.createDataFrame([(i, json.dumps(b) if not isinstance(b, str) else b)
                                  for i, b in enumerate(bodies)], "batch long, body string")


def test_enrichment_later_answer_wins_and_bad_ones_wait(spark, articles):
    packed = packed_of(articles)                          # ids 1,2 | 3,4 | 6,7
    answers = answers_of(spark, [
        [{"i": 1, "company": "Old"}, {"i": "1", "company": " New. ", "category": "ipo", "summary": "S  x"},
         {"i": "two"}, {"i": 9}, 5], "no json at all"])
    thin = articles.withColumn("description", F.when(F.col("id") == "1", "thin").otherwise(
        F.col("description")))
    got = {r.id: r for r in labels.apply_enrichment(thin, packed, answers, AS_OF).collect()}
    assert (got["1"].company, got["1"].category, got["1"].summary) == ("New", "IPO", "S x")
    assert (got["1"].description, got["1"].description_origin) == ("S x", "generated")
    assert got["2"].enriched_at is None and got["2"].company == "Acme" and len(got) == 8


def test_apply_is_idempotent(spark, articles):
    packed = packed_of(articles)
    answers = answers_of(spark, [[{"i": 1, "company": "New", "category": "ipo"}]])
    once = labels.apply_enrichment(articles, packed, answers, AS_OF)
    twice = labels.apply_enrichment(once, packed, answers, AS_OF)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert labels.pending_articles(once).count() == labels.pending_articles(articles).count() - 1


def test_label_evaluation(spark):
    want = spark.createDataFrame([(1, "Funding", ["M&A"], "Kotak Alts"), (2, "IPO", None, None),
                                  (3, "Other", None, "X")],
                                 "id int, category string, also_ok array<string>, company string")
    got = spark.createDataFrame([(1, "m&a", "kotak alts fund"), (2, "ipo", "null")],
                                "id int, category string, company string")
    r = labels.evaluate(want, got).first()
    assert (r.labelled, r.answered) == (3, 2)
    assert (r.exact, r.acceptable, r.company) == pytest.approx((1 / 3, 2 / 3, 2 / 3))


def test_posts_needing_their_page(spark):
    posts = spark.createDataFrame(
        [(i, "s", f"https://a.co/my-post-{i}", f"My post {i}", None, False) for i in range(20)]
        + [(99, "s", "https://a.co/x", "Real title", day(1), False)],
        "id int, source_key string, url string, title string, published_at timestamp, date_approx boolean")
    need = labels.posts_needing_page(posts)
    assert sorted(r.id for r in need.collect()) == list(range(12))
    meta = spark.createDataFrame([("https://a.co/my-post-1", "Own title", "About", day(2))],
                                 "url string, page_title string, description string, published_at timestamp")
    got = {r.id: r for r in labels.apply_post_pages(
        posts.withColumn("snippet", F.lit("")), need, meta).collect()}
    assert (got[1].title, got[1].snippet, got[1].published_at) == ("Own title", "About", day(2))
    assert got[2].title == "My post 2"


def test_names_from_own_posts(spark):
    src = spark.createDataFrame([(1, "slug", True), (2, "Kept", False)],
                                "id int, label string, label_auto boolean")
    found = spark.createDataFrame([(1, "Other", True, 0), (1, "Acme", False, 1), (2, "Z", False, 0)],
                                  "source_id int, author string, repost boolean, pos int")
    got = {r.id: (r.label, r.label_auto) for r in labels.name_from_posts(src, found).collect()}
    assert got == {1: ("Acme", False), 2: ("Kept", False)}


def test_upsert_keeps_found_at_and_is_idempotent(spark):
    old = spark.createDataFrame([("u1", "Old", day(9), day(9))],
                                "uid string, title string, found_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("u1", "New"), ("u2", "Two")], "uid string, title string")
    got = {r.uid: r for r in sinks.upsert(old, new, "uid", AS_OF).collect()}
    assert (got["u1"].title, got["u1"].found_at, got["u1"].updated_at) == ("New", day(9), AS_OF)
    assert got["u2"].found_at == AS_OF
    again = sinks.upsert(sinks.upsert(old, new, "uid", AS_OF), new, "uid", AS_OF).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_purge_and_writes(spark, tmp_path):
    gone = spark.createDataFrame([(1,)], "key int")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "source_id int, v string")
    left = sinks.purge(gone, {"posts": (rows, "source_id"), "reads": (rows, "source_id")})
    assert {n: [r.v for r in d.collect()] for n, d in left.items()} == {"posts": ["y"], "reads": ["y"]}
    path = str(tmp_path / "t")
    sinks.append_rows(rows, path, "source_id")
    sinks.append_rows(rows, path, "source_id")
    assert spark.read.parquet(path).count() == 4
    sinks.rewrite_partitions(rows.where("source_id = 2"), path, "source_id")
    assert spark.read.parquet(path).count() == 3
    sinks.write_export(rows, str(tmp_path / "csv"), "source_id")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_due_reads_ignore_failures(spark):
    src = spark.createDataFrame([("a", "luma", 24), ("b", "html", 168), ("c", "page", 24)],
                                "source_key string, via string, every_hours int")
    reads = spark.createDataFrame([("a", "upcoming", day(2), None), ("a", "past", day(90), None),
                                   ("b", "page", day(2), None), ("c", "page", day(0, 1), "boom")],
                                  "source_key string, kind string, started_at timestamp, error string")
    assert sorted(r.source_key for r in incremental.due(src, reads, AS_OF).collect()) == ["a", "c"]
    assert {(r.source_key, r.kind) for r in incremental.due_kinds(src, reads, AS_OF).collect()} == {
        ("a", "upcoming"), ("c", "page")}
    s = incremental.schedule(reads, AS_OF).first()
    assert s.fresh and s.cooldown_seconds == 0 and s.next_due == day(0, 1) + dt.timedelta(hours=12)


def test_events_last_their_day(spark):
    src = spark.createDataFrame([("s", "https://s.co", False, "f", "Firm", "Web"),
                                 ("site-1", "https://t.co", True, "site-1", "T", "Web")],
                                "source_key string, source_url string, custom boolean, organiser_key string,"
                                "organiser string, via_label string")
    rows = spark.createDataFrame(
        [(1, "site-1", "https://e.co/1", day(0, 1), None, False),
         (2, "s", "https://e.co/1/", day(0, 1), None, False),
         (3, "s", "https://s.co", day(0, 20), None, True), (4, "s", "https://s.co", day(-1), None, False),
         (5, "gone", "https://x.co", day(1), None, False)],
        "id int, source_key string, url string, starts_at timestamp, ends_at timestamp, date_only boolean")
    shown = events.shown_events(rows, src, AS_OF)
    assert {r.id: r.when for r in shown.collect()} == {2: "past", 3: "upcoming", 4: "upcoming"}
    assert [r.id for r in events.listing(shown, "upcoming").collect()] == [3, 4]
    t = events.event_totals(shown, "f").first()
    assert (t.upcoming, t.past) == (2, 1)


def test_firm_activity_prefers_own_site(spark):
    reg = registry.checked_firms(spark, [
        {"key": "f", "label": "Firm", "home": "h", "site": {"via": "rss", "url": "u"},
         "aliases": [r"\bfirm\b"], "events": []}])
    posts = spark.createDataFrame(
        [(1, "f", "rss", "u", "t", None, "Acme", "Seed", None, "Investment", day(3), False, day(0)),
         (2, "f", "rss", "u", "t", None, "Beta", None, None, "Other", day(3), False, day(0)),
         (3, "pasted-7", "added", "u", "t", "h", "Gamma", None, None, "Fund news", None, False, day(0)),
         (4, "nobody", "rss", "u", "t", None, "Z", None, None, "Fund news", day(1), False, day(0))],
        "id int, firm string, via string, url string, title string, headline string, company string,"
        "round_label string, amount string, kind string, published_at timestamp, date_approx boolean,"
        "classified_at timestamp")
    added = spark.createDataFrame([(7, "https://www.g.co/x", "G", None)],
                                  "id int, url string, label string, firm string")
    own = firms.site_posts(posts, reg, added)
    assert firms.hidden_other(posts, reg, added).first().hidden_other == 1
    news = spark.createDataFrame(
        [("feed", 10, "ACME ", ["The FIRM", "X"], day(10)), ("web", 11, "Acme", ["firm"], day(60)),
         ("web", 12, "Delta", ["confirmed"], day(1))],
        "origin string, row_id int, company string, investors array<string>, published_at timestamp"
    ).select("*", *[F.lit("x").alias(c) for c in ("headline", "round", "amount", "url", "source_label")],
             F.lit(False).alias("date_approx"))
    rows = firms.firm_activity(own, firms.news_posts(news, reg)).collect()
    assert [r.id for r in rows] == ["site-1", "web-11-f", "site-3"]
    assert rows[2].source_label == "g.co" and rows[2].firm == "pasted-7"


def test_social_counts(spark):
    rows = spark.createDataFrame(
        [(1, 1, "We  raised", "Ann", False, "Funding", None, "Seed", day(1), day(0)),
         (2, 1, "Hiring", "Bob", True, "Other", None, None, None, day(0)),
         (3, 2, "Launch", "Cy", True, "Funding", "H", None, day(2), day(0)),
         (4, 2, "x", "Cy", True, None, "H", None, day(2), None)],
        "id int, source_id int, content string, author string, repost boolean, kind string,"
        "headline string, round_label string, posted_at timestamp, classified_at timestamp"
    ).withColumn("company", F.lit("A")).withColumn("amount", F.lit(None).cast("string")).withColumn(
        "investors", F.lit(None).cast("string")).withColumn("url", F.lit("u"))
    src = spark.createDataFrame([(1, "One"), (2, "Two")], "id int, label string")
    shown = social.posts(rows, src)
    assert tuple(social.kind_counts(shown, 1).first()) == (1, 0, 1)
    assert [r.id for r in social.listing(shown).collect()] == [1, 3]
    got = {r.id: (r.stage, r.source_label) for r in social.funding_rounds(shown).collect()}
    assert got == {"social-1": ("Seed", "One"), "social-3": ("Other", "Two (repost of Cy)")}


def test_spend_and_report(spark):
    ledger = spark.createDataFrame([("a", day(0, 1), 0.1), ("a", day(3), 0.2), ("b", day(5), 0.05)],
                                   "feature string, ts timestamp, cost_usd double")
    s = status.spend(ledger, AS_OF).first()
    assert (s.calls, s.exhausted) == (3, False)
    assert (s.total_usd, s.last_24h_usd, s.headroom) == pytest.approx((0.35, 0.1, 0.4))
    lines = [r.line for r in status.spend_report(ledger, AS_OF).collect()]
    assert lines[0] == "LLM spend" and lines[4].split() == ["a", "2", "$0.300000"]


def test_search_index_update_equals_rebuild(spark):
    docs = spark.createDataFrame([(1, "Zepto raises funding", None, "Zepto", None),
                                  (2, "Funding rounds rise", "About zepto's rivals", "Ola", None),
                                  (3, "Nothing here", None, None, None)],
                                 "id int, headline string, description string, company string, summary string")
    index = search.postings(docs)
    changed = docs.where("id = 3").withColumn("headline", F.lit("Zepto raised again"))
    fresh = docs.where("id != 3").unionByName(changed)
    a = sorted(map(str, search.update_postings(index, changed).collect()))
    assert a == sorted(map(str, search.postings(fresh).select(*index.columns).collect()))
    hits = search.ranked(search.postings(fresh), "raising").collect()
    assert {r.id for r in hits} == {1, 3}
    tiers = search.tiered(search.postings(fresh), fresh, "funding", "ola", 10).collect()
    assert [(r.id, r.tier) for r in tiers] == [(2, 1), (1, 3)]


def test_full_refresh_survives_a_bad_part(spark):
    rss = "".join(f"<item><title>{t}</title><link>https://n.co/{i}</link></item>" for i, t in enumerate(
        ["Zepto hires new chief officer", "Zepto hires a new chief officer", "Ola opens plant"]))
    feeds = spark.createDataFrame([("https://n.co/feed", "n", f"<rss>{rss}</rss>")],
                                  "url string, source string, body string")
    state = {"articles": spark.createDataFrame([], ARTICLES),
             "chunks": spark.createDataFrame([], "article_id string, chunk_index int, text string")}
    bad = spark.createDataFrame([("x",)], "nonsense string")
    after, outcome = refresh.full_refresh(spark, state, {"feed_payloads": feeds, "event_rows": bad}, AS_OF)
    errors = {r.part: r.error for r in outcome.collect()}
    assert errors["events"] and not errors["ingest"] and not errors["chunks"]
    rows = after["articles"].collect()
    assert len(rows) == 3 and sum(r.canonical_id is not None for r in rows) == 1
    assert after["chunks"].count() == 3
    again, _ = refresh.full_refresh(spark, after, {"feed_payloads": feeds}, AS_OF)
    assert sorted(map(str, again["articles"].collect())) == sorted(map(str, rows))


def test_many_firms_are_all_matched(spark):
    kind = "key string, label string, aliases array<string>"
    rows = [(f"f{i}", f"Fund {i}", [f"\\bfund{i:05d} ventures\\b"]) for i in range(20_000)]
    rows += [("two", "Two", ["\\bab\\b"]), ("any", "Any", ["zed(?:ra)? capital"]), ("amp", "Amp", ["a&b partners"])]
    made = spark.createDataFrame(rows, kind)
    said = ["Fund00007 Ventures; AB and Zed Capital", "fund19999 ventures, xfund00001 ventures", "ZEDRA CAPITAL; abc",
            "A&B Partners", None, ""]
    rounds = spark.createDataFrame(list(enumerate(said)), "id int, investors string")
    got = {(r.id, r.firm) for r in firms.named_firms(rounds, made).collect()}
    assert got == {(0, "f7"), (0, "two"), (0, "any"), (1, "f19999"), (2, "any"), (3, "amp")}


def test_firm_activity_reads_posts_and_news_once(spark):
    """merging deals asks for the rows several times; which rounds name a firm is worked out once."""
    reads = spark.sparkContext.accumulator(0)

    def read(title):
        reads.add(1)
        return title
    seen = F.udf(read, "string").asNondeterministic()

    def rows(origin, n):
        day = F.timestamp_seconds(F.lit(915148800) + F.col("id") * 86400 * 5)
        return spark.range(n).select(
            F.concat(F.lit(f"{origin}-"), "id").alias("id"), F.col("id").alias("row_id"), F.lit("n-1").alias("firm"),
            F.when(F.col("id") % 4 != 1, "Acme").alias("company"), seen(F.lit("x")).alias("headline"),
            day.alias("published_at"), F.lit(origin).alias("origin"))
    got = [r.id for r in firms.firm_activity(rows("site", 4), rows("news", 8)).collect()]
    assert reads.value == 12
    assert sorted(got) == ["news-1", "news-5", "news-6", "site-0", "site-1", "site-3"]
