import datetime as dt

import pytest
from pyspark.sql import functions as F

from wirefold.functions import markup, taxonomy, text, times, urls
from wirefold.functions.answers import answer_rows, unwrap
from wirefold.sources import feeds, pages, payloads, registry

UTC = dt.datetime


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


RSS = """<?xml version="1.0"?><rss><channel><title>Chan</title>
<item><title>Zepto &amp;amp; Blinkit &lt;b&gt;merge&lt;/b&gt;</title><link> https://a.co/1 </link>
<pubDate>Tue, 23 Sep 2026 10:00:00 +0530</pubDate><category>Deals</category>
<category><![CDATA[Food & Co]]></category>
<description><![CDATA[<p>First &#8377;12 crore&nbsp;deal</p>]]></description></item>
<item><title>No link</title></item>
<item><title>Third</title><guid>https://a.co/3</guid><pubDate>bad</pubDate></item>
</channel></rss>"""
ATOM = """<feed><entry><title>Atom one</title><link rel="self" href="https://a.co/self"/>
<link rel="alternate" href="https://a.co/x"/><updated>2026-09-23T04:30:00Z</updated>
<category term="Tech"/><summary>Sum</summary></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("f1", "s1", RSS), ("f2", "s2", ATOM)],
                               "url string, source string, body string")
    got = {r.url: r for r in feeds.parse_feeds(df).collect()}
    assert set(got) == {"https://a.co/1", "https://a.co/3", "https://a.co/x"}
    one = got["https://a.co/1"]
    assert one.headline == "Zepto & Blinkit merge"
    assert one.description == "First ₹12 crore deal"
    assert one.published_at == UTC(2026, 9, 23, 4, 30) == got["https://a.co/x"].published_at
    assert one.feed_categories == ["Deals", "Food & Co"]
    assert got["https://a.co/x"].feed_categories == ["Tech"]
    assert got["https://a.co/3"].published_at is None
    assert feeds.feed_posts(df, limit=1).count() == 2


PAGE = """<html><head><title> The  page </title>
<meta property="og:description" content=" A &amp; B "><meta content="2026-09-24T10:00:00+05:30"
 property="article:published_time">
<link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate"
 type="application/rss+xml" title="Comments" href="/blog/comments/feed">
<link rel="alternate" type="application/atom+xml" href="/blog/feed"></head><body>
<nav><a href="/blog/nav-link-long">A navigation link with many words here</a></nav>
<header><a href="/blog/one#x"><h3>Acme raises a large round</h3> September 24, 2026 Read more</a></header>
<a href="/blog/one">Acme raises a large round from many investors this year</a>
<a href="two">Second post about the market today | 3 mins read</a>
<a href="/short">Too short</a><a href="https://x.com/post">A social link with plenty of words</a>
<script>var a = '<a href="/s">A script link with plenty of words</a>'</script>
<p>Text <b>bold</b> &copy;</p><footer><a href="/f">Footer link with many many words</a></footer>
</body></html>"""


def test_pages(spark):
    df = spark.createDataFrame([("https://site.co/blog/", PAGE)], "url string, body string")
    got = pages.html_posts(df).orderBy("rank").collect()
    assert [(r.url, r.title) for r in got] == [
        ("https://site.co/blog/one", "Acme raises a large round from many investors this year"),
        ("https://site.co/blog/two", "Second post about the market today")]
    assert not got[0].date_approx
    m = value(spark, markup.page_meta(F.lit(PAGE)))
    assert (m.description, m.published_at) == ("A & B", UTC(2026, 9, 24, 4, 30))
    assert value(spark, markup.page_title(F.lit(PAGE))) == "The page"
    assert value(spark, markup.declared_feed(F.lit(PAGE), F.lit("https://site.co/blog/"))) \
        == "https://site.co/blog/feed"
    lines = value(spark, markup.page_text(F.lit(PAGE), F.lit("https://site.co/blog/"))).split("\n")
    assert lines[0] == "The page" and lines[-3:] == ["Text", "bold", "©"]
    assert "[Too short](https://site.co/short)" in lines
    clean = value(spark, markup.clean_page(F.lit('<html><title>T</title><body class="x"><p id=1>'
                  'Hi <a class="c" href="/a?b=1">x</a><script>z</script></p></body></html>'),
                  F.lit("https://s.co/p/")))
    assert clean.html == '<h1>T</h1>\n<body><p>Hi <a href="https://s.co/a?b=1">x</a></p></body>'
    assert (clean.text_chars, clean.truncated) == (6, False)


def test_card_date_marks_an_approximate_day(spark):
    body = '<a href="/p/1">September 24, 2026 Acme raises a very large round</a>'
    r = pages.html_posts(spark.createDataFrame([("https://s.co/", body)],
                                               "url string, body string")).first()
    assert (r.title, r.published_at, r.date_approx) == (
        "Acme raises a very large round", UTC(2026, 9, 23, 18, 30), True)


def test_markdown_and_anchors(spark):
    md = ('![logo](x.png) [September 18\\ Acme raises five crore rupees](/news/a "t") '
          '[short](/news/b)')
    r = pages.markdown_posts(spark.createDataFrame([("https://s.co/", md)],
                                                   "url string, body string")).collect()
    assert [(x.url, x.title) for x in r] == [("https://s.co/news/a",
                                              "Acme raises five crore rupees")]
    html = ('<a href="/acme-raises-a-large-round-today">Acme raises a large round today</a>'
            '<a href="/tag/acme-raises-a-large-round-today">Acme raises a large round today</a>')
    got = pages.anchor_items(spark.createDataFrame([("https://s.co/", html)],
                                                   "url string, body string")).collect()
    assert [x.url for x in got] == ["https://s.co/acme-raises-a-large-round-today"]


def test_sitemaps(spark):
    xml = ("<urlset><url><loc>https://s.co/blog/old-post.html</loc><lastmod>2026-01-01</lastmod></url>"
           "<url><loc>https://s.co/blog/new%20post</loc><lastmod>2026-02-01T00:00:00Z</lastmod></url>"
           "<url><loc>https://s.co/about</loc></url></urlset>")
    index = "<sitemapindex><sitemap><loc>https://s.co/m1.xml</loc></sitemap></sitemapindex>"
    schema = "url string, body string"
    got = feeds.sitemap_posts(spark.createDataFrame([("m", xml)], schema), "/blog/").orderBy("rank")
    assert [(r.title, r.date_approx) for r in got.collect()] == [("New post", True),
                                                                 ("Old post", True)]
    undated = "".join(f"<url><loc>https://s.co/p/{i}</loc></url>" for i in range(120))
    assert feeds.sitemap_posts(spark.createDataFrame([("u", undated)], schema)).count() == 100
    both = feeds.resolve_sitemaps(spark.createDataFrame([("i", index)], schema),
                                  spark.createDataFrame([("https://s.co/m1.xml", xml)], schema),
                                  limit=2).orderBy("rank").collect()
    assert [r.title for r in both] == ["New post", "Old post"]


@pytest.mark.parametrize("raw,n", [
    ('[{"headline": "A", "url": "/a"}, 3]', 1),
    ('{"articles": [{"headline": "A"}]}', 1),
    ('{"content": "[{\\"headline\\": \\"A\\"}, {\\"headline\\": \\"B\\"}]"}', 2),
    ('{"headline": "A"}', 1),
    ('<reasoning>hm [1]</reasoning>```json\n[{"headline": "A"}]\n```', 1),
    ('[{"headline": "A }", "url": "/a"}, {"headline": "B"}, {"head', 2),
    ('<reasoning>never ends [{"headline": "A", "url": "/a"}', 1),
    ("NA", 0), (None, 0),
])
def test_answer_rows(spark, raw, n):
    assert len(value(spark, answer_rows(F.lit(raw).cast("string")))) == n


def test_listing_answers_and_search(spark):
    body = ('[{"headline": "One <b>story</b>", "url": "/one", "published": "2026-09-01"},'
            '{"headline": "Two", "url": "https://other.co/x"}, {"headline": "Again", "url": "/one"}]')
    items, bad = pages.answer_items(spark.createDataFrame(
        [("https://s.co/", body), ("https://t.co/", "NA")], "url string, body string"))
    assert [(r.url, r.headline, r.published_at) for r in items.collect()] == [
        ("https://s.co/one", "One story", UTC(2026, 8, 31, 18, 30))]
    assert [r.url for r in bad.collect()] == ["https://t.co/"]
    payload = ('{"data": {"news": [{"url": "ftp://x"}, {"url": "https://www.a.co/1", '
               '"title": "# Big [news](x)", "snippet": "s", "date": " 2 days ago "}]}}')
    r = pages.search_rows(spark.createDataFrame([("q", payload)], "query string, body string")).first()
    assert (r.n, r.title, r.description, r.domain, r.published) == (1, "Big news", "s", "a.co",
                                                                    "2 days ago")
    listing = '{"links": ["https://s.co/blog/my-post", {"url": "https://s.co/b", "title": "T"}]}'
    got = pages.listing_links(spark.createDataFrame([("https://s.co", listing)],
                                                    "url string, body string"))
    assert [r.title for r in got.orderBy("rank").collect()] == ["My post", "T"]
    assert value(spark, unwrap(F.lit('{"content": "[1, 2]"}'))) == "[1, 2]"


def test_events(spark):
    rows = [('{"url": "/e1", "name": " Demo  day ", "startAt": "2026-10-14T13:00:00.000Z", '
             '"isOnline": false, "addressShort": "HSR", "calendarName": "Cal", "countryCode": "in"}',),
            ('{"_diagnostic": true, "errorCode": "X"}',), ('{"url": "/e2", "name": "TBA"}',),
            ('{"url": "/e3", "name": "Abroad", "startAt": "2026-10-14T13:00", "countryCode": "US"}',)]
    df = spark.createDataFrame(rows, "body string").select(
        F.lit("k").alias("source_key"), F.lit(True).alias("india_only"), "body")
    got = payloads.calendar_events(df).collect()
    assert len(got) == 1
    e = got[0]
    assert (e.url, e.title, e.venue, e.host, e.online) == (
        "https://luma.com/e1", "Demo day", "HSR", "Cal", False)
    assert e.starts_at == UTC(2026, 10, 14, 13, 0)
    answer = ('{"events": [{"title": "Meet", "start": "14 Oct 2026"}, {"title": "X", "start": "soon"},'
              '{"name": "Call", "start": "2026-10-14T18:30", "url": "/call", "online": true}]}')
    page = spark.createDataFrame([("k", "https://f.co/events", answer)],
                                 "source_key string, page_url string, body string")
    got = {r.title: r for r in payloads.page_events(page).collect()}
    assert set(got) == {"Meet", "Call"}
    assert (got["Meet"].starts_at, got["Meet"].date_only, got["Meet"].own_link) == (
        UTC(2026, 10, 13, 18, 30), True, False)
    assert (got["Call"].starts_at, got["Call"].url, got["Call"].online) == (
        UTC(2026, 10, 14, 13, 0), "https://f.co/call", True)


def test_social_posts(spark):
    def row(**kw):
        import json
        base = {"type": "post", "id": "1", "content": "We  raised\n\n money",
                "linkedinUrl": "https://l.co/p", "author": {"name": "Acme.", "universalName": "acme"},
                "postedAt": {"timestamp": 1790000000000}}
        return json.dumps({**base, **kw})
    bodies = [row(), row(id="2", author={"universalName": "other"}), row(id="3", error="x"),
              row(id="4", content=" ", document={"title": "Deck"}, postedAt="2026-09-24T10:00:00Z"),
              row(id="5", type="comment"), row(id="6", isRepost=True)]
    df = spark.createDataFrame([(1, "acme", i, b) for i, b in enumerate(bodies)],
                               "source_id long, slug string, pos int, body string")
    got = {r.post_id: r for r in payloads.social_posts(df).collect()}
    assert set(got) == {"1", "2", "4", "6"}
    assert (got["1"].content, got["1"].author, got["1"].repost) == ("We raised\nmoney", "Acme", False)
    assert got["2"].repost and got["6"].repost and got["4"].content == "Deck"
    assert got["1"].posted_at == UTC(2026, 9, 21, 14, 13, 20)
    assert got["4"].posted_at == UTC(2026, 9, 24, 10, 0)


@pytest.mark.parametrize("v,label,want", [
    ("Pre-Seed", None, "Pre-Seed"), ("series a", None, "Series A"), (None, "Pre-Series A1", "Seed"),
    ("nonsense", "Bridge", "Seed"), ("Other", "Seed", "Other"), (None, "Angel round", "Pre-Seed"),
    ("Series C", "Series B2", "Series B"), (None, None, "Other")])
def test_stage(spark, v, label, want):
    assert value(spark, taxonomy.stage(F.lit(v).cast("string"), F.lit(label).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [
    ("pre seed", "Pre-Seed"), ("pre-series a", "Pre-Series A"), ("bridge", "Bridge"),
    ("series a1", "Series A1"), ("PRE  IPO", "Pre-IPO"), ("series bb", "Series BB"), ("", None),
    ("ncd debt", "NCD Debt")])
def test_round_label(spark, raw, want):
    assert value(spark, taxonomy.round_label(F.lit(raw))) == want


def test_labels(spark):
    assert value(spark, taxonomy.investors_text(taxonomy.split_investors(
        F.lit("Accel, accel; N/A and Blume Ventures.")))) == "Accel; Blume Ventures"
    assert value(spark, taxonomy.category(F.lit(" m&a "))) == "M&A"
    assert value(spark, taxonomy.category(F.lit("hiring layoffs"))) == "Hiring/Layoffs"
    assert value(spark, taxonomy.category(F.lit(None).cast("string"))) == "Other"
    assert value(spark, taxonomy.firm_post_kind(F.lit("portfolio"))) == "Portfolio news"
    assert value(spark, taxonomy.social_kind(F.lit("Fundraise"))) == "Funding"
    assert value(spark, text.label_text(F.lit(" Undisclosed. "), 50)) is None
    assert value(spark, text.company_text(F.lit(" Acme, "))) == "Acme"
    assert value(spark, text.feed_text(F.lit("<p>one two three</p>"), 9)) == "one two…"
    assert value(spark, text.steer_query(F.lit("zepto  news"))) == "zepto news startup news"
    assert value(spark, text.unescape(F.lit("&amp;lt; &#x20B9; &bogus; a&b"))) == "&lt; ₹ &bogus; a&b"


AS_OF = UTC(2026, 9, 25, 12, 0)


@pytest.mark.parametrize("raw,want,approx", [
    ("3 hours ago", UTC(2026, 9, 25, 9), True), ("2 days ago", UTC(2026, 9, 23, 12), True),
    ("yesterday", UTC(2026, 9, 24, 12), True), ("Sep 23, 2026", UTC(2026, 9, 22, 18, 30), False),
    ("1 month ago", UTC(2026, 8, 25, 12), True), ("nonsense", None, False), (None, None, False)])
def test_published_time(spark, raw, want, approx):
    r = value(spark, times.published_time(F.lit(raw).cast("string"), AS_OF))
    assert (r.ts, r.approx) == (want, approx if raw else r.approx)


@pytest.mark.parametrize("raw,want,day", [
    ("2026-10-14T18:30", UTC(2026, 10, 14, 13), False), ("2026-10-14", UTC(2026, 10, 13, 18, 30), True),
    ("14 Oct 2026", UTC(2026, 10, 13, 18, 30), True), ("2026-10-14T18:30:00Z", UTC(2026, 10, 14, 18, 30),
                                                      False),
    ("October 14th, 2026 6:30 pm", UTC(2026, 10, 14, 13), False), ("TBA", None, False)])
def test_event_time(spark, raw, want, day):
    r = value(spark, times.event_time(F.lit(raw)))
    assert (r.ts, r.date_only) == (want, day)


@pytest.mark.parametrize("base,href,want", [
    ("https://a.co/x/y?q=1", "z", "https://a.co/x/z"), ("https://a.co/x/y", "../z?k", "https://a.co/z?k"),
    ("https://a.co", "z", "https://a.co/z"), ("https://a.co/x", "//b.co/c", "https://b.co/c"),
    ("https://a.co/x", "mailto:a@b", "mailto:a@b"), ("https://a.co/x?q", "?r", "https://a.co/x?r"),
    ("https://a.co/x", "/./b/./c", "https://a.co/b/c"), ("https://a.co/x#f", "", "https://a.co/x#f")])
def test_join_url(spark, base, href, want):
    assert value(spark, urls.join_url(F.lit(base), F.lit(href))) == want


def test_url_rules(spark):
    r = value(spark, urls.social_account(F.lit("linkedin.com/company/Acme~C%C3%B6/posts/?x=1")))
    assert tuple(r) == ("https://www.linkedin.com/company/acme~c%C3%B6/", "company", "acme~cö", None)
    assert value(spark, urls.social_account(F.lit("linkedin.com/in/a%20b"))).reason == "no account"
    assert value(spark, urls.social_account(F.lit("https://linkedin.com/posts/x"))).reason == "single post"
    assert value(spark, urls.social_account(F.lit("https://evil.com/in/x"))).reason == "not a social link"
    assert value(spark, urls.normalise_url(F.lit(" a.co/x "))).url == "https://a.co/x"
    assert value(spark, urls.normalise_url(F.lit("https://u:p@a.co"))).reason == "has credentials"
    assert value(spark, urls.normalise_url(F.lit("nodots"))).reason == "not a web address"
    assert value(spark, urls.same_url(F.lit("https://A.co/"), F.lit("https://a.co")))
    assert value(spark, urls.calendar_read_url(F.lit("http://www.luma.com/x?a=1"))) == "https://lu.ma/x?a=1"
    assert not value(spark, urls.calendar_readable(F.lit("https://lu.ma/calendar/cal-1")))
    assert value(spark, urls.domain(F.lit("https://WWW.a.co/x"))) == "a.co"
    assert value(spark, urls.slug_title(F.lit("https://a.co/x/my-first_post.html/"))) == "My first post"


def test_ages(spark):
    ago = lambda h: F.lit(str(AS_OF - dt.timedelta(hours=h))).cast("timestamp")
    assert value(spark, times.read_ago(ago(0.5), AS_OF)) == "read just now"
    assert value(spark, times.read_ago(ago(30), AS_OF)) == "read 30h ago"
    assert value(spark, times.read_ago(ago(72), AS_OF)) == "read 3 days ago"
    assert value(spark, times.refreshed_ago(ago(0.25), AS_OF, 12)) == "Refreshed 15 min ago"
    assert value(spark, times.refreshed_ago(ago(50), AS_OF, 12)) \
        == "Refreshed 2 days ago (expected every 12h)"
    assert value(spark, times.mentions_events(F.lit("Join our demo day on 14 Oct")))


def test_registry(spark):
    good = [{"key": "f", "label": "Firm", "home": "h", "site": {"via": "rss", "url": "u"},
             "events": [{"via": "html", "url": "https://f.co", "site": True}]}]
    firms = registry.checked_firms(spark, good)
    added = spark.createDataFrame([(3, "https://x.co", "X", None, "page"),
                                   (4, "https://y.co", "Y", "f", "luma")],
                                  "id long, url string, label string, firm string, via string")
    got = {r.source_key.split(":")[0]: r for r in registry.event_sources(firms, added).collect()}
    assert got["f"].every_hours == 168 and got["f"].via_label == "Firm website"
    assert (got["site-3"].organiser_key, got["site-4"].organiser_key) == ("site-3", "f")
    with pytest.raises(ValueError, match="unknown site via"):
        registry.checked_firms(spark, [{"key": "b", "site": {"via": "fax", "url": "u"}}])
    with pytest.raises(ValueError, match="no reason"):
        registry.checked_firms(spark, [{"key": "b"}])


@pytest.mark.parametrize("html,left", [
    ("<nav><nav>x</nav><a href='/a'>menu</a></nav><p>y</p>", "<p>y</p>"),
    ("<div><form><p>a</p></div><p>b</p>", "<div></div><p>b</p>"),
    ("<ul><li>a<nav><li>b<li>c</nav></b><li>d</ul>", "<ul><li>a</b><li>d</ul>"),
    ("a<script>if (a<b) '</nav>'</script>b<!-- <nav> -->c", "abc"),
    ("a<nav/>b<img><br/>c<footer>d", "ab<img><br/>c"),
    ("<NAV>a</nav >b<style>c", "b"),
    ("a</nav>b<navx>c</navx>", "a</nav>b<navx>c</navx>"),
    ("1 < 2 <nav>x</nav> & 3", "1 < 2  & 3"),
    ("", ""), (None, None)])
def test_dropped_elements(spark, html, left):
    assert value(spark, markup.drop_tags(F.lit(html).cast("string"), markup.TEXT_DROP_TAGS)) == left


def test_dropping_elements_of_a_long_page(spark):
    page = "<div><nav><nav>x</nav>m</nav><p>y</p></div>" * 4000
    assert value(spark, F.length(markup.drop_tags(F.lit(page), markup.TEXT_DROP_TAGS))) == len("<div><p>y</p></div>") * 4000


def test_feed_markup_in_cdata(spark):
    body = ("<rss><channel><item><title>A story told</title><link>https://s.co/a</link><description><![CDATA[one </item> two &amp; "
            "three]]></description></item><!-- <item><title>no</title></item> --><item><title><![CDATA[B]]> &amp; C</title>"
            "<link>https://s.co/b</link><description><![CDATA[open</description></item></channel></rss>")
    df = spark.createDataFrame([("https://s.co/feed", "s", body)], "url string, source string, body string")
    got = [(r.url, r.headline, r.description) for r in feeds.parse_feeds(df).orderBy("pos").collect()]
    assert got[0] == ("https://s.co/a", "A story told", "one two & three") and len(got) == 1
    maps = spark.createDataFrame([("m", "s", "<urlset><url><loc><![CDATA[ https://s.co/x?a=1&b=2 ]]></loc><lastmod>2026-01-02</lastmod>"
                                   "</url><url ><loc>https://s.co/y&amp;z</loc></url></urlset>")], "url string, source string, body string")
    assert {r.url for r in feeds.sitemap_posts(maps).collect()} == {"https://s.co/x?a=1&b=2", "https://s.co/y&z"}
