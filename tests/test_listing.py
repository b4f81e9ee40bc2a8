import pytest

from tests.test_plans import AS_OF, day
from wirefold.operators import labels
from wirefold.plans import firms, status
from wirefold.sources import registry


def registered(spark):
    return registry.checked_firms(spark, [
        {"key": k, "label": k.upper(), "home": "h", "site": {"via": "rss", "url": "u"}, "aliases": [], "events": []}
        for k in ("f", "g")])


def test_a_firm_is_picked_last_and_must_be_known(spark):
    reg = registered(spark)
    added = spark.createDataFrame([(7, "G", None), (8, "H", "f")], "id int, label string, firm string")
    assert firms.checked_firm("f", reg, added) == "f" and firms.checked_firm("pasted-7", reg, added) == "pasted-7"
    assert firms.checked_firm("", reg, added) is None and firms.checked_firm(None, reg, added) is None
    for name in ("F", "nobody", "pasted-9"):
        with pytest.raises(ValueError):
            firms.checked_firm(name, reg, added)


def test_added_sites_in_the_firm_list(spark):
    reg = registered(spark)
    sites = spark.createDataFrame([(7, "https://x.co", "X", "gone", "scrape"), (8, "https://y.co", "Y", "f", "rss")],
                                  "id int, url string, label string, firm string, via string")
    reads = spark.createDataFrame([(1, 8, "f", "rss", day(2), None), (2, 8, "f", "rss", day(1), "late")],
                                  "id int, source_id int, firm string, via string, started_at timestamp, error string")
    activity = spark.createDataFrame([("f",), ("f",), ("pasted-7",)], "firm string")
    table = firms.added_sources(sites, spark.createDataFrame([], "source_id int"), reads)
    rows = {(r.firm, r.read_label): r for r in firms.firm_counts(activity, reg, reads, table).collect()}
    assert set(rows) == {("f", "own website feed"), ("g", "own website feed"), ("f", "added by you, from its feed"),
                         ("pasted-7", "added by you, from its page, via Firecrawl")}
    assert rows["f", "added by you, from its feed"]["count"] == 2
    assert rows["f", "added by you, from its feed"].last_error == "late"
    own = rows["pasted-7", "added by you, from its page, via Firecrawl"]
    assert (own["count"], own.label, own.home, own.last_read) == (1, "X", "https://x.co", None)
    assert {r.firm: r["count"] for r in firms.firm_counts(activity, reg, reads).collect()} == {"f": 2, "g": 0}


def told(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("s")).first().s


def test_sentences(spark):
    feed = dict(new=1, rounds=None, firm_new=None, added_reads=0, added_new=0, events_new=None, social_reads=None,
                social_new=None, unread=[])
    assert told(spark, status.feed_sentence(), **feed) == "Refreshed: 1 new story."
    every = dict(new=2, rounds=1, firm_new=0, added_reads=3, added_new=4, events_new=1, social_reads=1, social_new=1,
                 unread=["a", "b"])
    assert told(spark, status.feed_sentence(), **every) == (
        "Refreshed: 2 new stories, 1 funding round read, 0 new VC firm posts, 4 new from the websites you added, "
        "1 new event, 1 new LinkedIn post. Could not read a, b.")
    assert told(spark, status.firms_sentence(24), new=1, reads=2, added_reads=0, added_new=0, skipped=3, failed=1) == (
        "Refreshed VC firms: 1 new post from 2 reads; 3 Firecrawl reads skipped, as they ran in the last 24h; 1 failed.")
    assert told(spark, status.events_sentence(24), new=0, reads=0, failed=0) == (
        "Events are up to date: every source was read in the last 24h.")
    assert told(spark, status.social_sentence(12), new=0, reads=0, skipped=0, failed=0, sorted=2) == (
        "LinkedIn is up to date: every account was read in the last 12h; 2 waiting posts read.")
    assert told(spark, status.social_sentence(12), new=1, reads=1, skipped=0, failed=0, sorted=0) == (
        "Refreshed LinkedIn: 1 new post from 1 account.")


def test_event_page_prompts(spark):
    hosts = spark.createDataFrame([("a", "Host A", True), ("b", "Host B", None)],
                                  "source_key string, organiser string, india_only boolean")
    pages = spark.createDataFrame([("a", "u1", "text"), ("b", "u2", None), ("c", "u3", "x"), (None, "u4", "y")],
                                  "source_key string, url string, body string")
    fields = (("Today is ", "today"), ("Page: ", "url"), ("From: ", "label"), ("", "rule"))
    rows = labels.event_pages(pages, hosts, AS_OF.replace(hour=20), "Only here.")     # the next day in India
    got = {r.url: r for r in labels.page_prompts(rows, "Head", fields, "Tail", limit=3).collect()}
    assert set(got) == {"u1", "u2"}
    assert got["u1"].prompt == "Head\nToday is 2026-09-26\nPage: u1\nFrom: Host A\nOnly here.\ntex\nTail" and got["u1"].cut == 1
    assert got["u2"].prompt == "Head\nToday is 2026-09-26\nPage: u2\nFrom: Host B\n\nTail" and got["u2"].cut == 0
