import datetime as dt
import re

from wirefold.streaming import refresh

AS_OF = dt.datetime(2026, 9, 25)
ITEM = ("url string, source string, headline string, description string, published_at timestamp, "
        "pos bigint")


def item(i, headline, days, description=None, source="s"):
    return (f"https://n.co/{i}", source, headline, description, AS_OF - dt.timedelta(days=days), i)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, ITEM).coalesce(1).write.parquet(f"{folder}/landed/{name}")


def test_batches_are_once_only_and_repeatable(spark, tmp_path):
    folder = str(tmp_path)
    stream = spark.readStream.schema(ITEM).parquet(f"{folder}/landed/*")
    root = f"{folder}/store"
    ids = []

    def each(df, batch):
        ids.append(batch)
        refresh.ingest_batch(df, batch, root, AS_OF)

    land(spark, folder, "one", [item(1, "Zepto hires new chief officer", 10),
                                item(2, "Ola opens battery plant", 9, "d")])
    refresh.run_available(stream, each, f"{folder}/cp")
    # A late story still meets its own days; a known link only lends its description.
    second = [item(3, "Zepto hires chief officer today", 11), item(1, "Zepto hires", 10, "lent"),
              item(2, "Ola", 9, "other"), item(4, "Zepto hires different chief", 1)]
    land(spark, folder, "two", second)
    refresh.run_available(stream, each, f"{folder}/cp")
    refresh.run_available(stream, each, f"{folder}/cp")
    assert ids == [0, 1]
    rows = {r.url: r for r in refresh.stored_articles(spark, root, 2).collect()}
    assert len(rows) == 4
    assert rows["https://n.co/3"].canonical_id == rows["https://n.co/1"].id
    assert rows["https://n.co/4"].canonical_id is None
    assert rows["https://n.co/1"].description == "lent" and rows["https://n.co/2"].description == "d"
    reads = spark.read.parquet(f"{root}/reads/batch=1").first()
    assert (reads.items_seen, reads.items_new, reads.items_duplicate) == (4, 1, 1)
    # The same batch again, as after a lost driver, leaves the same tables.
    refresh.ingest_batch(spark.createDataFrame(second, ITEM), 1, root, AS_OF)
    again = {r.url: r for r in refresh.stored_articles(spark, root, 2).collect()}
    assert again == rows


def test_the_first_lent_description_stays(spark, tmp_path):
    root = str(tmp_path / "store")
    for batch, lent in enumerate([None, "first", "second", ""]):
        rows = [item(1, "Zepto hires new chief officer", 10, lent), item(2, "Ola opens plant", 9, "own")]
        refresh.ingest_batch(spark.createDataFrame(rows, ITEM), batch, root, AS_OF)
    got = {r.url: r.description for r in refresh.stored_articles(spark, root, 4).collect()}
    assert got == {"https://n.co/1": "first", "https://n.co/2": "own"}
    empty = refresh.read_before(spark, root, "fills", 4, refresh.FILL, True)
    assert [(r.batch, r.description) for r in empty.collect()] == [(1, "first")]


def partition_filters(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)]


def test_a_batch_reads_its_own_days_and_prefixes(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = [item(i, f"Company{i} opens plant number {i}", i) for i in range(40)]
    refresh.ingest_batch(spark.createDataFrame(rows, ITEM), 0, root, AS_OF)
    late = spark.createDataFrame([item(3, "Company3", 3), item(90, "Company30 opens plant number 30", 10)], ITEM)
    links = refresh.links_read(late, root, 1)
    assert "prefix" in partition_filters(links)[0] and {r.url for r in links.collect()} >= {"https://n.co/3"}
    assert links.count() < 40
    near = refresh.stories_near(late, root, 1, AS_OF)
    by_day, by_key = partition_filters(near)
    assert "day" in by_day and "prefix" in by_key and "batch" in by_key
    got = {r.headline for r in near.collect()}
    assert got == {f"Company{i} opens plant number {i}" for i in (*range(0, 14), 30)}
    # The same headline twenty days away, outside the days that are read, is found by its key.
    refresh.ingest_batch(late, 1, root, AS_OF)
    told = {r.url: r for r in refresh.stored_articles(spark, root, 2).collect()}
    assert told["https://n.co/90"].canonical_id == told["https://n.co/30"].id and len(told) == 41


def test_undated_and_empty_batches(spark, tmp_path):
    root = str(tmp_path / "store")
    undated = ("https://n.co/u", "s", "Zepto hires new chief officer", None, None, 5)
    refresh.ingest_batch(spark.createDataFrame([undated], ITEM), 0, root, AS_OF)
    refresh.ingest_batch(spark.createDataFrame([], ITEM), 1, root, AS_OF)
    again = [("https://n.co/v", "s", "Zepto hires new chief officer", None, None, 6),
             ("https://n.co/w", "s", "Zepto hires new chief officer", None, AS_OF - dt.timedelta(days=400), 7)]
    refresh.ingest_batch(spark.createDataFrame(again, ITEM), 2, root, AS_OF)
    rows = {r.url: r.canonical_id for r in refresh.stored_articles(spark, root, 3).collect()}
    assert len(rows) == 3 and rows["https://n.co/u"] is None
    assert rows["https://n.co/v"] == rows["https://n.co/w"] is not None


def test_refresh_records_failures(spark):
    ran = []
    out = refresh.refresh(spark, {"a": lambda: ran.append(1), "b": lambda: 1 / 0,
                                  "c": lambda: ran.append(2)})
    assert {r.part: bool(r.error) for r in out.collect()} == {"a": False, "b": True, "c": False}
    assert ran == [1, 2]
