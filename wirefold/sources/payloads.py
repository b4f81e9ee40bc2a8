"""JSON payloads (calendar rows, page-event answers, social posts) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.answers import answer_rows, json_part
from wirefold.functions.text import blank_to_null, col, label_text, let, squeeze, strip
from wirefold.functions.times import event_time, read_time
from wirefold.functions.urls import event_uid, web_url

# --- fixed values -------------------------------------------------------------
NO_VALUE = ("null", "none", "n/a", "tba", "tbd")
HOME_ZONES = ("Asia/Kolkata", "Asia/Calcutta")
HOME_COUNTRY = "IN"
POST_CHARS = 4000
CALENDAR_BASE = "https://luma.com/"
# ------------------------------------------------------------------------------

CALENDAR_ROW = (
    "eventId string, url string, name string, startAt string, endAt string, timezone string, "
    "isOnline string, venueName string, addressShort string, city string, country string, "
    "countryCode string, hostName string, calendarName string, description string, "
    "_diagnostic string, _sample string")
POST_ROW = (
    "type string, id string, error string, content string, linkedinUrl string, "
    "document struct<title: string>, socialContent struct<shareUrl: string>, "
    "author struct<name: string, universalName: string, publicIdentifier: string>, "
    "postedAt string, repostedBy string, isRepost string, resharedPost string")


def field_text(c: Column | str, limit: int) -> Column:
    return let(squeeze(c), lambda t: F.when(
        (t != "") & ~F.lower(t).isin(*NO_VALUE), F.substring(t, 1, limit)))


def _truth(c: Column | str) -> Column:
    return F.when(col(c) == "true", True).when(col(c) == "false", False)


def _set(c: Column | str) -> Column:
    return F.coalesce(~col(c).isin("", "false", "0", "null", "[]", "{}"), F.lit(False))


def _some(*cols) -> Column:
    return F.coalesce(*[blank_to_null(col(c)) for c in cols])


def calendar_events(rows: DataFrame) -> DataFrame:
    """Events of calendar rows(source_key, india_only, body); diagnostics are not events."""
    parsed = rows.select("source_key", F.col("india_only"), F.from_json("body", CALENDAR_ROW)
                         .alias("r")).select("source_key", "india_only", "r.*")
    real = parsed.where(~_set("_diagnostic") & ~_set("_sample"))
    here = (F.upper("countryCode") == HOME_COUNTRY) | F.col("timezone").isin(*HOME_ZONES)
    events = real.where(~F.coalesce("india_only", F.lit(False))
                        | F.coalesce(here, F.lit(False))).select(
        "source_key", web_url("url", F.lit(CALENDAR_BASE)).alias("url"), F.lit(True).alias("own_link"),
        field_text("name", 300).alias("title"), event_time("startAt")["ts"].alias("starts_at"),
        event_time("endAt")["ts"].alias("ends_at"), F.lit(False).alias("date_only"),
        field_text("timezone", 60).alias("timezone"),
        field_text(_some("venueName", "addressShort"), 300).alias("venue"),
        field_text("city", 120).alias("city"), field_text("country", 80).alias("country"),
        _truth("isOnline").alias("online"),
        field_text(_some("hostName", "calendarName"), 300).alias("host"),
        field_text("description", 400).alias("description"))
    return _with_uid(events.where("url is not null and title is not null and starts_at is not null"))


def page_events(answers: DataFrame) -> DataFrame:
    """Events of page answers(source_key, page_url, body): a list, or an object's first list."""
    def list_in(part: Column) -> Column:
        fields = F.map_values(F.from_json(F.when(part.startswith("{"), part), "map<string,string>"))
        return F.coalesce(F.when(part.startswith("["), part),
                          F.get(F.filter(fields, lambda v: v.startswith("[")), F.lit(0)))

    listed = let(json_part("body"), list_in)
    items = F.filter(F.from_json(listed, "array<string>"), lambda i: i.startswith("{"))
    fields = ("title string, name string, start string, end string, city string, "
              "venue string, online string, url string, description string")

    # Finished inside the array, before items become rows, so that the filter sees values and nothing is done twice.
    def finished(r: Column) -> Column:
        return F.struct(
            web_url(r["url"], "page_url").alias("link"),
            field_text(_some(r["title"], r["name"]), 300).alias("title"), event_time(r["start"]).alias("start"),
            event_time(r["end"])["ts"].alias("ends_at"), field_text(r["venue"], 300).alias("venue"),
            field_text(r["city"], 120).alias("city"), _truth(r["online"]).alias("online"),
            field_text(r["description"], 400).alias("description"))
    events = (answers.select("source_key", "page_url", F.explode(F.transform(items, lambda i: let(
                  F.from_json(i, fields), finished))).alias("e"))
              .select(
        "source_key", F.coalesce("e.link", "page_url").alias("url"),
        (F.col("e.link").isNotNull() & (F.coalesce("e.link", F.lit("")) != F.col("page_url")))
        .alias("own_link"), "e.title", F.col("e.start.ts").alias("starts_at"), "e.ends_at", "e.start.date_only",
        F.lit(None).cast("string").alias("timezone"), "e.venue", "e.city", F.lit(None).cast("string").alias("country"),
        "e.online", F.lit(None).cast("string").alias("host"), "e.description"))
    return _with_uid(events.where("title is not null and starts_at is not null"))


def _with_uid(events: DataFrame) -> DataFrame:
    return events.withColumn("uid", event_uid("source_key", "own_link", "url", "title", "starts_at"))


def _posted(c: Column | str) -> Column:
    """postedAt as {"timestamp": ms, "date": ISO}, or either alone."""
    c = col(c)
    nested = c.startswith("{")
    stamp = F.when(nested, F.get_json_object(c, "$.timestamp")).otherwise(c).try_cast("double")
    text = F.when(nested, F.get_json_object(c, "$.date")).otherwise(c)
    millis = F.when(stamp > 0, F.timestamp_millis(stamp.cast("bigint")))
    return F.coalesce(millis, F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"),
                                     read_time(text, "UTC")["ts"]))


def is_social_post(row: Column) -> Column:
    return (F.coalesce(row["type"], F.lit("post")) == "post") & _set(row["id"]) & ~_set(row["error"])


def social_posts(rows: DataFrame) -> DataFrame:
    """Posts of rows(source_id, slug, pos, body). A repost is marked, or written by another account;
    accounts known by number cannot be compared by name."""
    parsed = rows.select("source_id", "slug", "pos", F.from_json("body", POST_ROW).alias("r"))
    own_text = F.when(strip("r.content") != "", F.col("r.content"))
    lines = F.split(F.coalesce(own_text, F.col("r.document.title"), F.lit("")), r"\r\n|[\n\r]")
    content = F.substring(F.array_join(F.filter(F.transform(lines, squeeze), lambda x: x != ""),
                                       "\n"), 1, POST_CHARS)
    author = blank_to_null(F.lower(strip(F.coalesce(
        blank_to_null(F.col("r.author.publicIdentifier")), F.col("r.author.universalName"),
        F.lit("")))))
    marked = _set("r.repostedBy") | _set("r.isRepost") | _set("r.resharedPost")
    other = author.isNotNull() & ~F.col("slug").rlike("^[0-9]+$") & (author != F.lower("slug"))
    return (parsed.where(is_social_post(F.col("r")))
            .select("source_id", "pos", F.substring(strip("r.id"), 1, 80).alias("post_id"),
                    F.coalesce(web_url("r.linkedinUrl", limit=1000),
                               web_url("r.socialContent.shareUrl", limit=1000)).alias("url"),
                    content.alias("content"), _posted("r.postedAt").alias("posted_at"),
                    label_text("r.author.name", 200).alias("author"),
                    (marked | F.coalesce(other, F.lit(False))).alias("repost"))
            .where("url is not null and content != ''"))


__all__ = ["answer_rows", "calendar_events", "field_text", "is_social_post", "page_events",
           "social_posts"]
