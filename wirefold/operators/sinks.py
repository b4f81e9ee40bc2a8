"""Writing results: appends, insert-if-new, upserts, exports and purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.taxonomy import investors_list
from wirefold.functions.times import IST, instant
from wirefold.operators.dedupe import first_per_key


def append_rows(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def insert_new(incoming: DataFrame, existing: DataFrame, keys: list[str],
               order: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored, the first one of each key."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return first_per_key(fresh, keys, order)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, as_of,
           keep: tuple[str, ...] = ("found_at", "id", "via", "source_key")) -> DataFrame:
    """Both tables as one: known keys take the incoming values but keep ``keep``.

    ``incoming`` has one row per key. ``found_at`` of a new key and ``updated_at`` of every
    touched one become ``as_of``.
    """
    now = instant(as_of)
    left, right = existing.alias("e"), incoming.alias("i")
    joined = left.join(right, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer")
    known, touched = F.col(f"e.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(touched, now).otherwise(F.col("e.updated_at"))
        if c == "found_at":
            return F.when(known, F.col("e.found_at")).otherwise(now)
        if c == key:
            return F.coalesce(f"e.{key}", f"i.{key}")
        if c not in incoming.columns:
            return F.col(f"e.{c}")
        if c in keep:
            return F.when(known, F.col(f"e.{c}")).otherwise(F.col(f"i.{c}"))
        return F.when(touched, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}"))

    return joined.select(*[value(c).alias(c) for c in existing.columns])


def rewrite_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Replace only the partitions ``df`` has rows for, all at the commit of the job."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def fill_empty(existing: DataFrame, incoming: DataFrame, key: str, *columns: str) -> DataFrame:
    """Empty columns of known rows filled; nothing that is set changes."""
    offer = incoming.select(key, *[F.col(c).alias(f"n_{c}") for c in columns])

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        if dict(existing.dtypes)[c] == "string":
            return F.coalesce(F.when(F.col(c) != "", F.col(c)), f"n_{c}").alias(c)
        return F.coalesce(c, f"n_{c}").alias(c)

    return existing.join(offer, key, "left").select(*[value(c) for c in existing.columns])


def purge(removed: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each dependent table without the rows of the ``removed(key)`` sources."""
    return {name: df.join(removed.select(F.col("key").alias(column)), column, "left_anti")
            for name, (df, column) in tables.items()}


# --- exports: the column lists readers get -------------------------------------------------

def _ist(c: str) -> Column:
    return F.from_utc_timestamp(F.col(c), IST)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


FOUND_VIA = {"feed": "News feed", "web": "Web search", "pasted": "Your website",
             "social": "Social posts"}


def export_rounds(rows: DataFrame) -> DataFrame:
    found = F.col("origin")
    for key, label in FOUND_VIA.items():
        found = F.when(F.col("origin") == key, F.lit(label)).otherwise(found)
    return rows.select(
        _text("company").alias("Company"), F.col("stage").alias("Stage"),
        _text("round").alias("Round"), F.array_join("investors", ", ").alias("Investors"),
        F.coalesce(F.when(F.col("amount") != "", F.col("amount")), F.lit("Undisclosed"))
        .alias("Amount"), _ist("published_at").alias("Published (IST)"),
        F.col("source_label").alias("Source"), found.alias("Found via"),
        F.col("headline").alias("Headline"), F.col("url").alias("Link"))


def export_firm_posts(rows: DataFrame) -> DataFrame:
    prefix = F.when(F.col("origin") == "news", "News feed: ").when(
        F.col("origin") == "added", "Added by you: ").otherwise("")
    return rows.select(
        F.col("firm_label").alias("VC firm"), F.col("kind").alias("What"),
        _text("company").alias("Company"), _text("round").alias("Round"),
        _text("amount").alias("Amount"), _ist("published_at").alias("Published (IST)"),
        F.concat(prefix, "source_label").alias("Found via"),
        F.col("headline").alias("Headline"), F.col("url").alias("Link"))


def export_events(rows: DataFrame) -> DataFrame:
    shape = F.when(F.col("online"), "Online").when(~F.col("online"), "In person").otherwise("")
    return rows.select(
        F.col("organiser").alias("Organiser"), F.col("title").alias("Event"),
        _ist("starts_at").alias("Starts (IST)"), _ist("ends_at").alias("Ends (IST)"),
        _text("city").alias("City"), _text("venue").alias("Venue"), shape.alias("Format"),
        F.col("via_label").alias("Found via"), F.col("url").alias("Link"))


def write_export(df: DataFrame, path: str, *partition_by: str, fmt: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).format(
        fmt).save(path)


def stored_investors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("investors", investors_list("investors"))
