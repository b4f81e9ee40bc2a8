"""Stored tables changed by key: a merge rewrites the partitions its changed rows lie in, no others.

A row's partition is named by an expression over columns that never change for its key (the day it was taken
in, say), so the old version of a changed row lies in the same partition as the new one. A merge reads these
partitions, and the job that writes replaces them at its commit: tasks that are run again after an executor was lost
read the old files. Key columns are never null, and changed rows have one row for a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wirefold.operators.sinks import rewrite_partitions

PLACE = "place"


@dataclass(frozen=True)
class Layout:
    key: tuple[str, ...]
    place: str                # SQL: the name of a row's partition


def day(column: str) -> str:
    return f"coalesce(date_format({column}, 'yyyy-MM-dd'), 'none')"


def hashed(column: str, parts: int = 64) -> str:
    return f"cast(pmod(xxhash64({column}), {parts}) as string)"


def replaced(rows: DataFrame, changed: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``rows`` with the ``changed`` ones in place of those of the same key."""
    return rows.join(changed.select(*key), list(key), "left_anti").select(rows.columns).unionByName(
        changed.select(rows.columns))


def differing(after: DataFrame, before: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows of ``after`` that are not in ``before`` in the same way."""
    value = F.struct(*after.columns)
    was = before.select(*key, F.struct(*after.columns).alias("_was"))
    return after.join(was, list(key), "left").where(~value.eqNullSafe(F.col("_was"))).select(after.columns)


class Store:
    """Tables under one root, each laid out by its Layout."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout]) -> None:
        self.spark, self.root, self.layouts = spark, root, layouts
        self.schemas: dict[str, StructType] = {}
        self.rewritten: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str, rows: DataFrame) -> None:
        """Write a table whole; what lay there goes."""
        placed = rows.withColumn(PLACE, F.expr(self.layouts[name].place))
        placed.hint("rebalance", F.col(PLACE)).write.mode("overwrite").partitionBy(PLACE).parquet(self.path(name))
        self.schemas[name] = rows.schema

    def read(self, name: str, places: list[str] | None = None) -> DataFrame:
        schema = self.schemas[name]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        rows = self.spark.read.schema(f"{columns}, {PLACE} string").parquet(self.path(name))
        if places is not None:
            rows = rows.where(F.col(PLACE).isin(places))
        return rows.select(schema.names)

    def merge(self, name: str, changed: DataFrame) -> list[str]:
        """Put ``changed`` rows in place of those of the same key; the partitions rewritten.

        ``changed`` is read twice, so it is best a table already written.
        """
        layout = self.layouts[name]
        new = changed.select(self.schemas[name].names).withColumn(PLACE, F.expr(layout.place))
        # Days of the calendar, or the hashed parts of a layout.
        places = sorted(r[0] for r in new.select(PLACE).distinct().collect())
        if places:
            rows = replaced(self.read(name, places), new, layout.key)
            placed = rows.withColumn(PLACE, F.expr(layout.place))
            rewrite_partitions(placed.hint("rebalance", F.col(PLACE)), self.path(name), PLACE)
        self.rewritten.setdefault(name, []).extend(places)
        return places
