"""Helpers of the training-data operators: written intermediates, names, bounded samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirefold.session import CONF, checkpoint_dir


FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


class Scratch:
    """Intermediate tables of one job in the shared checkpoint folder.

    A saved table ends the lineage: a lost executor costs a re-read. ``drop`` removes tables that
    nothing reads any more, so a long job holds only what it still needs.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compact: bool = False) -> DataFrame:
        """``df`` written and read back; ``compact`` merges its last shuffle to files of the advised
        size instead of one for every core, for narrow tables whose rows cost little."""
        path = f"{self.root}/{name}"
        held = self.spark.conf.get(FIRST)
        self.spark.conf.set(FIRST, "false" if compact else held)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FIRST, held)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def settings(spark: SparkSession, batch_rows: int = 256) -> None:
    """Session settings of the text jobs: AQE with skew splitting, and Arrow batches small enough
    that a batch of long texts fits a worker."""
    for key, value in CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names clash regardless of case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``: the folds that decide what is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def bounded(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of ``key``: the same ones on every run and layout."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
