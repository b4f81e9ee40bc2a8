"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# UTC is part of the semantics: Indian-day bounds and zone-less stamps are
# computed against it. The rest lets AQE split hot keys and merge small tasks.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "wirefold", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def spread(df: DataFrame, bytes_per_core: int = 16 << 20) -> DataFrame:
    """A table too small to keep every core busy, dealt out evenly; larger ones as they are.

    Text work is CPU-bound, and a small file is a single row group read by a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_core else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder iterative jobs cut their lineage in.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session may fall back to a folder of its own, since every task then runs on
    this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="wirefold-checkpoint-")
    sc.setCheckpointDir(named)
    return named
