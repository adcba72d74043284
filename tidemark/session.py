"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sorted rows of a stay take some forty times their shuffled size, so small partitions are put together to 8 MB only.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where a later aggregation then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# For the studies, whose rows are a few bytes long on disk: 128 MB of them are some twenty million rows, all of which one task would
# sort or hold in its first aggregate.  Splits and the row groups of intermediate tables (bytes) are kept small instead, and a table
# written in parts keeps one file open for each part, which needs no sort.
STUDY_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "8m",
    "parquet.block.size": str(8 << 20),
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

# Rows of the given tables for each partition of a shuffle, at least; a stay of the label study has some ten hours for each of its events.
ROWS_PER_PARTITION = 100_000

# For maps over whole texts: a batch of 10,000 rows is some 25 MB of them, held by Spark and by the Python worker, and more with longer texts.
TEXT_SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings above; `conf` keys use '_' for '.'."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession, more: Mapping[str, str] | None = None) -> SparkSession:
    """Put the runtime settings, and `more` of them, on a session that somebody else made."""
    for key, value in {**SETTINGS, **(more or {})}.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Let the number of shuffle partitions follow the rows of the input, so that the rows one task sorts do not grow with it.

    The session's own number is the least.  Partitions that turn out small are put together at run time, up to the advisory size.
    """
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(own, -(-rows // ROWS_PER_PARTITION))))


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: what `spark.checkpoint.dir` names on the cluster.

    It has to be shared by all executors, so only a local session may fall back to a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame, *parts: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there; `parts` are columns it is partitioned by.

    Later plans start at a Parquet scan: lost executors cost nothing that was done before, columns can
    be pruned, and the true size is known when a join picks its strategy.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
