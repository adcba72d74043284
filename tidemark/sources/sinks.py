"""Matrices, predictions and reports on storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import MatrixNames


def materialise(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Write Parquet and read it back: an intermediate table that survives lost executors.

    An event frame partitioned by concept lets later readers skip the other concepts; one sorted by
    stay lets them skip row groups.
    """
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_matrix(matrix: DataFrame, names: MatrixNames, path: str) -> None:
    """Matrix rows, and the column names as one JSON row beside them."""
    matrix.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    spark = matrix.sparkSession
    text = json.dumps({"tabular": names.tabular, "sequence": names.sequence, "static": names.static})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/names")


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixNames]:
    names = json.loads(spark.read.text(f"{path}/names").head()[0])
    return spark.read.parquet(f"{path}/rows"), MatrixNames(**names)


def write_report(df: DataFrame, path: str, fmt: str = "json", ordered_by: tuple[str, ...] = ()) -> None:
    """Aggregate report: JSON lines (nested columns allowed) or CSV with a header."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"report format {fmt!r}")
    if ordered_by:
        df = df.orderBy(*ordered_by)
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def nest(df: DataFrame, key: str, into: str) -> DataFrame:
    """Rows of a summary frame as one nested list per key, for JSON reports."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(into))
