"""CSV to Parquet with explicit types, idempotent, with a manifest; view registration."""

from __future__ import annotations

import csv
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("table", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("csv_bytes", T.LongType()), T.StructField("parquet_bytes", T.LongType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("ignored_pins", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
])


@dataclass(frozen=True)
class TableSpec:
    """How one CSV table is read: pinned types, or text throughout, or not at all.

    Columns without a pin are read as `default`; text is the safe choice, cast late.
    """

    name: str
    types: Mapping[str, str] = field(default_factory=dict)
    all_text: bool = False
    default: str = "string"
    skip: bool = False
    reason: str | None = None

    @property
    def table(self) -> str:
        return self.name.rsplit("/", 1)[-1]


def _files(spark: SparkSession, path: str):
    """Hadoop file system of a path: works on any storage the cluster can read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return bool(fs.exists(p))


def path_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _files(spark, path)
    return int(fs.getContentSummary(p).getLength())


def find_csv(spark: SparkSession, root: str, name: str) -> str | None:
    """Plain file first, gzip otherwise."""
    for suffix in (".csv", ".csv.gz"):
        path = f"{root}/{name}{suffix}"
        if path_exists(spark, path):
            return path
    return None


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line only; no data is sampled."""
    first = spark.read.text(path).head()
    return next(csv.reader([first[0].rstrip("\r")])) if first else []


def schema_for(columns: Sequence[str], spec: TableSpec) -> tuple[T.StructType, list[str]]:
    """Explicit schema from the header and the pins, and the pins whose column is absent."""
    pins = {} if spec.all_text else dict(spec.types)
    default = "string" if spec.all_text else spec.default
    ddl = ", ".join(f"`{c}` {pins.get(c, default)}" for c in columns)
    return T.StructType.fromDDL(ddl), sorted(set(pins) - set(columns))


def read_csv(spark: SparkSession, path: str, spec: TableSpec) -> tuple[DataFrame, list[str]]:
    schema, ignored = schema_for(header_columns(spark, path), spec)
    frame = (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    )
    return frame, ignored


def convert_table(spark: SparkSession, source: str, csv_root: str, out_root: str, spec: TableSpec,
                  force: bool = False, gzip_partitions: int | None = None) -> Row:
    """One table; a finished table is left alone unless `force`.  The row count comes from the written
    files' footers.  A gzip file cannot be split, so it is spread out after reading."""
    base = {"source": source, "table": spec.table, "ignored_pins": [], "reason": None,
            "rows": None, "csv_bytes": None, "parquet_bytes": None, "seconds": None}
    if spec.skip:
        return Row(**{**base, "status": "skipped", "reason": spec.reason})
    path = find_csv(spark, csv_root, spec.name)
    if path is None:
        return Row(**{**base, "status": "missing", "reason": f"{csv_root}/{spec.name}.csv"})
    target = f"{out_root}/{spec.table}.parquet"
    # A folder without _SUCCESS is an interrupted write and is redone.
    if path_exists(spark, f"{target}/_SUCCESS") and not force:
        return Row(**{**base, "status": "cached", "rows": spark.read.parquet(target).count(),
                      "parquet_bytes": path_bytes(spark, target)})
    start = time.monotonic()
    frame, ignored = read_csv(spark, path, spec)
    if path.endswith(".gz"):
        frame = frame.repartition(gzip_partitions or spark.sparkContext.defaultParallelism)
    frame.write.mode("overwrite").option("compression", "zstd").parquet(target)
    rows = spark.read.parquet(target).count()
    return Row(**{**base, "status": "converted", "rows": rows, "csv_bytes": path_bytes(spark, path),
                  "parquet_bytes": path_bytes(spark, target), "seconds": round(time.monotonic() - start, 3),
                  "ignored_pins": ignored})


def convert_source(spark: SparkSession, source: str, csv_root: str, out_root: str, tables: Sequence[TableSpec],
                   force: bool = False) -> DataFrame:
    """Manifest frame with one row per table."""
    rows = [convert_table(spark, source, csv_root, out_root, t, force) for t in tables]
    return spark.createDataFrame([tuple(r[f.name] for f in MANIFEST.fields) for r in rows], MANIFEST)


# --- views ----------------------------------------------------------------------
def register(spark: SparkSession, root: str, tables: Sequence[str], prefix: str = "", missing_ok: bool = False) -> dict[str, DataFrame]:
    """Views <prefix><table> over Parquet.  A missing table is an error unless `missing_ok`."""
    out = {}
    for t in tables:
        path = f"{root}/{t}.parquet"
        if not path_exists(spark, path):
            if missing_ok:
                continue
            raise FileNotFoundError(path)
        out[t] = spark.read.parquet(path)
        out[t].createOrReplaceTempView(f"{prefix}{t.lower()}")
    return out


def register_tree(spark: SparkSession, root: str) -> list[str]:
    """Views <folder>_<table> for every <root>/<folder>/<table>.parquet."""
    fs, p = _files(spark, root)
    names = []
    if not fs.exists(p):
        return names
    for folder in sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()):
        fs_, q = _files(spark, folder)
        for path in sorted(s.getPath().toString() for s in fs_.listStatus(q)):
            if path.endswith(".parquet"):
                view = f"{folder.rsplit('/', 1)[-1]}_{path.rsplit('/', 1)[-1][:-len('.parquet')].lower()}"
                spark.read.parquet(path).createOrReplaceTempView(view)
                names.append(view)
    return names


def describe(df: DataFrame) -> DataFrame:
    """(column_name, data_type) of a frame."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, data_type string")
