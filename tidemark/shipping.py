"""The package on the executors: Python tasks import it by name, so it has to be where they look."""

from __future__ import annotations

import shutil
import tempfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

import tidemark


@cache
def _archive() -> str:
    """Zip of the package, made once by the driver; Spark serves it to the executors."""
    root = Path(tidemark.__file__).resolve().parent
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-package-')}/tidemark", "zip", root.parent, root.name)


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the session's Python files (again: no effect)."""
    if Path(_archive()).name not in {Path(name).name for name in spark.sparkContext.listFiles}:
        spark.sparkContext.addPyFile(_archive())
    return spark
