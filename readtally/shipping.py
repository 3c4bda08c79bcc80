"""The package as a zip file, for executors that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import cache

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


@cache
def _zipped() -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="readtally-"), "readtally.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    return path


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once."""
    if not any(p.endswith("readtally.zip") for p in spark.sparkContext.listFiles):
        spark.sparkContext.addPyFile(_zipped())
