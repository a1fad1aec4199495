"""Making the package known to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the workers of spark, once for each application, so that they can import it."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="rowceil-src-"), "rowceil-src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    spark.sparkContext.addPyFile(path)
    _sent[app] = path
