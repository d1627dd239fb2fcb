"""The package, sent to Python workers that cannot find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once.

    Workers of a local master share the driver's machine: they find the package where PYTHONPATH
    or the working folder leads to it.  Those of a cluster have neither for certain."""
    app = spark.sparkContext.applicationId
    known = {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if app in _SHIPPED or (spark.sparkContext.master.startswith("local") and ROOT in known):
        return
    folder = tempfile.mkdtemp(prefix="pulselake-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/pulselake", "zip", ROOT, "pulselake"))
    _SHIPPED.add(app)
