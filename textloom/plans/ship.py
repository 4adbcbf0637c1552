"""Make the package importable on every worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's source to the workers once for each application (what ``--py-files`` does)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="textloom-")
    path = os.path.join(folder, "textloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, files in os.walk(os.path.join(root, "textloom")):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shipped(query):
    """A query that ships the package before it runs."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship_package(spark)
        return query(spark, sf_dir)

    return run
