"""Sends this package to Python workers that can't import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package once a Spark application; returns the session."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="cueloom-zip-"), "cueloom.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("cueloom", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _sent[app] = path
    return spark
