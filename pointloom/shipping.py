"""Sends this package to the executors, so that functions they run can import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="pointloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.join(os.path.basename(top), os.path.relpath(at, top)))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
