"""Send this package to the Python workers, wherever they start."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's own modules to the application's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(top):  # runs from an archive that was sent already
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="siftlog-"), "siftlog.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _sent.add(context.applicationId)
