"""Brings the package to Python workers that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's Python files, once, unless the workers
    find it by PYTHONPATH or by the folder they start in.  Spark's driver serves the file."""
    sc = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if ROOT in paths or getattr(sc, "_corpusmill_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="corpusmill-"), "corpusmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "corpusmill")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    sc._corpusmill_shipped = True
