"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers where neither PYTHONPATH nor the working folder holds it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in paths or os.path.abspath(os.getcwd()) == root or getattr(context, "_loom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="scriptloom-"), "scriptloom_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "scriptloom")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._loom_shipped = True
