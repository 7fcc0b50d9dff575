"""Sends this package to the executors, wherever Python was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's source once per session, so that functions inside tasks find it."""
    sc = spark.sparkContext
    if getattr(sc, "_glean_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp()) / "glean_package.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(made))
    sc._glean_shipped = True
