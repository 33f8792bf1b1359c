"""Gives the package to Python workers, which need it where their functions name its modules."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="wayline-"), "wayline_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "wayline").rglob("*.py")):
            z.write(p, p.relative_to(root).as_posix())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
