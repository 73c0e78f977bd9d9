"""Makes the package importable by Python workers on executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="litspark-src-") as folder:
        shutil.copytree(root, f"{folder}/src/litspark", ignore=shutil.ignore_patterns("__pycache__"))
        # The archive itself stays while the application runs: executors fetch it from the driver.
        to = tempfile.mkdtemp(prefix="litspark-zip-")
        sc.addPyFile(shutil.make_archive(f"{to}/litspark-src", "zip", f"{folder}/src"))
    _shipped.add(sc.applicationId)
