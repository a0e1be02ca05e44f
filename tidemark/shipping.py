"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark's own file server, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-ship-")) / "tidemark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))
    _SHIPPED[sc.applicationId] = str(target)
