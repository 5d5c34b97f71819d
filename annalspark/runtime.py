"""Makes this package importable on the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Hands a zip of the package to the session's executors, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_annalspark_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="annalspark-")) / "annalspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    context.addPyFile(str(target))
    context._annalspark_shipped = True
    return spark
