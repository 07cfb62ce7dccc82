"""Gets this package to the Python workers where they can't import it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the job's Python files, once an application, unless PYTHONPATH has it."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-trellis-")) / "trellis.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(ROOT.rglob("*.py")):
            z.write(source, source.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
