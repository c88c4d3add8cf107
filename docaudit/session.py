"""Sessions and the package on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers find it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="docaudit-")) / "docaudit.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f"docaudit/{f.relative_to(_ROOT)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
