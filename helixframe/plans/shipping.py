"""Sends this package to Python workers that can't import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "helixframe.sent"


def ship(spark: SparkSession, *more: Path) -> None:
    """Once a session: the package, and the modules in more, as a zip on the workers' path."""
    context = spark.sparkContext
    if context.getLocalProperty(_SENT):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="helixframe-")) / "helixframe.zip"  # the driver serves it from there as long as it runs
    with zipfile.ZipFile(path, "w") as out:
        for file in root.rglob("*.py"):
            out.write(file, file.relative_to(root.parent))
        for file in more:
            out.write(file, file.name)
    context.addPyFile(str(path))
    context.setLocalProperty(_SENT, "yes")
