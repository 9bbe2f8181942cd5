"""Session set-up: what every executor needs to run this package's functions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(name: str = "docweave", master: str | None = None) -> SparkSession:
    """A session with the settings that the operators assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docweave-")  # executors fetch the file from here as long as the application runs
    atexit.register(shutil.rmtree, folder, True)
    path = Path(folder) / "docweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
