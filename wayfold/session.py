"""Session helpers: a local session for tests and benches, and the package for executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, unless their path has it already."""
    home = str(ROOT.parent)
    sc = spark.sparkContext
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_wayfold_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="wayfold-")
    target = os.path.join(folder, "wayfold.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT.parent)))
    sc.addPyFile(target)
    sc._wayfold_sent = True


def local_session(name: str = "wayfold", cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
