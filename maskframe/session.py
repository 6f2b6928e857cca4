"""Sessions, and the package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, unless it is on their path or was shipped before."""
    on_path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if any(os.path.isdir(p) and os.path.samefile(p, ROOT) for p in on_path) or getattr(sc, "_maskframe_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "maskframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "maskframe").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(archive)
    sc._maskframe_shipped = True
