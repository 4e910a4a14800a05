"""Sessions for local work, and the package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that tasks can import it wherever it was started from."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_package.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for path in sorted(HERE.rglob("*.py")):
            packed.write(path, str(path.relative_to(HERE.parent)))
    context.addPyFile(str(target))
    context._tidemark_shipped = True
