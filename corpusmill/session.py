"""Session settings used by tests, the bench and stand-alone runs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(
    app: str = "corpusmill", cores: int = 8, shuffle_partitions: int | None = None, memory: str = "8g"
) -> SparkSession:
    """A local session; on a cluster the submitter's own settings are used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once an application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parent
    if app in _SHIPPED or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "corpusmill.zip"  # on the driver; Spark serves it from there
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
