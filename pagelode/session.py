"""Session helpers: shipping this package to executors, and the session used by tests and the bench."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="pagelode-src-")) / "pagelode_src.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, Path(root.name) / source.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark


def local_session(cores: str = "8", app: str = "pagelode", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings this engine is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
