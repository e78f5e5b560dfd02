"""Spark sessions with the settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

#: Settings that change results or plans; cluster deployments put the same ones into spark-defaults.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "tessera", cpus: int | None = None, memory: str = "16g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).master(f"local[{cpus or '*'}]")
    settings = BASE_CONF | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus or 8)}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, once for each application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    top = Path(__file__).resolve().parent
    package = shutil.copytree(top, Path(folder, "package", top.name), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{top.name}", "zip", package.parent))
    _shipped.add(app)
