"""Session helpers: a tuned session for local use, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once an application.

    The driver serves the archive to executors, as --py-files would.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark_code.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(here.rglob("*.py")):
                archive.write(path, path.relative_to(here.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def materialized(df: DataFrame) -> DataFrame:
    """The rows in the shared folder of spark.checkpoint.dir, without what led there: for tables that a plan reads often.

    Where the setting is missing, a temporary folder in local mode and an error on a cluster.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return df.checkpoint(eager=True)


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
