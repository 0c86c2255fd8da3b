"""Session helpers shared by the queries, the tests and the bench."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("attestia")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; sf_dir may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str, bin_bytes: int = 2 << 20) -> DataFrame:
    """Rows of a scan dealt out by keys, in as many parts as its (compressed) size asks for, so that a part does not grow with it."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(width, min(size // bin_bytes + 1, 100_000)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="attestia-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that do not share this folder."""
    sc = spark.sparkContext
    inherited = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in inherited or os.getcwd() == str(ROOT) or getattr(sc, "_attestia_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="attestia-")  # served to executors by the driver, never read by path there
    target = os.path.join(folder, "attestia.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "attestia").rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT)))
    if target not in sys.path:
        sc.addPyFile(target)
    sc._attestia_shipped = True
