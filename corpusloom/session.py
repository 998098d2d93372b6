"""Session helpers shared by every query."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    On a cluster the package is installed or sent with ``--py-files``; where the
    driver's folder is visible to the workers this only adds it to their path.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors see, for files a query makes of the tables; deleted when the program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors share no folder with the driver: set spark.checkpoint.dir")
    path = f"{base or tempfile.mkdtemp(prefix='corpusloom-')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_shared_folders() -> None:
    """Delete the folders made so far, once no plan reads them any more."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before the interpreter
            pass
