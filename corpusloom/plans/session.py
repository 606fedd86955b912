"""The session as this library wants it, and its code on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers of this application, once."""
    sc = spark.sparkContext
    if not getattr(sc, "_loom_shipped", False):
        top = Path(__file__).resolve().parents[2]
        to = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        shutil.copytree(top / "corpusloom", to / "src" / "corpusloom", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(to / "corpusloom"), "zip", to / "src"))
        sc._loom_shipped = True
    return spark
