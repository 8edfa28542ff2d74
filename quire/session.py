"""Session helpers shared by tests, the bench and the driver's entry."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package wherever the driver was started. Clusters get it by --py-files."""
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """A UTC session on this machine, for tests and the bench. scratch: the folder that spark.checkpoint.dir names."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", f"file://{scratch}") if scratch else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
