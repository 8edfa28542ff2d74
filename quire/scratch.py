"""Tables written on the way to a result, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a written table's shuffle files when the write is done; the table itself is read from then on.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. A temporary one only where that is unset and Spark runs on this machine alone."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quire-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/quire-{app}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared scratch folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch = path
    return kept


def forget(kept: DataFrame) -> None:
    """Delete a scratch table that nothing still to be computed reads."""
    _delete(kept.sparkSession, kept._scratch)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Results not yet computed need them."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
