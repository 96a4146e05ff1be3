"""Tables that a job writes for itself and reads again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def path_for(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``, dropped when the session's process ends; only a local master without that setting gets a folder of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = getattr(spark.sparkContext, "_tessella_scratch", None)
        if top is None:
            top = spark.sparkContext._tessella_scratch = "file://" + tempfile.mkdtemp(prefix="tessella-")
            atexit.register(_drop, spark, top)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended first
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, and whole when executors are lost."""
    path = path_for(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
