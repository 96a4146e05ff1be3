"""Logs of attempts as streams: appended durably, repaired as they come in, summed up as they grow.

Every sink here writes files and has a checkpoint. A query that is stopped or killed at any point and started again on the same
checkpoint goes on where it was, and the files hold each row once: the file sink's own log says which files count, and tables that are written
batch by batch have a folder for each batch, which a repeated batch replaces.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.rundirs import same_config, write_text


def watch(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A table of Parquet files as a stream, ``files_per_batch`` files at a time; a table that is one file is that file of its folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def guard_config(spark: SparkSession, checkpoint: str, config: dict) -> None:
    """Keeps ``config`` beside the checkpoint when a stream is first started, and refuses to go on with another one."""
    path = f"{checkpoint}/stream-config.json"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        same_config(json.loads(spark.read.text(path, wholetext=True).first()["value"]), config)
    else:
        fs.mkdirs(p.getParent())
        write_text(spark, path, json.dumps(config), replace=False)


def append(rows: DataFrame, path: str, checkpoint: str, config: dict | None = None):
    """Starts appending a stream's rows to the JSON lines under ``path``; returns the query, which ends when all that is there has been read."""
    spark = rows.sparkSession
    guard_config(spark, checkpoint, config or {})
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an appended log: files that no batch has committed don't count."""
    return spark.read.schema(schema).json(path)


def collect(lines: DataFrame, path: str, checkpoint: str, schema: str, key: str, config: dict | None = None, keep: Column | None = None, within: tuple[str, str] | None = None):
    """Starts repairing a stream of JSON texts (column line): good rows to ``path/good``, each key once, bad ones to ``path/dead``.

    A text is bad if it isn't a JSON object of ``schema`` or has no ``key``; it is kept as it is. Keys that an earlier batch has written are left out by a
    join with what is there, so a key may come again at any time; of one batch's rows of a key, that with the smallest columns counts.
    ``keep`` leaves good rows out that need no work. ``within`` (a column of time, a duration) drops repeated keys before that by a state of
    that duration, which spares joins; rows that are later than it would be lost, so it is for sources that promise. A changed ``config`` is refused.
    """
    spark = lines.sparkSession
    guard_config(spark, checkpoint, config or {})
    if within:
        lines = lines.withWatermark(*within).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        own = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        parsed = batch.select("line", own.alias("r"), F.try_parse_json("line").isNotNull().alias("whole")).persist()
        ok = F.coalesce(F.col("whole") & F.col("r._bad").isNull() & F.col(f"r.{key}").isNotNull(), F.lit(False))
        parsed.where(~ok).select("line").write.mode("overwrite").parquet(f"{path}/dead/batch={number}")
        good = parsed.where(ok).select("r.*").drop("_bad")
        good = good.groupBy(key).agg(F.min(F.struct(*[c for c in good.columns if c != key])).alias("r")).select(key, "r.*")
        if keep is not None:
            good = good.where(keep)
        if done := earlier(spark, f"{path}/good", number):
            good = good.join(done.select(key), key, "left_anti")
        good.write.mode("overwrite").parquet(f"{path}/good/batch={number}")
        parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def earlier(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What batches before ``number`` have written, if there are any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(f.getPath().getName() not in (f"batch={number}",) and f.getPath().getName().startswith("batch=") for f in fs.listStatus(p)):
        return None
    return spark.read.parquet(path).where(F.col("batch") < number)


def running_solved(rows: DataFrame, path: str, checkpoint: str, threshold: float = 100.0):
    """Starts summing up a stream of events: arm, n and solved so far, the arms that a batch has changed in a folder of that batch."""
    counts = rows.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= threshold).alias("solved"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str = "arm") -> DataFrame:
    """Each key's row of the last batch that has changed it."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
