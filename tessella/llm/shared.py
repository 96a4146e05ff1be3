"""What the operators of this subpackage have in common: the shared folder, global ranks, salted group extremes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sub-groups of one key; a key with a third of all rows is then dealt to so many tasks.
SALTS = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where that is unset (tests), an own one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        told = getattr(spark.sparkContext, "_tessella_dir", None)
        if told is None:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            told = spark.sparkContext._tessella_dir = "file://" + tempfile.mkdtemp(prefix="tessella-")
            _drop_at_exit(spark, told)
    return told


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop():
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may have ended first
            pass

    atexit.register(drop)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex[:12]}"
    _drop_at_exit(spark, path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, units: float, per_task: float) -> int:
    """Partitions so that each has about ``per_task`` units, at least the configured shuffle partitions."""
    return int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(200_000, -(-units // per_task))))


def globally_ranked(df: DataFrame, keys: list[Column], rank: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``rank``: the row's position (from 0) in the order of ``keys``, or the sum of ``weight`` over all rows before it.

    Rows are range-partitioned and sorted, never gathered in one task; the driver sees one number per partition.
    ``keys`` must order rows totally for a reproducible result.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = stored(placed, "ranked")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    if weight is None:
        sums = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).orderBy("_p").collect()
        within = row
    else:
        from pyspark.sql import Window

        sums = placed.groupBy(part.alias("_p")).agg(F.sum(weight).alias("_n")).orderBy("_p").collect()
        w = Window.partitionBy(part).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(weight).over(w), F.lit(0))
    starts, total = [], 0
    for r in sums:
        starts.append((r["_p"], total))
        total += r["_n"] or 0
    # A row for each partition.
    before = spark.createDataFrame(starts, "_part long, _before long")
    return placed.withColumn("_part", part).withColumn(rank, within).join(F.broadcast(before), "_part").withColumn(rank, (F.col(rank) + F.col("_before")).cast("long")).drop("_at", "_part", "_before")


def with_group_extreme(df: DataFrame, keys: list[str], value: str, out: str, how: str = "min") -> DataFrame:
    """``df`` with ``out``: the least (or greatest) ``value`` among rows of equal ``keys``.

    A hot key is split by a salt both when it is aggregated and when its result is joined back, so that no task
    holds more than one part in ``SALTS`` of its rows. ``df`` is read twice: pass something stored.
    """
    agg = F.min if how == "min" else F.max
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(*keys, "_salt").agg(agg(value).alias("_part"))
    whole = parts.groupBy(*keys).agg(agg("_part").alias(out))
    return salted.join(parts.drop("_part").join(whole, keys), [*keys, "_salt"], "left").drop("_salt")
