"""Tables in shards that are written once each: what is finished isn't done again, and all are put together only when none is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import GuardError


def finished(spark: SparkSession, path: str) -> DataFrame:
    """shard of every folder that Spark has committed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return spark.createDataFrame([(int(n.removeprefix("shard=")),) for n in names if n.startswith("shard=")], "shard int")


def with_shard(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``df`` with ``shard``: ``rows`` following one another by ``order`` (a whole number from 0) make one."""
    return df.withColumn("shard", F.expr(f"cast({order} div {rows} as int)"))


def write_missing(df: DataFrame, path: str, make: Callable[[DataFrame], DataFrame] = lambda x: x) -> int:
    """Writes the shards of ``df`` (column shard) that aren't there yet, each whole or not at all; ``make`` does the costly part on those only. Returns how many."""
    spark = df.sparkSession
    todo = df.join(F.broadcast(finished(spark, path)), "shard", "left_anti")
    n = todo.select("shard").distinct().count()
    if n:
        make(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return n


def assembled(spark: SparkSession, path: str, key: str, expected: DataFrame) -> DataFrame:
    """All shards as one table; refused if a key of ``expected`` is missing or there twice."""
    out = spark.read.parquet(path)
    if missing := expected.select(key).join(out.select(key), key, "left_anti").count():
        raise GuardError(f"{missing} rows are missing")
    if twice := out.groupBy(key).count().where("count > 1").count():
        raise GuardError(f"{twice} rows are there more than once")
    return out.drop("shard")


def save_vectors(df: DataFrame, path: str) -> None:
    """A dense index (doc_id, vec) and what it says of itself."""
    df.write.parquet(f"{path}/vectors")
    spark = df.sparkSession
    n, docs, dim = spark.read.parquet(f"{path}/vectors").agg(F.count("*"), F.countDistinct("doc_id"), F.max(F.size("vec"))).first()
    spark.createDataFrame([(n, docs, dim)], "n_vectors long, n_docs long, dim int").write.parquet(f"{path}/meta")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The saved index; refused if vectors, documents or lengths aren't what it says."""
    out, meta = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta").first()
    n, docs, low, high = out.agg(F.count("*"), F.countDistinct("doc_id"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if (n, docs) != (meta["n_vectors"], meta["n_docs"]) or {low, high} - {meta["dim"]}:
        raise GuardError(f"{n} vectors of {docs} documents with {low} to {high} numbers; the index says {meta.asDict()}")
    return out
