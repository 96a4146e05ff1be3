"""JSON lines: strict and tolerant scans, quarantine, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Raises on the first row that isn't JSON of the schema; blank lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and of bad ones the text and its size in bytes. Rows end at line feeds only; what follows a whole object makes a row bad."""
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    # The parser stops at the end of the first object, so what stands behind it is looked for apart.
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("value").alias("whole"))
    good = parsed.where(F.col("r._bad").isNull() & F.col("whole").isNotNull() & F.rtrim("value").endswith("}")).select("r.*").drop("_bad")
    bad = parsed.where(F.col("r._bad").isNotNull() | F.col("whole").isNull() | ~F.rtrim("value").endswith("}")).select("value", F.octet_length("value").alias("n_bytes"))
    return good, bad


def write(df: DataFrame, path: str) -> int:
    """Writes JSON lines and returns how many, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def quarantine(spark: SparkSession, path: str, schema: str, good_path: str, bad_path: str) -> tuple[int, int]:
    good, bad = read_tolerant(spark, path, schema)
    return write(good, good_path), write(bad, bad_path)


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: name and text."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")
