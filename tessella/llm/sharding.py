"""Sharding by proportional stratified interleaving, under the law ``rows``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, globally_ranked


def shard(df: DataFrame, shards: int = 40, seed: int = 17, key: str = "doc_id", text: str = "text", stratum: str = "source") -> DataFrame:
    """Deals all rows to ``shards`` so that each holds every stratum in its share of the whole.

    Rows of a stratum are put in a seeded random order; row ``r`` of ``n`` gets the fraction ``(r + 1/2) / n``. All rows
    are sorted by it and the order is cut into equal lengths. Returns key, size, text_crc32, law, shard, slot, grown_shard.

    Null strata are a stratum of their own; a null text has 16 bytes and the checksum of the empty text; null keys and
    repeated rows are rows like others. No row: no result rows. Other columns are not read. Equal texts are dealt like other rows: under the law ``rows`` a
    large group of them can't stay together.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key).alias("k"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("s"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "k", "text_crc32"))
    tie = [F.col(c) for c in ("h", "k", "text_crc32", "size")]
    within = globally_ranked(rows, [F.col("s"), *tie], "r")
    groups = within.groupBy("s").agg(F.min("r").alias("r0"), F.count("*").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    part = within.join(groups, "s").withColumn("f", (F.col("r") - F.col("r0") + 0.5) / F.col("n")).drop("r", "r0", "n")
    placed = globally_ranked(part, [F.col("f"), F.col("s"), *tie], "at")
    return placed.select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"),
        F.expr(f"cast((at * {shards}L) div {max(total, 1)}L as int)").alias("shard"), "at",
    ).select(
        key, "size", "text_crc32", "law", "shard",
        F.expr(f"at - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
