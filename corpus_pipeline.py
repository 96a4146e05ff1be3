"""A corpus of documents made fit for training: toxic texts, near copies, repeated passages and benchmark texts go, the rest is tokenised.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and reread as the next one's docs. Columns other
than those of documents aren't read and go. No documents: no result rows. Texts may be of any length. Rows that repeat a
document share its fate; rows with a null key are judged where a stage says so, and are never dropped for another's sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontaminate, neardup, substring, toxicity
from tessella.llm.shared import documents, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored 1/2 or more go. Learns from the labels of the documents at hand; without labels of both kinds none goes.

    Null and empty texts have no toxic word and stay, as do rows with a null key.
    """
    model = toxicity.train(toxicity.labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    bad = toxicity.score_texts(docs, model).where("predicted = 1").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti").select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, the one with the smallest id stays.

    Null and empty texts are linked with nothing and stay, as do rows with a null key.
    """
    gone = neardup.near_duplicates(docs, num=80, den=100).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what repeats an earlier passage of 20 words or more. A document of which no word is left goes; texts without a cut stay as they are.

    Null, empty and short texts stay, rows with a null key stay whole and take nothing from others.
    """
    cut = substring.deduplicate(docs, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("_id"), "kept_text").dropDuplicates(["_id"])
    out = docs.join(cut, F.col("doc_id") == F.col("_id"), "left").where("_id is null or kept_text <> ''")
    text = F.when(F.col("_id").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("_id").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"))


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words one in twenty or more lies in passages of benchmark items.

    Null and empty texts stay, as do rows with a null key; null items, and a benchmark without items, match nothing.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti").select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the checksums of ids and of the text that they decode to. Null and empty texts have none; every row gives a row."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_texts),
    ("bpe_encode_decode", tokenise),
]

#: The scores and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(COLUMNS)
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
