"""Ranked retrieval: BM25 over an inverted index, exact and two-stage late interaction, fusion, recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Bytes up to which queries are sent to all tasks; beyond it they are shuffled.
BROADCAST = 64 << 20
#: Rows of documents, and of queries, that one task compares at once.
DOC_ROWS, QUERY_ROWS = 25_000, 2_000


def small(df: DataFrame, per_row: int = 64, limit: int = BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it fits; otherwise as it is."""
    most = limit // per_row
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dealt(rows: DataFrame) -> DataFrame:
    """A few files of one row group each would be a few tasks: their rows are dealt out. Many files need no shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if 0 < len(rows.inputFiles()) < cores else rows


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", lowercase: bool = False) -> DataFrame:
    """term, key, tf: combined on the map side before the shuffle. Null texts have no terms."""
    return docs.select(key, F.explode(tokens(F.col(text), lowercase)).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def bm25_index(docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, lowercase: bool = False) -> dict[str, DataFrame]:
    """postings(term, key, tf), terms(term, df, idf), lengths(key, len, norm). Lengths count documents without terms too."""
    p = postings(docs, key, text, lowercase)
    once = docs.select(F.explode(F.array_distinct(tokens(F.col(text), lowercase))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    lengths = docs.select(key, F.coalesce(F.size(tokens(F.col(text), lowercase)), F.lit(0)).cast("long").alias("len")).withColumn("len", F.greatest("len", F.lit(0)))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).select("n", F.when(F.col("avg") <= 0, 1.0).otherwise(F.col("avg")).alias("avg"))
    norms = lengths.crossJoin(F.broadcast(stats)).select(key, "len", (k1 * (1 - b + b * F.col("len") / F.col("avg"))).alias("norm"))
    terms = once.crossJoin(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return {"postings": p, "terms": terms, "lengths": norms}


def topk(scored: DataFrame, k: int, query: str, key: str, *more: str) -> DataFrame:
    """Rows of rank 1..k of each query (and each value of ``more``) by (score rounded to 9 places, key)."""
    w = Window.partitionBy(query, *more).orderBy(F.round("score", 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))


#: Keys of a range, and ranges that one window sums up.
RANGE = 4096


def offsets(counts: DataFrame, key: str, n: str, out: str = "start") -> DataFrame:
    """``counts`` (a whole-number key, each once, and ``n``) with the sum of ``n`` over all smaller keys.

    Sums of ranges of keys come first, and theirs in the same way, until one window holds them; no row meets another range's rows.
    """
    ranged = counts.withColumn("_range", F.expr(f"`{key}` div {RANGE}"))
    sums = ranged.groupBy("_range").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(n).over(before), F.lit(0))
    if sums.limit(2).count() < 2:
        return ranged.withColumn(out, within.cast("long")).drop("_range")
    base = offsets(sums.select(F.col("_range").alias("_at"), "_sum"), "_at", "_sum", "_base").select(F.col("_at").alias("_range"), F.col("_base").alias("_below"))
    return ranged.withColumn(out, within).join(base, "_range").withColumn(out, (F.col("_below") + F.col(out)).cast("long")).drop("_range", "_below")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / n)


def _best(k: int):
    """The best ``k`` documents of a block for each query of a block by (score rounded to 9 places, doc_id). Tokens of a document, and of a query, lie in one block."""

    def run(queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "doc_id": [], "score": []}
        if len(queries) and len(docs) and k > 0:
            docs, queries = docs.sort_values("doc_id", kind="stable"), queries.sort_values(["qid", "tok"], kind="stable")
            ids, first = np.unique(docs["doc_id"].to_numpy(), return_index=True)
            v = np.stack(docs["vec"].to_numpy()).astype(np.float64)
            qids, begin = np.unique(queries["qid"].to_numpy(), return_index=True)
            w = queries["weight"].to_numpy(np.float64)
            for qid, lo, hi in zip(qids, begin, [*begin[1:], len(queries)], strict=True):
                q = np.stack(queries["qvec"].iloc[lo:hi].to_numpy()).astype(np.float64)
                s = np.maximum.reduceat(v @ q.T, first, axis=0) @ w[lo:hi]
                near = np.round(s, 9)
                few = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k]) if len(near) > k else np.arange(len(near))
                few = few[np.argsort(-near[few], kind="stable")][:k]
                out["qid"] += [qid] * len(few)
                out["doc_id"] += ids[few].tolist()
                out["score"] += s[few].tolist()
        return pd.DataFrame(out)

    return run


def _in_blocks(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: every query (qid, tok, weight, qvec) meets every document (doc_id, vec), block by block. Rows without a vector take no part."""
    docs, queries = docs.select("doc_id", "vec").where("vec is not null"), queries.where("qvec is not null")
    parts = max(1, -(-docs.count() // DOC_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    d = docs.withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = queries.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    types = {x: f.schema[x].dataType.simpleString() for f, x in ((q, "qid"), (d, "doc_id"))}
    found = q.groupBy("p", "b").cogroup(d.groupBy("p", "b")).applyInPandas(_best(k), f"qid {types['qid']}, doc_id {types['doc_id']}, score double")
    return topk(found, k, "qid", "doc_id")


def vector_topk(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, doc_id, score, rank over all documents (doc_id, vec) for each query (qid, vec)."""
    return _in_blocks(docs, queries.select("qid", F.lit(0).alias("tok"), F.lit(1.0).alias("weight"), F.col("vec").alias("qvec")), k)


def maxsim(doc_tokens: DataFrame, query_tokens: DataFrame) -> DataFrame:
    """qid, doc_id, score: for each query token the best of a document's tokens, then their sum (weighted by ``weight`` if there is one).

    doc_tokens: doc_id, vec; query_tokens: qid, tok, vec.
    """
    weight = F.col("weight") if "weight" in query_tokens.columns else F.lit(1.0)
    q = query_tokens.select("qid", "tok", F.col("vec").alias("qvec"), weight.cast("double").alias("weight"))
    on = ["qid"] if "qid" in doc_tokens.columns else F.lit(True)
    best = (doc_tokens.join(small(q, 2048), on).select("qid", "tok", "weight", "doc_id", dot(F.col("vec"), F.col("qvec")).alias("s"))
            .groupBy("qid", "tok", "weight", "doc_id").agg(F.max("s").alias("s")))
    return best.groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("s")).alias("score"))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """qid, n_exact, n_found, recall of each query of ``exact``; a query without exact results has 1."""
    found = exact.select("qid", "doc_id").join(approximate.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    return found.groupBy("qid").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.when(F.col("n_exact") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_exact")))


def rrf(rankings: list[DataFrame], query: str, key: str, constant: int = 60, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion: query, key, score, rank; ties by key."""
    if len(rankings) < 2:
        raise ValueError("fusion needs two rankings at least")
    rows = None
    for r in rankings:
        one = r.select(query, key, "rank")
        rows = one if rows is None else rows.unionByName(one)
    return topk(rows.groupBy(query, key).agg(F.sum(1 / (constant + F.col("rank"))).alias("score")), k, query, key)


def interleave(rankings: list[DataFrame], query: str, key: str, k: int = 10) -> DataFrame:
    """Round-robin: first of each, second of each, ...; a repeated key keeps its first place and that ranking's score."""
    if len(rankings) < 2:
        raise ValueError("fusion needs two rankings at least")
    rows = None
    for i, r in enumerate(rankings):
        one = r.select(query, key, "score", "rank", F.lit(i).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    first = Window.partitionBy(query, key).orderBy("rank", "source")
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    w = Window.partitionBy(query).orderBy(F.col("rank"), F.col("source"))
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(query, key, "score", F.col("place").alias("rank"), "source")


def propose(premises: DataFrame, closers: dict[str, float], templates: dict[str, float], query: str = "qid", n: int = 32, reserved: int = 8) -> DataFrame:
    """query, tactic, score, rank: steps for each query of ``premises`` (query, name, rank from 1), the n best of closers and filled templates.

    Scores are logarithms of shares; a premise's falls with its rank. The best ``reserved`` closers are always in, all
    others compete for the rest; a step that can be had in several ways keeps its best score.
    """
    spark = premises.sparkSession
    fixed = spark.createDataFrame(list(closers.items()), "tactic string, share double")
    shapes = spark.createDataFrame(list(templates.items()), "shape string, share double")
    own = premises.select(query).distinct().crossJoin(F.broadcast(fixed)).select(query, "tactic", F.log("share").alias("score"), F.lit(True).alias("closer"))
    made = premises.crossJoin(F.broadcast(shapes)).select(query, F.replace(F.col("shape"), F.lit("{p}"), F.col("name")).alias("tactic"), (F.log("share") - F.log(F.col("rank").cast("double"))).alias("score"), F.lit(False).alias("closer"))
    best = own.unionByName(made).groupBy(query, "tactic").agg(F.max("score").alias("score"), F.max("closer").alias("closer"))
    order = [F.round("score", 9).desc(), F.col("tactic")]
    seated = best.withColumn("c", F.row_number().over(Window.partitionBy(query, "closer").orderBy(*order))).withColumn("sure", F.col("closer") & (F.col("c") <= reserved))
    rest = seated.withColumn("r", F.row_number().over(Window.partitionBy(query, "sure").orderBy(*order))).where(F.col("sure") | (F.col("r") <= n - reserved))
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).select(query, "tactic", "score", "rank")
