"""BM25 over an inverted index: postings in blocks by term and range of documents, read for the queries' terms only and skipped by bounds.

A row of the index is a block: a term, a range of documents, the documents of the range that hold the term and how often.
Beside them stand the block's greatest frequency and the length of its shortest document, which bound what the term adds to any
score of the range whatever the parameters. One row for each range, without a term, has the keys and lengths of its documents.

A search first reads the blocks' bounds alone. Each query is scored in the range with its greatest bound; the score of its k-th document there
is a floor, and only ranges whose bound reaches it have their postings read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..sources.scratch import stored
from .retrieval import dealt, topk
from .runs import GuardError

#: Documents of a range, and characters of its texts, about.
RANGE_DOCS, RANGE_CHARS = 1024, 4_000_000
#: Texts that are Python's strings at once.
TEXTS = 64
#: Characters of queries that are searched at once; more are taken in further passes.
QUERY_CHARS = 4_000_000
#: Folders of a saved index, by a hash of the term.
BUCKETS = 64
INDEX = "range long, term string, n int, most long, shortest int, docs binary, tfs binary"
#: Scores are ordered as rounded to 9 places; a bound that is lower by more than this can't reach a floor.
SLACK = 1e-8
_TOKEN = re.compile(TOKEN, re.ASCII)


def _tokens(text: str | None, lowercase: bool) -> list[str]:
    return _TOKEN.findall(text.lower() if lowercase else text) if text else []


def _blocks(number: int, keys: list[int], vocabulary: dict[str, int], counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The rows of one range: of each document the terms by their number in ``vocabulary`` and how often each occurs."""
    term = np.concatenate([t for t, _ in counts]).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), [len(t) for t, _ in counts])
    tf = np.concatenate([n for _, n in counts]).astype(np.int64)
    length = np.array([int(n.sum()) for _, n in counts], np.int64)
    order = np.argsort(term, kind="stable")
    term, doc, tf = term[order], doc[order].astype("<u2"), tf[order].astype("<u4")
    first = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    n = np.diff(first)
    most = np.maximum.reduceat(tf, first[:-1]) if len(n) else np.empty(0)
    shortest = np.minimum.reduceat(length[doc], first[:-1]) if len(n) else np.empty(0)
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    rows = len(vocabulary) + 1
    return pa.record_batch([
        pa.array(np.full(rows, number)), pa.array([*vocabulary, None], pa.string()), pa.array([*n.tolist(), len(counts)], pa.int32()), pa.array([*most.tolist(), int(length.sum())], pa.int64()),
        pa.array([*shortest.tolist(), 0], pa.int32()), pa.array([*cut(doc), np.array(keys, "<i8").tobytes()], pa.binary()), pa.array([*cut(tf), length.astype("<u4").tobytes()], pa.binary()),
    ], [c.split()[0] for c in INDEX.split(", ")])


def _indexed(lowercase: bool, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, counts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        vocabulary: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    # Numbers in place of strings at once: a range's strings are held once, not by each document.
                    c = Counter(_tokens(text, lowercase))
                    keys.append(key)
                    counts.append((np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in c), np.int32, len(c)), np.fromiter(c.values(), np.uint32, len(c))))
                    chars += len(text or "")
                    if len(keys) == most_docs or chars >= RANGE_CHARS:
                        yield _blocks(number, keys, vocabulary, counts)
                        number, keys, vocabulary, counts, chars = number + 1, [], {}, [], 0
        if keys:
            yield _blocks(number, keys, vocabulary, counts)

    return run


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", lowercase: bool = False, most_docs: int = RANGE_DOCS) -> DataFrame:
    """The index of ``docs`` (``INDEX``); store it before it is searched. Keys are whole numbers; rows without one take no part, null texts have no terms."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null")
    return dealt(rows).mapInArrow(_indexed(lowercase, most_docs), INDEX)


def _sums(index: DataFrame) -> tuple[int, int, int]:
    """Documents, tokens, postings."""
    n, total, posts = index.agg(F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.sum(F.when(F.col("term").isNull(), F.col("most"))), F.sum(F.when(F.col("term").isNotNull(), F.col("n")))).first()
    return n or 0, total or 0, posts or 0


def save(index: DataFrame, path: str, lowercase: bool = False) -> None:
    """The index under ``path``, in folders by a hash of the term and in order of terms there, and what it says of itself. An empty corpus is refused."""
    spark = index.sparkSession
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    whole = stored(index, "bm25")
    n, total, posts = _sums(whole)
    if not n:
        raise GuardError("an index needs documents")
    whole.withColumn("bucket", bucket).repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(n, total, posts, lowercase)], "n_docs long, n_tokens long, n_postings long, lowercase boolean").write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The saved index; refused if its documents, tokens or postings aren't as many as it says."""
    index, meta = spark.read.schema(f"{INDEX}, bucket int").parquet(f"{path}/postings"), spark.read.parquet(f"{path}/meta").first()
    if (have := _sums(index)) != (meta["n_docs"], meta["n_tokens"], meta["n_postings"]):
        raise GuardError(f"the index has {have} documents, tokens and postings, its description says {tuple(meta)[:3]}")
    return index


def _gain(tf: np.ndarray, length: np.ndarray, avg: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def _bounded(wanted: list[np.ndarray], idf: np.ndarray, avg: float, params: list[tuple[float, float]], floors: np.ndarray):
    """setting, nth, range, bound of the queries whose best conceivable score in a range reaches their floor."""

    def run(table: pa.Table) -> pa.Table:
        number = table["no"].to_numpy()
        tf, length = table["most"].to_numpy().astype(float), table["shortest"].to_numpy().astype(float)
        out = []
        for p, (k1, b) in enumerate(params):
            own = np.zeros(len(idf))
            own[number] = idf[number] * _gain(tf, length, avg, k1, b)
            sums = np.array([own[terms].sum() for terms in wanted])
            at = np.flatnonzero((sums > 0) & (sums + SLACK >= floors[p]))
            out.append((np.full(len(at), p, np.int32), at, sums[at]))
        p, at, sums = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"setting": p, "nth": at, "range": np.full(len(at), table["range"][0].as_py()), "bound": sums})

    return run


def _scored(wanted: list[np.ndarray], idf: np.ndarray, avg: float, params: list[tuple[float, float]], k: int):
    """The best ``k`` documents of a range for each query that asks for it, by score rounded to 9 places and key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        number, bodies, tfs = left["no"].to_numpy(), left["docs"].combine_chunks(), left["tfs"].combine_chunks()
        info = np.flatnonzero(number < 0)
        if len(info) and right.num_rows:
            keys = np.frombuffer(bodies[int(info[0])].as_buffer(), "<i8")
            length = np.frombuffer(tfs[int(info[0])].as_buffer(), "<u4").astype(float)
            at = np.flatnonzero(number >= 0)
            at = at[np.argsort(number[at], kind="stable")]
            docs = [np.frombuffer(bodies[i].as_buffer(), "<u2") for i in at.tolist()]
            size = np.array([len(d) for d in docs], np.int64)
            end = np.cumsum(size)
            doc = np.concatenate(docs).astype(np.int64) if docs else np.empty(0, np.int64)
            tf = np.concatenate([np.frombuffer(tfs[i].as_buffer(), "<u4") for i in at.tolist()]).astype(float) if docs else np.empty(0)
            own = number[at]
            for p in range(len(params)):
                gain = _gain(tf, length[doc], avg, *params[p]) * np.repeat(idf[own], size)
                for q in right["nth"].filter(pc.equal(right["setting"], p)).to_pylist():
                    here = np.flatnonzero(np.isin(own, wanted[q], assume_unique=True))
                    if not len(here):
                        continue
                    rows = np.concatenate([np.arange(end[i] - size[i], end[i]) for i in here])
                    scores = np.bincount(doc[rows], gain[rows], len(keys))
                    found = np.flatnonzero(scores > 0)
                    near = np.round(scores[found], 9)
                    if len(found) > k:
                        keep = near >= np.partition(near, len(near) - k)[len(near) - k]
                        found, near = found[keep], near[keep]
                    best = found[np.lexsort((keys[found], -near))[:k]]
                    out += [(p, q, int(keys[i]), float(scores[i])) for i in best.tolist()]
        p, q, key, score = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({"setting": pa.array(p, pa.int32()), "nth": pa.array(q, pa.int64()), "key": pa.array(key, pa.int64()), "score": pa.array(score, pa.float64())})

    return run


def rank(index: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", query: str = "item_id", text: str = "text", params: list[tuple[float, float]] | None = None, lowercase: bool = False, counts: dict | None = None) -> DataFrame:
    """setting, query, key, score, rank: the best ``k`` documents of each query for each (k1, b) of ``params``.

    ``index`` is stored or loaded. A query is the set of its terms; documents without any of them don't appear, nor do null
    queries. Queries are collected in blocks of ``QUERY_CHARS`` characters. ``k`` below 1 gives nothing. ``counts``, if given,
    is told the postings that there are and those that were read.
    """
    spark, params = index.sparkSession, params or [(1.5, 0.75)]
    asked = queries.select(F.col(query).alias("q"), F.col(text).alias("t")).where("t is not null")
    kind = asked.schema["q"].dataType.simpleString()
    n_docs, total, posts = _sums(index)
    if counts is not None:
        counts |= {"postings": posts, "read": 0}
    blocks = int((asked.agg(F.sum(F.length("t"))).first()[0] or 0) // QUERY_CHARS) + 1
    found = []
    for block in range(blocks if n_docs and k > 0 else 0):
        own = [(r["q"], set(_tokens(r["t"], lowercase))) for r in asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in own for t in terms}))}
        if not vocabulary:
            continue
        wanted = [np.array([vocabulary[t] for t in sorted(terms)], np.int64) for _, terms in own]
        terms = F.broadcast(spark.createDataFrame(list(vocabulary.items()), "term string, no int"))
        tops = stored(_in_buckets(index, vocabulary).select("range", "term", "n", "most", "shortest").join(terms, "term").select("range", "no", "n", "most", "shortest"), "bm25-tops")
        df = np.zeros(len(vocabulary))
        for r in tops.groupBy("no").agg(F.sum("n").alias("df")).collect():
            df[r["no"]] = r["df"]
        idf, avg = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), total / n_docs or 1.0
        schema = "setting int, nth long, range long, bound double"
        bounds = lambda floors: tops.groupBy("range").applyInArrow(_bounded(wanted, idf, avg, params, floors), schema)
        floors = np.zeros((len(params), len(own)))
        # A row for each query and setting, of which the block's size bounds the number.
        best = bounds(floors).groupBy("setting", "nth").agg(F.max_by("range", F.struct("bound", -F.col("range"))).alias("range")).collect()
        first = spark.createDataFrame([(r["setting"], r["nth"], r["range"]) for r in best], "setting int, nth long, range long")
        result = "setting int, nth long, key long, score double"

        of_query = F.broadcast(spark.createDataFrame([(q, int(t)) for q, terms in enumerate(wanted) for t in (-1, *terms)], "nth long, no int"))

        def scores(pairs: DataFrame) -> DataFrame:
            """Scores of pairs of a query and a range; blocks of other ranges, and of terms that no query there asks for, don't reach the tasks."""
            rows = _in_buckets(index, vocabulary).select("range", "term", "docs", "tfs").join(terms, "term").select("range", "no", "docs", "tfs")
            rows = rows.unionByName(index.where("term is null").select("range", F.lit(-1).alias("no"), "docs", "tfs"))
            rows = rows.join(pairs.join(of_query, "nth").select("range", "no").distinct(), ["range", "no"], "left_semi")
            if counts is not None:
                counts["read"] += rows.where("no >= 0").agg(F.sum(F.octet_length("docs") / 2)).first()[0] or 0
            return rows.groupBy("range").cogroup(pairs.groupBy("range")).applyInArrow(_scored(wanted, idf, avg, params, k), result)

        begun = stored(scores(first), "bm25-first")
        for r in begun.groupBy("setting", "nth").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
            floors[r["setting"], r["nth"]] = r["least"]
        rest = stored(bounds(floors).select("setting", "nth", "range").join(F.broadcast(first), ["setting", "nth", "range"], "left_anti"), "bm25-pairs")
        names = F.broadcast(spark.createDataFrame([(i, q) for i, (q, _) in enumerate(own)], f"nth long, _query {kind}"))
        found.append(begun.unionByName(scores(rest)).join(names, "nth").select("setting", F.col("_query").alias(query), F.col("key").alias(key), "score"))
    if not found:
        return spark.createDataFrame([], f"setting int, {query} {kind}, {key} long, score double, rank int")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return topk(out, k, query, key, "setting")


def _in_buckets(index: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Of a saved index the folders that may hold a term of the vocabulary, if those are few terms; all rows otherwise."""
    if "bucket" not in index.columns or len(vocabulary) > BUCKETS:
        return index
    spark = index.sparkSession
    own = spark.createDataFrame([(t,) for t in vocabulary], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()
    return index.where(F.col("bucket").isin([r["b"] for r in own]))


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", query: str = "item_id", text: str = "text", k1: float = 1.5, b: float = 0.75, lowercase: bool = False) -> DataFrame:
    """query, key, score, rank over ``docs`` without a saved index."""
    return rank(stored(build(docs, key, text, lowercase), "bm25"), queries, k, key, query, text, [(k1, b)], lowercase).drop("setting")
