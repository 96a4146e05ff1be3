"""A late-interaction index: documents' token vectors packed by block with offsets, their pooled vectors beside them.

A row is a block of documents: ids, offsets (document ``i`` has the tokens ``offsets[i]:offsets[i + 1]``), tokens in half or single precision,
and for each document the mean of its tokens scaled to length 1. The first stage of a search reads the pooled vectors
alone, the second the tokens of blocks that hold a candidate. An index of single vectors is one with a token for each document.

Queries are collected in blocks of bounded size; documents never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .retrieval import topk
from .runs import GuardError

#: Token vectors of a block, about; numbers of a block of queries, and of a task's matrix of similarities, at most.
BLOCK_TOKENS, QUERY_NUMBERS, CELLS = 65_536, 4_000_000, 8_000_000
INDEX = "block long, n int, n_tokens long, dim int, half boolean, ids binary, offsets binary, tokens binary, pooled binary"
_NAMES = [c.split()[0] for c in INDEX.split(", ")]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def pool(vectors: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The means of the runs of rows that begin at ``first``, scaled to length 1; a mean of zero stays zero."""
    mean = np.add.reduceat(vectors.astype(np.float64), first, axis=0) / np.diff(np.append(first, len(vectors)))[:, None]
    return mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)


def _packed(half: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("pos", "ascending")])
        ids, first = np.unique(table["doc_id"].to_numpy(), return_index=True)
        tokens = _matrix(table["vec"]).astype("<f4")
        offsets = np.append(first, len(tokens)).astype("<i8")
        row = [table["block"][0].as_py(), len(ids), len(tokens), tokens.shape[1], half, ids.astype("<i8").tobytes(), offsets.tobytes(), tokens.astype("<f2" if half else "<f4").tobytes(), pool(tokens, first).astype("<f8").tobytes()]
        return pa.table([[x] for x in row], _NAMES).cast(pa.schema([(n, t) for n, t in zip(_NAMES, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)]))

    return run


def build(doc_tokens: DataFrame, half: bool = True, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The index (``INDEX``) of doc_id, vec and, if their order matters, pos; store it before it is searched.

    Vectors have one length. Rows without a document or a vector take no part. A document lies in one block: its tokens are
    as many as a model reads at once.
    """
    pos = F.col("pos") if "pos" in doc_tokens.columns else F.lit(0)
    rows = doc_tokens.select(F.col("doc_id").cast("long").alias("doc_id"), pos.cast("long").alias("pos"), F.col("vec").cast("array<float>").alias("vec")).where("doc_id is not null and vec is not null")
    blocks = max(1, -(-rows.count() // block_tokens))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).groupBy("block").applyInArrow(_packed(half), INDEX)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        r = batch.to_pydict()
        bad = 0
        for n, t, dim, half, ids, offsets, tokens, pooled in zip(*(r[c] for c in ("n", "n_tokens", "dim", "half", "ids", "offsets", "tokens", "pooled")), strict=True):
            at = np.frombuffer(offsets, "<i8")
            bad += not (ids == 8 * n and len(at) == n + 1 and at[0] == 0 and at[-1] == t and (np.diff(at) > 0).all() and tokens == t * dim * (2 if half else 4) and pooled == n * dim * 8)
        yield pa.record_batch([pa.array([sum(r["n"])], pa.int64()), pa.array([sum(r["n_tokens"])], pa.int64()), pa.array([bad], pa.int64())], ["n", "t", "bad"])


def _shape(index: DataFrame) -> tuple[int, int, int, int | None]:
    """Documents, tokens, blocks whose offsets or lengths don't agree, numbers of a vector. Reads sizes and offsets, no vectors."""
    size = lambda c: F.octet_length(c).alias(c)
    sums = index.select("n", "n_tokens", "dim", "half", size("ids"), "offsets", size("tokens"), size("pooled")).mapInArrow(_checked, "n long, t long, bad long").agg(F.sum("n"), F.sum("t"), F.sum("bad")).first()
    dims = [r["dim"] for r in index.select("dim").distinct().limit(2).collect()]
    if len(dims) > 1:
        raise GuardError("vectors of several lengths")
    return sums[0] or 0, sums[1] or 0, sums[2] or 0, dims[0] if dims else None


def save(index: DataFrame, path: str) -> None:
    """The index under ``path`` and what it says of itself."""
    spark = index.sparkSession
    index.write.parquet(f"{path}/blocks")
    n, t, bad, dim = _shape(spark.read.schema(INDEX).parquet(f"{path}/blocks"))
    if not n or bad:
        raise GuardError("an index needs documents, and offsets that agree with its tokens")
    spark.createDataFrame([(n, t, dim)], "n_docs long, n_tokens long, dim int").write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The saved index; refused if documents, tokens, lengths or offsets aren't what it says."""
    index, meta = spark.read.schema(INDEX).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/meta").first()
    n, t, bad, dim = _shape(index)
    if bad or (n, t, dim) != (meta["n_docs"], meta["n_tokens"], meta["dim"]):
        raise GuardError(f"{n} documents with {t} tokens of {dim} numbers, {bad} blocks with wrong offsets; the index says {meta.asDict()}")
    return index


class _Query:
    """Some queries: ids, where the tokens of each begin, token vectors and weights."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["qid", "tok"], kind="stable")
        self.ids, self.first = np.unique(rows["qid"].to_numpy(np.int64), return_index=True)
        self.vec = np.stack(rows["vec"].to_numpy()).astype(np.float64)
        self.weight = rows["weight"].to_numpy(np.float64)
        self.whole = np.add.reduceat(self.vec, self.first, axis=0)
        self.end = np.append(self.first[1:], len(rows))


def _blocks_of(queries: DataFrame) -> Iterator[_Query]:
    """Queries (qid, tok, vec and, if there is one, weight) block by block."""
    weight = F.col("weight") if "weight" in queries.columns else F.lit(1.0)
    rows = stored(queries.where("vec is not null and qid is not null").select(F.col("qid").cast("long").alias("qid"), F.col("tok").cast("long").alias("tok"), weight.cast("double").alias("weight"), F.col("vec").cast("array<double>").alias("vec")), "queries")
    blocks = int((rows.agg(F.sum(F.size("vec"))).first()[0] or 0) // QUERY_NUMBERS) + 1
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas()
        if len(own):
            yield _Query(own)


def _few(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest, as rounded to 9 places, ties to smaller ids."""
    near, at = np.round(score, 9), np.arange(len(score))
    if len(near) > k:
        at = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
    return at[np.lexsort((ids[at], -near[at]))[:k]]


def _maxsim(tokens: np.ndarray, offsets: np.ndarray, some: np.ndarray | None, q: _Query, i: int) -> np.ndarray:
    """Scores of query ``i`` for the documents ``some`` (None: all) of a block."""
    own, weight = q.vec[q.first[i]:q.end[i]], q.weight[q.first[i]:q.end[i]]
    size = np.diff(offsets)
    docs = np.arange(len(size)) if some is None else some
    step = max(1, CELLS // max(1, len(own) * int(size.max(initial=1))))
    out = np.empty(len(docs))
    for lo in range(0, len(docs), step):
        part = docs[lo:lo + step]
        first = np.cumsum(size[part]) - size[part]
        rows = np.repeat(offsets[part] - first, size[part]) + np.arange(int(size[part].sum()))
        out[lo:lo + step] = np.maximum.reduceat(tokens[rows].astype(np.float64) @ own.T, first, axis=0) @ weight
    return out


def _table(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table({n: pa.array(np.concatenate(c) if rows else [], t) for c, (n, t) in zip(columns, names, strict=True)})


_SCORED = [("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["offsets"], "<i8"), np.frombuffer(row["tokens"], "<f2" if row["half"] else "<f4").reshape(-1, row["dim"])


def _exact(q: _Query, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, tokens = _unpacked(row)
                out = []
                # Documents and queries of one token each: some queries' products at once.
                single = len(tokens) == len(ids) and len(q.vec) == len(q.ids)
                some = max(1, CELLS // max(1, len(ids)))
                wide = tokens.astype(np.float64) if single else None
                for i in range(len(q.ids)):
                    if single and i % some == 0:
                        scores = q.weight[i:i + some, None] * (q.vec[i:i + some] @ wide.T)
                    score = scores[i % some] if single else _maxsim(tokens, offsets, None, q, i)
                    at = _few(score, ids, k)
                    out.append((np.full(len(at), q.ids[i]), ids[at], score[at]))
                yield from _table(out, _SCORED).to_batches()

    return run


def _first_stage(q: _Query, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, pooled = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["pooled"], "<f8").reshape(-1, row["dim"])
                scores, out = pooled @ q.whole.T, []
                for i in range(len(q.ids)):
                    at = _few(scores[:, i], ids, n)
                    out.append((np.full(len(at), q.ids[i]), ids[at], scores[at, i], np.full(len(at), row["block"])))
                yield from _table(out, [*_SCORED, ("block", pa.int64())]).to_batches()

    return run


def _second_stage(q: _Query):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            ids, offsets, tokens = _unpacked(left.slice(0, 1).to_pylist()[0])
            qid, doc, place = (right[c].to_numpy() for c in ("qid", "doc_id", "place"))
            for i in np.flatnonzero(np.isin(q.ids, qid)).tolist():
                own = np.flatnonzero(qid == q.ids[i])
                out.append((qid[own], doc[own], _maxsim(tokens, offsets, np.searchsorted(ids, doc[own]), q, i), place[own]))
        return _table(out, [*_SCORED, ("place", pa.int32())])

    return run


def exact_topk(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, doc_id, score, rank by MaxSim over all documents: for each token of a query the best of a document's, then their sum by weight."""
    schema, out = "qid long, doc_id long, score double", None
    for q in _blocks_of(queries) if k > 0 else ():
        one = index.select("dim", "half", "ids", "offsets", "tokens").mapInArrow(_exact(q, k), schema)
        out = one if out is None else out.unionByName(one)
    return topk(out if out is not None else index.sparkSession.createDataFrame([], schema), k, "qid", "doc_id")


def rescored(index: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """qid, doc_id, place, score: the first stage's ``n`` documents for each query, with their place there (the largest sum of inner products of the query's tokens with the pooled vector is 1) and their MaxSim."""
    schema, out = "qid long, doc_id long, score double, place int", None
    for q in _blocks_of(queries) if n > 0 else ():
        near = index.select("block", "dim", "ids", "pooled").mapInArrow(_first_stage(q, n), "qid long, doc_id long, score double, block long")
        candidates = topk(near, n, "qid", "doc_id").select("qid", "doc_id", "block", F.col("rank").alias("place"))
        one = index.select("block", "dim", "half", "ids", "offsets", "tokens").groupBy("block").cogroup(candidates.groupBy("block")).applyInArrow(_second_stage(q), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else index.sparkSession.createDataFrame([], schema)


def two_stage_topk(index: DataFrame, queries: DataFrame, k: int = 10, n_candidates: int = 1000) -> DataFrame:
    """qid, doc_id, score, rank by MaxSim over the first stage's candidates; there are ``k`` of them at least."""
    return topk(rescored(index, queries, max(k, n_candidates) if k > 0 else 0), k, "qid", "doc_id").drop("place")


def recall_per_query(index: DataFrame, queries: DataFrame, budgets: list[int], k: int = 10) -> DataFrame:
    """qid, budget, n_exact, n_found, recall: how much of the exact ``k`` each budget of candidates finds.

    One exact search, one first stage and one MaxSim for the largest budget serve all: a smaller budget's candidates are those
    whose place in the first stage it reaches.
    """
    exact = stored(exact_topk(index, queries, k).select("qid", "doc_id", F.lit(1).alias("hit")), "exact")
    scored = stored(rescored(index, queries, max(k, *budgets)), "rescored")
    each = scored.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in sorted(set(budgets))]))).where(F.col("place") <= F.greatest("budget", F.lit(k)))
    found = topk(each, k, "qid", "doc_id", "budget").join(exact, ["qid", "doc_id"]).groupBy("qid", "budget").agg(F.count("*").alias("n_found"))
    n = exact.groupBy("qid").agg(F.count("*").alias("n_exact")).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in sorted(set(budgets))])))
    out = n.join(found, ["qid", "budget"], "left").fillna(0, ["n_found"])
    return out.select("qid", "budget", "n_exact", "n_found", (F.col("n_found") / F.col("n_exact")).alias("recall"))


def recall_at_budgets(per_query: DataFrame) -> DataFrame:
    """budget, micro (found over all exact results), macro (mean of the queries' shares), n_lossless (queries with all found)."""
    return per_query.groupBy("budget").agg(F.round(F.sum("n_found") / F.sum("n_exact"), 6).alias("micro"), F.round(F.avg("recall"), 6).alias("macro"), F.count_if(F.col("recall") == 1).alias("n_lossless"))


def pooled(index: DataFrame) -> DataFrame:
    """doc_id, vec: each document's pooled vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(row["pooled"], "<f8")
                offsets = np.arange(0, len(flat) + 1, row["dim"], dtype=np.int32)
                yield pa.record_batch([pa.array(np.frombuffer(row["ids"], "<i8")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "vec"])

    return index.select("dim", "ids", "pooled").mapInArrow(run, "doc_id long, vec array<double>")
