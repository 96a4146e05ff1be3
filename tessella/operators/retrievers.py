"""Retrievers behind one protocol: a table of queries in, ranked documents out. What turns text into vectors is handed in.

A retriever has a ``name`` and ``retrieve(queries, k)``: queries have qid and text, results qid, doc_id, score and rank from 1. Queries without a
result have no row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..sources.scratch import stored
from . import bm25, dense, guards, retrieval
from .bm25 import _tokens

RESULT = "qid long, doc_id long, score double, rank int"
#: From a column of texts to one of vectors (single) or of lists of vectors, one for each token (late interaction).
Encode = Callable[[Column], Column]


@runtime_checkable
class Retriever(Protocol):
    name: str

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The best ``k`` documents of each query."""
        ...


@lru_cache(maxsize=1 << 16)
def _place(token: str, dim: int) -> tuple[int, float]:
    h = hashlib.md5(token.encode()).hexdigest()
    return int(h[:4], 16) % dim, 1.0 if int(h[4], 16) % 2 == 0 else -1.0


def _places(tokens: Iterable[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    places = [_place(t, dim) for t in tokens]
    return np.array([i for i, _ in places], np.int64), np.array([s for _, s in places], np.float64)


def hashing_encoder(dim: int = 64, unit: bool = True, per_token: bool = False) -> Encode:
    """An encoder that learns nothing: each token adds 1 or -1 at a place, both from its hash. Equal texts have equal vectors on any machine; null texts have none.

    ``per_token`` gives a vector for each token in place of their sum; ``unit`` scales vectors to length 1.
    """

    def vectors(text: str | None):
        if text is None:
            return None
        if per_token:
            at, sign = _places(_tokens(text, False), dim)
            v = np.zeros((len(at), dim), np.float32)
            v[np.arange(len(at)), at] = sign
        else:
            c = Counter(_tokens(text, False))
            at, sign = _places(c, dim)
            v = np.bincount(at, sign * np.fromiter(c.values(), np.int64, len(c)), dim).astype(np.float32)[None]
        if unit:
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return v.tolist() if per_token else v[0].tolist()

    kind = ArrayType(ArrayType(FloatType())) if per_token else ArrayType(FloatType())

    @F.pandas_udf(kind)
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(vectors, na_action=None)

    return encode


def token_table(rows: DataFrame, key: str, encode: Encode, text: str = "text", single: bool = True) -> DataFrame:
    """key, pos, vec: one vector for each text, or one for each of its tokens. Store it if it is read more than once: each reading encodes."""
    rows = retrieval.dealt(rows.select(key, text))
    if single:
        return rows.select(key, F.lit(0).alias("pos"), encode(F.col(text)).alias("vec"))
    return rows.select(key, F.posexplode(encode(F.col(text))).alias("pos", "vec"))


@dataclass
class NullRetriever:
    """The floor that others are measured against: nothing."""

    name: str = "none"

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return queries.sparkSession.createDataFrame([], RESULT)


@dataclass
class Bm25Retriever:
    index: DataFrame
    name: str = "bm25"
    k1: float = 1.5
    b: float = 0.75

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return bm25.rank(self.index, queries, k, "doc_id", "qid", "text", [(self.k1, self.b)]).select("qid", "doc_id", "score", "rank")


@dataclass
class VectorRetriever:
    """The largest inner products with a query's vector. ``index`` has one vector for each document."""

    index: DataFrame
    encode: Encode
    name: str = "sv"

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return dense.exact_topk(self.index, token_table(queries, "qid", self.encode).withColumnRenamed("pos", "tok"), k)


@dataclass
class LateInteractionRetriever:
    """MaxSim over the candidates of the first stage, or over all documents."""

    index: DataFrame
    encode: Encode
    n_candidates: int | None = 1000
    name: str = "li"

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        q = token_table(queries, "qid", self.encode, single=False).withColumnRenamed("pos", "tok")
        return dense.exact_topk(self.index, q, k) if self.n_candidates is None else dense.two_stage_topk(self.index, q, k, self.n_candidates)


@dataclass
class FusionRetriever:
    """Rankings of different retrievers, each ``depth`` long, as one."""

    parts: list[Retriever]
    mode: str = "rrf"
    depth: int = 32
    name: str = field(default="fusion")

    def __post_init__(self) -> None:
        guards.require_fusion([p.name for p in self.parts], self.mode)

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        rankings = [stored(p.retrieve(queries, max(k, self.depth)), f"ranking-{p.name}") for p in self.parts]
        fuse = retrieval.rrf if self.mode == "rrf" else retrieval.interleave
        return fuse(rankings, "qid", "doc_id", k=k).select("qid", "doc_id", "score", "rank")


def accounted(retriever: Retriever, queries: DataFrame, k: int = 10) -> tuple[DataFrame, dict]:
    """Results, written, and what they cost: n_queries, total_latency_s, mean_latency_ms, mean_premises_returned."""
    import time

    began = time.perf_counter()
    found = stored(retriever.retrieve(queries, k), f"found-{retriever.name}")
    seconds, n, returned = time.perf_counter() - began, queries.count(), found.count()
    return found, {"n_queries": n, "total_latency_s": round(seconds, 3), "mean_latency_ms": round(1000 * seconds / max(n, 1), 2), "mean_premises_returned": round(returned / max(n, 1), 2)}
