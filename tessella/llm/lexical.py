"""Ranked search by hierarchical maxima: an inverted index whose postings carry a tree of the greatest impact by range of documents.

The corpus is cut into shards of some megabytes of text. For each shard and term the index has the documents that hold the
term with their impact (what the term adds to a score, but for its weight), and of each range of 32 documents, of each
32 such ranges and of the whole shard the greatest impact. A query's terms give upper bounds for any range as the sum of these by weight.

A search is branch and bound on two levels. Each query is first searched in the shard with its greatest bound; the score of its k-th
document there is a floor. Then all shards are searched, each range-wise: the node with the greatest bound is opened next,
until the greatest bound that is left lies below the floor or below the k-th score found. Nodes whose bound equals it are opened, as a
document of equal score and smaller id goes first. So a shard sends back what may be among the best, and nothing else.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import slices
from .shared import documents, scratch_path, stored
from .words import LETTERS, bounds, packed, spans, texts, words_of

#: Children of a node; documents of a shard are three levels below its root.
FAN = 32
MOST_DOCS = FAN**3
#: Bytes of text of a shard, about.
SHARD = 1 << 23
#: Characters of queries that are searched at once; more go in further passes.
QUERY_CHARS = 4_000_000
#: Node numbers: the root, its children, their children.
_UPPER, _RANGES = 1, 1 + FAN
_NODE = np.dtype([("node", "<u4"), ("top", "<u4")])
_POST = np.dtype([("doc", "<u4"), ("impact", "<u4")])
#: Bits of a node's or a document's number in a key of a term and that number.
_KEY = 20
INDEX = "shard long, term binary, df long, top long, tree binary, posts binary"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = LETTERS[0]
    for batch in batches:
        data, off = texts(batch.column(0))
        n = []
        for lo, hi in spans(off, SHARD):
            mask = word[data[off[lo]:off[hi]]]
            begin = mask.copy()
            begin[1:] &= ~mask[:-1]
            at = (off[lo:hi] - off[lo])[off[lo:hi] < off[hi]]
            begin[at] = mask[at]
            n.append(np.diff(np.concatenate([[0], np.cumsum(begin)])[off[lo:hi + 1] - off[lo]]))
        n = np.concatenate(n) if n else np.empty(0, np.int64)
        yield pa.record_batch([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1e9 * tf) div (1000 * tf + 12 * m), with m = 75 + (25 * n * n_docs) div n_terms, in whole numbers."""
    if 25 * n_docs * int(n.max(initial=0)) >= 2**63:
        m = 75 + np.array([25 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 75 + 25 * n.astype(np.int64) * n_docs // n_terms
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _with_tops(term: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, node and greatest value of each run of one term and node."""
    b = bounds(term << np.int64(_KEY) | node)
    return (term[b[:-1]], node[b[:-1]], np.maximum.reduceat(value, b[:-1])) if len(term) else (term, node, value)


def _alike(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """An order of the shard's documents in which like ones are near one another, so that ranges have few terms in common use and low bounds: by most frequent term (as a rule a word of the language), then by length."""
    df = np.bincount(term)
    lead = np.full(len(n), -1)
    order = np.lexsort((term, df[term], tf, doc))
    lead[doc[order]] = term[order]
    return np.lexsort((np.arange(len(n)), n, lead))


def index_shard(shard: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The rows of one shard: one for each term, and one without a term that has the documents' ids."""
    w = words_of(data, offsets, LETTERS, identity=True)
    doc = w.doc()
    order = np.lexsort((doc, w.low, w.high))
    low, high, doc = w.low[order], w.high[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    number = np.cumsum(new) - 1
    first = order[new]
    post = bounds(number << np.int64(_KEY) | doc)
    term, doc, tf = number[post[:-1]], doc[post[:-1]], np.diff(post)
    alike = _alike(term, doc, tf, w.counts)
    place = np.empty(len(alike), np.int64)
    place[alike] = np.arange(len(alike))
    order = np.lexsort((place[doc], term))
    term, doc, impact = term[order], place[doc][order], impacts(tf, w.counts[doc], n_docs, n_terms)[order]
    t1, n1, v1 = _with_tops(term, doc // FAN, impact)
    t2, n2, v2 = _with_tops(t1, n1 // FAN, v1)
    _, _, top = _with_tops(t2, n2 * 0, v2)
    posts = np.empty(len(doc), _POST)
    posts["doc"], posts["impact"] = doc, impact
    nodes = np.empty(len(t1) + len(t2), _NODE)
    owner = np.concatenate([t2, t1])
    nodes["node"], nodes["top"] = np.concatenate([n2 + _UPPER, n1 + _RANGES]), np.concatenate([v2, v1])
    order = np.argsort(owner, kind="stable")
    k = len(top)
    at = np.repeat(offsets[:-1], w.counts)[first] + w.start[first]
    size = (w.end - w.start)[first]
    names = packed(slices(LETTERS[1][data], at, size), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    p, t = bounds(term), bounds(owner[order])
    columns = [pa.array(np.full(k, shard)), names, pa.array(np.diff(p)), pa.array(top.astype(np.int64)), packed(nodes[order], t), packed(posts, p)]
    keys = packed(ids.to_numpy(zero_copy_only=False)[alike], np.array([0, len(ids)]))
    ends = [pa.array([shard]), pa.nulls(1, pa.binary()), pa.array([len(ids)]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), keys]
    return pa.record_batch([pa.concat_arrays([a, b]) for a, b in zip(columns, ends, strict=True)], [c.split()[0] for c in INDEX.split(", ")])


def _indexed(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off, SHARD):
                for a in range(lo, hi, MOST_DOCS):
                    b = min(hi, a + MOST_DOCS)
                    yield index_shard(shard, batch.column(0).slice(a, b - a), data, off[a:b + 1], n_docs, n_terms)
                    shard += 1

    return run


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the index of all documents under ``path``: ``terms`` (``INDEX``) and ``meta``. Rows with a null key take no part; null texts have no terms; repeated rows are documents of their own."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text")).where("key is not null")
    if 0 < len(docs.inputFiles()) < docs.sparkSession.sparkContext.defaultParallelism:
        # Few files would be few tasks.
        rows = rows.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    sums = rows.select("text").mapInArrow(_counted, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0
    rows.mapInArrow(_indexed(n_docs, max(1, n_terms)), INDEX).write.option("compression", "zstd").parquet(f"{path}/terms")
    docs.sparkSession.createDataFrame([(n_docs, n_terms)], "n_docs long, n_terms long").write.parquet(f"{path}/meta")


class ShardSearch:
    """The postings and trees of a block's terms in one shard."""

    def __init__(self, number: np.ndarray, top: np.ndarray, trees: list[np.ndarray], posts: list[np.ndarray], ids: np.ndarray):
        number = number.astype(np.int64)  # keys of a term and a node need all 64 bits
        order = np.argsort(number)
        number, trees, posts = number[order], [trees[i] for i in order], [posts[i] for i in order]
        self.ids, self.number, self.top = ids, number, top[order]
        key = lambda parts, field: np.repeat(number, [len(p) for p in parts]) << _KEY | np.concatenate([p[field] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        value = lambda parts, field: np.concatenate([p[field] for p in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        self.nodes, self.node_tops = key(trees, "node"), value(trees, "top")
        self.docs, self.impacts = key(posts, "doc"), value(posts, "impact")
        self.opened = self.scored = 0

    def _bound(self, terms: np.ndarray, weights: np.ndarray) -> int:
        return int((weights * self.top[np.searchsorted(self.number, terms)]).sum())

    def _of(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.number):
            return terms[:0], weights[:0]
        has = self.number[np.minimum(np.searchsorted(self.number, terms), len(self.number) - 1)] == terms
        return terms[has], weights[has]

    @staticmethod
    def _sums(keys: np.ndarray, values: np.ndarray, terms: np.ndarray, weights: np.ndarray, first: int) -> np.ndarray:
        """Sums by weight of what ``FAN`` children from ``first`` on have."""
        lo = np.searchsorted(keys, terms << _KEY | first)
        size = np.searchsorted(keys, terms << _KEY | (first + FAN)) - lo
        out = np.zeros(FAN, np.int64)
        child = (slices(keys, lo, size) & ((1 << _KEY) - 1)) - first
        np.add.at(out, child, slices(values, lo, size) * np.repeat(weights, size))
        return out

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, id) of the shard's documents that may be among the best ``k``: scores of ``floor`` at least, and above zero."""
        terms, weights = self._of(terms, weights)
        floor = max(floor, 1)
        found: list[tuple[int, int]] = []
        heap = [(-self._bound(terms, weights), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            self.opened += 1
            if node >= _RANGES:
                first = (node - _RANGES) * FAN
                scores = self._sums(self.docs, self.impacts, terms, weights, first)
                self.scored += FAN
                for i in np.flatnonzero(scores >= floor).tolist():
                    own = (int(scores[i]), -int(self.ids[first + i]))
                    if len(found) < k:
                        heapq.heappush(found, own)
                    elif own > found[0]:
                        heapq.heapreplace(found, own)
                if len(found) == k:
                    floor = max(floor, found[0][0])
                continue
            first = _UPPER if node == 0 else _RANGES + (node - _UPPER) * FAN
            sums = self._sums(self.nodes, self.node_tops, terms, weights, first)
            for i in np.flatnonzero(sums >= floor).tolist():
                heapq.heappush(heap, (-int(sums[i]), first + i))
        return [(score, -i) for score, i in found]


def _searched(wanted: list[tuple[np.ndarray, np.ndarray]], k: int, floors: list[int], only: dict[int, list[int]] | None, done: list[int | None]):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        number = table["no"].to_numpy()
        bodies = table["posts"].combine_chunks()
        trees = table["tree"].combine_chunks()
        at = np.flatnonzero(number >= 0)
        ids = np.frombuffer(bodies[int(np.flatnonzero(number < 0)[0])].as_buffer(), np.int64)
        search = ShardSearch(number[at], table["top"].to_numpy()[at].astype(np.int64), [np.frombuffer(trees[i].as_buffer(), _NODE) for i in at.tolist()], [np.frombuffer(bodies[i].as_buffer(), _POST) for i in at.tolist()], ids)
        out = [(q, i, score) for q in (range(len(wanted)) if only is None else only[shard]) if only is not None or done[q] != shard for score, i in search.best(*wanted[q], k, floors[q])]
        q, i, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"nth": pa.array(q, pa.int64()), "doc": pa.array(i, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _bounds(wanted: list[tuple[np.ndarray, np.ndarray]]):
    def run(table: pa.Table) -> pa.Table:
        number, top = table["no"].to_numpy(), table["top"].to_numpy()
        own = np.zeros(int(max([number.max(initial=0), *(t.max(initial=0) for t, _ in wanted)])) + 1, np.int64)
        own[number] = top
        sums = np.array([int((own[t] * w).sum()) for t, w in wanted], np.int64)
        has = np.flatnonzero(sums > 0)
        return pa.table({"nth": has, "shard": np.full(len(has), table["shard"][0].as_py()), "bound": sums[has]})

    return run


def _terms(text: str | None) -> Counter:
    data = (text or "").encode()
    w = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), LETTERS)
    low = LETTERS[1][np.frombuffer(data, np.uint8)].tobytes()
    return Counter(low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, query: str = "item_id", text: str = "text", key: str = "doc_id") -> DataFrame:
    """query, rank from 1, key, score: the ``k`` documents of greatest score above zero for each query, ties to smaller ids.

    A query's terms count as often as they stand in it. Null and empty queries, and those none of whose terms is in a
    document, have no rows; rows with one query key are queries of their own if their texts differ. Queries are taken in
    blocks of about ``QUERY_CHARS`` characters: what the driver and the tasks hold of them has that bound (or one query). Other columns aren't read.
    """
    index, meta = spark.read.schema(INDEX).parquet(f"{path}/terms"), spark.read.parquet(f"{path}/meta").first()
    kind = queries.schema[query].dataType.simpleString()
    asked = stored(queries.select(F.col(query).alias("q"), F.col(text).cast("string").alias("t")).where("t is not null").distinct(), "queries")
    blocks = int((asked.agg(F.sum(F.length("t"))).first()[0] or 0) // QUERY_CHARS) + 1
    found = []
    for block in range(blocks):
        own = [(r["q"], _terms(r["t"])) for r in asked.where(F.pmod(F.xxhash64("q", "t"), F.lit(blocks)) == block).collect()]
        names = sorted({t for _, terms in own for t in terms})
        if not names or k < 1 or not meta["n_docs"]:
            continue
        number = {t: i for i, t in enumerate(names)}
        terms = spark.createDataFrame([(bytearray(t), i) for t, i in number.items()], "term binary, no int")
        used = stored(index.join(F.broadcast(terms), "term").select("shard", "no", "df", "top", "tree", "posts")
                      .unionByName(index.where("term is null").select("shard", F.lit(-1).alias("no"), "df", "top", "tree", "posts")), "postings")
        df = {r["no"]: r["df"] for r in used.where("no >= 0").groupBy("no").agg(F.sum("df").alias("df")).collect()}
        weights = np.array([weight(meta["n_docs"], df.get(i, 0)) for i in range(len(names))], np.int64)
        wanted = []
        for _, counts in own:
            at = np.array(sorted(number[t] for t in counts if number[t] in df), np.int64)
            wanted.append((at, weights[at] * np.array([counts[names[i]] for i in at], np.int64)))
        tops = used.where("no >= 0").select("shard", "no", "top").groupBy("shard").applyInArrow(_bounds(wanted), "nth long, shard long, bound long")
        # A row for each query of the block.
        best = {r["nth"]: r["at"]["shard"] for r in tops.groupBy("nth").agg(F.max(F.struct("bound", "shard")).alias("at")).collect()}
        only: dict[int, list[int]] = {}
        for q, shard in best.items():
            only.setdefault(shard, []).append(q)
        if not only:
            continue
        columns = used.select("shard", "no", "top", "tree", "posts")
        chosen = spark.createDataFrame([(s,) for s in only], "shard long")
        result = "nth long, doc long, score long"
        nothing = [0] * len(own)
        first = stored(columns.join(F.broadcast(chosen), "shard").groupBy("shard").applyInArrow(_searched(wanted, k, nothing, only, []), result), "first-found")
        floors = list(nothing)
        for r in first.groupBy("nth").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():
            floors[r["nth"]] = r["least"]
        rest = columns.groupBy("shard").applyInArrow(_searched(wanted, k, floors, None, [best.get(i) for i in range(len(own))]), result)
        keys = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(own)], f"nth long, _q {kind}")
        w = Window.partitionBy("nth").orderBy(F.desc("score"), "doc")
        ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(keys), "nth").select(F.col("_q").alias(query), "rank", F.col("doc").alias(key), "score"))
    if not found:
        return spark.createDataFrame([], f"{query} {kind}, rank int, {key} long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op13_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "max-trees")
    write_index(documents(spark, sf_dir), path)
    return search(spark, path, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
