"""Nearest neighbours by inner product from balanced posting lists.

The index has centroids, fitted by balanced k-means to a bounded sample, and a posting list for each. Every vector goes
to its nearest list and, near a boundary, to others whose centroid isn't much farther (closure replication). A query
walks a small neighbour graph of the centroids in memory, takes all lists whose distance is within a ratio of the
second nearest's (however many), and compares itself exactly with what is in them. Vectors get one more dimension, sqrt(max norm² - norm²),
so that the nearest in Euclidean distance has the largest inner product.

The ratio isn't guessed: a bounded set of queries is searched by brute force over all rows, and the ratio is the least with
which so many of their neighbours as ``recall`` asks for lie in the lists taken. Vectors without structure then need most lists, structured ones few. ``recall=1.0`` takes every list: the exact search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, tasks_for
from .words import bounds, mix

#: Rows to which centroids are fitted, at least and for each list: those with the least seeded hashes.
SAMPLE, PER_CENTROID = 20_000, 16
#: Vectors of a list, about, and most lists; beyond it lists grow and are searched by parts.
PER_LIST, MOST_LISTS = 400, 4096
#: A vector is also put in lists up to so many times as far as its nearest (in distance), at most in ``COPIES`` lists.
BOUNDARY, COPIES = 1.15, 4
#: Share of the true neighbours that the ratio must reach, on so many queries searched by brute force.
RECALL, MEASURED = 0.97, 300
#: Least number of lists of a query.
FEWEST = 4
#: Neighbours of a centroid in the graph (and those whose neighbour it is), and the least width of a walk.
DEGREE, WIDTH = 24, 128
#: Bytes of vectors (in double precision), and queries, that are searched by one task at once.
PART_BYTES, PART_QUERIES = 32 << 20, 20_000


@dataclass
class Centroids:
    at: np.ndarray
    links: list[np.ndarray]
    starts: np.ndarray
    peak: float

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.peak - (x * x).sum(axis=1), 0))
        return np.concatenate([x, more[:, None]], axis=1)

    def walk(self, q: np.ndarray, ratio: float, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near ``q`` and their distances, nearest first: best-first search over the graph, until all that is left is beyond both the ``width`` nearest and ``ratio`` times the second nearest's distance."""
        d = np.full(len(self.at), np.inf)
        d[self.starts] = ((self.at[self.starts] - q) ** 2).sum(axis=1)
        todo = list(zip(d[self.starts].tolist(), self.starts.tolist(), strict=True))
        heapq.heapify(todo)
        best = [-x for x in heapq.nsmallest(width, d[self.starts].tolist())]
        heapq.heapify(best)
        low, far = sorted(d[self.starts].tolist())[:2], ratio * ratio
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= width and x > max(-best[0], far * low[-1]):
                break
            near = self.links[i][np.isinf(d[self.links[i]])]
            d[near] = ((self.at[near] - q) ** 2).sum(axis=1)
            for y, j in zip(d[near].tolist(), near.tolist(), strict=True):
                if len(best) < width or y < -best[0] or y <= far * low[-1]:
                    heapq.heappush(todo, (y, j))
                    heapq.heappush(best, -y)
                    if len(best) > width:
                        heapq.heappop(best)
                    low = sorted([*low, y])[:2]
        met = np.flatnonzero(np.isfinite(d))
        met = met[np.argsort(d[met], kind="stable")]
        return met, np.sqrt(d[met])


def _graph(d: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each centroid's ``DEGREE`` nearest and those it is one of the nearest of, so that none is out of reach; starts lie in each part of the graph."""
    n = len(d)
    to = np.argsort(d, axis=1)[:, : min(DEGREE, n - 1)]
    pairs = np.stack([np.repeat(np.arange(n), to.shape[1]), to.ravel()])
    pairs = np.unique(np.concatenate([pairs, pairs[::-1]], axis=1), axis=1)
    links = np.split(pairs[1], np.searchsorted(pairs[0], np.arange(1, n)))
    reached, parts = np.zeros(n, bool), []
    for i in range(n):
        if not reached[i]:
            parts.append(i)
            reached[i], todo = True, [i]
            while todo:
                new = links[(at := todo.pop())][~reached[links[at]]]
                reached[new] = True
                todo += new.tolist()
    return links, np.unique(np.concatenate([np.linspace(0, n - 1, min(16, n)).astype(int), parts]))


def fit(sample: np.ndarray, lists: int, peak: float, rounds: int = 12) -> Centroids:
    """Balanced k-means: a list that has more than its share looks farther away, so that vectors at its edge go elsewhere."""
    c = Centroids(np.empty((0, 0)), [], np.empty(0, int), peak)
    x = c.lifted(sample)
    lists = max(1, min(lists, len(x)))
    rng = np.random.default_rng(11)
    at = x[rng.choice(len(x), lists, replace=False)]
    extra = np.zeros(lists)
    for _ in range(rounds):
        own = np.concatenate([np.argmin((at * at).sum(axis=1) + extra - 2 * x[i:i + 2048] @ at.T, axis=1) for i in range(0, len(x), 2048)])
        n = np.bincount(own, minlength=lists)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), lists)])
        spread = max(float(((x - at[own]) ** 2).sum(axis=1).mean()), 1e-12)
        extra = np.maximum(0, extra + 0.2 * spread * (n * lists / len(x) - 1))
    d = (at * at).sum(axis=1)[None] + (at * at).sum(axis=1)[:, None] - 2 * at @ at.T
    np.fill_diagonal(d, np.inf)
    return Centroids(at, *_graph(d), peak)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _assign(c: Centroids, dim: int):
    """Each vector's lists; the first is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = c.lifted(_vectors(batch.column(1), dim))
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c.at * c.at).sum(axis=1)[None] - 2 * x @ c.at.T, 0))
            k = min(COPIES, d.shape[1])
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            dn = np.take_along_axis(d, near, 1)
            order = np.argsort(dn, axis=1)
            near, dn = np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)
            row, col = np.nonzero(dn <= BOUNDARY * dn[:, :1])
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(near[row, col].astype(np.int32)), batch.column(1).take(pa.array(row))], ["vec_id", "list", "vec"])

    return run


def _route(c: Centroids, dim: int, ratio: float, block: np.ndarray, parts: np.ndarray):
    """The lists that each query takes, by block of lists (and by each part of a block that has several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, to, lists = [], [], []
            if batch.num_rows:
                for i, q in enumerate(c.lifted(_unit(_vectors(batch.column(1), dim)) * np.sqrt(c.peak), True)):
                    at, d = c.walk(q, ratio)
                    at = at[: max(int((d <= ratio * d[:2][-1]).sum()), FEWEST)]
                    at = at[np.argsort(block[at], kind="stable")]
                    b = bounds(block[at])
                    for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
                        for part in range(parts[block[at[x]]]):
                            row.append(i)
                            to.append((int(block[at[x]]) << 24) + part)
                            lists.append(at[x:y].astype(np.int32))
            take = pa.array(row, pa.int64())
            yield pa.record_batch([batch.column(0).take(take), pa.array(to, pa.int64()), pa.array(lists, pa.list_(pa.int32())), batch.column(1).take(take)], ["query_id", "block", "lists", "q"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _dots(q: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of pairs. The order of sums is the same for all pairs, so equal vectors have equal scores."""
    return np.concatenate([np.einsum("ij,ij->i", q[row[i:i + 50_000]], v[col[i:i + 50_000]]) for i in range(0, len(row), 50_000)] or [np.empty(0)])


def _close(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among the best ``k`` of their query: all that aren't clearly below the k-th."""
    rows, cols = [], []
    for lo in range(0, len(q), 256):
        s = q[lo:lo + 256] @ v.T
        if len(v) > k:
            least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k]
            near = s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        else:
            near = np.ones(s.shape, bool)
        r, c = np.nonzero(near)
        rows.append(r + lo)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _best(queries: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are the best ``k`` of their query: largest score, then smaller id; a pair that repeats counts once."""
    order = np.lexsort((ids, -score, queries))
    once = np.concatenate([[True], (queries[order][1:] != queries[order][:-1]) | (ids[order][1:] != ids[order][:-1])]) if len(order) else np.empty(0, bool)
    order = order[once]
    b = bounds(queries[order])
    return order[np.arange(len(order)) - np.repeat(b[:-1], np.diff(b)) < k]


def _search(k: int, dim: int):
    """The best ``k`` of a block's lists for each query that takes any. Equal vectors of a list are compared once; their ids stand for them."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        queries, vectors = queries.combine_chunks(), vectors.combine_chunks()
        q, v = (_vectors(x.combine_chunks(), dim) for x in (queries["q"], vectors["vec"]))
        qid, ids, own = (x.to_numpy() for x in (queries["query_id"], vectors["vec_id"], vectors["list"]))
        taken = queries["lists"].combine_chunks()
        asker, asked = np.repeat(np.arange(len(q)), np.diff(taken.offsets.to_numpy())), taken.flatten().to_numpy()
        by = np.argsort(asked, kind="stable")
        asker, asked = asker[by], asked[by]
        h = mix(v.view(np.uint64) * np.arange(3, 2 * dim + 3, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        order = np.lexsort((ids, h, own))
        v, ids, own, h = v[order], ids[order], own[order], h[order]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])
        new[1:] |= (v[1:] != v[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        copies = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
        row, col = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        b = bounds(own[first])
        for lo, hi in zip(b[:-1].tolist(), b[1:].tolist(), strict=True):
            x, y = np.searchsorted(asked, own[first[lo]]), np.searchsorted(asked, own[first[lo]], "right")
            if x < y:
                r, c = _close(q[asker[x:y]], v[first[lo:hi]], k + 1)
                row.append(asker[x:y][r])
                col.append(c + lo)
        row, col = np.concatenate(row), np.concatenate(col)
        score = _dots(q, v, row, first[col])
        n = copies[col]
        at = np.repeat(first[col] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        row, score = np.repeat(row, n), np.repeat(score, n)
        other = ids[at] != qid[row]
        row, at, score = row[other], at[other], score[other]
        keep = _best(row, ids[at], score, k)
        return pa.table({"query_id": qid[row[keep]], "vec_id": ids[at[keep]], "score": score[keep]})

    return run


def _brute(q: np.ndarray, qid: np.ndarray, k: int, dim: int):
    """The best ``k`` of each batch for each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column(0).to_numpy(), _vectors(batch.column(1), dim)
                for lo in range(0, len(v), 4096):
                    row, col = _close(q, v[lo:lo + 4096], k + 1)
                    other = ids[lo + col] != qid[row]
                    row, col = row[other], col[other]
                    score = _dots(q, v[lo:], row, col)
                    keep = _best(row, ids[lo + col], score, k)
                    row, col = row[keep], col[keep] + lo
                    yield pa.record_batch([pa.array(row), batch.column(0).take(pa.array(col)), pa.array(score[keep])], ["q", "vec_id", "score"])

    return run


def exact(rows: DataFrame, q: np.ndarray, qid: np.ndarray, k: int, dim: int) -> DataFrame:
    """q (number), vec_id: the ``k`` nearest of a few queries among all rows (vec_id, vec), by brute force."""
    found = rows.select("vec_id", "vec").mapInArrow(_brute(q, qid, k, dim), "q long, vec_id long, score double")
    best = found.groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("all"))
    return best.select("q", F.explode(F.slice(F.array_sort("all"), 1, k)).alias("x")).select("q", "x.vec_id")


def needed_ratio(c: Centroids, q: np.ndarray, found: dict[int, list[list[int]]], recall: float) -> float:
    """The least ratio with which queries ``q`` take a list of so many of their neighbours as ``recall`` asks for; ``found`` has each one's neighbours' lists."""
    need = []
    for i, x in enumerate(c.lifted(_unit(q) * np.sqrt(c.peak), True)):
        d = np.sqrt(((c.at - x) ** 2).sum(axis=1))
        second = max(float(np.sort(d)[:2][-1]), 1e-12)
        need += [float(d[lists].min()) / second for lists in found.get(i, [])]
    return float(np.quantile(need, recall, method="higher")) * (1 + 1e-9) if need else 1.0


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec of the rows that take part: no null, zero or non-finite vector, nor one of another length than most have."""
    ok = F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)")
    rows = df.where(ok & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec"))
    return rows


def search(df: DataFrame, queries, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest found of each row that ``queries`` (a condition on vec_id) selects, among all other rows: query_id, rank, vec_id, score.

    Score is the inner product in double precision on the vectors as given; ties go to the smaller id. Vectors that are
    null, zero or hold null or non-finite components take no part, nor those of another dimension than the most frequent;
    ids should be unique, a repeated one is one row (the greatest vector). No rows: no result. Lists are searched in
    blocks of ``PART_BYTES``; a list that is larger is dealt to several parts, and many queries of a block to several tasks.
    """
    spark = df.sparkSession
    every = usable(df, key, vector)
    dims = every.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0]["d"]
    rows = stored(every.where(F.size("vec") == dim).groupBy("vec_id").agg(F.max("vec").alias("vec")), "vectors")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, peak = rows.agg(F.count("*"), F.max(norm)).first()
    lists = min(MOST_LISTS, max(1, n // PER_LIST))
    take = lambda frame, m: np.array([r["vec"] for r in frame.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).select("vec").collect()], np.float64).reshape(-1, dim)
    c = fit(take(rows, max(SAMPLE, PER_CENTROID * lists)), lists, float(peak))
    kind = rows.schema["vec"].dataType.simpleString()
    postings = stored(rows.mapInArrow(_assign(c, dim), f"vec_id long, list int, vec {kind}"), "postings")
    asked = rows.where(queries)

    ratio = float("inf")
    if recall < 1:
        some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).collect()
        q, qid = np.array([r["vec"] for r in some], np.float64).reshape(-1, dim), np.array([r["vec_id"] for r in some], np.int64)
        near = exact(rows, q, qid, k, dim)
        held: dict[int, list[list[int]]] = {}
        # MEASURED times k rows, each with COPIES lists at most.
        for r in postings.select("vec_id", "list").join(F.broadcast(near), "vec_id").groupBy("q", "vec_id").agg(F.collect_set("list").alias("lists")).collect():
            held.setdefault(r["q"], []).append(r["lists"])
        ratio = needed_ratio(c, q, held, recall)

    # Lists side by side along the centroids' main axis make a block; one beyond the bound is a block of several parts.
    size = np.zeros(len(c.at), np.int64)
    for r in postings.groupBy("list").count().collect():
        size[r["list"]] = r["count"]
    most = max(1, min(PART_BYTES // (8 * dim), -(-int(size.sum()) // tasks_for(spark, 1, 1))))
    axis = np.argsort((c.at - c.at.mean(axis=0)) @ np.linalg.svd(c.at - c.at.mean(axis=0), full_matrices=False)[2][0], kind="stable")
    block, now, held_now = np.zeros(len(size), np.int64), 0, 0
    for i in axis.tolist():
        if held_now and held_now + size[i] > most:
            now, held_now = now + 1, 0
        block[i], held_now = now, held_now + size[i]
    whole = np.bincount(block, size, now + 1)
    parts = np.maximum(1, -(-whole // max(most * 2, PART_BYTES // (8 * dim)))).astype(np.int64)
    routed = stored(asked.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q")).mapInArrow(_route(c, dim, ratio, block, parts), f"query_id long, block long, lists array<int>, q {kind}"), "routed")
    crowds = {r["block"]: -(-r["count"] // PART_QUERIES) for r in routed.groupBy("block").count().collect()}
    crowd = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for b, m in crowds.items() if m > 1 for x in (b, m)]), F.col("block")), F.lit(1)) if max(crowds.values(), default=1) > 1 else F.lit(1).cast("long")
    of = F.element_at(F.array(*[F.lit(int(x)) for x in block]), F.col("list") + 1).cast("long")
    per = F.element_at(F.array(*[F.lit(int(x)) for x in parts[block]]), F.col("list") + 1)
    dealt = postings.withColumn("block", F.shiftleft(of, 24) + F.pmod(F.xxhash64("vec_id"), per)).withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), crowd.cast("long") - 1)))
    routed = routed.withColumn("crowd", F.pmod(F.xxhash64("query_id"), crowd.cast("long")))
    found = routed.groupBy("block", "crowd").cogroup(dealt.groupBy("block", "crowd")).applyInArrow(_search(k, dim), "query_id long, vec_id long, score double")
    # A query has at most k rows from each block; a vector that two blocks hold has the same score in both.
    best = found.groupBy("query_id").agg(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("all"))
    return best.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("r", "x")).select(
        "query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op6_posting_list_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
