"""Scores of texts by a hidden Markov language model.

Words are emitted by way of classes: the ``HEAD`` most frequent words are a class each, all others share ``TAIL`` classes
by hash, in which a word has the chance (c + 1/2) / (sum of the class + 1/2), the last half for words never seen; so the
tables that tasks get whole have a fixed size, and the counts of all words stay distributed. Baum-Welch sums its expected
counts over the partitions of all training texts; the scaled forward recursion gives the exact likelihood of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import BUCKETS, ENTRY, SHIFT, answer_bits, by_bucket, entry, groups, joined
from .shared import documents, stored
from .words import LOWER, bounds, mix, packed, signed, spans, texts, words_of

HEAD = 49_152
TAIL = BUCKETS
END = HEAD + TAIL
CLASSES = END + 1
STATES = 8
ITERATIONS = 4
#: Words after which training starts anew within a text; bounds memory. Scores don't use it.
SEGMENT = 1024
#: Pull of each state's emissions to the words' own frequencies, in words.
PULL = 2000.0
#: Classes in a row of expected counts.
STRIDE = 2048


@dataclass
class Model:
    start: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # by class, then state


@dataclass
class Counts:
    """What all tasks know of the corpus: the head's words and counts, the sums, and each class's share."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    share: np.ndarray
    #: Sum of (c + 1/2) over the words of each tail class, and 1/2.
    tail: np.ndarray

    @property
    def floor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


_WORD = np.dtype([("key", "<u8"), ("n", "<i8")])
_USE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("train", "u1")])
_ADDED = np.dtype([("doc", "<i8"), ("base", "<f8"), ("model", "<f8"), ("known", "<i8")])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = texts(batch.column(0))
        for lo, hi in spans(off, 1 << 23):
            u, n = np.unique(words_of(data, off[lo:hi + 1], LOWER).hash, return_counts=True)
            if len(u):
                r = np.zeros(len(u), _WORD)
                r["key"], r["n"] = u, n
                yield by_bucket(u, r)


def _summed(head: int):
    """Of a group: its most frequent words (kind 0), and words and distinct words of each bucket (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        x = joined(table, _WORD)
        x = x[np.argsort(x["key"], kind="stable")]
        b = bounds(x["key"])
        key, n = x["key"][b[:-1]], np.add.reduceat(x["n"], b[:-1])
        top = np.lexsort((key, -n))[:head]
        bucket = (key >> SHIFT).astype(np.int64)
        c = bounds(bucket)
        k0, k1 = len(top), len(c) - 1
        return pa.table({"kind": pa.array([0] * k0 + [1] * k1, pa.int32()), "key": np.concatenate([signed(key[top]), bucket[c[:-1]]]), "n": np.concatenate([n[top], np.add.reduceat(n, c[:-1])]), "distinct": np.concatenate([np.ones(k0, np.int64), np.diff(c)])})

    return run


def count_words(train: DataFrame) -> Counts:
    """Counts over all texts of ``train`` (column t). The driver gets the head and two sums for each of ``TAIL`` buckets."""
    n_docs = train.count()
    sent = stored(train.select("t").mapInArrow(_word_counts, ENTRY), "words")
    per_group = stored(groups(sent, _WORD).select("group", "body").groupBy("group").applyInArrow(_summed(HEAD), "kind int, key long, n long, distinct long"), "counts")
    top = per_group.where("kind = 0").orderBy(F.col("n").desc(), "key").limit(HEAD).select("key", "n").toPandas()
    sums = per_group.where("kind = 1").select("key", "n", "distinct").toPandas()
    key, n = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    share = np.zeros(CLASSES)
    share[: len(key)] = n
    at, own = sums["key"].to_numpy(np.int64), (key >> SHIFT).astype(np.int64)
    tail = np.maximum(0, np.bincount(at, sums["n"].to_numpy(float), TAIL) - np.bincount(own, n, TAIL))
    kinds = np.bincount(at, sums["distinct"].to_numpy(float), TAIL) - np.bincount(own, minlength=TAIL)
    share[HEAD:END] = tail + 0.5
    share[END] = n_docs + 0.5
    return Counts(key, n, int(sums["n"].sum()) + n_docs, int(sums["distinct"].sum()) + (n_docs > 0), share / share.sum(), tail + 0.5 * kinds + 0.5)


_CODED = ENTRY + ", head_log double, head_known long, held_out boolean"


def _coded(c: Counts, n_docs_log: float):
    """Classes of each text (kind 1), and what texts have of words outside the head, by bucket (kind 0)."""
    log = np.log10(c.counts + 0.5)
    names = [*(x.split()[0] for x in _CODED.split(", ")), "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            held = batch.column(2).to_numpy(zero_copy_only=False)
            data, off = texts(batch.column(1))
            for lo, hi in spans(off):
                w = words_of(data, off[lo:hi + 1], LOWER)
                h, doc = w.hash, w.doc()
                at = np.minimum(np.searchsorted(c.words, h), max(len(c.words) - 1, 0))
                known = c.words[at] == h if len(c.words) else np.zeros(len(h), bool)
                k = hi - lo
                cls = np.empty(len(h) + k, np.uint16)
                ends = w.first[1:] + np.arange(k)
                inner = np.ones(len(cls), bool)
                inner[ends] = False
                cls[inner] = np.where(known, at, HEAD + (h >> SHIFT).astype(np.int64))
                cls[ends] = END
                head_log = np.bincount(doc[known], log[at[known]] if len(c.words) else None, k) + n_docs_log
                head_known = np.bincount(doc[known], minlength=k)
                row = [*entry([1] * k, [0] * k, uid[lo:hi], w.counts + 1, packed(cls, w.first + np.arange(k + 1))).columns,
                       pa.array(head_log), pa.array(head_known), pa.array(held[lo:hi]), batch.column(3).slice(lo, k)]
                yield pa.record_batch(row, names)
                h, d = h[~known], doc[~known]
                if len(h):
                    order = np.lexsort((d, h))
                    h, d = h[order], d[order]
                    b = np.append(np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])), len(h))
                    r = np.zeros(len(b) - 1, _USE)
                    r["key"], r["doc"], r["n"], r["train"] = h[b[:-1]], uid[lo:hi][d[b[:-1]]], np.diff(b), ~held[lo:hi][d[b[:-1]]]
                    e = by_bucket(r["key"], r)
                    m = e.num_rows
                    yield pa.record_batch([*e.columns, pa.array(np.zeros(m)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, bool)), pa.nulls(m, batch.column(3).type)], names)

    return run


def _tail(whole: np.ndarray, bits: int):
    """Counts of a group's words, and what they add to each text's scores: packed by bucket of texts, so that few rows move however many texts there are."""
    whole = np.log10(whole)

    def run(table: pa.Table) -> pa.Table:
        x = joined(table, _USE)
        x = x[np.argsort(x["key"], kind="stable")]
        b = bounds(x["key"])
        size = np.diff(b)
        count = np.add.reduceat(x["n"].astype(np.int64) * x["train"], b[:-1])
        base = np.repeat(np.log10(count + 0.5), size)
        model = base - np.repeat(whole[(x["key"][b[:-1]] >> SHIFT).astype(np.int64)], size)
        known = np.repeat(count > 0, size)
        order = np.argsort(x["doc"], kind="stable")
        d = bounds(x["doc"][order])
        n = x["n"][order].astype(float)
        out = np.zeros(len(d) - 1, _ADDED)
        out["doc"] = x["doc"][order][d[:-1]]
        for name, v in (("base", base), ("model", model), ("known", known)):
            out[name] = np.add.reduceat(v[order] * n, d[:-1])
        return pa.Table.from_batches([by_bucket(mix(np.ascontiguousarray(out["doc"]).view(np.uint64)), out, bits=bits)])

    return run


def _per_text(table: pa.Table) -> pa.Table:
    """What all groups add to each text of a part."""
    x = joined(table, _ADDED)
    x = x[np.argsort(x["doc"], kind="stable")]
    b = bounds(x["doc"])
    add = lambda v: np.add.reduceat(v, b[:-1]) if len(v) else v
    return pa.table({"uid": x["doc"][b[:-1]], "base": add(x["base"]), "model": add(x["model"]), "known": add(x["known"])})


class _Layout:
    """Sequences side by side, longest first: step t of all that are longer than t stands together."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray):
        self.order = np.argsort(-lens, kind="stable")
        n = lens[self.order]
        begin = (np.cumsum(lens) - lens)[self.order]
        self.steps = int(n[0]) if len(n) else 0
        self.active = np.searchsorted(-n, -np.arange(self.steps), "left")
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        self.seq_at = np.cumsum(n) - n
        total = int(n.sum())
        step = np.arange(total) - np.repeat(self.seq_at, n)
        self.place = self.at[step] + np.repeat(np.arange(len(n)), n)
        self.ids = np.empty(total, np.int64)
        self.ids[self.place] = ids[step + np.repeat(begin, n)]


def _forward(m: Model, x: _Layout, start: np.ndarray, keep: bool):
    """Scales of each step (their logs sum to the log-likelihood), and the scaled forward vectors if kept."""
    scale = np.empty(len(x.ids))
    alphas = np.empty((len(x.ids), m.move.shape[0])) if keep else None
    a = start
    for t in range(x.steps):
        lo, hi = x.at[t], x.at[t + 1]
        e = m.emit[x.ids[lo:hi]]
        a = (a if t == 0 else a[: hi - lo] @ m.move) * e
        s = a.sum(axis=1)
        a /= s[:, None]
        scale[lo:hi] = s
        if keep:
            alphas[lo:hi] = a
    return scale, alphas


def log10_likelihood(m: Model, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each sequence of classes."""
    x = _Layout(ids, lens)
    scale, _ = _forward(m, x, np.broadcast_to(m.start, (len(lens), len(m.start))), False)
    out = np.empty(len(lens))
    out[x.order] = np.add.reduceat(np.log10(scale)[x.place], x.seq_at) if len(lens) else 0
    return out


def expected(m: Model, ids: np.ndarray, lens: np.ndarray, first: np.ndarray):
    """Expected counts of starts, later starts, moves and emissions, and the log-likelihood."""
    k = len(m.start)
    x = _Layout(ids, lens)
    first = first[x.order]
    scale, alpha = _forward(m, x, np.where(first[:, None], m.start, m.later), True)
    gamma = alpha
    move = np.zeros((k, k))
    beta = np.ones((0, k))
    for t in range(x.steps - 1, -1, -1):
        lo, hi = x.at[t], x.at[t + 1]
        if t + 1 < x.steps:
            n = x.active[t + 1]
            nxt = beta * m.emit[x.ids[hi:hi + n]] / scale[hi:hi + n, None]
            move += alpha[lo:lo + n].T @ nxt
            beta = np.concatenate([nxt @ m.move.T, np.ones((hi - lo - n, k))])
        else:
            beta = np.ones((hi - lo, k))
        gamma_t = alpha[lo:hi] * beta
        if t == 0:
            starts = gamma_t[first].sum(axis=0), gamma_t[~first].sum(axis=0)
        # alpha of this step is still needed by the step before it, which reads its own rows only
        alpha[lo:hi], held = gamma_t, None
        del held
    emit = np.stack([np.bincount(x.ids, gamma[:, j], len(m.emit)) for j in range(k)], axis=1)
    return starts[0], starts[1], move * m.move, emit, np.log10(scale).sum()


def _estep(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(m.start)
        small, emit, seen = np.zeros((k + 2) * k + 1), np.zeros((CLASSES, k)), False
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(0)]
            cut = [(p[i:i + SEGMENT], i == 0) for p in parts for i in range(0, len(p), SEGMENT)]
            lo = 0
            while lo < len(cut):
                hi, held = lo, 0
                while hi < len(cut) and held < 400_000:
                    held += len(cut[hi][0])
                    hi += 1
                own = cut[lo:hi]
                s0, s1, move, e, ll = expected(m, np.concatenate([x for x, _ in own]).astype(np.int64), np.array([len(x) for x, _ in own]), np.array([f for _, f in own]))
                small += np.concatenate([s0, s1, move.reshape(-1), [ll]])
                emit += e
                seen, lo = True, hi
        if seen:
            rows = [emit[i:i + STRIDE].astype(np.float32).tobytes() for i in range(0, CLASSES, STRIDE)]
            yield pa.record_batch([pa.array([-1, *range(len(rows))], pa.int32()), pa.array([small.astype(np.float64).tobytes(), *rows], pa.binary())], ["part", "body"])

    return run


def _add(table: pa.Table) -> pa.Table:
    kind = np.float64 if table["part"][0].as_py() < 0 else np.float32
    total = sum(np.frombuffer(x.as_buffer(), kind).astype(np.float64) for x in table["body"])
    if kind == np.float32:
        total = total.astype(np.float32)
    return pa.table({"part": table["part"].slice(0, 1), "body": pa.array([total.tobytes()], pa.binary()), "branch": table["branch"].slice(0, 1)})


def baum_welch(coded: DataFrame, share: np.ndarray, states: int = STATES, iterations: int = ITERATIONS, seed: int = 3) -> Model:
    """A model from all rows of ``coded`` (body: classes as 16-bit integers), whose expected counts are summed over all partitions in each iteration."""
    rng = np.random.default_rng(seed)
    noisy = share[:, None] * np.exp(rng.normal(0, 0.5, (len(share), states)))
    m = Model(np.full(states, 1 / states), np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), noisy / noisy.sum(axis=0))
    branches = max(2, int(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    for _ in range(iterations):
        # A tree: each branch sums what about as many tasks have sent as there are branches, then the branches are summed.
        sent = coded.select("body").mapInArrow(_estep(m), "part int, body binary").withColumn("branch", F.spark_partition_id() % branches)
        for keys in (["part", "branch"], ["part"]):
            sent = sent.groupBy(*keys).applyInArrow(_add, "part int, body binary, branch int")
        got = sent.collect()
        if not got:
            break
        by = {r["part"]: np.frombuffer(r["body"], np.float64 if r["part"] < 0 else np.float32).astype(np.float64) for r in got}
        small = by.pop(-1)
        emit = np.concatenate([by[i] for i in sorted(by)]).reshape(-1, states)
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        move = small[2 * states:-1].reshape(states, states)
        m = Model(norm(small[:states] + 1), norm(small[states:2 * states] + emit.sum(axis=0) * 1e-3 + 1), norm(move + 1), (emit + PULL * share[:, None]) / (emit.sum(axis=0) + PULL))
    return m


def _likelihood(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.array(batch.column(1).to_pylist(), np.int64)
            ends = np.cumsum(lens)
            lo = 0
            while lo < len(lens):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
                ids = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(2).slice(lo, hi - lo)])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(log10_likelihood(m, ids, lens[lo:hi]))], ["uid", "hmm"])
                lo = hi

    return run


def score(df: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row.

    Learns from rows whose crc32(key) mod 5 isn't 1 (a null key: learnt from). Null and empty texts are the end token
    alone; repeated rows are texts of their own; no rows: no result. Other columns are not read.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"),
                     F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 1, F.lit(False)).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = count_words(train)
    n_docs = train.count()
    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    coded = stored(numbered.select("uid", "t", "held_out", "k").mapInArrow(_coded(counts, float(np.log10(n_docs + 0.5))), f"{_CODED}, k {rows.schema['k'].dataType.simpleString()}"), "coded", partition_by="kind")
    own = coded.where("kind = 1")
    model = baum_welch(own.where(~F.col("held_out")), counts.share, states, iterations)
    hmm = own.select(F.col("doc_id").alias("uid"), "n", "body").mapInArrow(_likelihood(model), "uid long, hmm double")
    tail = groups(coded.where("kind = 0").select("bucket", "n", "body", "text"), _USE).select("group", "body").groupBy("group").applyInArrow(_tail(counts.tail, answer_bits(df.sparkSession)), ENTRY)
    tail = tail.select("bucket", "body").groupBy("bucket").applyInArrow(_per_text, "uid long, base double, model double, known long")
    texts_ = own.select(F.col("doc_id").alias("uid"), "n", "head_log", "head_known", "held_out", "k")
    all_ = texts_.join(hmm, "uid").join(tail, "uid", "left").fillna(0, ["base", "model", "known"])
    return all_.select(
        F.col("k").alias(key), "held_out", F.col("n").alias("n_tokens"), (F.col("head_known") + F.col("known") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("head_log") + F.col("base") - F.col("n") * F.lit(float(np.log10(counts.floor)))).alias("base_score"),
        (F.col("hmm") + F.col("model")).alias("score"))


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
