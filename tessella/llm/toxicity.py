"""Toxic passages by maximum-scoring segments.

Training counts, over the distinct labelled texts, in how many toxic and other texts each word, and each begin of words
(``HEAD`` bytes: stems of compounds and inflected words), stands. A word's score is its log-odds under Dirichlet priors
drawn from all of them, or else those of its begin; where neither is significant it is a small negative number, so that
a segment must earn its length. A linear-time scan finds all maximal segments of a text. Their scores are calibrated by the
extreme-value law of the best segment of a random text (E = K n exp(-lambda S)); lambda is the root of the score's moment
equation, K the estimate of greatest likelihood on the training texts that aren't toxic. All significant passages of a text
are aggregated by the law of the sum of the r best; a rising curve, fitted to counts of all training texts,
turns that value into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored
from .words import LETTERS, signed, spans, texts, words_of

#: Labelled documents to learn from, about: of more, a sample by hash of the id. Their ids and labels are broadcast.
LABELLED = 100_000
#: Least |z| of a word's log-odds.
SIGNIFICANT = 3.0
#: Pseudo-texts of the priors: shared out by how often a word stands in texts at all, and for each word.
PRIOR, FLAT = 50.0, 0.5
#: Bytes of a word's begin.
HEAD = 5
#: Score of words outside the lexicon, and the least score of one inside.
DRIFT = -0.25
LEAST = -2.0
#: Passages with less expected matches by chance are significant.
E_VALUE = 1e-3
#: Bins of the calibration's input.
BINS, LOW, HIGH = 240, -20.0, 40.0


@dataclass
class Model:
    """Lexicon (sorted word hashes and scores), extreme-value parameters and the rising curve's corners."""

    words: np.ndarray
    scores: np.ndarray
    lam: float
    k: float
    curve_x: np.ndarray = field(default_factory=lambda: np.array([LOW]))
    curve_p: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, words) -> np.ndarray:
        out = np.full(len(words.hash), DRIFT)
        for hashes in (words.head, words.hash) if len(self.words) else ():
            near = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, hashes[near]), len(self.words) - 1)
            ok = self.words[at] == hashes[near]
            out[near[ok]] = self.scores[at[ok]]
        return out

    def value(self, scores: list[float], n: int) -> float:
        """-ln of the chance of a text's passages (their scores, and the words of the text): large if chance doesn't bring them about.

        With x = lambda S - ln(K n), the best alone has the chance exp(-x); the r best, whose x sum up to T, have about
        exp(-T) T^(r-1) / (r! (r-1)!). The least over all r counts, each r at half the weight of the one before it.
        Only passages of a positive x come in beside the best. Without any: ``LOW``.
        """
        if not scores:
            return LOW
        x = self.lam * np.sort(scores)[::-1] - np.log(max(self.k, 1e-12) * max(n, 1))
        best = x[0]
        x = x[x >= -np.log(E_VALUE)]
        if len(x) > 1:
            r = np.arange(1, len(x) + 1)
            total, steps = np.cumsum(x), np.cumsum(np.log(r))
            best = max(best, float((total + steps + (steps - np.log(r)) - (r - 1) * (np.log(np.maximum(total, 1)) + np.log(2))).max()))
        return float(np.clip(best, LOW, HIGH))

    def probability(self, value: np.ndarray) -> np.ndarray:
        tilt = (value - LOW) / (HIGH - LOW)  # keeps apart what the curve holds equal
        return np.clip(np.interp(value, self.curve_x, self.curve_p) + 1e-6 * (tilt - 0.5), 0.0, 1.0)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), in linear time: no segment of them can gain by growing or shrinking, and they are disjoint.

    Only positive scores take part one by one; sums of those between come from one cumulative sum.
    """
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    c = np.concatenate([[0.0], np.cumsum(score)])
    out: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    link: list[int] = []  # the nearest one to the left with a smaller sum before
    for i in at.tolist():
        b, e, lo, hi = i, i + 1, float(c[i]), float(c[i + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= lo:
                j = link[j]
            if j < 0 or out[j][3] >= hi:
                out.append((b, e, lo, hi))
                link.append(j)
                break
            b, lo = out[j][0], out[j][2]
            del out[j:], link[j:]
    return [(b, e, hi - lo) for b, e, lo, hi in out]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in which each word stands, by label; the row of word 0 counts the texts."""
    for batch in batches:
        data, off = texts(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in spans(off, 1 << 22):
            w = words_of(data, off[lo:hi + 1], LETTERS, HEAD)
            h, d = np.concatenate([w.hash, w.head]), np.tile(w.doc(), 2)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
            h, t = h[once], toxic[lo:hi][d[once]]
            u, which = np.unique(h, return_inverse=True)
            yield pa.record_batch(
                [pa.array(np.append(signed(u), 0)), pa.array(np.append(np.bincount(which, t, len(u)), toxic[lo:hi].sum()).astype(np.int64)),
                 pa.array(np.append(np.bincount(which, minlength=len(u)), hi - lo).astype(np.int64))], ["word", "y", "n"])


def _judged(model: Model, words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The value, the best segment's score, the number of significant passages, and the number of words of each text."""
    s = model.of(words)
    first = words.first
    n = np.diff(first)
    value, best, many = np.full(len(n), LOW), np.zeros(len(n)), np.zeros(len(n), np.int64)
    has = np.unique(np.searchsorted(first, np.flatnonzero(s > 0), "right") - 1)
    for i in has.tolist():
        scores = [x[2] for x in segments(s[first[i]:first[i + 1]])]
        value[i], best[i] = model.value(scores, int(n[i])), max(scores)
        many[i] = sum(model.k * n[i] * np.exp(-model.lam * x) <= E_VALUE for x in scores)
    return value, best, many, n


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off):
                value, best, many, n = _judged(model, words_of(data, off[lo:hi + 1], LETTERS, HEAD))
                p = model.probability(value)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(value), pa.array(best), pa.array(many), pa.array(n)],
                                      ["_key", "score", "predicted", "value", "best", "n_passages", "n_words"])

    return run


def train(labelled: DataFrame, text: str = "text", label: str = "label") -> Model:
    """A model from rows (text, label 0/1; others are left out). Equal texts count once, toxic if any is.

    The driver sees the lexicon (significant words of the texts learnt from, of which ``labelled_documents`` bounds the number), sums, and ``BINS`` counts. Without both labels every score is the
    share of label 1 (0 without rows).
    """
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    rows = stored(rows.groupBy(F.xxhash64("t").alias("h"), F.crc32("t").alias("c")).agg(F.first("t").alias("t"), F.max("y").alias("y")).select("t", "y"), "labelled")
    counts = stored(rows.mapInArrow(_presence, "word long, y long, n long").groupBy("word").agg(F.sum("y").alias("y"), F.sum("n").alias("n")), "presence")
    total = counts.where("word = 0").first()
    n1, n = (int(total["y"]), int(total["n"])) if total else (0, 0)
    n0 = n - n1
    if not n1 or not n0:
        return Model(np.empty(0, np.uint64), np.empty(0), 1.0, 1.0, np.array([LOW]), np.array([n1 / n if n else 0.0]))
    y, m = F.col("y"), F.col("n")
    share = m / F.lit(float(n))
    a1 = y + share * PRIOR + FLAT
    a0 = m - y + share * PRIOR + FLAT
    odds = F.log(a1 / (n1 + PRIOR + 1 - a1)) - F.log(a0 / (n0 + PRIOR + 1 - a0))
    words = (counts.where("word <> 0").withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / a1 + 1 / a0))
             .where(F.abs("z") >= SIGNIFICANT)
             .select("word", "odds", "y", "n").toPandas())
    h = words["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    score = np.maximum(words["odds"].to_numpy(float), LEAST)[order]
    score = np.where((score < 0) & (score > DRIFT), DRIFT, score)
    # Chance of each score in a text that isn't toxic: a word's share of the words of such texts, never quite none.
    p = ((words["n"] - words["y"]).to_numpy(float)[order] + 0.5)
    all_words = float(counts.where("word <> 0").agg(F.sum(F.col("n") - F.col("y"))).first()[0] or 0) + 0.5 * len(p)
    lam = _lambda(score, p / all_words)
    model = Model(h[order], score, lam, 1.0)
    model.k = _k(model, rows)
    binned = (rows.select(F.lit(0).cast("long").alias("k"), "t", "y").mapInArrow(_values(model), "y int, bin int").groupBy("y", "bin").count().collect())
    model.curve_x, model.curve_p = _rising(binned)
    return model


def _values(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off):
                v = _judged(model, words_of(data, off[lo:hi + 1], LETTERS, HEAD))[0]
                yield pa.record_batch([batch.column(2).slice(lo, hi - lo), pa.array(((v - LOW) / (HIGH - LOW) * BINS).astype(np.int32))], ["y", "bin"])

    return run


def _lambda(score: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    rest = max(0.0, 1 - p.sum())
    f = lambda x: float((p * np.exp(np.minimum(x * score, 600))).sum() + rest * np.exp(x * DRIFT) - 1)
    lo, hi = 1e-3, 20.0
    if not (score > 0).any() or f(hi) < 0 or f(lo) > 0:
        return 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _k(model: Model, rows: DataFrame) -> float:
    """K of greatest likelihood from the texts that aren't toxic: with a best score S among n words, P(S <= x) = exp(-K n exp(-lambda x)), so K is the number of texts over the sum of n exp(-lambda S)."""
    r = (rows.where("y = 0").select(F.lit(0).cast("long").alias("k"), "t").mapInArrow(_scored(model), "_key long, score double, predicted int, value double, best double, n_passages long, n_words long")
         .where("n_words > 0").agg(F.count("*"), F.sum(F.col("n_words") * F.exp(-F.lit(model.lam) * F.col("best")))).first())
    return best_k(r[0], r[1] or 0.0)


def best_k(texts_: int, total: float) -> float:
    return (texts_ + 1.0) / (total + 1.0)


def _rising(binned) -> tuple[np.ndarray, np.ndarray]:
    """The closest rising curve to the bins' shares of label 1 (pool adjacent violators): level within a pool, a straight line between two."""
    counts = np.zeros((2, BINS + 1))
    for r in binned:
        counts[r["y"], r["bin"]] += r["count"]
    pools: list[list[float]] = []  # label 1, all, first and last bin
    for i in np.flatnonzero(counts.sum(axis=0)).tolist():
        pools.append([counts[1, i], counts[:, i].sum(), i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            y, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2], last]
    x = np.array([LOW + (i + 0.5) * (HIGH - LOW) / BINS for *_, i, j in pools for i in (i, j)])
    return x, np.array([(y + 0.1) / (n + 0.2) for y, n, *_ in pools for _ in range(2)])


def score_texts(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score, predicted, value, best, n_passages and n_words of each text. Null and empty texts get the score of a text without any toxic word; repeated rows and null keys are rows like others."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").cast("binary").alias("t"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"_key {kind}, score double, predicted int, value double, best double, n_passages long, n_words long").withColumnRenamed("_key", key)


def passages(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", e_value: float = E_VALUE) -> DataFrame:
    """Every passage with ``e_value`` matches by chance at most: key, begin and end (bytes of the text), passage, score, e_value."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").cast("binary").alias("t"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off):
                w = words_of(data, off[lo:hi + 1], LETTERS, HEAD)
                s = model.of(w)
                out = []
                for i in range(hi - lo):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    for x, y, v in segments(s[a:b]):
                        e = model.k * (b - a) * np.exp(-model.lam * v)
                        if e <= e_value:
                            p, q = int(w.start[a + x]), int(w.end[a + y - 1])
                            out.append((lo + i, p, q, data[off[lo + i] + p:off[lo + i] + q].tobytes().decode(), float(v), float(e)))
                if out:
                    c = list(zip(*out, strict=True))
                    yield pa.record_batch([batch.column(0).take(pa.array(c[0])), pa.array(c[1]), pa.array(c[2]), pa.array(c[3]), pa.array(c[4]), pa.array(c[5])], ["_key", "begin", "end", "passage", "score", "e_value"])

    return rows.mapInArrow(run, f"_key {kind}, begin long, end long, passage string, score double, e_value double").withColumnRenamed("_key", key)


def labelled_documents(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """text and label of the documents that may be learnt from; a document with several labels has the highest.

    Of more than ``most`` labelled ids, about so many are taken by a hash of the id, so what is broadcast has a fixed
    size and no text moves before it is known to be learnt from.
    """
    may = lambda key: F.crc32(F.col(key).cast("string")) % 5 != 0
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("label")).where(may("_id") & F.col("label").isNotNull()).groupBy("_id").agg(F.max("label").alias("label"))
    n = own.count()
    if n > most:
        own = own.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    mine = docs.select("doc_id", "text").where(may("doc_id"))
    return mine.join(F.broadcast(own), mine["doc_id"] == own["_id"]).select("text", "label")


def op7_max_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score_texts(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.col("best").alias("best_segment"), "n_passages")
