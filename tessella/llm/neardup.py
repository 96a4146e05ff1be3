"""Near-duplicate groups by b-bit MinHash.

1. Each document's set of word shingles gives ``HASHES`` minima. Their lowest two bits are packed into longs, bands of
   minima into keys. Documents with the very same set are one class from here on, known by its smallest id.
2. Classes that share a band's key are candidates. Each is paired with the smallest class of its bucket alone (a star).
3. A pair whose collision-corrected similarity, by bit counts of the packed signatures, is far below the threshold is
   dropped; the others are confirmed on the full sets, and linked classes get one label.
4. Buckets in which several labels are left are compared once more across labels; members of one label need no more
   pairs, as links within it can't change the groups. Small buckets give pairs that are confirmed like the stars. In
   larger ones, blocks of members with their full sets meet each other (but for those of the bucket's largest label among
   themselves), and only links that join two labels leave the task: a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored, with_group_extreme
from .words import LOWER, mix, ngrams, packed, spans, texts, words_of

SHINGLE = 5
ROWS = 4
BANDS = 24
HASHES = ROWS * BANDS
BITS = 2
#: Longs of a packed signature.
LONGS = HASHES * BITS // 64
#: Standard deviations below the threshold at which an estimate rules a pair out.
SIGMAS = 6.0
#: Classes of a bucket that may be paired as rows; classes, and shingles, of a block in larger ones.
SMALL, BLOCK, BLOCK_SHINGLES = 16, 2048, 2_000_000
_R = np.random.default_rng(5).integers(0, 2**63, (2, HASHES), dtype=np.uint64)
_XOR, _MUL = _R[0], _R[1] * np.uint64(2) + np.uint64(1)


def shingle_sets(w, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and where each document's begin. A shorter text is one shingle."""
    n = w.counts
    left = w.left()
    at = np.flatnonzero(left >= size)
    doc = w.doc()
    h = ngrams(w.hash, size)[at] if len(at) else np.empty(0, np.uint64)
    owner = doc[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        one = np.array([mix(np.bitwise_xor.accumulate(mix(w.hash[w.first[i]:w.first[i + 1]] + np.arange(1, n[i] + 1, dtype=np.uint64)))[-1:])[0] + np.uint64(n[i]) for i in short], np.uint64)
        h, owner = np.concatenate([h, one]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(n) + 1))


def minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``HASHES`` least values of each set; sets must not be empty."""
    out = np.empty((len(first) - 1, HASHES), np.uint64)
    step = 1 << 15
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step, "right")) - 1)
        part, at = h[first[lo]:first[hi]], first[lo:hi] - first[lo]
        for i in range(HASHES):
            out[lo:hi, i] = np.minimum.reduceat((part ^ _XOR[i]) * _MUL[i], at)
        lo = hi
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off):
                w = words_of(data, off[lo:hi + 1], LOWER)
                h, first = shingle_sets(w, size)
                n = np.diff(first)
                has = np.flatnonzero(n > 0)
                sums = np.zeros((2, len(n)), np.int64)
                bands, sig = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), LONGS), np.int64)
                if len(has):
                    starts = first[:-1][has]
                    sums[0, has] = np.add.reduceat(mix(h), starts).view(np.int64)
                    sums[1, has] = np.bitwise_xor.reduceat(mix(h + np.uint64(7)), starts).view(np.int64)
                    m = minima(h, np.append(starts, len(h)))
                    b = np.zeros((len(has), BANDS), np.uint64)
                    for r in range(ROWS):
                        b = mix(b * np.uint64(0x9E3779B97F4A7C15) + m[:, r::ROWS])
                    bands[has] = mix(b + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                    # The lowest bits of a product with an odd number depend on few bits: take them after mixing.
                    low = (mix(m) & np.uint64(3)).reshape(len(has), LONGS, 32)
                    sig[has] = (low << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
                flat = np.arange(len(n) + 1)
                as_lists = lambda x, k: pa.ListArray.from_arrays(pa.array((flat * k).astype(np.int32)), pa.array(x.reshape(-1)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), as_lists(bands, BANDS), as_lists(sig, LONGS)],
                                      ["doc_id", "n_shingles", "s0", "s1", "bands", "sig"])

    return run


def _estimate(a: str, b: str):
    """Similarity from the share of equal two-bit minima, corrected for those that are equal by chance (one in four)."""
    same = F.lit(HASHES)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        same = same - F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    return (same / F.lit(HASHES) - 0.25) / 0.75


def _floor(threshold: float) -> float:
    p = threshold + (1 - threshold) / 4
    return threshold - SIGMAS * (p * (1 - p) / HASHES) ** 0.5 / 0.75


def _confirm(size: int, num: int, den: int):
    """Pairs of texts whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (2, 3):
                data, off = texts(batch.column(c))
                parts, firsts, base = [], [np.zeros(1, np.int64)], 0
                for lo, hi in spans(off):
                    h, first = shingle_sets(words_of(data, off[lo:hi + 1], LOWER), size)
                    parts.append(h)
                    firsts.append(first[1:] + base)
                    base += len(h)
                sets.append((np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate(firsts)))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (h[f[i]:f[i + 1]] for h, f in sets)
                if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = den * both >= num * (len(a) + len(b) - both)
            yield pa.record_batch([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _linked(pairs: DataFrame, bodies: DataFrame, size: int, num: int, den: int) -> DataFrame:
    left = pairs.join(bodies.withColumnsRenamed({"doc_id": "a", "t": "ta"}), "a")
    both = left.join(bodies.withColumnsRenamed({"doc_id": "b", "t": "tb"}), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirm(size, num, den), "a long, b long")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (a, b).

    Each round hooks every label onto the smallest label beside it and then shortens paths; the rows stay distributed
    and each round is written to the shared folder. Rounds grow as the logarithm of the longest chain.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), name)
    label = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), name)
    while True:
        near = edges.join(label.withColumnsRenamed({"id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
        hooked = label.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        # What one member of a label has found holds for the label, and a label that has moved takes its members along.
        moved = hooked.groupBy(F.col("old").alias("was")).agg(F.min("new").alias("to")).where("to < was")
        step = hooked.join(moved, hooked["old"] == moved["was"], "left").select("id", "old", F.least("new", F.coalesce("to", "new")).alias("new"))
        hop = step.select(F.col("id").alias("at"), F.col("new").alias("beyond"))
        after = step.join(hop, step["new"] == hop["at"], "left").select("id", "old", F.least("new", F.coalesce("beyond", "new")).alias("component"))
        after = stored(after, name)
        changed = after.where("component <> old").limit(1).count()
        label = after.select("id", "component")
        if not changed:
            return label


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off):
                h, first = shingle_sets(words_of(data, off[lo:hi + 1], LOWER), size)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), packed(h, first)], ["id", "shingles"])

    return run


def _forest(num: int, den: int, floor: float):
    """Links between labels of two blocks of a bucket, as few as join all labels that they join."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, label = (table[c].to_numpy() for c in ("side", "id", "label"))
        sig = table["sig"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
        size = np.array([len(x) for x in sets])
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(one) and len(two):
            _, number = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate([number[at[j]:at[j + 1]] for j in two])
            starts = np.cumsum(size[two]) - size[two]
            mark = np.zeros(int(number.max()) + 1, np.int32)
            for i in one:
                far = label[two] != label[i]
                if not far.any():
                    continue
                x = sig[two] ^ sig[i]
                differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
                if not (far := far & (((HASHES - differ) / HASHES - 0.25) / 0.75 >= floor)).any():
                    continue
                own = number[at[i]:at[i + 1]]
                mark[own] = 1
                both = np.add.reduceat(mark[flat], starts)
                mark[own] = 0
                for j in two[far & (den * both >= num * (size[two] + size[i] - both))]:
                    if label[j] != label[i]:
                        out.append((ids[i], ids[j]))
                        label = np.where(label == label[j], label[i], label)
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(df: DataFrame, num: int = 80, den: int = 100, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row: documents are linked if ``den`` * intersection >= ``num`` * union of their shingle sets.

    Words are lower-cased (A-Z). A text with fewer words than a shingle is one shingle; null and empty texts have none
    and are linked with nothing. ``key`` must be unique for documents of different texts; repeated rows are in one
    group with themselves; a row with a null key is linked with nothing, kept, its component_id null. No rows: no result
    rows. Other columns are not read.

    A pair at the threshold 0.8 shares no band with a chance of 3e-6 (0.85: 2e-8) and is ruled out by its estimate with
    one of 1e-9; all pairs that are linked have been confirmed on full sets.
    """
    threshold = num / den
    bodies = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    signed = stored(bodies.mapInArrow(_signatures(size), "doc_id long, n_shingles long, s0 long, s1 long, bands array<long>, sig array<long>"), "signatures")
    some = signed.where("doc_id is not null and n_shingles > 0")
    member = stored(with_group_extreme(some.select("doc_id", "n_shingles", "s0", "s1"), ["n_shingles", "s0", "s1"], "doc_id", "class").select("doc_id", "class").distinct(), "classes")
    heads = stored(some.join(member.where("doc_id = class").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sig"), "heads")

    rows = heads.select("id", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    seats = stored(rows.join(buckets, "band"), "buckets")
    sigs = heads.select("id", "sig", "n_shingles")
    stars = seats.where("id <> head").select("head", "id").distinct()
    rated = (stars.join(sigs, "id").join(sigs.withColumnsRenamed({"id": "head", "sig": "head_sig", "n_shingles": "head_n"}), "head")
             .where(F.least("n_shingles", "head_n") * den >= F.greatest("n_shingles", "head_n") * num)
             .where(_estimate("sig", "head_sig") >= _floor(threshold)).select(F.col("head").alias("a"), F.col("id").alias("b")))
    links = stored(_linked(rated, bodies, size, num, den), "links")
    label = components(links)

    named = seats.join(label, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("label"))
    mixed = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    rest = stored(named.join(mixed, "band").join(sigs, "id"), "open")
    small = rest.where(F.col("n") <= SMALL).select("band", "id", "label", "sig", "n_shingles")
    other = small.withColumnsRenamed({"id": "b", "label": "b_label", "sig": "b_sig", "n_shingles": "b_n"})
    few = (small.join(other, "band").where((F.col("id") < F.col("b")) & (F.col("label") != F.col("b_label")))
           .where(F.least("n_shingles", "b_n") * den >= F.greatest("n_shingles", "b_n") * num)
           .where(_estimate("sig", "b_sig") >= _floor(threshold)).select(F.col("id").alias("a"), "b").distinct())
    large = rest.where(F.col("n") > SMALL)
    # The members of a bucket's largest label need not meet one another: their sets go out once for each block of the others,
    # of which there are few, and only the others meet all blocks. Others have the blocks 0..ks-1, the largest label ks..ks+kb-1.
    of_label = large.groupBy("band", "label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    many = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("long")
    blocks = (of_label.groupBy("band").agg(F.max(F.struct("m", "label", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
              .select("band", F.col("top.label").alias("largest"), many(F.col("top.m"), F.col("top.s")).alias("kb"), many(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("ks")))
    sets = stored(bodies.join(large.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets(size), "id long, shingles binary"), "sets")
    inner = F.col("label") == F.col("largest")
    dealt = (large.join(blocks, "band").withColumn("block", F.when(inner, F.col("ks") + F.pmod(F.xxhash64("id"), F.col("kb"))).otherwise(F.pmod(F.xxhash64("id"), F.col("ks"))))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inner, F.col("ks")).otherwise(F.col("ks") + F.col("kb")) - 1))))
    sides = dealt.select("band", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "id", "label", "sig",
                         F.explode(F.when(F.col("block") == F.col("other"), F.array(F.lit(0), F.lit(1))).when(F.col("block") < F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))).alias("side"))
    forest = sides.join(sets, "id").groupBy("band", "b0", "b1").applyInArrow(_forest(num, den, _floor(threshold)), "a long, b long")
    links = links.unionByName(stored(_linked(few, bodies, size, num, den).unionByName(forest), "links"))
    label = components(links)

    grouped = member.join(label, member["class"] == label["id"], "left").select("doc_id", F.coalesce("component", "class").alias("component_id")).withColumnRenamed("doc_id", "_d")
    out = signed.select("doc_id", "n_shingles").join(grouped, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), num=85, den=100)
