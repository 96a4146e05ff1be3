"""Near-duplicate groups by SimHash: all pairs of fingerprints at a small Hamming distance, found by vantage-point trees.

1. A text's fingerprint has the majority of each bit over the XXH64 of its word shingles. Documents of one fingerprint are one
   class from here on, known by its smallest id.
2. A tree over a bounded sample of fingerprints splits the space: at each node by the distance to a vantage point. Its leaves are shards.
3. Each class has its home in one shard. By the triangle inequality its ball of the radius can reach the other side of a
   node only if it lies within the radius of the border; such classes visit the shards beyond it that come after their home. So each pair within
   the radius meets in a shard, the home of one of them.
4. A shard joins homes with visitors by a tree of its own, pruned in the same way. Only links that join two groups leave
   it, a forest: never more than it has members. Shards with more members than a task should hold are cut in blocks that
   meet each other.
5. The links' components give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import slices
from .neardup import components
from .shared import documents, stored, with_group_extreme
from .words import LOWER, Words, bounds, packed, spans, texts, words_of

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that the driver fits the tree to, about; shards at most; homes and visitors of a task's blocks, about.
SAMPLE, MOST_SHARDS, HOMES, VISITORS = 65_536, 4096, 16_384, 524_288
#: Homes of the smallest shard that is split further; pairs that numpy compares at once.
LEAST, CELLS = 128, 1 << 20
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
_PAIR = np.dtype([("print", "<u8"), ("id", "<i8")])


def joined_words(w: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of all documents, A-Z lower-cased, with one space after each, and where each begins and ends."""
    at = np.repeat(offsets[:-1], w.counts) + w.start
    size = w.end - w.start + 1
    end = np.cumsum(size)
    text = slices(np.append(LOWER[1][data], np.uint8(32)), at, size)
    text[end - 1] = 32
    return text.tobytes(), end - size, end - 1


def shingle_hashes(w: Words, data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle, repeats included, and where those of each document begin. A shorter text is one shingle, one without words has none."""
    text, start, end = joined_words(w, data, offsets)
    n = w.counts
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    begins = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], count)
    ends = np.minimum(begins + size, np.repeat(w.first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(start[begins].tolist(), end[ends].tolist(), strict=True)), np.uint64, len(begins)) if len(begins) else np.empty(0, np.uint64)
    return h, first


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits for each document: those that are set in more than half of its hashes; none where there are no hashes."""
    n = len(first) - 1
    ones = np.zeros((n, 64), np.int64)
    for lo in range(0, len(h), CHUNK):
        part = h[lo:lo + CHUNK]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, lo + len(part), "left")
        has = np.flatnonzero(first[a + 1:b + 1] > np.maximum(first[a:b], lo)) + a
        ones[has] += np.add.reduceat(bits, np.maximum(first[has], lo) - lo, axis=0, dtype=np.int64)
    major = (2 * ones > np.diff(first)[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").reshape(-1) if n else np.empty(0, np.uint64)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            for lo, hi in spans(off, 1 << 20):
                own = off[lo:hi + 1]
                found = fingerprints(*shingle_hashes(words_of(data, own, LOWER), data, own, size))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree: node ``i`` has a point, a border (distances up to it are inside) and two children; a child below zero is the shard ``-1 - child``."""

    def __init__(self) -> None:
        self.point: list[int] = []
        self.border: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.sizes: list[int] = []
        self.visits: list[int] = []
        self.root = -1

    @classmethod
    def fit(cls, sample: np.ndarray, least: int, radius: int, seed: int = 12) -> Tree:
        """Splits at the median distance while a node holds more than ``least`` of the sample and a split spares comparisons.

        ``sizes`` and ``visits``: fingerprints of the sample that live in each shard, and that may visit it.
        """
        tree, rng = cls(), np.random.default_rng(seed)

        def grow(homes: np.ndarray, guests: np.ndarray) -> int:
            if len(homes) > least and (cut := _cut(homes, guests, radius, rng)):
                point, border, near, near_guests = cut
                node = len(tree.point)
                tree.point.append(int(point))
                tree.border.append(border)
                tree.inside.append(0)
                tree.outside.append(0)
                tree.inside[node] = grow(homes[near], guests[near_guests[0]])
                tree.outside[node] = grow(homes[~near], guests[near_guests[1]])
                return node
            tree.sizes.append(len(homes))
            tree.visits.append(len(guests))
            return -len(tree.sizes)

        tree.root = grow(sample, sample)
        return tree

    def homes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                out[at] = -1 - node
                continue
            near = distance(x[at], np.uint64(self.point[node])) <= self.border[node]
            stack += [(self.inside[node], at[near]), (self.outside[node], at[~near])]
        return out

    def reached(self, x: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with the places in ``x`` of what it may hold a neighbour of: the triangle inequality rules the others out."""
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
                continue
            d = distance(x[at], np.uint64(self.point[node]))
            stack += [(self.inside[node], at[d - radius <= self.border[node]]), (self.outside[node], at[d + radius > self.border[node]])]


def _cut(homes: np.ndarray, guests: np.ndarray, radius: int, rng: np.random.Generator):
    """The best of a few vantage points: point, border, which homes are inside, which guests may have a neighbour on either side. None if no split saves a tenth of the comparisons."""
    best, cost = None, 0.9 * len(homes) * len(guests)
    for point in homes[rng.integers(0, len(homes), 3)]:
        d = distance(homes, point)
        border = int(np.partition(d, len(d) // 2)[len(d) // 2])
        for b in {border, border - 1}:
            near = d <= b
            n = int(near.sum())
            if not 0 < n < len(homes):
                continue
            to = distance(guests, point)
            sides = to - radius <= b, to + radius > b
            own = n * int(sides[0].sum()) + (len(homes) - n) * int(sides[1].sum())
            if own < cost:
                best, cost = (point, b, near, sides), own
    return best


class _Groups:
    """Labels of members, and the links that have joined them."""

    def __init__(self, n: int):
        self.top = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.top[x]
        while True:
            up = self.top[r]
            if (up == r).all():
                self.top[x] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            differ = x != y
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            lo, hi = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
            # Each label is hooked to one smaller label, so every link kept joins two groups.
            hi, one = np.unique(hi, return_index=True)
            lo = lo[one]
            self.top[hi] = lo
            self.links.append((hi, lo))


def near_links(x: np.ndarray, homes: np.ndarray, guests: np.ndarray, radius: int, groups: _Groups, seed: int = 3) -> int:
    """Joins the groups of all homes and guests (places in ``x``) that lie within the radius; returns how many pairs were compared."""
    rng, compared = np.random.default_rng(seed), 0
    stack = [(homes, guests)]
    while stack:
        own, others = stack.pop()
        if not len(own) or not len(others):
            continue
        if len(own) > LEAST and (cut := _cut(x[own], x[others], radius, rng)):
            _, _, near, sides = cut
            stack += [(own[near], others[sides[0]]), (own[~near], others[sides[1]])]
            continue
        compared += len(own) * len(others)
        step = max(1, CELLS // len(others))
        for lo in range(0, len(own), step):
            some = own[lo:lo + step]
            i, j = np.nonzero(np.bitwise_count(x[some][:, None] ^ x[others][None, :]) <= radius)
            i, j = some[i], others[j]
            groups.join(i[i != j], j[i != j])
    return compared


def _dealt(tree: Tree, radius: int, home_blocks: list[int], guest_blocks: list[int]):
    """Rows (shard, home block, guest block, side, body): classes at home (0) go to each block of guests, those that visit (1) to each block of homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, _PAIR)
            rows["print"], rows["id"] = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            home = tree.homes(rows["print"])
            keys, parts = [], []

            def put(shard: int, block: np.ndarray, n: int, others: int, side: int, own: np.ndarray) -> None:
                order = np.argsort(block, kind="stable")
                b = bounds(block[order])
                for i in range(len(b) - 1):
                    some = own[order[b[i]:b[i + 1]]]
                    for other in range(others):
                        h, g = (int(block[order[b[i]]]), other) if side == 0 else (other, int(block[order[b[i]]]))
                        keys.append((shard, h, g, side))
                        parts.append(some)

            for shard, at in tree.reached(rows["print"], radius):
                kh, kg = home_blocks[shard], guest_blocks[shard]
                own = at[home[at] == shard]
                if len(own):
                    put(shard, rows["id"][own] % kh, kh, kg, 0, rows[own])
                # A pair with homes in two shards meets in the later one.
                guests = at[home[at] <= shard]
                if len(guests):
                    put(shard, rows["id"][guests] % kg, kg, kh, 1, rows[guests])
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            body = packed(np.concatenate(parts) if parts else np.empty(0, _PAIR), first)
            cols = list(zip(*keys, strict=True)) if keys else [()] * 4
            yield pa.record_batch([*(pa.array(c, pa.int32()) for c in cols), body], ["shard", "home_block", "guest_block", "side", "body"])

    return run


def _joined(radius: int):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        bodies = [np.frombuffer(b.as_buffer(), _PAIR) for b in table["body"].combine_chunks()]
        part = [[b for b, s in zip(bodies, side, strict=True) if s == want] for want in (0, 1)]
        homes, guests = (np.concatenate(p) if p else np.empty(0, _PAIR) for p in part)
        both = np.concatenate([homes, guests])
        x, one, place = np.unique(both["print"], return_index=True, return_inverse=True)
        ids = both["id"][one]
        groups = _Groups(len(x))
        near_links(x, place[:len(homes)], place[len(homes):], radius, groups)
        a, b = (np.concatenate(z) for z in zip(*groups.links, strict=True)) if groups.links else (np.empty(0, np.int64),) * 2
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def sign(df: DataFrame, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print: the 64-bit SimHash of each text over its shingles of ``size`` words (A-Z lower-cased); zero for texts without words, null ones included."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(_signed(size), "doc_id long, print long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links that connect all classes (print, id; stored, no print twice) whose prints differ in ``radius`` bits or fewer, as a forest for each shard."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.where(F.pmod(F.xxhash64("print", F.lit(7)), F.lit(max(1, -(-n // SAMPLE)))) == 0).select("print")
    fitted = np.sort(np.array([r["print"] for r in sample.collect()], np.int64).view(np.uint64))
    wanted = min(MOST_SHARDS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // HOMES)), max(1, n // LEAST))
    tree = Tree.fit(fitted, max(1, len(fitted) // wanted), radius)
    share = n / max(1, len(fitted))
    blocks = lambda sizes, most: [max(1, int(-(-s * share // most))) for s in sizes]
    dealt = classes.select("print", "id").mapInArrow(_dealt(tree, radius, blocks(tree.sizes, HOMES), blocks(tree.visits, VISITORS)), "shard int, home_block int, guest_block int, side int, body binary")
    return dealt.groupBy("shard", "home_block", "guest_block").applyInArrow(_joined(radius), "a long, b long")


def near_duplicates(df: DataFrame, radius: int = RADIUS, size: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, print, component_id of each row: documents are linked if their fingerprints differ in ``radius`` bits or fewer.

    Null and empty texts have the fingerprint zero and are linked like any other. A row with a null key is linked with
    nothing and has a null component_id; rows of one key are one document, whose texts are linked. No rows: no result rows.
    Other columns are not read. All pairs within the radius are found: the tree only rules out what the triangle inequality does.
    """
    signed = stored(sign(df, size, key, text), "simhash")
    member = stored(with_group_extreme(signed.where("doc_id is not null"), ["print"], "doc_id", "id").select("doc_id", "print", "id"), "simhash-members")
    classes = stored(member.where("doc_id = id").select("print", "id").distinct(), "simhash-classes")
    label = components(stored(links(classes, radius), "simhash-links"), "simhash-components")
    group = classes.select("id").distinct().join(label.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("component", "id").alias("component_id"))
    known = member.join(group, "id").select("doc_id", "print", "component_id")
    return known.unionByName(signed.where("doc_id is null").select("doc_id", "print", F.lit(None).cast("long").alias("component_id")))


def op12_vantage_point_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
