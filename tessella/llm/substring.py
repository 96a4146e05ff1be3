"""Substring dedup by prefix-partitioned suffix trees, cut at the depth of the window.

1. Which suffixes matter. Every window of ``window`` words holds a least n-gram (``ANCHOR`` words, by hash); equal windows
   have the same at the same place in them. Suffixes that begin with such n-grams are the leaves; those whose n-gram
   stands in one place of the corpus are leaves alone and go no further. About one suffix in seven is looked at for this.
2. Prefixes. A suffix goes to a group by a prefix of its words, known by its hash: the n-gram, or, where more suffixes
   begin with it than ``hot`` allows, the whole window, so that no prefix has more suffixes than fit in memory; groups
   are as many prefixes as fit (``exchange.groups``). What moves is the text itself: the words from the first to the
   last window that holds the n-gram.
3. A group's subtree is the sorted array of its suffixes' words with the lengths of common prefixes (LCP); the words to the
   left of the suffixes are sorted the same way, backwards. A node of depth d to the right and one of depth ``window`` - d
   to the left are one repeated window; maximal repeats are chains of them. The first place of each, in order of document
   and place, stays; the others go back to their documents as ranges.

Words are compared by their 128-bit identities (see ``words``), never by the hashes that deal suffixes out. Each task sends
only the first of equal texts that it has, and knows by itself that its others aren't first: a passage in a third of all
documents sends a few rows per task, not some per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import ENTRY, answer_bits, by_bucket, entry, groups, joined, texts_of
from .shared import documents, stored
from .words import EXACT, FACTORS, FACTORS_2, Words, bounds, hashed, mix, ngrams, packed, spans, texts, words_of

WINDOW = 20
ANCHOR = 8
#: Suffixes of a group, about.
SUFFIXES = 60_000
#: Batches that may send one n-gram before its suffixes go by longer prefixes; grows with the corpus, so that at most ``HOT_KEYS`` n-grams have more.
HOT, HOT_KEYS = 4_000, 1_000_000


def _windows(w, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins of all windows, the least n-gram in each, and where it stands first."""
    left = w.left()
    begin = np.flatnonzero(left >= window)
    if not len(begin):
        return begin, np.empty(0, np.uint64), begin
    g = ngrams(w.hash, anchor)
    m = g[: len(g) - (window - anchor)].copy()
    at = np.arange(len(m))
    for j in range(1, window - anchor + 1):
        less = g[j:j + len(m)] < m
        at[less] = np.flatnonzero(less) + j
        np.minimum(m, g[j:j + len(m)], out=m)
    return begin, m[begin], at[begin]


def _by_doc(kind: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row per document with its values; ``ids`` are sorted."""
    b = bounds(ids)
    k = len(b) - 1
    return entry([kind] * k, [0] * k, ids[b[:-1]], np.diff(b), packed(values, b))


_SEEN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("many", "<u4")])
#: A suffix: key of its prefix, place of the first window that holds it, words to its left, windows, bytes of text.
_LEAF = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("left", "u1"), ("n", "u1"), ("size", "<u4")])
#: Windows that repeat earlier ones: the first and how many.
_RANGE = np.dtype([("at", "<i4"), ("n", "<i4")])
_KEY = np.dtype("<u8")


def _anchors(window: int, anchor: int):
    """Sends each distinct (n-gram, document) that is some window's least; n-grams that repeat in the batch are answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in spans(off):
                w = words_of(data, off[lo:hi + 1], EXACT)
                begin, least, place = _windows(w, window, anchor)
                if not len(begin):
                    continue
                doc = w.doc()[begin]
                new = np.concatenate([[True], place[1:] != place[:-1]])
                key, own = least[new], ids[lo:hi][doc[new]]
                order = np.argsort(key, kind="stable")
                key, own = key[order], own[order]
                b = bounds(key)
                size = np.diff(b)
                many = np.repeat(size > 1, size)
                if many.any():
                    k, d = key[many], own[many]
                    o = np.lexsort((k, d))
                    k, d = k[o], d[o]
                    once = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
                    yield _by_doc(1, d[once], k[once])
                record = np.zeros(len(size), _SEEN)
                record["key"], record["doc"], record["many"] = key[b[:-1]], own[b[:-1]], size
                yield by_bucket(record["key"], record)

    return run


def _answers(doc: np.ndarray, value: np.ndarray, bits: int) -> pa.Table:
    """What documents are told, by bucket of documents: few rows, however many documents there are."""
    x = np.zeros(len(doc), [("doc", "<i8"), ("value", value.dtype)])
    x["doc"], x["value"] = doc, value
    return pa.Table.from_batches([by_bucket(mix(np.ascontiguousarray(doc).view(np.uint64)), x, bits=bits)])


def _per_document(kind: np.dtype):
    def run(table: pa.Table) -> pa.Table:
        x = joined(table, np.dtype([("doc", "<i8"), ("value", kind)]))
        x = x[np.argsort(x["doc"], kind="stable")]
        b = bounds(x["doc"])
        return pa.table({"doc_id": x["doc"][b[:-1]], "body": packed(x["value"], b)})

    return run


def _repeated(bits: int, hot: int):
    """n-grams of several places: told to those documents whose task had one place only. Kind 2: those of more than ``hot`` suffixes."""

    def run(table: pa.Table) -> pa.Table:
        x = joined(table, _SEEN)
        x = x[np.argsort(x["key"], kind="stable")]
        b = bounds(x["key"])
        size = np.diff(b)
        often = x["key"][b[:-1]][np.add.reduceat(x["many"].astype(np.int64), b[:-1]) > hot] if len(x) else np.empty(0, _KEY)
        x = x[np.repeat(size > 1, size) & (x["many"] == 1)]
        out = [_answers(x["doc"], x["key"], bits)]
        if len(often):
            out.append(pa.Table.from_batches([entry([2], [0], [0], [len(often)], packed(often, np.array([0, len(often)])))]))
        return pa.concat_tables(out)

    return run


def _whole_hash(w: Words, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``n`` words from each ``begin``: together 128 bits."""
    one, two = n.astype(np.uint64), n.astype(np.uint64)
    other = hashed(w.high, w.low)
    for j in range(int(n.max(initial=0))):
        at = np.flatnonzero(n > j)
        i = begin[at] + j
        one[at] += w.hash[i] * FACTORS[j]
        two[at] += other[i] * FACTORS_2[j]
    return mix(one), mix(two)


def _suffixes(window: int, anchor: int, hot: np.ndarray):
    """Suffixes whose n-gram repeats, each with the text of the windows that hold it; of equal ones in the batch the first is sent, others are answered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            told, told_off = texts(batch.column(2))
            for lo, hi in spans(off):
                known = np.sort(np.frombuffer(told[told_off[lo]:told_off[hi]].tobytes(), _KEY))
                if not len(known):
                    continue
                w = words_of(data, off[lo:hi + 1], EXACT, identity=True)
                begin, least, place = _windows(w, window, anchor)
                ok = known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least
                begin, least, place = begin[ok], least[ok], place[ok]
                if not len(begin):
                    continue
                long = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least if len(hot) else np.zeros(len(begin), bool)
                # Windows that hold the same n-gram go together; those of hot ones go each by itself, keyed by all its words.
                new = np.concatenate([[True], (place[1:] != place[:-1]) | long[1:]])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(begin)))
                long = long[first]
                key, b0, left = least[first].copy(), begin[first], place[first] - begin[first]
                if long.any():
                    key[long], left[long] = ngrams(w.hash, window)[b0[long]], 0
                h1, h2 = _whole_hash(w, b0, n + window - 1)
                doc = w.doc()[b0]
                own, at = ids[lo:hi][doc], b0 - w.first[doc]
                order = np.lexsort((at, own, h2, h1))
                same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1]) & (left[order][1:] == left[order][:-1])
                again = same & (own[order][1:] == own[order][:-1]) & (at[order][1:] == at[order][:-1])  # a row that repeats its document
                order, same = order[np.concatenate([[True], ~again])], np.concatenate([[False], same[~again]])
                rest = order[same]
                if len(rest):
                    rest = rest[np.argsort(own[rest], kind="stable")]
                    r = np.zeros(len(rest), _RANGE)
                    r["at"], r["n"] = at[rest], n[rest]
                    yield _by_doc(1, own[rest], r)
                send = np.sort(order[~same])
                x = np.zeros(len(send), _LEAF)
                base = off[lo:hi][doc[send]]
                start = base + w.start[b0[send]]
                x["key"], x["doc"], x["at"], x["left"], x["n"] = key[send], own[send], at[send], left[send], n[send]
                x["size"] = base + w.end[b0[send] + n[send] + window - 2] - start
                yield by_bucket(x["key"], x, data, start)

    return run


def _sorted_depths(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``rows`` (words of suffixes as numbers of ``bits`` bits, 0 beyond their ends) and the common prefix of each with the one before it. As many words as fit make one sort key."""
    per = max(1, 63 // bits)
    keys = []
    for at in range(0, rows.shape[1], per):
        key = np.zeros(len(rows), np.int64)
        for j in range(at, min(at + per, rows.shape[1])):
            key = (key << bits) | rows[:, j]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    x = rows[order]
    same = np.concatenate([np.zeros((1, rows.shape[1]), bool), x[1:] == x[:-1]])
    return order, np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))


def _nodes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix, the node of ``depth`` above it."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def repeated_windows(x: np.ndarray, w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and places of the windows of a group's suffixes that repeat an earlier window."""
    order = np.lexsort((w.high, w.low))
    new = np.concatenate([[True], (w.low[order][1:] != w.low[order][:-1]) | (w.high[order][1:] != w.high[order][:-1])]) if len(order) else np.empty(0, bool)
    word = np.zeros(len(order) + 1, np.int32)
    word[order] = np.cumsum(new)
    bits = int(new.sum()).bit_length()
    n, left, first = x["n"].astype(np.int64), x["left"].astype(np.int64), w.first[:-1]
    at = first + left
    step = np.arange(window)
    right = np.where(step < (w.first[1:] - at)[:, None], word[np.minimum(at[:, None] + step, len(word) - 1)], 0)
    back = np.where(step < left[:, None], word[np.maximum(at[:, None] - 1 - step, 0)], 0)
    to_right, to_left = _sorted_depths(right, bits), _sorted_depths(back[:, : max(1, int(left.max(initial=0)))], bits)
    doc, place = [], []
    for d in range(int(left.max(initial=0)) + 1):
        has = np.flatnonzero((d <= left) & (left - d < n))
        if len(has) < 2:
            continue
        node = _nodes(*to_right, window - d)[has] * (len(x) + 1) + _nodes(*to_left, d)[has]
        # Leaves alone in their node have nothing to give.
        order = np.argsort(node, kind="stable")
        size = np.diff(bounds(node[order]))
        has, node = has[order], node[order]
        many = np.repeat(size > 1, size)
        has, node = has[many], node[many]
        if not len(has):
            continue
        own, begin = x["doc"][has], x["at"][has] + left[has] - d
        order = np.lexsort((begin, own, node))
        node, own, begin = node[order], own[order], begin[order]
        again = node[1:] == node[:-1]
        # Rows that repeat a document stand in one place: the first of a run of equal places decides for all of them.
        repeat = (own[1:] == own[:-1]) & (begin[1:] == begin[:-1])
        fresh = np.flatnonzero(np.concatenate([[True], ~(again & repeat)]))
        later = np.concatenate([[False], again])[fresh]
        doc.append(own[fresh][later])
        place.append(begin[fresh][later])
    return (np.concatenate(doc), np.concatenate(place)) if doc else (np.empty(0, np.int64), np.empty(0, np.int64))


def _tree(window: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        x, data = joined(table, _LEAF), texts_of(table)
        off = np.concatenate([[0], np.cumsum(x["size"].astype(np.int64))])
        doc, place = repeated_windows(x, words_of(data, off, EXACT, identity=True), window)
        # In order of document and place, each once: what follows one another is a range.
        order = np.lexsort((place, doc))
        order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0)])] if len(order) else order
        doc, place = doc[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (np.diff(place) > 1)])) if len(doc) else np.empty(0, np.int64)
        r = np.zeros(len(first), _RANGE)
        r["at"], r["n"] = place[first], np.diff(np.append(first, len(doc)))
        return _answers(doc[first], r, bits)

    return run


def _told(own: DataFrame, answers: DataFrame, kind: np.dtype) -> DataFrame:
    """doc_id and what its parts are told: from the batch itself and from the groups."""
    back = answers.select("bucket", "body").groupBy("bucket").applyInArrow(_per_document(kind), "doc_id long, body binary")
    both = own.select("doc_id", "body").unionByName(back)
    told = both.groupBy("doc_id").agg(F.array_join(F.collect_list(F.hex("body")), "").alias("told"))
    return told.select("doc_id", F.unhex("told").alias("told"))


def _cut(window: int, with_text: bool):
    """Words that no repeated window covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = texts(batch.column(1))
            told, told_off = texts(batch.column(2))
            for lo, hi in spans(off):
                w = words_of(data, off[lo:hi + 1], EXACT)
                gone, sha, body = [], [], []
                for i in range(hi - lo):
                    raw = data[off[lo + i]:off[lo + i + 1]]
                    n = int(w.first[i + 1] - w.first[i])
                    at = np.frombuffer(told[told_off[lo + i]:told_off[lo + i + 1]].tobytes(), _RANGE)
                    kept = raw.tobytes().split()
                    if len(at):
                        change = np.zeros(n + 1, np.int32)
                        np.add.at(change, at["at"], 1)
                        np.add.at(change, at["at"] + at["n"] + window - 1, -1)
                        keep = np.cumsum(change[:-1]) == 0
                        kept = [x for x, k in zip(kept, keep.tolist(), strict=True) if k]
                    joined = b" ".join(kept)
                    gone.append(n - len(kept))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    body.append(joined.decode() if len(at) else raw.tobytes().decode())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(sha)] + ([pa.array(body)] if with_text else []),
                                      ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def deduplicate(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of each document of ``df``.

    Words are removed that a window of ``window`` words covers which also begins earlier: in a document of smaller key,
    or earlier in the same. Windows are judged on the input. kept_text is the text itself where nothing is removed, else the kept words joined by a space.

    Null and empty texts, and those shorter than a window, keep all. Rows that repeat a document are that one document and lose the
    same; keys must otherwise be unique. Rows with a null key keep all and take nothing from others. No rows: no result rows.
    Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    keyed = rows.where("doc_id is not null")
    kind, bits = F.col("kind"), answer_bits(spark)

    entries = stored(keyed.mapInArrow(_anchors(window, anchor), ENTRY), "anchors", partition_by="kind")
    sent, own = (entries.where(kind == k) for k in (0, 1))
    limit = max(hot, (sent.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    found = stored(groups(sent, _SEEN).groupBy("group").applyInArrow(_repeated(bits, limit), ENTRY), "repeated", partition_by="kind")
    often = [np.frombuffer(r["body"], _KEY) for r in found.where(kind == 2).select("body").collect()]
    anchors = _told(own, found.where(kind == 0), _KEY)
    some = keyed.join(anchors, "doc_id").select("doc_id", "t", "told")

    entries = stored(some.mapInArrow(_suffixes(window, anchor, np.unique(np.concatenate(often)) if often else np.empty(0, _KEY)), ENTRY), "suffixes", partition_by="kind")
    sent, own = (entries.where(kind == k) for k in (0, 1))
    places = _told(own, groups(sent, _LEAF, SUFFIXES).groupBy("group").applyInArrow(_tree(window, bits), ENTRY), _RANGE)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.join(places, "doc_id", "left").select("doc_id", "t", "told").mapInArrow(_cut(window, with_text), schema)


def op10_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))
