"""Benchmark decontamination over a positional inverted index.

The index is a table of segments. A segment holds the postings of some documents: its terms (the words' 128-bit identities)
and, for each, the ascending list of the places where it stands (numpy arrays in binary columns). A search needs no
shuffle of the corpus: each segment takes the windows whose terms it all has and intersects their lists, rarest first, each
shifted by the term's offset in the window, until none or the exact phrase is left; with slack, proximity matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored
from .words import LETTERS, Words, bounds, packed, spans, texts, words_of

WINDOW = 13
#: Words of test items that are searched for at once; more items are taken in further blocks.
ITEM_WORDS = 500_000
SEGMENT = "segment string, doc_id long, n_docs int, ids binary, id_null binary, first binary, low binary, high binary, term_first binary, places binary"
FOUND = "segment string, nth int, starts binary, lengths binary, items array<string>"


def _terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places by term, and where each term's begin; terms are in order of both halves of their identities."""
    order = np.lexsort((w.high, w.low)).astype(np.uint32)
    low, high = w.low[order], w.high[order]
    return order, np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(order) else np.empty(0, np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = texts(batch.column(1))
        ids = batch.column(0).cast(pa.int64())
        for lo, hi in spans(off):
            w = words_of(data, off[lo:hi + 1], LETTERS, identity=True)
            order, at = _terms(w)
            own = ids.slice(lo, hi - lo)
            one = lambda x: packed(x, np.array([0, len(x)]))
            yield pa.record_batch(
                [pa.array([uuid.uuid4().hex]), pa.array([0], pa.int64()), pa.array([hi - lo], pa.int32()),
                 one(own.fill_null(0).to_numpy(zero_copy_only=False)), one(own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
                 one(w.first.astype(np.int64)), one(w.low[order[at]]), one(w.high[order[at]]), one(np.append(at, len(order)).astype(np.int64)), one(order)],
                [c.split()[0] for c in SEGMENT.split(", ")])


def build_index(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index of all words of all texts (null: no words)."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return stored(rows.mapInArrow(_build, SEGMENT), "postings")


class _Segment:
    def __init__(self, row: dict):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.first, self.low, self.high, self.term_first, self.places = get("first", np.int64), get("low", np.uint64), get("high", np.uint64), get("term_first", np.int64), get("places", np.uint32)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where each term is in the dictionary, -1 for none."""
        at = np.searchsorted(self.low, low)
        out = np.full(len(low), -1)
        todo = np.flatnonzero(at < len(self.low))
        while len(todo):  # terms with the same lower half stand side by side
            todo = todo[self.low[at[todo]] == low[todo]]
            ok = self.high[at[todo]] == high[todo]
            out[todo[ok]] = at[todo[ok]]
            todo = todo[~ok]
            at[todo] += 1
            todo = todo[at[todo] < len(self.low)]
        return out

    def list_of(self, slot: int) -> np.ndarray:
        return self.places[self.term_first[slot]:self.term_first[slot + 1]].astype(np.int64)

    def phrase(self, slots: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase begins, and the documents; with slack, each term may stand so far from its place (a proximity match), in the same document."""
        size = self.term_first[slots + 1] - self.term_first[slots]
        order = np.argsort(size, kind="stable")
        at = self.list_of(slots[order[0]])
        doc = np.searchsorted(self.first, at, "right") - 1
        begin = at - order[0]
        for j in order[1:]:
            places = self.list_of(slots[j])
            low, high = np.maximum(begin + j - slack, self.first[doc]), np.minimum(begin + j + slack, self.first[doc + 1] - 1)
            ok = np.searchsorted(places, high, "right") > np.searchsorted(places, low)
            begin, doc = begin[ok], doc[ok]
            if not len(begin):
                break
        return begin, doc


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_buffer() if pa.types.is_binary(batch.schema.field(k).type) else batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


@dataclass
class Items:
    """Test items as distinct terms and, for each window, its terms by number: what each task gets whole."""

    low: np.ndarray
    high: np.ndarray
    #: Length of each window, where it begins in ``term``, and its item.
    size: np.ndarray
    at: np.ndarray
    item: np.ndarray
    term: np.ndarray
    names: list[str]


def windows_of(items: list[tuple[str, str | None]], n: int = WINDOW) -> Items:
    """All windows of all items; a window that repeats within its item counts once, by its words."""
    w = words_of(*texts(pa.array([t for _, t in items], pa.string())), LETTERS, identity=True)
    order, first = _terms(w)
    term = np.empty(len(order), np.int32)
    term[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    size = np.minimum(w.counts, n)
    windows = np.where(size > 0, w.counts - size + 1, 0)
    item = np.repeat(np.arange(len(items)), windows)
    at = np.repeat(w.first[:-1] - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    return Items(w.low[order[first]], w.high[order[first]], size[item], at, item, term, [i for i, _ in items])


def _searcher(items: Items, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seg = _Segment(row)
            slots = seg.slots(items.low, items.high)[items.term]
            missing = np.concatenate([[0], np.cumsum(slots < 0)])
            starts, docs, which = [], [], []
            for i in np.flatnonzero(missing[items.at + items.size] == missing[items.at]).tolist():
                at, doc = seg.phrase(slots[items.at[i]:items.at[i] + items.size[i]], slack)
                if len(at):
                    starts.append(at)
                    docs.append(doc)
                    which.append(np.full(len(at), i))
            if not starts:
                continue
            s, doc, which = np.concatenate(starts), np.concatenate(docs), np.concatenate(which)
            order = np.argsort(doc, kind="stable")
            s, which, doc = s[order], which[order], doc[order]
            b = bounds(doc)
            s -= seg.first[doc]
            names = [sorted({items.names[j] for j in np.unique(items.item[which[x:y]]).tolist()}) for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array([row["segment"]] * len(names)), pa.array(doc[b[:-1]], pa.int32()), packed(s.astype(np.int64), b), packed(items.size[which].astype(np.int64), b), pa.array(names, pa.list_(pa.string()))],
                                  [c.split()[0] for c in FOUND.split(", ")])

    return run


def search(index: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW, slack: int = 0) -> DataFrame:
    """Matches of every window of ``items``: segment, nth (document in it), starts and lengths (words), items.

    With ``slack`` each term may stand so many places from where the phrase has it (proximity). Items are collected in
    blocks of about ``ITEM_WORDS`` words, so the driver and the tasks never hold more of them.
    """
    rows = items.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    words = rows.agg(F.sum(F.length("t") / 2)).first()[0] or 0
    blocks = int(words // ITEM_WORDS) + 1
    found = None
    for b in range(blocks):
        own = [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()]
        one = index.mapInArrow(_searcher(windows_of(own, n), slack), FOUND)
        found = one if found is None else found.unionByName(one)
    return found


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that any match covers, over the blocks of items."""
    for batch in batches:
        hits = []
        for starts, lengths in zip(batch.column(2), batch.column(3), strict=True):
            s, n = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in part.values]) for part in (starts, lengths))
            order = np.argsort(s, kind="stable")
            s, e = s[order], (s + n)[order]
            reach = np.maximum.accumulate(e)
            hits.append(int(np.maximum(0, e - np.maximum(s, np.concatenate([[0], reach[:-1]]))).sum()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(4)], ["segment", "nth", "n_hit", "items"])


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        ids, gone, first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_null"], np.uint8), np.frombuffer(row["first"], np.int64)
        yield pa.record_batch([pa.array([row["segment"]] * len(ids)), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids, mask=gone.astype(bool)), pa.array(np.diff(first))],
                              ["segment", "nth", "doc_id", "n_words"])


def contamination(df: DataFrame, items: DataFrame, n: int = WINDOW, num: int = 1, den: int = 20) -> DataFrame:
    """For each row of ``df`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_list.

    A window is ``n`` consecutive item words; an item with fewer is one window. Null or empty texts have no words and
    are not contaminated, others are if ``den`` * n_hit >= ``num`` * n_words and a word is hit; null items, or items without words, match nothing; repeated rows are judged each by itself.
    No items: no hits. Other columns are not read.
    """
    index = build_index(df)
    found = search(index, items, n=n)
    # A document has a row from each block of items that it matches; sets and ranges are joined as columns, without a Python call for each document.
    rows = found.groupBy("segment", "nth").agg(F.collect_list("starts").alias("starts"), F.collect_list("lengths").alias("lengths"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = (rows.mapInArrow(_merge, "segment string, nth int, n_hit long, items array<string>")
            .select("segment", "nth", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("item_list")))
    docs = index.select("segment", "ids", "id_null", "first").mapInArrow(_docs, "segment string, nth int, doc_id long, n_words long")
    out = docs.join(hits, ["segment", "nth"], "left").fillna({"n_hit": 0, "n_items": 0, "item_list": ""})
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("item_list").cast("binary"), 256).alias("items_sha256"),
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * den >= F.col("n_words") * num)).alias("contaminated"), "item_list")


def op9_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("item_list")

