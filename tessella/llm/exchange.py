"""An exchange of packed records: tasks send numpy records by the highest bits of a hash, groups of them are resolved together.

A row holds many records, so Spark moves few rows. Groups have prefixes of variable length: buckets (the first
``BITS`` bits) side by side are joined while they are small, and a bucket beyond the bound is split by as many further
bits as it takes, in the tasks, so groups fit in memory at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import tasks_for
from .words import bounds, packed

#: Records of a group, about.
GROUP = 1_000_000
#: Buckets whose sizes the driver sees: as many as the first so many bits tell apart.
BITS = 12
BUCKETS = 1 << BITS
SHIFT = np.uint64(64 - BITS)
ENTRY = "kind int, bucket int, doc_id long, n long, body binary, text binary"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def entry(kind, bucket, doc, n, body, text=None) -> pa.RecordBatch:
    return pa.record_batch([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), body, pa.nulls(len(body), pa.binary()) if text is None else text], _NAMES)


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``data[start:start + size]`` of all starts, one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def answer_bits(spark: SparkSession) -> int:
    """Bits of a document's hash by which answers are sent back: a few parts for each shuffle partition, so that a part holds few documents at any size."""
    return (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()


def by_bucket(key: np.ndarray, record: np.ndarray, data: np.ndarray | None = None, start: np.ndarray | None = None, bits: int = BITS) -> pa.RecordBatch:
    """One row per bucket (the highest ``bits`` of the key) with its records and, if ``data`` is given, the ``record["size"]`` bytes at ``start`` of each."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    b = bounds(bucket[order])
    k = len(b) - 1
    text = None
    if data is not None:
        size = record["size"][order].astype(np.int64)
        text = packed(slices(data, start[order], size), np.concatenate([[0], np.cumsum(size)])[b])
    return entry([0] * k, bucket[order][b[:-1]], [0] * k, np.diff(b), packed(record[order], b), text)


def joined(table: pa.Table, kind: np.dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table["body"].combine_chunks()] if table.num_rows else []
    return np.concatenate(parts) if parts else np.empty(0, kind)


def texts_of(table: pa.Table) -> np.ndarray:
    """The bytes that go with the records of ``joined``, in their order."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["text"].combine_chunks()] if table.num_rows else []
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def _splitter(kind: np.dtype, bits: dict[int, int]):
    """Rows of large buckets by further bits of their records' keys; the group is the bucket and these bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bucket = row.column(0)[0].as_py()
                x = np.frombuffer(row.column(1)[0].as_buffer(), kind)
                sub = ((x["key"] << np.uint64(BITS)) >> np.uint64(64 - bits[bucket])).astype(np.int64)
                order = np.argsort(sub, kind="stable")
                b = bounds(sub[order])
                group = (np.int64(bucket) << 40) | (sub[order][b[:-1]] + 1)
                text = pa.nulls(len(group), pa.binary())
                if row.column(2)[0].is_valid:
                    size = x["size"].astype(np.int64)
                    data = np.frombuffer(row.column(2)[0].as_buffer(), np.uint8)
                    text = packed(slices(data, (np.cumsum(size) - size)[order], size[order]), np.concatenate([[0], np.cumsum(size[order])])[b])
                yield pa.record_batch([pa.array(group), packed(x[order], b), text], ["group", "body", "text"])

    return run


def groups(entries: DataFrame, kind: np.dtype, most: int = GROUP) -> DataFrame:
    """group, body, text: rows of a group have the same prefix of their records' field ``key``, and about ``most`` records or fewer, unless they are of one key.

    The driver sees one number per bucket, of which there are ``BUCKETS``.
    """
    sizes = {r["bucket"]: r["n"] for r in entries.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    cap = min(most, max(10_000, -(-sum(sizes.values()) // tasks_for(entries.sparkSession, 1, 1))))
    of: list[int] = [0] * BUCKETS

    def join(lo: int, size: int) -> None:
        if size == 1 or sum(sizes.get(i, 0) for i in range(lo, lo + size)) <= cap:
            of[lo:lo + size] = [lo] * size
        else:
            join(lo, size // 2)
            join(lo + size // 2, size // 2)

    join(0, BUCKETS)
    large = {b: min(36, int(-(-n // most)).bit_length()) for b, n in sizes.items() if n > most}
    out = entries.select(F.element_at(F.array(*[F.lit(x) for x in of]), F.col("bucket") + 1).cast("long").alias("group"), "bucket", "body", "text")
    if not large:
        return out.drop("bucket")
    is_large = F.element_at(F.array(*[F.lit(i in large) for i in range(BUCKETS)]), F.col("bucket") + 1)
    split = out.where(is_large).select("bucket", "body", "text").mapInArrow(_splitter(kind, large), "group long, body binary, text binary")
    return out.where(~is_large).drop("bucket").unionByName(split)
