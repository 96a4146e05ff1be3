"""Files that are one JSON array each, read by several tasks in bounded memory.

Whether a comma in the middle of a file separates elements depends on all that comes before it: it may stand in a string or
in a deeper value. So a file is read twice, in splits that end at commas. The first pass says of each split how it changes the depth
and whether it ends in a string, for both cases of how it began; the driver adds these up, a few numbers for each split. In the second
pass each split knows its begin and cuts itself at commas of the array's own depth. What lies before the first and behind the last is put together with the splits beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.runs import GuardError

WHOLE, HEAD, TAIL, NONE = range(4)


def _quotes(b: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end a string: not those behind an odd number of backslashes."""
    quote = b == 34
    back = b == 92
    if back.any():
        at = np.arange(len(b))
        last = np.maximum.accumulate(np.where(back, -1, at))
        run = np.zeros(len(b), np.int64)
        run[1:] = at[1:] - 1 - last[:-1]
        quote &= run % 2 == 0
    return quote


def _depths(b: np.ndarray, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether it lies in a string, and the depth behind it."""
    inside = (np.cumsum(_quotes(b)) + in_string) % 2 == 1
    step = np.isin(b, (91, 123)).astype(np.int64) - np.isin(b, (93, 125))
    return inside, np.cumsum(np.where(inside, 0, step)) + depth


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """File and block of the splits that the pieces come from, and their bytes, a batch at a time; every piece ends in a comma."""
    for batch in batches:
        files, blocks, pieces = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lo = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], blocks[i]) != (files[lo], blocks[lo]):
                yield (files[lo], blocks[lo]), b"".join(p + b"," for p in pieces[lo:i])
                lo = i


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and each case of its begin: does it end in a string, and by how much is it deeper."""
    at, state, out = None, [], []
    for split, data in _splits(batches):
        if split != at:
            if at:
                out.append((*at, *state[0], *state[1]))
            at, state = split, [(False, 0), (True, 0)]
        b = np.frombuffer(data, np.uint8)
        for i, (in_string, depth) in enumerate(state):
            inside, depths = _depths(b, in_string, depth)
            state[i] = bool(inside[-1]), int(depths[-1])
    if at:
        out.append((*at, *state[0], *state[1]))
    columns = zip(*out, strict=True) if out else [()] * 6
    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["file", "block", "s0", "d0", "s1", "d1"])


def _cut(begins: dict[tuple[str, int], tuple[bool, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, left, any_border = None, (False, 0), b"", False

        def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            kinds, n = [k for k, _ in found], len(found)
            return pa.record_batch([pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(kinds, pa.int32()),
                                    pa.array([t if k != WHOLE else None for k, t in found], pa.binary()), pa.array([t.strip() if k == WHOLE else None for k, t in found], pa.binary())], ["file", "block", "kind", "text", "whole"])

        for split, data in _splits(batches):
            if split != at:
                if at:
                    yield rows([(TAIL if any_border else NONE, left)])
                at, state, left, any_border = split, begins[split], b"", False
            b = np.frombuffer(data, np.uint8)
            inside, depth = _depths(b, *state)
            state = bool(inside[-1]), int(depth[-1])
            found, lo = [], 0
            for i in np.flatnonzero((b == 44) & ~inside & (depth == 1)).tolist():
                found.append((WHOLE if any_border else HEAD, left + data[lo:i]))
                left, lo, any_border = b"", i + 1, True
            left += data[lo:]
            yield rows(found)
        if at:
            yield rows([(TAIL if any_border else NONE, left)])

    return run


def _begins(changes: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """Whether each split begins in a string, and at what depth. A file that doesn't end as it began is refused."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    file, in_string, depth = None, False, 0
    for r in [*sorted(changes, key=lambda r: (r["file"], r["block"])), None]:
        if r is None or r["file"] != file:
            if file is not None and (in_string or depth):
                raise GuardError(f"{file} ends inside its array")
            if r is None:
                break
            file, in_string, depth = r["file"], False, 0
        out[file, r["block"]] = in_string, depth
        in_string, depth = (r["s1"], depth + r["d1"]) if in_string else (r["s0"], depth + r["d0"])
    return out


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, text: the elements of all arrays in ``path`` as JSON text, in no order. Commas, brackets and quotes in strings are part of them; an empty array has none."""
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", ",").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("piece"))
    begins = _begins(pieces.mapInArrow(_changes, "file string, block long, s0 boolean, d0 long, s1 boolean, d1 long").collect())
    rows = pieces.mapInArrow(_cut(begins), "file string, block long, kind int, text binary, whole binary")
    # Two at most for each split: what ends in it, and what begins in it. An element that goes on over splits is put together.
    ends = rows.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")
    number = ends.select("file", "block", "kind", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("number"))
    part = F.struct("block", "kind", "text")
    joined = ends.join(number, ["file", "block", "kind"]).groupBy("file", "number").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min(F.struct("block", "kind")).alias("first"))
    text = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["text"])).cast("string")
    last = F.max("number").over(Window.partitionBy("file"))
    text = F.regexp_replace(text, r"^\s+|[\s,]+$", "")
    text = F.when(F.col("number") == 0, F.regexp_replace(text, r"^\[\s*", "")).otherwise(text)
    # Whole elements have a column of their own, null elsewhere: a reader's own conditions may be looked at before the filter here.
    whole = rows.select("file", F.col("whole").cast("string").alias("text")).where("text is not null")
    ends = joined.withColumn("last", last).select("file", F.when(F.col("number") == F.col("last"), F.regexp_replace(text, r"\s*\]$", "")).otherwise(text).alias("text"))
    return whole.unionByName(ends.withColumn("text", F.nullif("text", F.lit(""))).where("text is not null"))


def read(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """The elements of the arrays in ``path`` as rows of ``schema``; with ``mode`` PERMISSIVE bad elements become nulls."""
    return elements(spark, path).select(F.from_json("text", schema, {"mode": mode}).alias("r")).select("r.*")


def write(df: DataFrame, path: str) -> None:
    """``df`` as JSON arrays, one for each of its partitions; partitions without rows give empty arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = [("[" if first and i == 0 else ",") + x for i, x in enumerate(batch.column(0).to_pylist())]
            first = first and not lines
            yield pa.record_batch([pa.array(lines, pa.string())], ["value"])
        yield pa.record_batch([pa.array(["[]" if first else "]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.text(path)
