"""Token ids in binary files: frequency-ranked, byte-aligned variable length with separate control bytes."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _WHITE_ASCII, STRETCH, Vocabulary, default_vocabulary, vocabulary
from .exchange import slices
from .shared import documents, scratch_path, stored
from .words import packed, spans, texts

#: Bytes of a text that is handed to the library, about. Its time for a word doubles from here to some 4 kB.
TEXT = 1 << 8
#: Ids that are packed or unpacked at once, about.
NUMBERS = 1 << 20
#: A row of a file: its number among the rows of its part, the ids of the part before it, the document, its number of ids,
#: control and data bytes. Parts are folders; they ascend as their numbers do, and rows within them.
ROW = "row long, begin long, doc_id long, n_tokens long, control binary, data binary"
_IDS = "part int, row long, begin long, doc_id long, n_tokens long, ids binary"
#: Bytes of each of a control byte's four numbers, and of all four.
_SIZES = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number's size stands if lists of ``n`` numbers begin at control bytes of their own, and the control bytes before each list."""
    control = np.concatenate([[0], np.cumsum(-(-n // 4))])
    return np.arange(int(n.sum())) + np.repeat(4 * control[:-1] - (np.cumsum(n) - n), n), control


def _pack(numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of lists of ``n`` numbers, one after another, and where each list's begin."""
    x = np.ascontiguousarray(numbers, np.uint32)
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    place, control = _places(n)
    code = np.zeros(4 * int(control[-1]), np.uint8)
    code[place] = size - 1
    code = code.reshape(-1, 4)
    data = x.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    return code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6, control, data, ends[np.concatenate([[0], np.cumsum(n)])]


def _unpack(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of lists of ``n``, their sizes looked up in a table by control byte."""
    size = _SIZES[control].reshape(-1)[_places(n)[0]]
    out = np.zeros((len(size), 4), np.uint8)
    out[np.arange(4) < size[:, None]] = data[: int(size.sum(dtype=np.int64))]
    return out.view(np.uint32).reshape(-1)


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits for each number: its bytes less one) and the numbers' low bytes."""
    control, _, data, _ = _pack(numbers, np.array([len(numbers)]))
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    return _unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), np.array([n]))


class _Encoder(Vocabulary):
    """The tokenizers library, asked once for each chunk that a worker sees and remembers.

    Chunks that begin with a space and don't end with white space are handed over one after another as one text, which the
    library cuts before each of them; their tokens' lengths tell where each ends. The others are texts of their own.
    """

    remembered = 2_000_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(path)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()

    def _library(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def of_chunks(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = start + size - 1
        end, two, three = data[last], data[np.maximum(last - 1, 0)], data[np.maximum(last - 2, 0)]
        # A last byte beyond ASCII may end a white space character only after these.
        row = (data[start] == 0x20) & (size > 1) & ~_WHITE_ASCII[end] & ~((end >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
        order = np.argsort(~row, kind="stable")
        start, size, k = start[order], size[order], int(row.sum())
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = slices(data, start, size)
        cuts = ends[np.unique(np.append(np.searchsorted(ends[: k + 1], np.arange(0, ends[k], TEXT)), k))]
        whole = flat[: ends[k]].tobytes()
        ids = self._library([whole[a:b].decode() for a, b in itertools.pairwise(cuts.tolist())])
        reach = np.cumsum(self.flat_len[np.concatenate([*ids, np.empty(0, np.uint32)])])
        lens = [np.diff(np.concatenate([[0], np.searchsorted(reach, ends[1:k + 1], "left") + 1]))]
        for i in range(k, len(size), 10_000):
            some = self._library([flat[ends[j]:ends[j + 1]].tobytes().decode() for j in range(i, min(len(size), i + 10_000))])
            ids += some
            lens.append(np.fromiter(map(len, some), np.int64, len(some)))
        n = np.concatenate(lens)
        back = np.argsort(order, kind="stable")
        return slices(np.concatenate([*ids, np.empty(0, np.uint32)]), (np.cumsum(n) - n)[back], n[back]), n[back]


_made: dict[str, _Encoder] = {}


def _encode(path: str, end: int, library: bool = True):
    """Ids of texts in the order of a partition, with the number and the begin of each in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if library and path not in _made:
            _made[path] = _Encoder(path)
        encoder = _made[path] if library else vocabulary(path)
        last = np.array([end], np.uint32)
        row = begin = 0

        def out(batch: pa.RecordBatch, lo: int, ids: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal row, begin
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            small = [x.astype(np.uint16).tobytes() if x.max() < 1 << 16 else x.tobytes() for x in ids]
            one = pa.record_batch([batch.column(0).slice(lo, len(ids)), pa.array(np.arange(row, row + len(ids))), pa.array(begin + np.cumsum(n) - n), batch.column(1).slice(lo, len(ids)), pa.array(n), pa.array(small, pa.binary())],
                                  [c.split()[0] for c in _IDS.split(", ")])
            row, begin = row + len(ids), begin + int(n.sum())
            return one

        for batch in batches:
            data, off = texts(batch.column(2))
            at, own = 0, []
            for lo, hi, ids, first in encoder.encode(data, off):
                if own and lo != at:
                    yield out(batch, at, [np.concatenate([*own, last])])
                    own = []
                at = lo
                if int(off[hi] - off[lo]) > STRETCH:  # a text in several blocks
                    own.append(ids)
                else:
                    yield out(batch, lo, [np.concatenate([ids[x:y], last]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            if own:
                yield out(batch, at, [np.concatenate([*own, last])])

    return run


def _some(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch in parts of about ``NUMBERS`` ids or one document, and how many ids each document has."""
    n = batch.column("n_tokens").to_numpy()
    for lo, hi in spans(np.concatenate([[0], np.cumsum(n)]), NUMBERS):
        yield batch.slice(lo, hi - lo), n[lo:hi]


def _ids(part: pa.RecordBatch, n: np.ndarray) -> np.ndarray:
    buffers = (x.as_buffer() for x in part.column("ids"))
    return np.concatenate([np.frombuffer(b, np.uint16 if b.size == 2 * k else np.uint32) for k, b in zip(n.tolist(), buffers, strict=True)])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part, n in _some(batch):
            c = np.bincount(_ids(part, n))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
    ids = np.flatnonzero(total)
    yield pa.record_batch([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def _writer(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n in _some(batch):
                control, first, data, begin = _pack(rank[_ids(part, n)], n)
                yield pa.record_batch([*part.columns[:5], packed(control, first), packed(data, begin)], ["part", "row", "begin", "doc_id", "n_tokens", "control", "data"])

    return run


def write_ids(df: DataFrame, path: str, vocab: str | None = None, key: str = "doc_id", text: str = "text", end: int = 0, library: bool = True) -> None:
    """The ids of all texts, ``end`` after each, into two tables under ``path``: ``ids`` (rows as in ``ROW``, in folders ``part=``, in ascending key order by part and row) and ``ranks`` (id of each rank, one row).

    Null and empty texts have the end id alone. Null keys come first, repeated rows follow one another. No rows: no
    files of ids. The most frequent id has rank 0, ties go to the smaller id; the table of ranks is as large as the
    vocabulary, the only thing that each task gets whole. Other columns are not read. Without ``library`` the transducer
    of ``bpe`` gives the ids, the same ones for less time.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("t")).sortWithinPartitions("doc_id", "t").select(F.spark_partition_id().alias("part"), "doc_id", "t")
    ids = stored(ordered.mapInArrow(_encode(vocab or default_vocabulary(), end, library), _IDS), "ids")
    found = ids.select("n_tokens", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = [r["id"] for r in sorted(found, key=lambda r: (-r["n"], r["id"]))]
    rank = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame([(by_rank,)], "ids array<long>").write.parquet(f"{path}/ranks")
    packed_ = ids.mapInArrow(_writer(rank), "part int, " + ROW)
    packed_.sortWithinPartitions("part", "row").write.option("compression", "none").partitionBy("part").parquet(f"{path}/ids")


def _bytes(column: pa.Array) -> np.ndarray:
    data, off = texts(column)
    return data[int(off[0]):int(off[-1])]


def _reader(by_rank: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n in _some(batch):
                x = by_rank[_unpack(_bytes(part.column("control")), _bytes(part.column("data")), n)]
                first = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(x[a:b]) for a, b in itertools.pairwise(first.tolist())]
                ids = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.view(np.int32)))] if with_ids else []
                yield pa.record_batch([*part.columns[:5], pa.array(crc, pa.int64()), *ids], ["part", "row", "begin", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it in the files), n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    by_rank = np.array(spark.read.schema("ids array<long>").parquet(f"{path}/ranks").first()["ids"], np.uint32)
    rows = spark.read.schema(ROW + ", part int").parquet(f"{path}/ids").select("part", *[c.split()[0] for c in ROW.split(", ")])
    found = rows.mapInArrow(_reader(by_rank, with_ids), "part int, row long, begin long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # One number for each part; the parts ascend.
    sizes = rows.groupBy("part").agg(F.max(F.col("begin") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "part int, before long")
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_vbyte_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vbyte")
    write_ids(documents(spark, sf_dir), path)
    return read_ids(spark, path)
