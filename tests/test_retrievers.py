"""Retrievers of all kinds behind one protocol."""
import numpy as np
import pytest

from tessella.operators import bm25, dense
from tessella.operators import retrievers as r
from tessella.operators.runs import GuardError

DOCS = [(0, "the quick brown fox"), (1, "the lazy dog sleeps"), (2, "a quick dog"), (3, None), (4, ""), (5, "quick quick fox fox jumps")]
ASKED = [(0, "quick fox"), (1, "dog"), (2, None), (3, "zebra")]


@pytest.fixture(scope="module")
def world(spark):
    docs, queries = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ASKED, "qid long, text string")
    one, many = r.hashing_encoder(32), r.hashing_encoder(32, per_token=True)
    lexical = bm25.build(docs).cache()
    single = dense.build(r.token_table(docs, "doc_id", one), half=False).cache()
    late = dense.build(r.token_table(docs, "doc_id", many, single=False), half=False).cache()
    return queries, {"bm25": r.Bm25Retriever(lexical), "sv": r.VectorRetriever(single, one), "li": r.LateInteractionRetriever(late, many, 2), "all": r.LateInteractionRetriever(late, many, None), "none": r.NullRetriever()}


def test_one_protocol(world):
    queries, kinds = world
    kinds = kinds | {"rrf": r.FusionRetriever([kinds["bm25"], kinds["sv"]]), "il": r.FusionRetriever([kinds["bm25"], kinds["li"]], "interleave")}
    for name, x in kinds.items():
        assert isinstance(x, r.Retriever)
        got = x.retrieve(queries, 2)
        assert got.columns == ["qid", "doc_id", "score", "rank"]
        rows = got.collect()
        assert all(1 <= z["rank"] <= 2 for z in rows) and len({(z.qid, z["rank"]) for z in rows}) == len(rows)
        if name == "none":
            assert not rows
        else:
            assert {z.qid for z in rows} >= {0, 1} and 2 not in {z.qid for z in rows}
    best = {(name, z.qid): z.doc_id for name in ("bm25", "li", "all", "rrf") for z in kinds[name].retrieve(queries, 1).collect()}
    # Both words are in documents 0 and 5: MaxSim counts each once, so the smaller id is first, BM25 counts repeats.
    assert (best["all", 0], best["bm25", 0]) == (0, 5) and best["bm25", 1] in (1, 2)


def test_vectors_by_hand(world):
    queries, kinds = world

    def vec(text):
        v = np.zeros(32)
        for t in text.split():
            i, s = r._place(t, 32)
            v[i] += s
        return v / max(np.linalg.norm(v), 1e-12)

    want = {(q, d): float(vec(a) @ vec(t)) for q, a in ASKED if a for d, t in DOCS if t is not None}
    got = {(z.qid, z.doc_id): z.score for z in kinds["sv"].retrieve(queries, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_encoder_is_the_same_everywhere(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b a", "", None, "∀ x"] * 20)], "i int, text string")
    one = {i.i % 5: i.v for i in rows.repartition(7).select("i", r.hashing_encoder(16)(rows["text"]).alias("v")).collect()}
    assert one[0] == one[1] and one[3] is None and one[2] == [0.0] * 16 and abs(sum(x * x for x in one[4]) - 1) < 1e-6


def test_fusion_wants_different_parts(world):
    _, kinds = world
    with pytest.raises(GuardError):
        r.FusionRetriever([kinds["bm25"], kinds["bm25"]])
    with pytest.raises(GuardError):
        r.FusionRetriever([kinds["bm25"], kinds["sv"]], "sum")


def test_account(world):
    queries, kinds = world
    found, cost = r.accounted(kinds["bm25"], queries, 2)
    assert cost["n_queries"] == 4 and cost["mean_premises_returned"] == round(found.count() / 4, 2) and cost["total_latency_s"] > 0


def test_a_single_file_is_encoded_by_many_tasks(spark, tmp_path):
    """A table of one file of one row group would be encoded by one task."""
    rows = [(i, f"word{i} word{i % 7} word{i % 7} it's") for i in range(200)] + [(200, None), (201, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    table = r.token_table(spark.read.parquet(f"{tmp_path}/d"), "doc_id", r.hashing_encoder(16, unit=False))
    assert table.rdd.getNumPartitions() > 1
    got = {x.doc_id: x.vec for x in table.collect()}
    for i, text in rows:
        want = None if text is None else np.zeros(16)
        for token in bm25._tokens(text, False):
            at, sign = r._place(token, 16)
            want[at] += sign
        assert got[i] is None if text is None else got[i] == want.tolist()


def test_a_range_holds_numbers_not_strings(monkeypatch):
    """Building an index, a worker holds few texts and each word of a range once, however many rows come in a batch."""
    import random
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(bm25, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(3000)]
    batch = pa.record_batch([pa.array(range(3000)), pa.array(texts)], ["key", "text"])
    del texts
    tracemalloc.start()
    rows = sum(b.num_rows for b in bm25._indexed(False, 1024)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 3 * 5000 and peak < 24e6, peak
