"""The late-interaction index against plain numpy."""
import numpy as np
import pytest

from tessella.operators import dense
from tessella.operators.runs import GuardError

DIM = 16


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(0)
    docs = {i: unit(r.normal(size=(r.integers(1, 8), DIM))).astype(np.float32) for i in range(60)}
    docs[61], docs[70] = docs[3], docs[3]  # ties
    queries = {i: unit(r.normal(size=(r.integers(1, 6), DIM))).astype(np.float32) for i in range(9)}
    return docs, queries | {20: docs[3]}


def tables(spark, docs, queries):
    d = spark.createDataFrame([(i, p, v.tolist()) for i, x in docs.items() for p, v in enumerate(x)] + [(None, 0, [1.0] * DIM), (5000, 0, None)], "doc_id long, pos int, vec array<float>").repartition(4)
    q = spark.createDataFrame([(i, p, v.tolist(), 1.0 + (p == 0)) for i, x in queries.items() for p, v in enumerate(x)], "qid long, tok int, vec array<float>, weight double")
    return d, q


def brute(docs, queries, k, only=None, weighted=False):
    out = []
    for qid, q in queries.items():
        w = np.array([1.0 + (weighted and p == 0) for p in range(len(q))])
        s = {i: float((x.astype(float) @ q.astype(float).T).max(axis=0) @ w) for i, x in docs.items() if only is None or i in only[qid]}
        out += [(qid, i, r + 1, round(v, 6)) for r, (i, v) in enumerate(sorted(s.items(), key=lambda t: (-round(t[1], 9), t[0]))[:k])]
    return sorted(out)


def first_stage(docs, queries, n):
    pooled = {i: x.astype(float).mean(axis=0) for i, x in docs.items()}
    pooled = {i: m / np.linalg.norm(m) for i, m in pooled.items()}
    return {qid: [i for i, _ in sorted(((i, float(m @ q.astype(float).sum(axis=0))) for i, m in pooled.items()), key=lambda t: (-round(t[1], 9), t[0]))[:n]] for qid, q in queries.items()}


def measured(df):
    return sorted((r.qid, r.doc_id, r["rank"], round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("block", "numbers", "cells"), [(65_536, 4_000_000, 8_000_000), (40, 100, 50)])
def test_search(spark, tmp_path, monkeypatch, data, block, numbers, cells):
    monkeypatch.setattr(dense, "QUERY_NUMBERS", numbers)
    monkeypatch.setattr(dense, "CELLS", cells)
    docs, queries = data
    d, q = tables(spark, docs, queries)
    dense.save(dense.build(d, half=False, block_tokens=block), str(tmp_path / "i"))
    index = dense.load(spark, str(tmp_path / "i"))
    assert measured(dense.exact_topk(index, q.drop("weight"), 5)) == brute(docs, queries, 5)
    assert measured(dense.exact_topk(index, q, 100)) == brute(docs, queries, 100, weighted=True)
    for n in (5, 12, 1000):
        assert measured(dense.two_stage_topk(index, q.drop("weight"), 5, n)) == brute(docs, queries, 5, first_stage(docs, queries, n))
    assert measured(dense.two_stage_topk(index, q.drop("weight"), 5, 1)) == brute(docs, queries, 5, first_stage(docs, queries, 5))  # as many as are asked for, at least
    assert dense.exact_topk(index, q, 0).count() == 0 and dense.two_stage_topk(index, q.where("false"), 3).count() == 0
    budgets = [5, 12, 1000]
    got = {(r.qid, r.budget): (r.n_exact, r.n_found) for r in dense.recall_per_query(index, q.drop("weight"), budgets, 5).collect()}
    exact = {i: {x[1] for x in brute(docs, {i: v}, 5)} for i, v in queries.items()}
    assert got == {(i, n): (5, len(exact[i] & {x[1] for x in brute(docs, {i: v}, 5, first_stage(docs, {i: v}, n))})) for i, v in queries.items() for n in budgets}
    shares = {r.budget: r for r in dense.recall_at_budgets(dense.recall_per_query(index, q.drop("weight"), budgets, 5)).collect()}
    assert shares[5].micro <= shares[12].micro <= shares[1000].micro == shares[1000].macro == 1.0 and shares[1000].n_lossless == len(queries)
    assert shares[5].micro == round(sum(got[i, 5][1] for i in queries) / sum(got[i, 5][0] for i in queries), 6)


def test_budgets_share_one_pass(spark, data):
    d, q = tables(spark, *data)
    index = dense.build(d).cache()
    plan = dense.recall_per_query(index, q, [5, 6, 7, 8, 9, 20])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4 and plan.count("InMemoryRelation") == 0


def test_half_precision(spark, tmp_path, data):
    docs, queries = data
    d, q = tables(spark, docs, queries)
    dense.save(dense.build(d, block_tokens=50), str(tmp_path / "h"))
    index = dense.load(spark, str(tmp_path / "h"))
    halved = {i: x.astype(np.float16).astype(np.float32) for i, x in docs.items()}
    assert measured(dense.exact_topk(index, q.drop("weight"), 7)) == brute(halved, queries, 7)
    assert sum(len(r.tokens) for r in index.collect()) == 2 * DIM * sum(map(len, docs.values()))
    whole = {r.doc_id: np.array(r.vec) for r in dense.pooled(index).collect()}
    assert all(np.allclose(v, docs[i].astype(float).mean(axis=0) / np.linalg.norm(docs[i].astype(float).mean(axis=0))) for i, v in whole.items()) and len(whole) == len(docs)


def test_refusals(spark, tmp_path, data):
    d, _ = tables(spark, *data)
    index = dense.build(d, block_tokens=60)
    dense.save(index, str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i/blocks"))
    for name, bad in (("offsets", "overlay(offsets placing unhex('09') from 1 for 1)"), ("tokens", "substring(tokens, 3)"), ("n", "n + 1"), ("n_tokens", "n_tokens - 1"), ("offsets", "substring(offsets, 9)")):
        path = str(tmp_path / f"bad-{name}-{len(bad)}")
        rows.selectExpr(*[f"{bad} {c}" if c == name else c for c in rows.columns]).write.parquet(f"{path}/blocks")
        spark.read.parquet(str(tmp_path / "i/meta")).write.parquet(f"{path}/meta")
        with pytest.raises(GuardError):
            dense.load(spark, path)
    for rows_ in (rows.limit(1), rows.where("false")):
        path = str(tmp_path / f"few-{rows_.count()}")
        rows_.write.parquet(f"{path}/blocks")
        spark.read.parquet(str(tmp_path / "i/meta")).write.parquet(f"{path}/meta")
        with pytest.raises(GuardError):
            dense.load(spark, path)
    with pytest.raises(GuardError):
        dense.save(index.where("false"), str(tmp_path / "e"))
