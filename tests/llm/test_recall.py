"""Corpus operators do the whole job: no fixed cap, no lost rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann


@pytest.mark.parametrize("per,least", [(10, 400), (5, 800)])
def test_ann_recall_with_many_lists(spark, monkeypatch, per, least):
    """Vectors without structure, where a query's neighbours are spread over most lists."""
    monkeypatch.setattr(ann, "PER_LIST", per)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(per * least, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in ann.search(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = n = 0
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.argsort(-s)[:20].tolist())
        hits += len(want & got[q])
        n += 20
    assert hits / n >= 0.9


@pytest.mark.parametrize("copies", [0, 60])
def test_walk_meets_every_list_within_the_ratio(copies):
    """Also where centroids are copies of one, which are only each other's neighbours."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies * 10] = x[0]
    c = ann.fit(x, 600, 1.0)
    for q in c.lifted(x[::200], True):
        d = np.sqrt(((c.at - q) ** 2).sum(axis=1))
        for ratio in (1.05, 1.3, float("inf")):
            at, _ = c.walk(q, ratio)
            assert set(np.flatnonzero(d <= ratio * np.sort(d)[1]).tolist()) <= set(at.tolist())
