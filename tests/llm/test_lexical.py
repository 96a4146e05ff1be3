"""Ranked search by trees of maxima against brute force."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm import SCHEMA, awkward

from tessella.llm import lexical
from tessella.llm.shared import scratch_path
from tessella.llm.words import texts

rng = random.Random(13)
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower())


def brute(docs, items, k=20):
    split = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    sizes = [c.total() for _, c in split]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        q, scores = Counter(terms(text)), []
        for (i, c), n in zip(split, sizes, strict=True):
            if n:
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if t in c)
                if s > 0:
                    scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def measured(spark, docs, items, k=20):
    path = scratch_path(spark, "test-trees")
    lexical.write_index(docs, path)
    return sorted(tuple(r) for r in lexical.search(spark, path, items, k).select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize(("shard", "chars", "k"), [(1 << 23, 4_000_000, 20), (3000, 300, 3)])
def test_search(spark, monkeypatch, shard, chars, k):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "QUERY_CHARS", chars)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(400)]
    rows = [(i, t) for i, t, *_ in awkward()] + [(100 + i, " ".join(rng.choices(vocab, k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(1000 + i, rows[30 + i // 40][1]) for i in range(80)]  # equal scores, more of them than are asked for
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 25)))) for i in range(30)] + [(50, None), (51, ""), (52, "nowhere-to-be-found"), (53, rows[30][1]), (54, "W1 w1 É é")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "k", "t", 1, 2, 3) for i, t in rows], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, 1, 1.0) for i, t in items], "item_id long, text string, rank int, score double")
    assert measured(spark, docs, asked, k) == brute(rows, items, k)


def test_awkward_rows(spark):
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert measured(spark, spark.createDataFrame([], SCHEMA), one) == []
    docs = spark.createDataFrame([(1, None), (2, "..."), (None, "a b"), (3, "A b"), (3, "a B"), (4, "b c"), (5, "b"), (6, "x " * 30000)], "doc_id long, text string")
    got = measured(spark, docs, one)
    assert [r[:3] for r in got] == [(1, 1, 3), (1, 2, 3)] and got[0][3] == got[1][3] > 0
    assert measured(spark, docs, one, 0) == [] and measured(spark, docs, one.where("false")) == []


def test_thousands_of_query_terms(spark):
    rows = [(i, " ".join(f"t{rng.randint(0, 6000)}" for _ in range(50))) for i in range(300)]
    items = [(i, " ".join(f"t{j}" for j in range(1000 * i, 1000 * i + 1000))) for i in range(6)]
    got = measured(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(rows, items)


def test_long_lengths_do_not_overflow():
    n = np.array([1, 10**8, 3])
    assert lexical.impacts(np.array([1, 2, 3]), n, 10**11, 10**13).tolist() == [(10**9 * t) // (1000 * t + 12 * (75 + 25 * int(x) * 10**11 // 10**13)) for t, x in zip((1, 2, 3), n, strict=True)]


def test_few_nodes_are_opened():
    vocab = [[f"{c}{int(rng.paretovariate(0.5)) % 3000}" for _ in range(3000)] for c in "abcd"]
    docs = [" ".join(rng.choices(rng.choice(vocab), k=rng.randint(20, 60))) for _ in range(8000)]
    data, off = texts(pa.array(docs))
    batch = lexical.index_shard(0, pa.array(range(len(docs))), data, off, len(docs), 40 * len(docs))
    assert sorted(np.frombuffer(batch.column(5).to_pylist()[-1], np.int64).tolist()) == list(range(len(docs)))
    names = batch.column(1).to_pylist()[:-1]
    trees = [np.frombuffer(x, lexical._NODE) for x in batch.column(4).to_pylist()[:-1]]
    posts = [np.frombuffer(x, lexical._POST) for x in batch.column(5).to_pylist()[:-1]]
    search = lexical.ShardSearch(np.arange(len(names)), np.array(batch.column(3).to_pylist()[:-1]), trees, posts, np.arange(len(docs)))
    number = {t: i for i, t in enumerate(names)}
    for _ in range(20):
        own = Counter(terms(rng.choice(docs)))
        at = np.array(sorted(number[t] for t in own))
        weights = np.array([lexical.weight(len(docs), len(posts[i])) for i in at])
        search.best(at, weights, 10, 0)
    assert 0 < search.scored < 0.4 * 20 * len(docs)
