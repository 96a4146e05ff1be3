"""SimHash and vantage-point trees against brute force."""
import random
import re

import numpy as np
import pytest
import xxhash
from test_llm import SCHEMA, VOCAB, awkward

from tessella.llm import simhash

rng = random.Random(12)


def prose(n):
    return " ".join(rng.choice(VOCAB) + str(rng.randint(0, 300)) for _ in range(n))


def brute_print(text, size=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius=3):
    top = {i: i for i in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


@pytest.mark.parametrize(("chunk", "least", "homes"), [(1 << 16, 128, 16_384), (7, 4, 5)])
def test_groups(spark, monkeypatch, chunk, least, homes):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "LEAST", least)
    monkeypatch.setattr(simhash, "HOMES", homes)
    monkeypatch.setattr(simhash, "VISITORS", 4 * homes)
    rows = [(i, t) for i, t, *_ in awkward()]
    for g in range(4):
        base = prose(200).split(" ")
        for i in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            rows.append((1000 * (g + 1) + i, " ".join(w)))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame([(i, t, "en", None, 1, "k", "t", 1, 2, 3) for i, t in rows], SCHEMA).repartition(6)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: r.print % 2**64 for i, r in got.items()} == prints
    groups = brute_groups(prints)
    assert {i: r.component_id for i, r in got.items()} == groups
    assert 10 < len(set(groups.values())) < len(rows)


def test_awkward_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a  B\nc d"), (8, None), (9, ""), (7, "far other words here"), (6, "one"), (6, "quite another text")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None), (3, 3), (5, 3), (5, 3), (6, 6), (6, 6), (7, 7), (8, 8), (9, 8)]


def clustered(n, r):
    base = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    near = base[r.integers(0, 20, n)]
    for _ in range(5):
        near = near ^ np.where(r.random(n) < 0.6, np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate([base, near]))


def test_every_pair_meets_in_a_shard():
    r = np.random.default_rng(4)
    x = clustered(600, r)
    for least in (1, 20, 300):
        tree = simhash.Tree.fit(x[::3], least, 3)
        home = tree.homes(x)
        reached = {s: set(at.tolist()) for s, at in tree.reached(x, 3)}
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
        assert all(b in reached[home[a]] for a, b in zip(i.tolist(), j.tolist(), strict=True))
        assert len(tree.sizes) == 1 or sum(map(len, reached.values())) < len(x) * len(tree.sizes)


def test_pruning_loses_nothing_and_saves_comparisons():
    x = clustered(3000, np.random.default_rng(5))
    at = np.arange(len(x))
    groups, plain = simhash._Groups(len(x)), simhash._Groups(len(x))
    compared = simhash.near_links(x, at, at, 3, groups)
    plain.join(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3))
    assert (groups.find(at)[:, None] == groups.find(at)).astype(int).tolist() == (plain.find(at)[:, None] == plain.find(at)).astype(int).tolist()
    assert compared < 0.4 * len(x) ** 2 and sum(len(a) for a, _ in groups.links) < len(x)
