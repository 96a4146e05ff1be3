"""What cited tokens may mean."""
import itertools
import math
import random

import pytest

from tessella.operators import names

CORPUS = ["S.a", "S.b", "N.c", "N.d", "A.card", "B.card", "card_x", "T.card_x", "deep.er.name", "plain", None, "", "S.a"]
SEEN = ["S.a", "S.b", "B.card"]


def table(spark, values, column="name"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def brute(tokens, corpus):
    own = {x for x in corpus if x}
    return sorted({(t, n, "exact" if t in own else "suffix") for t in tokens if t for n in ([t] if t in own else [x for x in own if x.rsplit(".", 1)[-1] == t])})


def test_resolve(spark):
    tokens = ["card", "card_x", "S.a", "a", "name", "er.name", "plain", "omega", None, "", "card"]
    index = names.name_index(table(spark, CORPUS))
    got = sorted(tuple(r) for r in names.resolve(table(spark, tokens, "token"), index).collect())
    assert got == brute(tokens, CORPUS)
    assert [r for r in got if r[0] == "card_x"] == [("card_x", "card_x", "exact")]  # the name itself, not what ends in it
    assert names.resolve(table(spark, tokens, "token"), names.name_index(table(spark, []))).count() == 0
    assert names.resolve(table(spark, [], "token"), index).count() == 0


def test_heavy_endings_are_split(spark):
    rng = random.Random(1)
    corpus = [f"M{i}.mk" for i in range(700)] + [f"M{i}.x{rng.randint(0, 50)}" for i in range(300)]
    tokens = ["mk", "x1", "x2", "M3.mk", "y"]
    index = names.name_index(table(spark, corpus))
    got = names.resolve(table(spark, tokens, "token"), index, heavy=50)
    assert sorted(tuple(r) for r in got.collect()) == brute(tokens, corpus)
    # Rows of the heavy ending are dealt out by part: 14 of them, none of them large.
    parts = index.where("token = 'mk'").selectExpr("pmod(xxhash64(name), 14) p").groupBy("p").count().collect()
    assert len(parts) == 14 and max(r["count"] for r in parts) < 100


def test_novelty_takes_the_widest_reading(spark):
    rows = [(1, ["exact", "N.c"]), (2, ["simp", "S.a", "S.b", "N.d"]), (3, ["omega"]), (4, ["card"]), (5, [])]
    cited = spark.createDataFrame(rows, "pid int, tokens array<string>")
    got = {r.pid: (r.n_cited, r.n_unseen, r.unseen, r.any_unseen) for r in names.novelty(cited, names.name_index(table(spark, CORPUS)), table(spark, SEEN), ["pid"]).collect()}
    assert got == {1: (1, 1, 1.0, True), 2: (3, 1, 1 / 3, True), 3: (0, 0, None, None), 4: (1, 0, 0.0, False), 5: (0, 0, None, None)}
    both = names.novelty(cited.where("pid < 4"), names.name_index(table(spark, CORPUS)), table(spark, SEEN), ["pid"]).selectExpr("*", "'all' arm")
    r = names.stratum(both, "arm").first()
    assert (r.n, r.n_citing, r.n_citing_unseen, r.mean_unseen, r.rate) == (3, 2, 2, round(2 / 3, 6), round(2 / 3, 6))


def test_one_step(spark):
    proofs = spark.createDataFrame([(1, ["exact N.c h"]), (2, ["apply card", " "]), (3, ["exact h₁"]), (4, ["exact fun x => N.c"]), (5, ["intro x", "exact N.c"]), (6, ["exact rfl"]), (7, None)], "id int, proof array<string>")
    got = sorted((r.id, r.head, r.name, r.how) for r in names.one_step(proofs, names.name_index(table(spark, [*CORPUS, "rfl"]))).collect())
    assert got == [(1, "N.c", "N.c", "exact"), (2, "card", "A.card", "suffix"), (2, "card", "B.card", "suffix")]


def test_shuffled_labels():
    """Against all ways to deal the labels out."""
    values, a, b = [0.0, 0.25, 0.5, 1.0], [3, 1, 1, 0], [1, 1, 2, 3]
    flat = [v for v, x, y in zip(values, a, b, strict=True) for v in [v] * (x + y)]
    seen = abs(sum(v * y for v, y in zip(values, b, strict=True)) / sum(b) - sum(v * x for v, x in zip(values, a, strict=True)) / sum(a))
    ways = list(itertools.combinations(range(len(flat)), sum(a)))
    far = sum(abs((sum(flat) - sum(flat[i] for i in w)) / sum(b) - sum(flat[i] for i in w) / sum(a)) >= seen - 1e-12 for w in ways) / len(ways)
    assert names.shuffled_p(values, a, b) == pytest.approx(far, abs=3 * math.sqrt(far * (1 - far) / 10_000))
    assert names.shuffled_p([1.0], [3], [0]) == 1.0 and names.shuffled_p([0.5], [3], [4]) == 1.0


def test_contrasts_of_exclusive_wins(spark):
    rng = random.Random(6)
    rows = [(b, str(i), arm, s, None if s is None else s > 0) for b in "xy" for i in range(80) for arm in ("li", "sv", "none") if rng.random() < 0.5 for s in [rng.choice([None, 0.0, 0.5, 1.0, 1 / 3])]]
    got = {(r.a, r.b): r for r in names.novelty_contrasts(spark.createDataFrame(rows, "benchmark string, pid string, arm string, unseen double, any_unseen boolean"), [("li", "sv"), ("none", "li"), ("sv", "absent")]).collect()}
    for (a, b), r in got.items():
        own = {x: {(k, p): s for k, p, arm, s, _ in rows if arm == x} for x in (a, b)}
        only = [{k: s for k, s in own[x].items() if k not in own[y]} for x, y in ((a, b), (b, a))]
        cites = [[s for s in o.values() if s is not None] for o in only]
        assert (r.n_a, r.n_b) == tuple(map(len, only))
        assert (r.a_unseen, r.a_seen, r.b_unseen, r.b_seen) == tuple(sum(f(s) for s in c) for c in cites for f in (lambda s: s > 0, lambda s: s == 0))
        assert r.mean_a == round(sum(cites[0]) / len(cites[0]), 6)
        values = sorted({*cites[0], *cites[1]})
        assert r.p_shuffled == pytest.approx(names.shuffled_p(values, [cites[0].count(v) for v in values], [cites[1].count(v) for v in values]), abs=1e-6)
    assert got["sv", "absent"].p_fisher == got["sv", "absent"].p_shuffled == 1.0
