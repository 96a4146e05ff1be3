"""Operators against naive versions, golden values and guards."""
import itertools
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessella.functions import stats, text
from tessella.operators import dense
from tessella.operators import retrieval as R
from tessella.operators import reports, runs, search
from tessella.sources import jsonl


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("b,c", [(10, 0), (0, 0), (3, 3), (18, 7), (23, 12), (400, 450)])
def test_mcnemar(spark, b, c):
    n = b + c
    want = 1.0 if n == 0 else min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(min(b, c) + 1)), 2**n)))
    assert value(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(want, rel=1e-9)
    assert value(spark, stats.mcnemar(F.lit(c), F.lit(b))) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("t", [(2, 0, 0, 2), (0, 0, 3, 4), (3, 5, 9, 1), (10, 20, 30, 5)])
def test_fisher(spark, t):
    a, b, c, d = t
    r1, r2, c1 = a + b, c + d, a + c
    p = {x: Fraction(math.comb(r1, x) * math.comb(r2, c1 - x), math.comb(r1 + r2, c1)) for x in range(max(0, c1 - r2), min(c1, r1) + 1)}
    want = 1.0 if 0 in (r1, r2, c1, b + d) else float(sum(v for v in p.values() if v <= p[a]))
    assert value(spark, stats.fisher(*map(F.lit, t))) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("t", [(20_000, 9_900, 19_700, 10_100), (30_000, 30_000, 30_000, 30_000), (50_000, 10, 20, 40_000), (90_000, 300, 88_000, 350)])
def test_fisher_of_large_tables(spark, t):
    """Steps go by the root of the least margin: sums over all tables for each table never ended."""
    a, b, c, d = t
    r1, r2, c1 = a + b, c + d, a + c
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = {x: math.exp(ln(r1, x) + ln(r2, c1 - x) - ln(r1 + r2, c1)) for x in range(max(0, c1 - r2), min(c1, r1) + 1)}
    assert value(spark, stats.fisher(*map(F.lit, t))) == pytest.approx(min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))), abs=1e-7)


def test_bootstrap_draws_are_dealt_out(spark, tmp_path):
    """Ids with gaps over many ranges and without an id: the SQL's interval, with no table gathered in a row and no draws sent to all tasks."""
    import duckdb

    from tessella import registry

    rng = random.Random(5)
    ids = rng.sample(range(-50_000, 100_000), 3000)
    rows = [(i, rng.randint(0, 1), rng.choice([0, 0, 1])) for i in ids] + [(None, 1, 0)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view labels as select * from '{tmp_path}/labels.parquet/*.parquet'")
    got = registry.queries()["bootstrap_md5"](spark, str(tmp_path))
    assert tuple(got.first()) == duck.sql(registry.oracle_sql()["bootstrap_md5"]).fetchall()[0]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan


def test_pass_at_k(spark):
    for n, c, k in itertools.product([8], range(9), range(1, 9)):
        want = 1 - math.comb(n - c, k) / math.comb(n, k)
        assert value(spark, stats.pass_at_k(F.lit(n), F.lit(c), F.lit(k))) == pytest.approx(want, abs=1e-12)


def test_tie_probability(spark):
    assert value(spark, stats.tie_probability(F.lit(6))) == pytest.approx(math.comb(6, 3) / 64)
    assert value(spark, stats.tie_probability(F.lit(5))) is None


def test_maxsim_and_two_stage(spark):
    rng = random.Random(1)
    v = lambda: [rng.gauss(0, 1) for _ in range(8)]
    docs = [(i, v()) for i in range(20) for _ in range(rng.randint(1, 5))]
    qs = [(q, t, v()) for q in range(3) for t in range(4)]
    d = spark.createDataFrame(docs, "doc_id int, vec array<double>")
    q = spark.createDataFrame(qs, "qid int, tok int, vec array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, j): sum(max(dot(t, x) for k, x in docs if k == j) for p, _, t in qs if p == i) for i in range(3) for j in range(20)}
    got = {(r.qid, r.doc_id): r.score for r in R.maxsim(d, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    index = dense.build(d, half=False).cache()
    exact = dense.exact_topk(index, q, 5)
    assert sorted(map(tuple, exact.select("qid", "doc_id", "rank").collect())) == sorted(map(tuple, dense.two_stage_topk(index, q, 5, 20).select("qid", "doc_id", "rank").collect()))
    assert all(r.recall == 1.0 for r in R.recall(exact, exact).collect())


def test_fusion_needs_two(spark):
    with pytest.raises(ValueError):
        R.rrf([spark.range(1)], "q", "d")


def test_text(spark):
    assert value(spark, text.tokens(F.lit("∀x foo_bar, y'"), split_underscores=True)) == ["∀", "x", "foo_bar", "foo", "bar", ",", "y'"]
    assert value(spark, text.admissible(F.lit("exact foo.sorry"))) is None
    assert value(spark, text.admissible(F.lit("by sorry"))) == "unproved"
    assert value(spark, text.admissible(F.lit(" "))) == "empty"
    assert value(spark, text.clean_step(F.lit(" TACTIC: tactic: simp "))) == "simp"
    r = value(spark, text.declaration_parts(F.lit("import A.B\nopen X\n\ntheorem t : 1 = 1 := by rfl")))
    assert (r.imports, r.preamble, r.declaration) == (["import A.B"], "open X", "theorem t : 1 = 1 := by rfl")
    out = lambda s, g, m, e: value(spark, text.step_outcome(F.lit(s), F.array(*map(F.lit, g)).cast("array<string>"), F.array(*map(F.lit, m)).cast("array<string>"), F.array(*map(F.lit, e)).cast("array<string>")))
    assert out("Completed", [], [], []) == "proved"
    assert out("Completed", [], ["uses sorry"], []) == "error"
    assert out("", ["g"], [], []) == "progress"
    assert out("odd", [], [], []) == "progress"
    assert out("", [], [], ["error"]) == "error"


def test_guards(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "arm string, seed int")
    with pytest.raises(runs.GuardError):
        runs.require_same_seeds(d)
    with pytest.raises(runs.GuardError):
        runs.require_unique(d, "arm")
    with pytest.raises(runs.GuardError):
        runs.require_rows(d, 4)
    runs.require_unique(d, "arm", "seed")


def test_search(spark):
    t = [(1, 0, "a", -0.1, "progress", 1), (1, 1, "b", -0.1, "proved", 2), (2, 0, "a", -0.1, "error", 1), (3, 0, "a", -0.2, "progress", 0), (4, 0, "x", -0.1, "crash", 1)]
    r = {x.problem: x for x in search.best_first(spark.createDataFrame(t, "problem long, state long, tactic string, logprob double, outcome string, next long")).collect()}
    assert (r[1].status, list(r[1].proof), r[1].n_expansions) == ("proved", ["a", "b"], 2)
    assert (r[2].status, r[3].status, r[4].status) == ("no_candidates", "no_candidates", "error")


def test_offsets(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 4)
    rng = random.Random(3)
    rows = {k: rng.randint(0, 9) for k in rng.sample(range(-90, 300), 150)}
    want, total = {}, 0
    for k in sorted(rows):
        want[k], total = total, total + rows[k]
    got = R.offsets(spark.createDataFrame(list(rows.items()), "k long, n long").repartition(4), "k", "n")
    assert {r.k: r.start for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "SinglePartition" not in plan
    assert R.offsets(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0


def test_heads_of_equal_frequency(spark):
    rows = [("li", 2, ["rw", "exact", "rw"]), ("li", 1, ["simp", "apply"]), ("li", 3, ["exact", "apply", "omega"])]
    wins = spark.createDataFrame([(a, o, h, "exhausted", len(h), 1, "x", False) for a, o, h in rows], "arm string, ord int, heads array<string>, mode string, n_steps int, n_expansions int, area string, one_step boolean")
    shown = lambda w: [r.head for r in reports.discordance(w, 4)[1].orderBy("rank").collect()]
    assert shown(wins) == ["apply", "rw", "exact", "simp"]  # simp comes first, but once; apply, rw and exact twice, in order of their first
    assert shown(wins.drop("ord")) == ["apply", "exact", "rw", "omega"]


def test_coverage_by_the_first_draw(spark):
    rows = [("b", "li", 0, p, p == "a") for p in "abcd"] + [("b", "li", 1, p, p in "ae") for p in "ae"] + [("b", "li", 2, "b", True), ("b", "li", 3, "a", False)]
    d = spark.createDataFrame(rows, "benchmark string, arm string, seed int, pid string, solved boolean")
    got = {r.k: (r.coverage, r.n_problems) for r in runs.coverage_of_first(d, 4, "seed", "arm").collect()}
    solved = [2, 1, 1]  # a at two seeds, b and e at one each; e isn't one of the first draw's four problems
    want = {k: round(sum(1 - math.comb(4 - c, k) / math.comb(4, k) for c in solved) / 4, 6) for k in range(1, 5)}
    assert got == {k: (v, 4) for k, v in want.items()}
    assert {r.k: r.coverage for r in runs.coverage_of_first(d, 4, "seed").collect()} == want
    assert runs.coverage_of_first(d.where("false"), 4, "seed", "arm").count() == 0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2\n{"a": 3} x\n{"a": " "}\n{"a": 4}\n', encoding="utf-8")
    good, bad = jsonl.read_tolerant(spark, str(p), "a string")
    assert sorted(r.a for r in good.collect()) == ["1", "4", " "]
    assert bad.count() == 2
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), "a int").collect()
    assert jsonl.write(good, str(tmp_path / "out")) == 3
