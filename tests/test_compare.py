"""Paired comparisons against resampling and counting by hand."""
import math
import random

import numpy as np
import pytest

from tessella.operators import compare
from tessella.operators.runs import GuardError

SCHEMA = "benchmark string, label string, pid string, solved boolean, status string, names boolean"


def multinomial(n, plus, minus):
    """The distribution of the sum by its definition."""
    r = (n - plus - minus) / n
    out = {}
    for i in range(n + 1):
        for j in range(n + 1 - i):
            p = math.comb(n, i) * math.comb(n - i, j) * (plus / n) ** i * (minus / n) ** j * r ** (n - i - j)
            out[i - j] = out.get(i - j, 0) + p
    return out


@pytest.mark.parametrize("counts", [(1, 1, 0), (1, 0, 0), (12, 10, 2), (20, 0, 0), (20, 3, 3), (30, 0, 7), (9, 9, 0)])
def test_distribution(counts):
    sums, p = compare.distribution(*counts)
    want = multinomial(*counts)
    assert p.sum() == pytest.approx(1) and all(abs(want.get(int(s), 0) - x) < 1e-12 for s, x in zip(sums, p, strict=True))


@pytest.mark.parametrize("counts", [(141, 10, 0), (186, 4, 4), (141, 20, 9), (3000, 400, 350)])
def test_interval_is_what_resampling_tends_to(counts):
    n, plus, minus = counts
    d = np.array([1] * plus + [-1] * minus + [0] * (n - plus - minus))
    r = np.random.default_rng(1)
    means = np.concatenate([d[r.integers(0, n, size=(500, n))].mean(axis=1) for _ in range(20)])
    lo, hi = compare.interval(*counts)
    # Three standard errors of the distribution function at its 2.5 % and 97.5 % points, from 10,000 resamples.
    e = 3 * math.sqrt(0.025 * 0.975 / len(means))
    assert np.quantile(means, 0.025 - e) <= lo <= np.quantile(means, 0.025 + e) and np.quantile(means, 0.975 - e) <= hi <= np.quantile(means, 0.975 + e)


def test_large_numbers_keep_small_tables():
    lo, hi = compare.interval(10**10, 3 * 10**9, 10**9)
    sd = math.sqrt(0.4 - 0.04) / math.sqrt(10**10)
    assert (lo, hi) == (pytest.approx(0.2 - 1.96 * sd, abs=1e-7), pytest.approx(0.2 + 1.96 * sd, abs=1e-7))


def arms(rng, labels, benchmarks=("x", "y"), n=60):
    rows = []
    for b in benchmarks:
        for k, label in enumerate(labels):
            for i in range(n):
                if rng.random() < 0.9:
                    solved = rng.random() < 0.3 + 0.1 * k
                    rows.append((b, label, str(i), solved, "error" if not solved and rng.random() < 0.1 else "done", None if label == "llm" else rng.random() < 0.5))
    return rows


def test_report(spark):
    rows = arms(random.Random(3), ["none", "li@1k", "li@50k", "llm"])
    contrasts = [("none", "li@1k"), ("none", "li@50k"), ("li@1k", "li@50k"), ("none", "llm"), ("none", "absent")]
    got = {(r.baseline, r.treatment, r.benchmark): r.asDict() for r in compare.compare_arms(spark.createDataFrame(rows, SCHEMA), contrasts).collect()}
    assert len(got) == 4 * 3
    of = {(b, label, i): (s, e, names) for b, label, i, s, e, names in rows}
    for (a, t, where), r in got.items():
        pids = [(b, i) for b in ("x", "y") if where in (b, None) for i in map(str, range(60)) if (b, a, i) in of and (b, t, i) in of]
        for end, own in (("", pids), ("_clean", [(b, i) for b, i in pids if of[b, a, i][1] != "error" and of[b, t, i][1] != "error"])):
            x = [(of[b, a, i][0], of[b, t, i][0]) for b, i in own]
            plus, minus = sum(q and not p for p, q in x), sum(p and not q for p, q in x)
            assert (r["n" + end], r["n_baseline" + end], r["n_treatment" + end], r["only_treatment" + end], r["only_baseline" + end]) == (len(x), sum(p for p, _ in x), sum(q for _, q in x), plus, minus)
            lo, hi = compare.interval(len(x), plus, minus)
            p = min(1, 2 * sum(math.comb(plus + minus, k) for k in range(min(plus, minus) + 1)) / 2 ** (plus + minus))
            assert (r["lo" + end], r["hi" + end], r["p" + end]) == (pytest.approx(lo, abs=1e-6), pytest.approx(hi, abs=1e-6), pytest.approx(p, abs=1e-6))
        used = [of[b, t, i][2] for b, i in pids if of[b, t, i][0]]
        assert r["used"] == (None if t == "llm" else pytest.approx(sum(used) / len(used), abs=1e-6))
        assert compare.format_report(r).count("\n") >= 3
    signs = {np.sign(got["none", "li@1k", b]["only_treatment"] - got["none", "li@1k", b]["only_baseline"]) for b in ("x", "y")} - {0}
    assert got["none", "li@1k", None]["heterogeneous"] == (len(signs) > 1)


def test_known_outcome(spark):
    """12 and 22 proofs of 141 problems, none by the baseline alone."""
    rows = [("fate_m", "none", str(i), i < 12, "done", False) for i in range(141)] + [("fate_m", "li", str(i), i < 22, "done", i >= 6) for i in range(141)]
    r = compare.compare_arms(spark.createDataFrame(rows, SCHEMA), [("none", "li")]).where("benchmark is not null").first()
    assert (r.only_treatment, r.only_baseline, r.baseline_is_subset, r.verdict, r.flips, r.union_gain) == (10, 0, True, "significant", False, 0)
    assert r.p == pytest.approx(0.001953125, abs=1e-6) and r.used == round(16 / 22, 6) and r.needed == 1.0


def test_a_verdict_that_hangs_on_errors(spark):
    rows = [("b", "a", str(i), False, "error" if i < 4 else "done", None) for i in range(50)] + [("b", "t", str(i), i < 8, "done", None) for i in range(50)]
    r = compare.compare_arms(spark.createDataFrame(rows, SCHEMA), [("a", "t")]).first().asDict()
    assert (r["verdict"], r["n_clean"], r["only_treatment_clean"], r["flips"]) == ("significant", 46, 4, True) and "report both" in compare.format_report(r)


def test_refusals(spark):
    df = spark.createDataFrame([], SCHEMA)
    for contrasts in ([("a", "a")], [("a", "b"), ("a", "b")]):
        with pytest.raises(GuardError):
            compare.compare_arms(df, contrasts)
    assert compare.compare_arms(df, [("a", "b")]).count() == 0
