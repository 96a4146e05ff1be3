"""Run folders, corpora, shards and indices on small files."""
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import prompts, stats, text
from tessella.operators import bm25, guards, reports, runs, search
from tessella.operators.runs import GuardError
from tessella.sources import corpora, jsonl, rundirs, shards

PIECES = [("Nat.add_comm", "∀ (n m : ℕ), n + m = m + n"), ("Nat.mul_comm", "∀ (n m : ℕ), n * m = m * n"), ("Nat.add_assoc", "∀ (n m k : ℕ), n + m + k = n + (m + k)"), ("Set.mem_union", "a ∈ s ∪ t ↔ a ∈ s ∨ a ∈ t")]


def attempt(pid, proved, n=1, **more):
    return {"problem_id": pid, "source": "s", "arm": "li", "status": "proved" if proved else "exhausted", "proved": proved, "proof": ["exact h"] if proved else None, "n_expansions": n, "elapsed_s": 1.5, "trace": [{"depth": 0, "logprob": -0.5, "tactic": "x"}]} | more


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "runs")
    ids = [rundirs.create(spark, path, f"r{i}", {"benchmark": "b", "arm": arm, "policy_kind": "llm", "n_problems": 3, "search": {"max": 64}}, seed=i) for i, arm in enumerate(["li", "sv", "li"])]
    rows = [[attempt("1", True), attempt("2", False), attempt("2", True)], [attempt("1", True), attempt("2", True), attempt("3", False)], [attempt("1", False)]]
    for run, own in zip(ids, rows, strict=True):
        lines = [json.dumps(r) for r in own]
        if run == ids[1]:
            lines[1:1] = ['{"problem_id": "9", "pro', '{"problem_id": "8"} x', ""]
            lines.append(json.dumps(attempt("4", False, error="line sep"), ensure_ascii=False))
        (tmp_path / "runs" / run / "attempts.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "runs" / ids[1] / "verification.json").write_text(json.dumps({"complete": True, "n_claimed": 2, "n_verified": 1, "n_failed": 1, "failures": [{"problem_id": "2", "reason": "x"}]}))
    for i in ids[:2]:
        rundirs.finalize(spark, path, i, {"n_proved": 2})
    return path, ids


def test_runs(spark, root, tmp_path):
    path, ids = root
    assert [r.run for r in rundirs.discover(spark, path, "b", "llm", ["arm=li", "search.max=64"]).collect()] == [ids[0]]
    assert rundirs.discover(spark, path, "b", "llm", ["search.max=65"]).count() == 0
    with pytest.raises(GuardError):
        rundirs.finalize(spark, path, ids[0], {"n": 1})
    good, bad = rundirs.attempts(spark, path)
    assert sorted((r.line_no, r.n_bytes) for r in bad.collect()) == [(1, 24), (2, 21)]
    assert good.where(F.col("error").contains(" ")).count() == 1
    arm = {(r.run, r.problem_id): (r.solved, r.discounted) for r in rundirs.arm(spark, path).collect()}
    assert arm[ids[0], "2"] == (True, False) and arm[ids[1], "2"] == (False, True) and arm[ids[1], "1"] == (True, False)
    draw = {(r.run, r.pid): (r.solved, r.proof) for r in rundirs.draw(spark, path).collect()}
    assert draw[ids[0], "b:2"] == (True, "exact h") and not draw[ids[1], "b:2"][0]
    assert rundirs.raw(spark, path).where("proved").count() == 4
    why = {r.run: r.reason for r in rundirs.unverified(rundirs.manifests(spark, path), rundirs.reports(spark, path)).collect()}
    assert why == {ids[0]: "no report", ids[1]: None, ids[2]: "no report"}
    assert rundirs.export(spark, path, str(tmp_path / "out")) == 2
    out = spark.read.json(str(tmp_path / "out/attempts"))
    assert "trace" not in out.columns and out.count() == 7


def test_repair_and_finish(spark, root, tmp_path):
    path, ids = root
    before = (tmp_path / "runs" / ids[1] / "attempts.jsonl").read_bytes()
    assert rundirs.repair(spark, path, ids[1], dry_run=True) == 2 and rundirs.repair(spark, path, ids[1]) == 2 and rundirs.repair(spark, path, ids[0]) == 0
    assert (tmp_path / "runs" / ids[1] / "attempts.jsonl.bak").read_bytes() == before
    assert rundirs.attempts(spark, path)[1].count() == 0
    own = lambda i: rundirs.attempts(spark, path)[0].where(F.col("run") == ids[i])
    assert rundirs.outcome(own(1), 4) == {"n_attempted": 4, "n_proved": 2, "rate": 0.5, "elapsed_s": 6.0}
    for rows, n in ((own(0), 2), (own(1), 5), (own(1), 3)):
        with pytest.raises(GuardError):
            rundirs.outcome(rows, n)
    rundirs.same_config({"a": 1, "p": 2}, {"a": 1, "p": 3}, ("p",))
    with pytest.raises(GuardError, match="a, c"):
        rundirs.same_config({"a": 1}, {"a": 2, "c": 3})


def test_values_are_compared_as_text(spark):
    config = {"flag": True, "off": False, "x": None, "s": "true", "n": 32, "f": 0.5, "list": ["a", 1], "search": {"max": 64}}
    row = spark.createDataFrame([(json.dumps({"config": config}),)], "text string")
    holds = ["flag=True", "off=False", "x=None", "absent=None", "search.absent=None", "n.deeper=None", "s=true", "n=32", "f=0.5", "list=['a', 1]", "search.max=64"]
    fails = ["flag=true", "s=True", "x=", "n=32.0", "absent=", "list=['a']", "search.max=None"]
    got = row.select(*[rundirs.matches(F.col("text"), [x]).alias(str(i)) for i, x in enumerate(holds + fails)]).first()
    assert list(got) == [True] * len(holds) + [False] * len(fails)


def test_labels_hold_the_budget(spark, tmp_path):
    path = str(tmp_path)
    for n in (1000, 50000, 300, None):
        run = rundirs.create(spark, path, f"r{n}", {"benchmark": "b", "arm": "li", "n_candidates": n} | ({} if n else {"policy_kind": "llm"}))
        (tmp_path / run / "attempts.jsonl").write_text(json.dumps(attempt("1", True) | {"trace": [{"depth": 0, "logprob": -1, "tactic": "x", "outcome": "error", "elapsed_s": 0.5, "error": "e"}]}) + "\n")
    assert {r.label for r in rundirs.manifests(spark, path).collect()} == {"li@1k", "li@50k", "li@300", "li"}
    for read in (rundirs.arm, rundirs.draw, rundirs.raw):
        assert sorted(r.label for r in read(spark, path).collect()) == ["li", "li@1k", "li@300", "li@50k"]
    assert {r.label: r.attributable for r in rundirs.arm(spark, path).collect()} == {"li@1k": True, "li@50k": True, "li@300": True, "li": False}
    step = rundirs.attempts(spark, path)[0].first().trace[0]
    assert (step.outcome, step.elapsed_s, step.error) == ("error", 0.5, "e")


def test_latest_runs(spark, tmp_path):
    path = str(tmp_path)

    def run(name, started, finished=True, log=True, seed=0, **config):
        (tmp_path / name).mkdir()
        manifest = {"run_id": name, "seed": seed, "started_utc": started, "config": {"benchmark": "b", "arm": "li", "n_problems": 3} | config, "outcome": {"n": 1} if finished else None}
        (tmp_path / name / "manifest.json").write_text(json.dumps(manifest))
        if log:
            (tmp_path / name / "attempts.jsonl").write_text(json.dumps(attempt("1", True)) + "\n")

    run("a", "2026-01-01", search={"max_expansions": 64, "samples_per_step": 16})
    run("b", "2026-01-03", search={"max_expansions": 64, "samples_per_step": 32})
    run("c", "2026-01-03", search={"max_expansions": 64, "samples_per_step": 16})  # as late as b, behind it by name
    run("d", "2026-01-09", finished=False)
    run("e", "2026-01-09", log=False)
    run("f", "2026-01-09", policy_kind="llm")
    run("g", "2026-01-09", n_problems=2)
    run("h", "2026-01-02", arm="sv", search={"max_expansions": 64, "samples_per_step": 16})
    got = lambda *a, **k: sorted(r.run for r in rundirs.latest(spark, path, *a, **k).collect())
    assert got() == ["g", "h"] and got(sizes={"b": 3}) == ["b", "h"] and got(sizes={"other": 3}) == ["g", "h"]
    assert got("llm") == ["f"] and got(specs=["search.samples_per_step=16"]) == ["c", "h"]
    rundirs.require_one_budget(spark, path, rundirs.latest(spark, path, specs=["search.samples_per_step=16"]))
    with pytest.raises(GuardError, match="64 x 16.*64 x 32"):
        rundirs.require_one_budget(spark, path, rundirs.latest(spark, path, sizes={"b": 3}))


def test_repair_keeps_every_byte(spark, tmp_path):
    path = str(tmp_path)
    run = rundirs.create(spark, path, "r", {"benchmark": "b"})
    good = [json.dumps(attempt(str(i), True, error="\u2028 ∀" if i else None), ensure_ascii=False).encode() for i in range(3)]
    torn = good[1][: good[1].index("∀".encode()) + 2]  # inside a character
    whole = b"\n".join([good[0], torn, b"", good[1], b"\xff\xfe{", good[2]]) + b"\n"
    log = tmp_path / run / "attempts.jsonl"
    log.write_bytes(whole)
    assert sorted((r.line_no, r.n_bytes) for r in rundirs.attempts(spark, path)[1].collect()) == [(1, len(torn)), (4, 3)]
    assert rundirs.repair(spark, path, run) == 2
    assert (tmp_path / run / "attempts.jsonl.bak").read_bytes() == whole
    assert (tmp_path / run / "attempts.bad.jsonl").read_bytes() == torn + b"\n\xff\xfe{\n"
    assert log.read_bytes() == b"\n".join(good) + b"\n"
    assert rundirs.repair(spark, path, run) == 0


def test_a_manifest_is_never_away(spark, tmp_path):
    path = str(tmp_path / "x.json")
    rundirs.write_text(spark, path, "one")
    rundirs.write_text(spark, path, "two")
    assert rundirs.read_text(spark, path) == "two"
    with pytest.raises(GuardError):
        rundirs.write_text(spark, path, "three", replace=False)
    (tmp_path / "y.json").write_text("three")
    with pytest.raises(Exception, match="exist"):  # someone else has been quicker
        rundirs._rename(spark, str(tmp_path / "y.json"), path, False)
    assert rundirs.read_text(spark, path) == "two"
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["x.json", "y.json"]


def test_names_that_compilers_make(spark):
    made = ["Foo.eq_1", "Foo.inj", "Foo.ndrec", "Foo.eq_def", "Foo.toCtorIdx", "Foo.rec.bar", "rec", "Foo._x", "_x", "Foo.match_12", "Foo.proof_3.x", "Foo.3", "Foo.noConfusionType"]
    own = ["Foo.noConfusionLemma", "Foo.match_1foo", "Nat.eq_zero_of_le_zero", "Foo.eq_", "Foo.record", "Foo.x_", "Foo.inj'"]
    rows = spark.createDataFrame([(x, "theorem") for x in made + own] + [("A.b", "rec"), ("A.c", "quot")], "name string, kind string")
    assert sorted(r.name for r in corpora.written_names(rows).collect()) == sorted(own)


def test_declarations(spark):
    texts = ["import Mathlib\nopen Nat\n\n  theorem a : x := by\n    simp\n", "@[simp] private noncomputable def f := 1", "lemma b : y", "\timport A.B\nset_option x true\n\n\tlemma c\n", "open Nat", "import A\nimport B\n-- note\n@[a, b]\n  protected theorem d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.explode(F.array(text.declaration_parts(F.col("t")))).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in rows] == [
        (["import Mathlib"], "open Nat", "theorem a : x := by\n    simp"), ([], "", "@[simp] private noncomputable def f := 1"), ([], "", "lemma b : y"),
        (["import A.B"], "set_option x true", "lemma c"), ([], "open Nat", None), (["import A", "import B"], "-- note", "@[a, b]\n  protected theorem d")]


def test_corpora(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("ROOT_X", "/data")
    (tmp_path / "c.yaml").write_text("a: ${ROOT_X}/b\nl: [1, '${ROOT_X}']\n")
    assert corpora.load_config(str(tmp_path / "c.yaml")) == {"a": "/data/b", "l": [1, "/data"]}
    (tmp_path / "n.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        corpora.load_config(str(tmp_path / "n.yaml"))
    rows = [{"name": n, "kind": "theorem", "statement": s, "module": "M.T", "is_prop": True} for n, s in PIECES] + [{"name": "x", "kind": "def", "statement": "y" * 5000, "module": "Z", "is_prop": False}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    c = corpora.read_corpus(spark, str(tmp_path / "corpus.jsonl"))
    assert [r.name for r in c.orderBy("ord").collect()] == [r["name"] for r in rows]
    assert corpora.corpus_filter(c, ["theorem"], True, ["M."], 4000).count() == 4 and corpora.corpus_filter(c, None, False, None, None).count() == 5
    problems = [{"id": f"p{i}", "formal_statement": f"import Mathlib\nopen Nat\n\ntheorem t{i} : {i} = {i} := by sorry"} for i in range(2)]
    (tmp_path / "two.jsonl").write_text("\n".join(map(json.dumps, problems)))
    got = corpora.load_benchmark(spark, "two", str(tmp_path), rows={"two": 2}).orderBy("problem_id").collect()
    assert got[0].statement == "open Nat\n\ntheorem t0 : 0 = 0 := by sorry" and got[0].imports == ["import Mathlib"]
    with pytest.raises(GuardError):
        corpora.load_benchmark(spark, "two", str(tmp_path), rows={"two": 3})
    (tmp_path / "files").mkdir()
    for name, body in (("putnam_1999_a1", "theorem x : 1 = 1 := by\n  rfl"), ("putnam_2001_b2", "-- nothing"), ("other", "theorem y : 1 = 1")):
        (tmp_path / "files" / f"{name}.lean").write_text(body)
    with pytest.warns(UserWarning):
        files = corpora.read_problem_files(spark, str(tmp_path / "files")).collect()
    assert [(r.problem_id, r.year, r.problem) for r in files] == [("putnam_1999_a1", 1999, "a1")]


def test_glosses(spark, tmp_path):
    lines = [{"formal_name": "a", "informal_name": "one"}, {"formal_name": "b", "informal_name": "  "}, {"formal_name": "a", "informal_name": "two"}, {"formal_name": ["C", "d"], "informal_name": "three"}]
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    g = corpora.read_glosses(spark, str(tmp_path / "g"))
    assert {r.name: r.gloss for r in g.collect()} == {"a": "two", "C.d": "three"}
    names = spark.createDataFrame([("a",), ("z",)], "name string")
    assert [(r.n, r.n_found, r.coverage) for r in corpora.gloss_coverage(names, g).collect()] == [(2, 1, 0.5)]
    with pytest.raises(Exception, match="cover only"):
        corpora.gloss_coverage(names.where("name = 'z'"), g).collect()
    (tmp_path / "e.jsonl").write_text('{"name": "a", "informal": ""}\n')
    with pytest.raises(GuardError):
        corpora.read_glosses(spark, str(tmp_path / "e.jsonl"))
    theorems = [{"full_name": "t", "traced_tactics": [{"annotated_tactic": ["x"]}, {"annotated_tactic": ["x", json.dumps([{"full_name": "p"}, {"full_name": "q"}])]}]}]
    (tmp_path / "t.json").write_text(json.dumps(theorems))
    seen = corpora.seen_names(corpora.read_json_array(spark, str(tmp_path / "t.json"), corpora.TRACED).withColumn("traced_tactics", F.transform("traced_tactics", lambda x: F.struct(x["annotated_tactic"].alias("annotated")))))
    assert {r.name for r in seen.collect()} == {"p", "q"}
    assert [r.name for r in corpora.written_names(spark.createDataFrame([("A.b", "theorem"), ("A.rec", "def"), ("A.match_1", "def"), ("q", "quot")], "name string, kind string")).collect()] == ["A.b"]


def test_shards_and_indices(spark, tmp_path):
    df = shards.with_shard(spark.range(25).withColumnRenamed("id", "doc_id"), "doc_id", 10)
    path, calls = str(tmp_path / "s"), []
    make = lambda x: (calls.append(x.count()), x.withColumn("vec", F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float"))))[1]
    assert shards.write_missing(df.where("shard < 2"), path, make) == 2 and shards.write_missing(df, path, make) == 1 and shards.write_missing(df, path, make) == 0
    assert calls == [20, 5]
    whole = shards.assembled(spark, path, "doc_id", df)
    assert whole.count() == 25
    with pytest.raises(GuardError):
        shards.assembled(spark, path, "doc_id", spark.range(30).withColumnRenamed("id", "doc_id"))
    shards.save_vectors(whole, str(tmp_path / "v"))
    assert shards.load_vectors(spark, str(tmp_path / "v")).count() == 25
    whole.limit(1).write.mode("append").parquet(str(tmp_path / "v/vectors"))
    with pytest.raises(GuardError):
        shards.load_vectors(spark, str(tmp_path / "v"))


def test_bm25_equals_a_naive_scorer(spark, tmp_path, monkeypatch):
    docs = [(i, f"{n} {s}") for i, (n, s) in enumerate(PIECES)] + [(9, None), (10, "")]
    asked = [(i, s) for i, (_, s) in enumerate(PIECES)] + [(7, "nothing matches zzzz"), (8, None), (9, "Nat.add_comm")]
    index = bm25.build(spark.createDataFrame(docs, "doc_id long, text string"), most_docs=2)
    bm25.save(index, str(tmp_path / "i"))
    loaded = bm25.load(spark, str(tmp_path / "i"))
    import re

    tok = lambda t: re.findall(text.TOKEN, t or "", re.ASCII)
    lens, n = {i: len(tok(t)) for i, t in docs}, len(docs)
    avg = sum(lens.values()) / n
    for block in (4_000_000, 20):
        monkeypatch.setattr(bm25, "QUERY_CHARS", block)
        got = {}
        for r in bm25.rank(loaded, spark.createDataFrame(asked, "item_id long, text string"), 3, params=[(1.5, 0.75), (0.9, 0.4)]).collect():
            got.setdefault((r.setting, r.item_id), []).append((r["rank"], r.doc_id, round(r.score, 6)))
        for p, (k1, b) in enumerate([(1.5, 0.75), (0.9, 0.4)]):
            for q, t in asked:
                score = {}
                for w in set(tok(t)):
                    df = sum(w in tok(x) for _, x in docs)
                    for i, x in docs:
                        if tf := tok(x).count(w):
                            score[i] = score.get(i, 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[i] / avg))
                want = [(r + 1, i, round(s, 6)) for r, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3])]
                assert sorted(got.get((p, q), [])) == want
    loaded.where("term is not null").limit(1).write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "i/postings"))
    with pytest.raises(GuardError):
        bm25.load(spark, str(tmp_path / "i"))
    with pytest.raises(GuardError):
        bm25.save(index.where("false"), str(tmp_path / "e"))


def test_bm25_reads_few_postings(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join([f"topic{i // 50}"] * 3 + [vocabulary[j] for j in rng.zipf(1.3, 30) % 3000])) for i in range(2000)]
    asked = [(t, f"topic{t} w{t}") for t in range(0, 40, 7)] + [(99, "w1 w2")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(4)
    bm25.save(bm25.build(frame, most_docs=50), str(tmp_path / "i"))
    loaded, queries, counts = bm25.load(spark, str(tmp_path / "i")), spark.createDataFrame(asked, "item_id long, text string"), {}
    got = sorted(tuple(r) for r in bm25.rank(loaded, queries, 5, counts=counts).collect())
    for most in (7, 5000):
        assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(tuple(r) for r in bm25.rank(bm25.build(frame, most_docs=most).cache(), queries, 5).collect())]
    of_terms = sum(t.split().count(w) > 0 for _, t in docs for w in {x for _, q in asked for x in q.split()})
    assert 0 < counts["read"] < of_terms < counts["postings"]
    # A search of few terms reads few folders, and none of its plan's scans takes the texts.
    few = bm25._in_buckets(loaded, {"topic7": 0, "w7": 1}).select("range").distinct()
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().toString() or len(few.inputFiles()) < len(loaded.inputFiles())
    assert bm25.rank(loaded, queries, 0).count() == 0 and bm25.rank(loaded, queries.where("false")).count() == 0


def test_guards(spark):
    assert guards.parse_seeds("0-3,7") == {0, 1, 2, 3, 7} and guards.parse_seeds(None) is None
    with pytest.raises(GuardError):
        guards.parse_seeds(" , ")
    for names, mode in ((["a"], "rrf"), (["a", "a"], "rrf"), (["a", "b"], "sum")):
        with pytest.raises(GuardError):
            guards.require_fusion(names, mode)
    guards.require_fusion(["a", "b"], "interleave")
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("a@50k", 1)], "arm string, seed int")
    with pytest.raises(GuardError, match="twice"):
        guards.enforce(guards.duplicates(rows, "arm", "seed"), "twice")
    assert guards.restrict(rows, ["a"], {1}).count() == 1
    assert guards.premise_free(16, 0.5) == (8, 8) and guards.premise_free(5, 0.5) == (3, 2) and guards.premise_free(16, 0.01) == (16, 0) and guards.premise_free(4, 1.0) == (4, 0)
    assert guards.clamp(10, 4) == (4, 4) and guards.clamp(-1, 4) == (0, 4) and guards.clamp(3, 100, 1) == (3, 3)
    with pytest.raises(GuardError):
        reports.budget_matched(rows, "a", "b", 5, 8)


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(stats.mcnemar(F.lit(10), F.lit(0))) == pytest.approx(0.001953125) and one(stats.fisher(*map(F.lit, (2, 0, 0, 2)))) == pytest.approx(1 / 3)
    assert [one(stats.verdict(F.lit(a), F.lit(b), F.lit(p))) for a, b, p in ((0.1, 0.2, 0.01), (0.1, 0.2, 0.2), (-0.1, 0.2, 0.2))] == ["significant", "borderline", "not significant"]
    assert one(prompts.node_score(F.lit(-4.0), F.lit(4))) == -2.0 and one(prompts.node_score(F.lit(-4.0), F.lit(4), 0.0)) == -4.0
    lo, hi, p = reports.stream_tests([1.0] * 18 + [-1.0] * 7 + [0.0] * 302)
    assert (round(lo, 4), round(hi, 4)) == (0.0031, 0.0642) and p == pytest.approx(0.0381, abs=0.01)
    assert reports.stream_tests([0.0] * 5)[2] == 1.0
    assert reports.stream_tests([1.0, 0.0, -1.0, 1.0] * 9, 500, 3) == reports.stream_tests([1.0, 0.0, -1.0, 1.0] * 9, 500, 3, 100)
    pairs = spark.createDataFrame([("x", i, i < 12, i < 22) for i in range(141)], "benchmark string, pid int, a boolean, b boolean")
    r = runs.compare(pairs).where("benchmark is null").first()
    assert (r.n_a, r.n_b, r.only_a, r.only_b, r.baseline_is_subset) == (12, 22, 0, 10, True) and r.p == pytest.approx(0.001953, abs=1e-6)
    named = pairs.withColumn("names", F.when(F.col("b"), F.col("pid") >= 6))
    assert tuple(reports.premise_rates(named).first()) == (22, 16, 0.727273, 10, 10, 1.0)
    assert reports.premise_rates(pairs.withColumn("names", F.lit(None).cast("boolean"))).first().used is None
    assert reports.markdown([{"a": 1, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 1 | — |"


def test_prompts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    decl = F.lit("theorem t (h : a := b) (k : [x := 1]) : p :=\n  by simp")
    assert one(prompts.with_proof(decl, F.array(F.lit("a\nb"), F.lit(" "), F.lit("c")))) == "theorem t (h : a := b) (k : [x := 1]) : p := by\n  a\n  b\n  c"
    assert one(prompts.as_open(F.lit("theorem t : p"))) == "theorem t : p := by sorry"
    none = F.array().cast("array<struct<name:string,informal_name:string,statement:string>>")
    assert one(prompts.tactic_content(F.lit("S"), none)) == "Please generate a tactic in lean4 to solve the state.\nHere're some theorems that may be helpful:\n\nSTATE:\nS\nTACTIC:\n"
    assert one(prompts.left_truncated(F.array(*map(F.lit, range(5))), 2)) == [3, 4]
    assert [one(prompts.one_step_name(F.array(*map(F.lit, s)))) for s in (["exact A.b h", " "], ["exact fun x => y"], ["simp"], ["exact a", "exact b"])] == ["A.b", None, None, None]
    assert one(prompts.one_step_name(F.array(F.lit("exact rfl")), True)) == "rfl"


def test_jsonl_tools(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2} x\n{"k"\n\n')
    assert jsonl.quarantine(spark, str(tmp_path / "a.jsonl"), "k int", str(tmp_path / "g"), str(tmp_path / "b")) == (1, 2)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("t\nu")
    assert [tuple(r) for r in jsonl.read_files(spark, str(tmp_path / "d"), "*.txt").collect()] == [("x.txt", "t\nu")]
    assert [r.id for r in jsonl.resume(spark.range(3), spark.range(2), "id").collect()] == [2]


def test_served(spark):
    def make():
        built = len("built once")
        return lambda rows: rows.assign(n=rows["q"].str.len() + built)

    assert sorted(r.n for r in reports.served(spark.createDataFrame([("a",), ("bcd",)], "q string"), make, "q string, n long").collect()) == [11, 13]


def test_candidates(spark):
    g = [("s", " simp", -4.0, 4), ("s", "TACTIC: simp", -1.0, 4), ("s", "ring", float("nan"), 1), ("s", "exact sorry", -0.1, 1), ("s", "x�", -0.1, 1), ("s", "", -0.1, 1)]
    got = reports.candidates(spark.createDataFrame(g, "state string, raw string, logprob double, n_tokens int")).orderBy("rank").collect()
    assert [(r.step, r.score) for r in got] == [("simp", -0.25), ("ring", float("-inf"))]


def test_search_without_transitions(spark):
    t = spark.createDataFrame([(1, 5, "a", -1.0, "progress", 6)], "problem long, state long, tactic string, logprob double, outcome string, next long")
    assert search.best_first(t).first().status == "no_candidates"
