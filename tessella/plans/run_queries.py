"""Queries on run logs, corpora, guards and reports, each beside the SQL that says what it returns.

An event is an attempt: its type is the arm, its user the problem (two benchmarks whose ids are the same), its day the seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prompts, stats, text
from ..operators import compare, guards, names, reports, retrieval, runs
from ..registry import query
from ..sources import corpora, json_array, rundirs, scratch
from .queries import IDENT, _t

# --- tables -----------------------------------------------------------------------------------------------------------
_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_A = f"""a AS (SELECT event_id, user_id, ts, value, user_id % 2 benchmark, user_id // 2 pid, event_type arm, (day(ts) - 1) % 8 seed, value >= 100 solved, {_K} k,
CASE WHEN value >= 100 THEN 'proved' WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 5 = 1 THEN 'no_candidates' ELSE 'exhausted' END status,
CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 64 AS INT) END n_expansions, CASE event_id % 3 WHEN 0 THEN 'max_expansions' WHEN 1 THEN 'wall_clock_s' END limit_hit,
CASE WHEN event_id % 4 = 0 THEN ['exact d' || (event_id % 11)] WHEN event_id % 4 = 1 THEN ['intro x', 'simp [d' || (event_id % 13) || ']'] WHEN event_id % 4 = 2 THEN [' ', 'simp'] ELSE ['exact fun h => d' || (event_id % 5)] END proof FROM events)"""
_D = _A + ", dr AS (SELECT benchmark, arm, seed, pid, bool_or(solved) solved, max_by(array_to_string(proof, '\n;;\n'), event_id) FILTER (WHERE solved) proof FROM a GROUP BY ALL)"
_AR = _D + ", ar AS (SELECT benchmark, arm, pid, bool_or(solved) solved FROM dr GROUP BY ALL), pr AS (SELECT x.benchmark, x.pid, x.solved a, y.solved b FROM ar x JOIN ar y ON x.benchmark = y.benchmark AND x.pid = y.pid WHERE x.arm = 'click' AND y.arm = 'view')"


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e, i = _t(spark, d, "events"), F.col("event_id")
    name = lambda n: F.concat(F.lit("d"), (i % n).cast("string"))
    proof = (F.when(i % 4 == 0, F.array(F.concat(F.lit("exact "), name(11)))).when(i % 4 == 1, F.array(F.lit("intro x"), F.concat(F.lit("simp ["), name(13), F.lit("]"))))
             .when(i % 4 == 2, F.array(F.lit(" "), F.lit("simp"))).otherwise(F.array(F.concat(F.lit("exact fun h => "), name(5)))))
    return e.select("event_id", "user_id", "ts", "value", (F.col("user_id") % 2).alias("benchmark"), F.expr("user_id div 2").alias("pid"), F.col("event_type").alias("arm"), ((F.day("ts") - 1) % 8).cast("long").alias("seed"),
                    (F.col("value") >= 100).alias("solved"), F.get_json_object("props", "$.k").cast("int").alias("k"),
                    F.when(F.col("value") >= 100, "proved").when(i % 5 == 0, "error").when(i % 5 == 1, "no_candidates").otherwise("exhausted").alias("status"),
                    F.when(i % 7 > 0, (i % 64).cast("int")).alias("n_expansions"), F.when(i % 3 == 0, "max_expansions").when(i % 3 == 1, "wall_clock_s").alias("limit_hit"), proof.alias("proof"))


def draws(spark: SparkSession, d: str) -> DataFrame:
    a = attempts(spark, d)
    return a.groupBy("benchmark", "arm", "seed", "pid").agg(F.bool_or("solved").alias("solved"), F.max_by(rundirs.proof_text(F.col("proof")), F.when(F.col("solved"), F.col("event_id"))).alias("proof"))


def paired(spark: SparkSession, d: str) -> DataFrame:
    return runs.pairs(draws(spark, d), "click", "view")


# --- corpus -----------------------------------------------------------------------------------------------------------
_C = "c AS (SELECT doc_id, source || '.' || doc_id AS name, lang kind, text statement, source module, n_chars % 2 = 0 is_prop FROM documents)"


def corpus(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.concat_ws(".", "source", F.col("doc_id").cast("string")).alias("name"), F.col("lang").alias("kind"), F.col("text").alias("statement"), F.col("source").alias("module"), (F.col("n_chars") % 2 == 0).alias("is_prop"))


@query("corpus_filter", f"WITH {_C} SELECT doc_id, name, kind FROM c WHERE kind IN ('en', 'de') AND is_prop AND (starts_with(module, 'src1') OR starts_with(module, 'src2')) AND length(statement) <= 4000")
def corpus_filter(spark, d):
    return corpora.corpus_filter(corpus(spark, d), ["en", "de"], True, ["src1", "src2"], 4000).select("doc_id", "name", "kind")


@query("filter_prop", f"WITH {_C} SELECT kind, count(*) n, count(*) FILTER (WHERE is_prop) n_props FROM c GROUP BY kind")
def filter_prop(spark, d):
    c = corpus(spark, d)
    props = corpora.corpus_filter(c, None, True, None, None).groupBy("kind").agg(F.count("*").alias("n_props"))
    return c.groupBy("kind").agg(F.count("*").alias("n")).join(props, "kind", "left").fillna(0, ["n_props"])


@query("json_array_stream", "SELECT doc_id, md5(text) digest, lang, source, n_chars FROM documents")
def json_array_stream(spark, d):
    """The documents written as JSON arrays and read back by splits at elements."""
    path = scratch.path_for(spark, "arrays")
    json_array.write(_t(spark, d, "documents"), path)
    return corpora.read_json_array(spark, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


_MADE = "['" + "', '".join(corpora.GENERATED) + "']"


@query("extract_filter", f"""
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '.') || CASE p_partkey % 9 WHEN 0 THEN '.rec' WHEN 1 THEN '.eq_' || p_size WHEN 2 THEN '.record' WHEN 3 THEN '._x' WHEN 4 THEN '.match_1foo' WHEN 5 THEN '.3' ELSE '' END AS name,
  CASE WHEN p_size % 10 = 0 THEN 'rec' ELSE 'theorem' END kind FROM part)
SELECT p_partkey, name FROM n
WHERE len(list_filter(string_split(name, '.'), lambda c: list_contains({_MADE}, c) OR regexp_full_match(c, '_.*|(eq_|proof_|match_)?[0-9]+'))) = 0 AND kind <> 'rec'""")
def extract_filter(spark, d):
    k = F.col("p_partkey") % 9
    ending = F.when(k == 0, ".rec").when(k == 1, F.concat(F.lit(".eq_"), F.col("p_size").cast("string"))).when(k == 2, ".record").when(k == 3, "._x").when(k == 4, ".match_1foo").when(k == 5, ".3").otherwise("")
    n = _t(spark, d, "part").select("p_partkey", F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), ending).alias("name"), F.when(F.col("p_size") % 10 == 0, "rec").otherwise("theorem").alias("kind"))
    return corpora.written_names(n).select("p_partkey", "name")


_G = "g AS (SELECT conv_id doc_id, max_by(trim(text), turn) gloss FROM conversations WHERE trim(text) <> '' GROUP BY conv_id)"


def glosses(spark, d):
    return corpora.last_gloss(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text", "turn"), "doc_id", "text", "turn").withColumnRenamed("text", "gloss")


@query("gloss_join", f"WITH {_G} SELECT d.doc_id, coalesce(gloss, '') gloss FROM documents d LEFT JOIN g USING (doc_id)")
def gloss_join(spark, d):
    return corpora.with_gloss(_t(spark, d, "documents").select("doc_id"), glosses(spark, d), "doc_id")


@query("gloss_coverage", f"WITH {_G} SELECT count(*) n, count(gloss) n_found, round(count(gloss) / count(*), 4) coverage FROM documents d LEFT JOIN g USING (doc_id)")
def gloss_coverage(spark, d):
    return corpora.gloss_coverage(_t(spark, d, "documents"), glosses(spark, d), "doc_id", 0.01)


@query("premise_documents", f"WITH {_C} SELECT doc_id, md5(name || ' ' || statement) digest FROM c")
def premise_documents(spark, d):
    return corpus(spark, d).select("doc_id", F.md5(prompts.premise_document(F.col("name"), F.col("statement"))).alias("digest"))


@query("seen_premises", f"WITH t AS (SELECT role, unnest(regexp_extract_all(text, '{IDENT}')) w FROM conversations) SELECT DISTINCT w AS name FROM t WHERE role = 'user'")
def seen_premises(spark, d):
    """A turn is a traced tactic, the identifiers of users' turns are the premises that it is annotated with."""
    names = F.to_json(F.transform(text.identifiers(F.col("text")), lambda x: F.struct(x.alias("full_name"))))
    annotated = F.when(F.col("role") == "user", F.array(F.col("text"), names)).otherwise(F.array("text"))
    theorems = _t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(annotated.alias("annotated"))).alias("traced_tactics"))
    return corpora.seen_names(theorems)


@query("corpus_agreement", "SELECT source, count(DISTINCT CASE WHEN lang <> 'en' THEN lang END) n_corpora FROM documents GROUP BY source HAVING count(DISTINCT CASE WHEN lang <> 'en' THEN lang END) > 1")
def corpus_agreement(spark, d):
    return guards.several_corpora(_t(spark, d, "documents").select("source", F.when(F.col("lang") != "en", F.col("lang")).alias("corpus_id")), "source")


# --- runs -------------------------------------------------------------------------------------------------------------
@query("json_config_match", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) k FROM events
WHERE CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'None' ELSE json_extract_string(props, '$.k') END = CAST(user_id % 8 AS VARCHAR)""")
def json_config_match(spark, d):
    k = rundirs.config_text(F.col("props"), "$.k")
    return _t(spark, d, "events").where(k == (F.col("user_id") % 8).cast("string")).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


_LABEL = "arm || CASE WHEN k % 2 = 0 THEN '@' || CASE WHEN k % 4 = 0 THEN '50k' ELSE CAST(k AS VARCHAR) END ELSE '' END"


def _label():
    k = F.col("k")
    return F.concat("arm", F.when(k % 2 == 0, F.concat(F.lit("@"), F.when(k % 4 == 0, "50k").otherwise(k.cast("string")))).otherwise(""))


@query("arm_match", f"WITH {_A}, l AS (SELECT event_id, seed, {_LABEL} label FROM a) SELECT event_id, label, split_part(label, '@', 1) arm FROM l WHERE (label = 'click' OR starts_with(label, 'click@') OR label = 'view@50k') AND seed IN (0, 1, 2, 3, 7)")
def arm_match(spark, d):
    rows = attempts(spark, d).withColumn("label", _label())
    return guards.restrict(rows, ["click", "view@50k"], guards.parse_seeds("0-3,7"), "label").select("event_id", "label", guards.arm_of(F.col("label")).alias("arm"))


@query("seeds_of", f"WITH {_A} SELECT arm, list_sort(list(DISTINCT seed)) seeds FROM a GROUP BY arm")
def seeds_of(spark, d):
    return attempts(spark, d).groupBy("arm").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))


#: Runs of the events: a benchmark, an arm and a seed; those of two seeds in three have a budget of candidates.
_RUN = "'b' || benchmark || '-' || arm || '-s' || seed"
_BUDGET = "CASE WHEN seed % 3 > 0 THEN '@' || (seed % 3) || 'k' ELSE '' END"


def run_folders(spark: SparkSession, d: str) -> str:
    """Writes the events as run folders, with the attempts in order of the events, a manifest and a verification report for each run; returns where."""
    root = scratch.path_for(spark, "runs")
    a = attempts(spark, d).withColumn("run", F.concat(F.lit("b"), "benchmark", F.lit("-"), "arm", F.lit("-s"), "seed"))
    line = F.struct(F.col("pid").cast("string").alias("problem_id"), "arm", "status", F.col("solved").alias("proved"), "proof", "n_expansions", F.col("value").alias("elapsed_s"), "limit_hit")
    rundirs.write_files(a.select("run", "event_id", F.to_json(line).alias("value")), root, "attempts.jsonl", "event_id")
    each = a.groupBy("run", "benchmark", "arm", "seed").agg(F.count_if("solved").alias("n"), F.countDistinct("pid").cast("int").alias("n_problems"), F.max("ts").cast("string").alias("started_utc"))
    config = F.struct(F.col("benchmark").cast("string").alias("benchmark"), "arm", F.when(F.col("seed") % 3 > 0, F.col("seed") % 3 * 1000).alias("n_candidates"), F.when(F.col("seed") % 2 > 0, "llm").alias("policy_kind"), "n_problems")
    manifest = F.struct(F.col("run").alias("run_id"), "seed", "started_utc", config.alias("config"), F.when(F.col("n") > 0, F.struct(F.col("n").alias("n_proved"))).alias("outcome"))
    rundirs.write_files(each.select("run", F.to_json(manifest).alias("value")), root, "manifest.json")
    toxic = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("pid")).distinct()
    bad = a.select("run", "pid").distinct().join(toxic, "pid").groupBy("run").agg(F.sort_array(F.collect_list(F.struct(F.col("pid").cast("string").alias("problem_id"), F.lit("refused").alias("reason")))).alias("failures"))
    report = F.struct(F.lit(True).alias("complete"), F.size("failures").alias("n_failed"), "failures")
    rundirs.write_files(bad.select("run", F.to_json(report).alias("value")), root, "verification.json")
    return root


_BAD = "f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"


@query("failed_verification", f"WITH {_A}, {_BAD} SELECT DISTINCT {_RUN} run, CAST(pid AS VARCHAR) problem_id FROM a JOIN f ON doc_id = pid")
def failed_verification(spark, d):
    return rundirs.failed(spark, run_folders(spark, d))


@query("load_arm", f"""
WITH {_A}, {_BAD},
l AS (SELECT benchmark, arm, seed, pid, max_by(solved, event_id) solved, max_by(status, event_id) status FROM a GROUP BY ALL)
SELECT CAST(benchmark AS VARCHAR) benchmark, arm || {_BUDGET} "label", CAST(seed AS INT) seed, CAST(pid AS VARCHAR) problem_id, solved AND doc_id IS NULL solved,
  solved AND doc_id IS NOT NULL discounted, CASE WHEN doc_id IS NOT NULL THEN 'verify_failed' ELSE status END status, seed % 2 = 0 attributable
FROM l LEFT JOIN f ON doc_id = pid""")
def load_arm(spark, d):
    return rundirs.arm(spark, run_folders(spark, d)).select("benchmark", "label", "seed", "problem_id", "solved", "discounted", "status", "attributable")


@query("load_draw", f"""
WITH {_D}, {_BAD}
SELECT benchmark || ':' || pid pid, arm || {_BUDGET} "label", CAST(seed AS INT) seed, solved AND doc_id IS NULL solved, proof FROM dr LEFT JOIN f ON doc_id = pid""")
def load_draw(spark, d):
    return rundirs.draw(spark, run_folders(spark, d)).select("pid", "label", "seed", "solved", "proof")


@query("discover_runs", f"""
WITH {_A}
SELECT {_RUN} run, CAST(benchmark AS VARCHAR) benchmark, CASE WHEN seed % 2 > 0 THEN 'llm' ELSE 'repertoire' END policy, CAST(count(DISTINCT pid) AS INT) n_problems
FROM a WHERE seed % 3 = 1 GROUP BY benchmark, arm, seed HAVING bool_or(solved)""")
def discover_runs(spark, d):
    return rundirs.discover(spark, run_folders(spark, d), specs=["n_candidates=1000"]).select("run", "benchmark", "policy", "n_problems")


@query("latest_runs", f"""
WITH {_A}, r AS (SELECT {_RUN} run, CAST(benchmark AS VARCHAR) benchmark, arm, seed, arm || {_BUDGET} "label", max(ts) t FROM a WHERE seed % 2 = 0 GROUP BY benchmark, arm, seed HAVING bool_or(solved))
SELECT run, benchmark, arm, "label" FROM r QUALIFY row_number() OVER (PARTITION BY benchmark, arm ORDER BY t DESC, run) = 1""")
def latest_runs(spark, d):
    """The run of each benchmark and arm that a table of results would show."""
    return rundirs.latest(spark, run_folders(spark, d)).select("run", "benchmark", "arm", "label")


@query("export_results", f"""
WITH {_A}, x AS (SELECT *, {_RUN} run FROM a)
SELECT run, CAST(pid AS VARCHAR) problem_id, status, solved proved, n_expansions, limit_hit FROM x WHERE run IN (SELECT run FROM x GROUP BY run HAVING bool_or(solved))""")
def export_results(spark, d):
    out = scratch.path_for(spark, "export")
    rundirs.export(spark, run_folders(spark, d), out)
    return spark.read.schema(f"{rundirs.ATTEMPT}, run string").json(f"{out}/attempts").select("run", "problem_id", "status", "proved", "n_expansions", "limit_hit")


@query("finalize_outcome", f"""
WITH {_A}, p AS (SELECT {_RUN} run, pid, count(*) n, count(*) FILTER (WHERE solved) s, sum(CAST(value AS DECIMAL(20, 6))) e FROM a GROUP BY ALL)
SELECT run, CAST(sum(n) AS BIGINT) n_attempted, CAST(sum(s) AS BIGINT) n_proved, round(sum(s) / sum(n), 4) rate, CAST(round(sum(e), 1) AS DOUBLE) elapsed_s, count(*) FILTER (WHERE n > 1) n_twice FROM p GROUP BY run""")
def finalize_outcome(spark, d):
    return rundirs.outcomes(rundirs.attempts(spark, run_folders(spark, d), rundirs.ATTEMPT)[0])


@query("statements_lookup", f"WITH {_A} SELECT event_id, coalesce(length(text), -1) n_chars FROM a LEFT JOIN documents ON doc_id = pid")
def statements_lookup(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.length("text").alias("n"))
    return attempts(spark, d).join(docs, "pid", "left").select("event_id", F.coalesce("n", F.lit(-1)).cast("long").alias("n_chars"))


@query("pair_without_errors", f"""WITH {_A}, bad AS (SELECT DISTINCT benchmark, pid FROM a WHERE status = 'error' AND arm IN ('click', 'view')), ok AS (SELECT a.* FROM a ANTI JOIN bad USING (benchmark, pid)),
x AS (SELECT benchmark, pid, arm, bool_or(solved) solved FROM ok GROUP BY ALL) SELECT c.benchmark, c.pid, c.solved a, v.solved b FROM x c JOIN x v ON c.benchmark = v.benchmark AND c.pid = v.pid WHERE c.arm = 'click' AND v.arm = 'view'""")
def pair_without_errors(spark, d):
    return runs.pairs(attempts(spark, d), "click", "view", True)


@query("date_formats", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') iso FROM events")
def date_formats(spark, d):
    return _t(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("stamp"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("run_labels", "SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || substr(md5(props), 1, 7) run_id, split_part(props, ':', 1) head FROM events")
def run_labels(spark, d):
    return _t(spark, d, "events").select("event_id", F.concat_ws("_", "event_type", F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.substr(F.md5("props"), F.lit(1), F.lit(7))).alias("run_id"), F.split_part("props", F.lit(":"), F.lit(1)).alias("head"))


# --- predicates on steps ----------------------------------------------------------------------------------------------
_CLOSERS = ", ".join(f"'{c}'" for c in text.CLOSERS)


@query("premise_tactics", f"WITH {_A}, s AS (SELECT event_id, unnest(proof) step, arm = 'click' OR arm = 'view' rep FROM a) SELECT event_id, step, CASE WHEN rep THEN trim(step) NOT IN ({_CLOSERS}) END names FROM s")
def premise_tactics(spark, d):
    s = attempts(spark, d).select("event_id", F.explode("proof").alias("step"), F.col("arm").isin("click", "view").alias("rep"))
    return s.select("event_id", "step", prompts.names_premise(F.col("step"), list(text.CLOSERS), F.col("rep")).alias("names"))


@query("cheats_and_noise", r"SELECT conv_id, turn, regexp_matches(text, '(^|[^A-Za-z0-9_.])(sorry|admit|sorryAx)($|[^A-Za-z0-9_])') cheat, contains(text, chr(65533)) undecodable FROM conversations")
def cheats_and_noise(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", prompts.contains_cheat(F.col("text")).alias("cheat"), prompts.undecodable(F.col("text")).alias("undecodable"))


@query("clean_steps", r"""WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Assistant: TACTIC:  ' || text WHEN 1 THEN ' tactic: ' || text ELSE text END r FROM conversations),
a AS (SELECT *, regexp_replace(r, '^\s+|\s+$', '', 'g') s FROM x), b AS (SELECT *, CASE WHEN starts_with(s, 'Assistant:') THEN regexp_replace(substr(s, 11), '^\s+|\s+$', '', 'g') ELSE s END t FROM a),
c AS (SELECT *, CASE WHEN starts_with(t, 'TACTIC:') THEN regexp_replace(substr(t, 8), '^\s+|\s+$', '', 'g') ELSE t END u FROM b)
SELECT conv_id, turn, CASE WHEN starts_with(u, 'tactic:') THEN regexp_replace(substr(u, 8), '^\s+|\s+$', '', 'g') ELSE u END step FROM c""")
def clean_steps(spark, d):
    t = F.col("turn") % 3
    raw = F.when(t == 0, F.concat(F.lit("Assistant: TACTIC:  "), "text")).when(t == 1, F.concat(F.lit(" tactic: "), "text")).otherwise(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", text.clean_step(raw).alias("step"))


#: A corpus in which some tokens of the proofs are names, others the last components of several names, others neither; and what each token may mean.
_NAMES = """nm AS (SELECT DISTINCT 'd' || (doc_id % 7) AS name FROM documents UNION SELECT source || '.d' || (doc_id % 11) FROM documents WHERE source IS NOT NULL),
ix AS (SELECT name AS token, name, 'exact' how FROM nm UNION SELECT split_part(name, '.', -1), name, 'suffix' FROM nm WHERE contains(name, '.')),
rs AS (SELECT * FROM ix WHERE how = 'exact' OR token NOT IN (SELECT name FROM nm))"""


def cited_names(spark, d):
    docs = _t(spark, d, "documents")
    name = lambda n: F.concat(F.lit("d"), (F.col("doc_id") % n).cast("string"))
    own = docs.select(name(7).alias("name")).union(docs.where("source is not null").select(F.concat("source", F.lit("."), name(11))))
    return scratch.stored(names.name_index(own), "names")


@query("one_step_citation", f"""
WITH {_A}, {_NAMES}, s AS (SELECT event_id, list_filter(list_transform(proof, lambda x: trim(x)), lambda x: x <> '') st FROM a),
h AS (SELECT event_id, regexp_extract(st[1], '^(exact|apply)\\s+({IDENT})', 2) head FROM s WHERE len(st) = 1)
SELECT event_id, head, rs.name, how FROM h JOIN rs ON token = head WHERE head NOT IN ({', '.join(f"'{x}'" for x in prompts.TACTIC_WORDS)})""")
def one_step_citation(spark, d):
    """Proofs of one step that cite what resolves to names of the corpus, with the names."""
    return names.one_step(attempts(spark, d).select("event_id", "proof"), cited_names(spark, d)).select("event_id", "head", "name", "how")


@query("resolve_name", f"""
WITH nm AS (SELECT replace(p_name, ' ', '.') AS name FROM part UNION SELECT 'b' || (item_id % 10) || '.' || unnest(regexp_extract_all(text, '{IDENT}')) FROM benchmark UNION SELECT unnest(regexp_extract_all(text, '{IDENT}')) FROM conversations),
w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{IDENT}')) AS token FROM documents),
ix AS (SELECT name AS token, name, 'exact' how FROM nm UNION SELECT split_part(name, '.', -1), name, 'suffix' FROM nm WHERE contains(name, '.'))
SELECT w.token, ix.name, how FROM w JOIN ix ON ix.token = w.token WHERE ix.name IS NOT NULL AND ix.name <> '' AND (how = 'exact' OR w.token NOT IN (SELECT name FROM nm WHERE name IS NOT NULL)) AND NOT (how = 'suffix' AND w.token = ix.name)""")
def resolve_name(spark, d):
    """Words of the documents against names of parts, words of the benchmark under their item's number, and words of conversations as they are."""
    words = lambda t, c="text": F.explode(text.identifiers(F.col(c))).alias("w")
    own = _t(spark, d, "part").select(F.replace(F.col("p_name"), F.lit(" "), F.lit(".")).alias("name"))
    own = own.union(_t(spark, d, "benchmark").select("item_id", words("text")).select(F.concat(F.lit("b"), (F.col("item_id") % 10).cast("string"), F.lit("."), F.col("w"))))
    own = own.union(_t(spark, d, "conversations").select(words("text")))
    return names.resolve(_t(spark, d, "documents").select(words("text")), scratch.stored(names.name_index(own), "names"), "w")


@query("one_step_loose", f"""WITH {_A}, s AS (SELECT event_id, list_filter(list_transform(proof, lambda x: trim(x)), lambda x: x <> '') st FROM a), h AS (SELECT event_id, regexp_extract(st[1], '^(exact|apply)\\s+({IDENT})', 2) head FROM s WHERE len(st) = 1)
SELECT event_id, head FROM h WHERE head <> '' AND head NOT IN ({', '.join(f"'{x}'" for x in prompts.NOT_A_PREMISE)})""")
def one_step_loose(spark, d):
    return attempts(spark, d).select("event_id", prompts.one_step_name(F.col("proof"), True).alias("head")).where("head is not null")


@query("proof_texts", f"WITH {_A} SELECT event_id, array_to_string(proof, '\n;;\n') proof, len(list_filter(proof, lambda x: contains(x, 'simp'))) > 0 any_simp FROM a")
def proof_texts(spark, d):
    return attempts(spark, d).select("event_id", rundirs.proof_text(F.col("proof")).alias("proof"), F.exists("proof", lambda x: x.contains("simp")).alias("any_simp"))


@query("same_index_path", "WITH x AS (SELECT page_id, url, '/data/' || replace(url, '/', chr(92)) || '/' v FROM pages), y AS (SELECT page_id, rtrim(replace(url, chr(92), '/'), '/') a, rtrim(replace(v, chr(92), '/'), '/') b FROM x) SELECT page_id, a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a) same FROM y")
def same_index_path(spark, d):
    other = F.concat(F.lit("/data/"), F.replace(F.col("url"), F.lit("/"), F.lit("\\")), F.lit("/"))
    return _t(spark, d, "pages").select("page_id", guards.same_index(F.col("url"), other).alias("same"))


@query("problem_statements", "SELECT item_id, md5(CASE WHEN item_id % 2 = 0 THEN trim(text) ELSE trim('open Nat' || chr(10) || chr(10) || text) END) digest FROM benchmark")
def problem_statements(spark, d):
    pre = F.when(F.col("item_id") % 2 == 0, "").otherwise("open Nat")
    return _t(spark, d, "benchmark").select("item_id", F.md5(corpora.problem_statement(pre, F.col("text"))).alias("digest"))


@query("split_statements", """
WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN '@[simp] private ' ELSE '' END || 'theorem t' || p_partkey || ' : ' || p_name || ' := by' || chr(10) || '  simp' d FROM part)
SELECT p_partkey, ['import Mathlib', 'import A.B'] imports, 'open ' || p_brand preamble, d declaration FROM x""")
def split_statements(spark, d):
    """Imports with white space before them, declarations with and without attribute, modifier and indent."""
    mark = F.when(F.col("p_partkey") % 2 == 0, "  @[simp] private ").otherwise("")
    t = F.concat(F.lit("import Mathlib\n\timport A.B\nopen "), "p_brand", F.lit("\n\n"), mark, F.lit("theorem t"), F.col("p_partkey").cast("string"), F.lit(" : "), "p_name", F.lit(" := by\n  simp"))
    return _t(spark, d, "part").select("p_partkey", text.declaration_parts(t).alias("d")).select("p_partkey", "d.imports", "d.preamble", "d.declaration")


@query("statement_with_proof", """SELECT p_partkey, 'theorem t (h : a := b) : ' || p_name || ' := by' || chr(10) || '  intro x' || chr(10) || '  simp' whole, 'theorem t (h : a := b) : ' || p_name || ' := by sorry' AS open FROM part""")
def statement_with_proof(spark, d):
    decl = F.concat(F.lit("theorem t (h : a := b) : "), "p_name", F.lit(" := by trivial"))
    return _t(spark, d, "part").select("p_partkey", prompts.with_proof(decl, F.array(F.lit("intro x"), F.lit(" "), F.lit("simp"))).alias("whole"), prompts.as_open(decl).alias("open"))


_SQL_CHATS = " ".join(f"WHEN {i} THEN '{a}' || q || '{b}'" for i, (a, b) in enumerate(prompts.CHATS.values()))


@query("chat_prompts", f"""WITH x AS (SELECT item_id, '{prompts.INSTRUCTION}' || chr(10) || '{prompts.HELPFUL.replace("'", "''")}' || chr(10) || CASE WHEN item_id % 2 = 0 THEN '' ELSE 'ID:0' || chr(10) || 'Formal name: n' || chr(10) || 'Informal name: ' || chr(10) || 'Formal statement: s' END || chr(10) || 'STATE:' || chr(10) || text || chr(10) || 'TACTIC:' || chr(10) q FROM benchmark)
SELECT item_id, md5(CASE item_id % 5 {_SQL_CHATS} END) digest FROM x""")
def chat_prompts(spark, d):
    one = F.array(F.struct(F.lit("n").alias("name"), F.lit("").alias("informal_name"), F.lit("s").alias("statement")))
    q = prompts.tactic_content(F.col("text"), F.when(F.col("item_id") % 2 == 0, F.slice(one, 1, 0)).otherwise(one))
    out = None
    for i, kind in enumerate(prompts.CHATS):
        out = F.when(F.col("item_id") % 5 == i, prompts.chat(q, kind)) if out is None else out.when(F.col("item_id") % 5 == i, prompts.chat(q, kind))
    return _t(spark, d, "benchmark").select("item_id", F.md5(out).alias("digest"))


@query("step_outcomes", """WITH x AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'incomplete: open goals' WHEN 2 THEN 'done' ELSE 'progress' END status, event_id % 3 goals, event_type = 'error' failed, event_id % 10 = 9 cheat FROM events)
SELECT event_id, CASE WHEN failed OR cheat THEN 'error' WHEN starts_with(status, 'incomplete') AND goals = 0 THEN 'error' WHEN starts_with(status, 'incomplete') OR goals > 0 THEN 'progress' WHEN status IN ('Completed', 'done') THEN 'proved' ELSE 'progress' END outcome FROM x""")
def step_outcomes(spark, d):
    u, i = F.col("user_id") % 4, F.col("event_id")
    status = F.when(u == 0, "Completed").when(u == 1, "incomplete: open goals").when(u == 2, "done").otherwise("progress")
    goals = F.slice(F.array(F.lit("g"), F.lit("g")), 1, (i % 3).cast("int"))
    return _t(spark, d, "events").select("event_id", text.step_outcome(status, goals, F.array(F.when(i % 10 == 9, "uses sorry").otherwise("ok")), F.array(F.when(F.col("event_type") == "error", "error").otherwise("info"))).alias("outcome"))


@query("node_scores", "SELECT event_id, round(-value / power(greatest(user_id % 9, 1), 0.5), 6) score, round(-value / greatest(event_id % 4, 1), 6) mean FROM events")
def node_scores(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(prompts.node_score(-F.col("value"), F.col("user_id") % 9), 6).alias("score"), F.round(prompts.mean_logprob(-F.col("value"), F.col("event_id") % 4), 6).alias("mean"))


@query("lm_propose", r"""WITH x AS (SELECT conv_id state, regexp_replace(text, '^\s+|\s+$', '', 'g') step, -CAST(length(text) AS DOUBLE) / greatest(turn, 1) score FROM conversations),
k AS (SELECT * FROM x WHERE step <> '' AND length(step) <= 2000 AND NOT contains(step, chr(65533)) AND NOT regexp_matches(step, '(^|[^A-Za-z0-9_.])(sorry|admit|sorryAx)($|[^A-Za-z0-9_])') AND NOT regexp_matches(step, '(^|[^A-Za-z0-9_.''])native_decide($|[^A-Za-z0-9_''])') AND NOT contains(step, 'apply?') AND NOT starts_with(step, 'Assistant:') AND NOT starts_with(step, 'TACTIC:') AND NOT starts_with(step, 'tactic:')),
g AS (SELECT state, step, max(score) score FROM k GROUP BY ALL) SELECT state, step, round(score, 6) score, CAST(row_number() OVER (PARTITION BY state ORDER BY score DESC, step) AS INT) rank FROM g QUALIFY rank <= 32""")
def lm_propose(spark, d):
    g = _t(spark, d, "conversations").select(F.col("conv_id").alias("state"), F.col("text").alias("raw"), (-F.length("text")).cast("double").alias("logprob"), F.col("turn").alias("n_tokens"))
    return reports.candidates(g).withColumn("score", F.round("score", 6))


@query("policy_stats", """WITH s AS (SELECT role, count(*) n_prompts, sum(turn % 2) n_free, sum(length(text)) chars, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) n_empty, sum(turn % 3) n_kept, sum(4) n_generated, sum(CASE WHEN contains(text, 'sorry') THEN 1 ELSE 0 END) n_cheats, -sum(0.25 * turn) logprob FROM conversations GROUP BY role)
SELECT role, n_prompts, n_generated, n_kept, round(chars / nullif(n_prompts + n_free, 0), 1) mean_prompt_chars, round(n_kept / nullif(n_prompts, 0), 2) mean_candidates, round(logprob / nullif(n_kept, 0), 4) mean_logprob, round(n_cheats / nullif(n_generated, 0), 4) cheat_rate, round(n_empty / nullif(n_generated, 0), 4) empty_rate FROM s""")
def policy_stats(spark, d):
    c = _t(spark, d, "conversations").select("role", F.lit(1).alias("n_prompts"), (F.col("turn") % 2).alias("n_free"), F.lit(4).alias("n_generated"), (F.trim("text") == "").cast("int").alias("n_empty"), F.col("text").contains("sorry").cast("int").alias("n_cheats"),
                                              (F.col("turn") % 3).alias("n_kept"), F.length("text").alias("chars"), (-0.25 * F.col("turn")).alias("logprob"))
    return reports.policy_stats(c, "role")


# --- reports ----------------------------------------------------------------------------------------------------------
_B = 200
_X = _AR + ", v AS (SELECT benchmark, pid, CAST(b AS INT) - CAST(a AS INT) x FROM pr)"
_POIS = " + ".join(f"CASE WHEN u >= {p!r} THEN 1.0 ELSE 0.0 END" for p in reports.POISSON)


def _tested_sql(values: str, group: str = "", keys: str = "benchmark || '-' || pid", seed: str = "0") -> str:
    g, on = (group + ", ", f"USING ({group})") if group else ("", "ON true")
    by = f"GROUP BY {group}" if group else ""
    return f"""r0 AS (SELECT {g}b, x, CAST('0x' || substr(md5('{seed}' || '-' || b || '-' || {keys}), 1, 8) AS BIGINT) h FROM {values}, unnest(range(0, {_B})) t(b)), r1 AS (SELECT *, h / 4294967296.0::DOUBLE u FROM r0),
r2 AS (SELECT {g}b, sum(({_POIS}) * x) / greatest(sum({_POIS}), 1.0) boot, sum(CASE WHEN h % 2 = 0 THEN 1.0 ELSE -1.0 END * x) / greatest(count(*) FILTER (WHERE x <> 0), 1) flipped FROM r1 GROUP BY {g}b),
o AS (SELECT {g}count(*) n, avg(x) m, count(*) FILTER (WHERE x <> 0) nz, abs(sum(x)) / greatest(count(*) FILTER (WHERE x <> 0), 1) obs FROM {values} {by}),
g1 AS (SELECT {g}n, m, nz, quantile_cont(boot, 0.025) lo, quantile_cont(boot, 0.975) hi, (count(*) FILTER (WHERE abs(flipped) >= obs - 1e-12) + 1) / ({_B} + 1) p0 FROM r2 JOIN o {on} GROUP BY {g}n, m, nz),
g2 AS (SELECT {g}n, round(m, 6) mean, round(lo, 6) lo, round(hi, 6) hi, CASE WHEN nz = 0 THEN 1.0 ELSE p0 END p1 FROM g1)
SELECT {g}n, mean, lo, hi, round(p1, 6) p, CASE WHEN (lo > 0 OR hi < 0) AND p1 < 0.05 THEN 'significant' WHEN (lo > 0 OR hi < 0) OR p1 < 0.05 THEN 'borderline' ELSE 'not significant' END verdict, (lo <= 0 AND hi >= 0) = (p1 >= 0.05) AS agree FROM g2"""


@query("compare_report", f"WITH {_X}, " + _tested_sql("v", "benchmark"))
def compare_report(spark, d):
    """Difference, interval, sign-flip test and verdict of each benchmark."""
    return reports.tested(reports.differences(paired(spark, d)), _B, "0", ("benchmark", "pid"), ("benchmark",))


@query("pooled_report", f"WITH {_X}, " + _tested_sql("v"))
def pooled_report(spark, d):
    return reports.tested(reports.differences(paired(spark, d)), _B)


_CONTRASTS = [("view", "click"), ("view", "purchase"), ("click", "signup"), ("view", "error")]
_ARMS = f"""{_A}, au AS (SELECT benchmark, arm, pid, solved, status = 'error' err, solved AND len(list_filter(proof, lambda x: contains(x, 'd'))) > 0 named FROM a),
av AS (SELECT benchmark, arm, pid, bool_or(solved) solved, bool_or(err) err, bool_or(named) named FROM au GROUP BY benchmark, arm, pid),
am AS (SELECT benchmark, arm, pid, solved, err, CASE WHEN arm <> 'signup' THEN coalesce(named, false) END named FROM av),
ct AS (SELECT * FROM (VALUES {', '.join(str(c) for c in _CONTRASTS)}) v(baseline, treatment)),
pr AS (SELECT baseline, treatment, x.benchmark, x.pid, x.solved a, y.solved b, NOT (x.err OR y.err) clean, y.named FROM ct JOIN am x ON x.arm = baseline JOIN am y ON y.arm = treatment AND y.benchmark = x.benchmark AND y.pid = x.pid),
g AS (SELECT baseline, treatment, benchmark, k.clean_only, count(*) n, count(*) FILTER (WHERE a) n_baseline, count(*) FILTER (WHERE b) n_treatment, count(*) FILTER (WHERE a AND b) n_both,
  count(*) FILTER (WHERE a AND NOT b) only_baseline, count(*) FILTER (WHERE b AND NOT a) only_treatment, count(*) FILTER (WHERE b AND named) used, count(*) FILTER (WHERE b AND NOT a AND named) needed, count(*) FILTER (WHERE b AND named IS NOT NULL) told
  FROM pr, (VALUES (false), (true)) k(clean_only) WHERE clean OR NOT clean_only GROUP BY GROUPING SETS ((baseline, treatment, benchmark, clean_only), (baseline, treatment, clean_only))),
-- The bootstrap's distribution: how likely i problems go one way and j the other, in n draws.
tr AS (SELECT g.*, i - j d, CASE WHEN (only_treatment = 0 AND i > 0) OR (only_baseline = 0 AND j > 0) OR (only_treatment + only_baseline = n AND i + j < n) THEN 0.0 ELSE
  exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(j + 1.0) - lgamma(n - i - j + 1.0) + CASE WHEN i > 0 THEN i * ln(only_treatment / n) ELSE 0 END + CASE WHEN j > 0 THEN j * ln(only_baseline / n) ELSE 0 END
  + CASE WHEN n - i - j > 0 THEN (n - i - j) * ln((n - only_treatment - only_baseline) / n) ELSE 0 END) END p FROM g, unnest(range(0, n + 1)) ti(i), unnest(range(0, n + 1 - i)) tj(j)),
ds AS (SELECT baseline, treatment, benchmark, clean_only, n, d, sum(p) p FROM tr GROUP BY ALL),
cu AS (SELECT *, round(sum(p) OVER (PARTITION BY baseline, treatment, benchmark, clean_only ORDER BY d), 10) f FROM ds),
iv AS (SELECT baseline, treatment, benchmark, clean_only, round(min(d) FILTER (WHERE f >= 0.025) / n, 6) lo, round(min(d) FILTER (WHERE f >= 0.975) / n, 6) hi FROM cu GROUP BY baseline, treatment, benchmark, clean_only, n),
-- Random signs: how likely the rarer way is as rare or rarer.
mc AS (SELECT g.*, CASE WHEN only_treatment + only_baseline = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_treatment, only_baseline) + 1), lambda k:
  exp(lgamma(only_treatment + only_baseline + 1.0) - lgamma(k + 1.0) - lgamma(only_treatment + only_baseline - k + 1.0) - (only_treatment + only_baseline) * ln(2.0))))) END p FROM g),
rp AS (SELECT mc.*, iv.lo, iv.hi, CASE WHEN (lo > 0 OR hi < 0) AND p < 0.05 THEN 'significant' WHEN (lo > 0 OR hi < 0) OR p < 0.05 THEN 'borderline' ELSE 'not significant' END verdict
  FROM mc JOIN iv ON iv.baseline = mc.baseline AND iv.treatment = mc.treatment AND iv.benchmark IS NOT DISTINCT FROM mc.benchmark AND iv.clean_only = mc.clean_only)"""


@query("compare_arms", f"""
WITH {_ARMS}
SELECT x.baseline, x.treatment, CAST(x.benchmark AS VARCHAR) benchmark, x.n, x.n_baseline, x.n_treatment, x.only_baseline, x.only_treatment, least(x.n_baseline, x.n_treatment) - x.n_both union_gain, x.lo, x.hi, round(x.p, 6) p, x.verdict,
  coalesce(c.n, 0) n_clean, coalesce(c.only_baseline, 0) only_baseline_clean, coalesce(c.only_treatment, 0) only_treatment_clean, c.lo lo_clean, c.hi hi_clean, coalesce(round(c.p, 6), 1.0) p_clean,
  coalesce(c.verdict, 'not significant') verdict_clean, (x.verdict = 'significant') <> coalesce(c.verdict = 'significant', false) flips,
  CASE WHEN x.told > 0 THEN round(x.used / nullif(x.n_treatment, 0), 6) END used, CASE WHEN x.told > 0 THEN round(x.needed / nullif(x.only_treatment, 0), 6) END needed
FROM rp x LEFT JOIN rp c ON c.baseline = x.baseline AND c.treatment = x.treatment AND c.benchmark IS NOT DISTINCT FROM x.benchmark AND c.clean_only WHERE NOT x.clean_only""")
def compare_arms(spark, d):
    """Four contrasts of arms, each benchmark and all, with and without problems that ended in errors."""
    named = F.exists("proof", lambda x: x.contains("d"))
    arms = attempts(spark, d).groupBy("benchmark", "arm", "pid").agg(F.bool_or("solved").alias("solved"), F.bool_or(F.col("status") == "error").alias("err"), F.bool_or(F.col("solved") & named).alias("named"))
    arms = arms.select(F.col("benchmark").cast("string").alias("benchmark"), F.col("arm").alias("label"), F.col("pid").cast("string").alias("pid"), "solved", F.when(F.col("err"), "error").otherwise("done").alias("status"), F.when(F.col("arm") != "signup", F.coalesce("named", F.lit(False))).alias("names"))
    return compare.compare_arms(arms, _CONTRASTS).select("baseline", "treatment", "benchmark", "n", "n_baseline", "n_treatment", "only_baseline", "only_treatment", "union_gain", "lo", "hi", "p", "verdict",
                                                         "n_clean", "only_baseline_clean", "only_treatment_clean", "lo_clean", "hi_clean", "p_clean", "verdict_clean", "flips", "used", "needed")


@query("stream_tests")
def stream_tests(spark, d):
    """lo, hi, p of 10,000 resamples and sign flips from one seeded generator over the differences in order of their problems; the number of problems bounds the row that holds them."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi, p = reports.stream_tests(rows.sort_values(["benchmark", "pid"])["x"])
        return pd.DataFrame({"lo": [lo], "hi": [hi], "p": [p]})

    return reports.differences(paired(spark, d)).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "lo double, hi double, p double")


@query("heterogeneous", f"WITH {_X}, g AS (SELECT benchmark, sum(x) d FROM v GROUP BY benchmark) SELECT count(DISTINCT CASE WHEN d <> 0 THEN sign(d) END) > 1 heterogeneous FROM g")
def heterogeneous(spark, d):
    return reports.heterogeneous(reports.differences(paired(spark, d)).groupBy("benchmark").agg(F.sum("x").alias("delta")))


@query("exclusive_lists", f"WITH {_AR} SELECT benchmark, coalesce(list_sort(list(pid) FILTER (WHERE a)), []) only_a, coalesce(list_sort(list(pid) FILTER (WHERE b)), []) only_b FROM pr WHERE a <> b GROUP BY benchmark")
def exclusive_lists(spark, d):
    return reports.exclusive_lists(paired(spark, d))


_RATE = "rt AS (SELECT benchmark, arm, pid, avg(CAST(solved AS DOUBLE)) rate, count(*) n FROM dr GROUP BY ALL)"


@query("rate_contrast", f"WITH {_D}, {_RATE}, v AS (SELECT x.benchmark, x.pid, y.rate - x.rate x FROM rt x JOIN rt y ON x.benchmark = y.benchmark AND x.pid = y.pid WHERE x.arm = 'click' AND y.arm = 'view'), " + _tested_sql("v", seed="rate"))
def rate_contrast(spark, d):
    """Paired difference of the shares of draws that solve a problem."""
    r = draws(spark, d).groupBy("benchmark", "arm", "pid").agg(F.avg(F.col("solved").cast("double")).alias("rate"))
    one = lambda arm, name: r.where(F.col("arm") == arm).select("benchmark", "pid", F.col("rate").alias(name))
    return reports.tested(reports.differences(one("click", "a").join(one("view", "b"), ["benchmark", "pid"])), _B, "rate")


@query("premise_use", f"""WITH {_AR}, n AS (SELECT benchmark, pid, max(CASE WHEN len(list_filter(proof, lambda s: trim(s) NOT IN ({_CLOSERS}))) > 0 THEN 1 ELSE 0 END) = 1 names FROM a WHERE arm = 'view' AND solved GROUP BY ALL),
g AS (SELECT count(*) FILTER (WHERE b) n_solved, count(*) FILTER (WHERE b AND names) n_used, count(*) FILTER (WHERE b AND NOT a) n_only, count(*) FILTER (WHERE b AND NOT a AND names) n_needed FROM pr LEFT JOIN n USING (benchmark, pid))
SELECT n_solved, n_used, round(n_used / nullif(n_solved, 0), 6) used, n_only, n_needed, round(n_needed / nullif(n_only, 0), 6) needed FROM g""")
def premise_use(spark, d):
    named = F.exists("proof", lambda s: prompts.names_premise(s, list(text.CLOSERS), F.lit(True)))
    n = attempts(spark, d).where("arm = 'view' and solved").groupBy("benchmark", "pid").agg(F.bool_or(named).alias("names"))
    return reports.premise_rates(paired(spark, d).join(n, ["benchmark", "pid"], "left"))


@query("loser_profile", f"""WITH {_AR}, w AS (SELECT benchmark, pid FROM pr WHERE a AND NOT b)
SELECT status, count(*) n, median(coalesce(n_expansions, 0)) FILTER (WHERE status = 'exhausted') median_expansions FROM a SEMI JOIN w USING (benchmark, pid) WHERE arm = 'view' GROUP BY status""")
def loser_profile(spark, d):
    return reports.loser_profile(attempts(spark, d), "click", "view")


_WINS = f"""{_AR}, w AS (SELECT benchmark, pid, CASE WHEN a THEN 'click' ELSE 'view' END arm, CASE WHEN a THEN 'view' ELSE 'click' END loser FROM pr WHERE a <> b),
best AS (SELECT benchmark, pid, arm, min_by(proof, event_id) proof, min_by(coalesce(n_expansions, -1), event_id) ne FROM a WHERE solved GROUP BY ALL),
lost AS (SELECT benchmark, pid, arm, max_by(CASE WHEN status = 'exhausted' THEN CASE limit_hit WHEN 'max_expansions' THEN 'max_expansions' WHEN 'wall_clock_s' THEN 'wall_clock' ELSE 'exhausted (None)' END ELSE status END, event_id) AS "mode" FROM a GROUP BY ALL),
wins AS (SELECT w.arm, "mode", list_filter(list_transform(b.proof, lambda s: trim(s)), lambda s: s <> '') st, ne FROM w JOIN best b ON b.benchmark = w.benchmark AND b.pid = w.pid AND b.arm = w.arm JOIN lost l ON l.benchmark = w.benchmark AND l.pid = w.pid AND l.arm = w.loser)"""


def wins(spark, d):
    a = attempts(spark, d)
    p = paired(spark, d).where("a <> b").select("benchmark", "pid", F.when(F.col("a"), "click").otherwise("view").alias("arm"), F.when(F.col("a"), "view").otherwise("click").alias("loser"))
    best = a.where("solved").groupBy("benchmark", "pid", "arm").agg(F.min_by("proof", "event_id").alias("proof"), F.min_by(F.coalesce("n_expansions", F.lit(-1)), "event_id").alias("n_expansions"))
    lost = a.groupBy("benchmark", "pid", F.col("arm").alias("loser")).agg(F.max_by(text.failure_mode(F.col("status"), F.col("limit_hit")), "event_id").alias("mode"))
    j = p.join(best, ["benchmark", "pid", "arm"]).join(lost, ["benchmark", "pid", "loser"])
    st = text.nonblank(F.col("proof"))
    return j.select("arm", "mode", F.size(st).alias("n_steps"), F.nullif("n_expansions", F.lit(-1)).alias("n_expansions"), F.transform(st, text.head).alias("heads"), text.area(rundirs.proof_text(st)).alias("area"), prompts.one_step_name(F.col("proof"), True).isNotNull().alias("one_step"))


@query("discordance_profile", f"""WITH {_WINS} SELECT arm, count(*) n, round(median(len(st)), 1) steps, round(median(nullif(ne, -1)), 1) expansions,
count(*) FILTER (WHERE len(st) = 1 AND regexp_extract(st[1], '^(exact|apply)\\s+({IDENT})', 2) NOT IN ('', {', '.join(f"'{x}'" for x in prompts.NOT_A_PREMISE)})) n_one_step, count(*) FILTER (WHERE "mode" = 'max_expansions') n_loser_at_limit FROM wins GROUP BY arm""")
def discordance_profile(spark, d):
    return reports.discordance(wins(spark, d))[0]


@query("win_profile", f"""WITH {_WINS}, h AS (SELECT arm, regexp_extract(unnest(st), '^\\s*([A-Za-z_][A-Za-z0-9_'']*)', 1) head FROM wins), g AS (SELECT arm, head, count(*) n FROM h GROUP BY ALL) SELECT arm, head, n, CAST(row_number() OVER (PARTITION BY arm ORDER BY n DESC, head) AS INT) rank FROM g QUALIFY rank <= 8""")
def win_profile(spark, d):
    return reports.discordance(wins(spark, d))[1]


#: What each solved problem of an arm cites, and whether any name that a token may mean is among the seen ones.
_CITE = f"""{_A}, {_NAMES},
sn AS (SELECT DISTINCT 'd' || (doc_id % 6) AS name FROM documents UNION SELECT DISTINCT source || '.d' || (doc_id % 11) FROM documents WHERE lang = 'en' AND source IS NOT NULL),
tk AS (SELECT token, bool_or(sn.name IS NOT NULL) seen FROM rs LEFT JOIN sn ON sn.name = rs.name GROUP BY token),
ct AS (SELECT benchmark, pid, arm, list_distinct(flatten(list(flatten(list_transform(proof, lambda x: regexp_extract_all(x, '{IDENT}')))))) tokens FROM a WHERE solved GROUP BY ALL),
e AS (SELECT benchmark, pid, arm, unnest(tokens) AS token FROM ct),
nv AS (SELECT ct.benchmark, ct.pid, ct.arm, count(tk.token) n_cited, count(*) FILTER (WHERE NOT seen) n_unseen
  FROM ct LEFT JOIN e ON e.benchmark = ct.benchmark AND e.pid = ct.pid AND e.arm = ct.arm LEFT JOIN tk ON tk.token = e.token GROUP BY ALL)"""


def _novel(spark, d):
    solved = attempts(spark, d).where("solved").groupBy("benchmark", "pid", "arm").agg(F.array_distinct(F.flatten(F.collect_list(prompts.cited(F.col("proof"))))).alias("tokens"))
    docs = _t(spark, d, "documents")
    name = lambda n: F.concat(F.lit("d"), (F.col("doc_id") % n).cast("string"))
    seen = docs.select(name(6).alias("name")).union(docs.where("lang = 'en'").select(F.concat("source", F.lit("."), name(11))))
    return names.novelty(solved, cited_names(spark, d), seen, ["benchmark", "pid", "arm"])


@query("citation_stratum", f"""
WITH {_CITE}
SELECT arm, count(*) n, count(*) FILTER (WHERE n_cited > 0) n_citing, count(*) FILTER (WHERE n_unseen > 0) n_citing_unseen, round(count(*) FILTER (WHERE n_unseen > 0) / count(*), 6) rate,
  round(avg(n_unseen / nullif(n_cited, 0)), 6) mean_unseen, round(avg(n_cited), 6) mean_cited, round(avg(n_unseen), 6) mean_n_unseen FROM nv GROUP BY arm""")
def citation_stratum(spark, d):
    return names.stratum(_novel(spark, d), "arm")


_LC = "lgamma(CAST({0} AS DOUBLE) + 1) - lgamma(CAST({1} AS DOUBLE) + 1) - lgamma(CAST({0} - {1} AS DOUBLE) + 1)"


@query("novelty_contrast", f"""WITH {_CITE}, t AS (SELECT count(*) FILTER (WHERE arm = 'click' AND n_unseen > 0) a, count(*) FILTER (WHERE arm = 'click' AND n_unseen = 0) b, count(*) FILTER (WHERE arm = 'view' AND n_unseen > 0) c, count(*) FILTER (WHERE arm = 'view' AND n_unseen = 0) d FROM nv WHERE n_cited > 0),
p AS (SELECT t.*, x, exp({_LC.format('(a + b)', 'x')} + {_LC.format('(c + d)', '(a + c - x)')} - ({_LC.format('(a + b + c + d)', '(a + c)')})) q FROM t, unnest(range(greatest(0, a - d), least(a + c, a + b) + 1)) u(x)), o AS (SELECT q FROM p WHERE x = a)
SELECT a, b, c, d, CASE WHEN a + b = 0 OR c + d = 0 OR a + c = 0 OR b + d = 0 THEN 1.0 ELSE round(least(1.0, sum(p.q) FILTER (WHERE p.q <= o.q * (1 + 1e-9))), 6) END p FROM p, o GROUP BY a, b, c, d""")
def novelty_contrast(spark, d):
    """Problems of two arms that cite an unseen name, against those that cite seen ones only: exact test."""
    n = _novel(spark, d).where("n_cited > 0")
    one = lambda arm, c: F.count_if((F.col("arm") == arm) & c)
    any_ = F.col("n_unseen") > 0
    g = n.agg(one("click", any_).alias("a"), one("click", ~any_).alias("b"), one("view", any_).alias("c"), one("view", ~any_).alias("d"))
    return g.withColumn("p", F.round(stats.fisher(*(F.col(x) for x in "abcd")), 6))


@query("novelty_exclusive", f"""
WITH {_CITE}, ct2 AS (SELECT * FROM (VALUES ('click', 'view'), ('click', 'purchase'), ('signup', 'error')) v(a, b)),
sd AS (SELECT a, b, a AS arm, 0 side FROM ct2 UNION ALL SELECT a, b, b, 1 FROM ct2),
x AS (SELECT a, b, benchmark, pid, min(side) side, min(n_cited) n_cited, min(n_unseen) n_unseen FROM nv JOIN sd ON sd.arm = nv.arm GROUP BY a, b, benchmark, pid HAVING count(DISTINCT side) = 1),
t AS (SELECT a x, b y, count(*) FILTER (WHERE side = 0) n_a, count(*) FILTER (WHERE side = 1) n_b, count(*) FILTER (WHERE side = 0 AND n_unseen > 0) a, count(*) FILTER (WHERE side = 0 AND n_cited > 0 AND n_unseen = 0) b,
  count(*) FILTER (WHERE side = 1 AND n_unseen > 0) c, count(*) FILTER (WHERE side = 1 AND n_cited > 0 AND n_unseen = 0) d,
  round(avg(n_unseen / nullif(n_cited, 0)) FILTER (WHERE side = 0), 6) mean_a, round(avg(n_unseen / nullif(n_cited, 0)) FILTER (WHERE side = 1), 6) mean_b FROM x GROUP BY a, b),
p AS (SELECT t.*, z, exp({_LC.format('(a + b)', 'z')} + {_LC.format('(c + d)', '(a + c - z)')} - ({_LC.format('(a + b + c + d)', '(a + c)')})) q FROM t, unnest(range(greatest(0, a - d), least(a + c, a + b) + 1)) u(z)),
o AS (SELECT x, y, q FROM p WHERE z = a)
SELECT p.x a, p.y b, n_a, n_b, p.a a_unseen, p.b a_seen, c b_unseen, d b_seen, mean_a, mean_b,
  CASE WHEN p.a + p.b = 0 OR c + d = 0 OR p.a + c = 0 OR p.b + d = 0 THEN 1.0 ELSE round(least(1.0, sum(p.q) FILTER (WHERE p.q <= o.q * (1 + 1e-9))), 6) END p_fisher
FROM p JOIN o ON o.x = p.x AND o.y = p.y GROUP BY p.x, p.y, n_a, n_b, p.a, p.b, c, d, mean_a, mean_b""")
def novelty_exclusive(spark, d):
    """What problems cite that one arm of a pair alone has solved; the shuffled p has no SQL and is tested."""
    return names.novelty_contrasts(_novel(spark, d), [("click", "view"), ("click", "purchase"), ("signup", "error")]).drop("p_shuffled")


@query("contamination_report", f"""
WITH {_A}, {_NAMES},
h AS (SELECT benchmark, pid, arm, solved, regexp_extract(trim(proof[1]), '^(exact|apply)\\s+({IDENT})', 2) head, len(proof) n FROM a),
o AS (SELECT benchmark, pid, arm, bool_or(solved) solved, bool_or(solved AND n = 1 AND head IN (SELECT token FROM rs) AND head NOT IN ({', '.join(f"'{x}'" for x in prompts.TACTIC_WORDS)})) one_step FROM h GROUP BY ALL),
ctl AS (SELECT benchmark, pid FROM o WHERE arm = 'view' AND solved)
SELECT arm, count(*) FILTER (WHERE o.solved) n_solved, count(*) FILTER (WHERE one_step) n_one_step, count(*) FILTER (WHERE o.solved AND ctl.pid IS NULL) n_won, count(*) FILTER (WHERE one_step AND ctl.pid IS NULL) n_won_one_step
FROM o LEFT JOIN ctl ON ctl.benchmark = o.benchmark AND ctl.pid = o.pid GROUP BY arm""")
def contamination_report(spark, d):
    """Proofs that only cite what the corpus holds under that name or ending, of all that an arm solves and of what the control doesn't."""
    a = attempts(spark, d)
    hits = names.one_step(a.where("solved"), cited_names(spark, d)).select("event_id").distinct().withColumn("hit", F.lit(True))
    o = a.join(hits, "event_id", "left").groupBy("benchmark", "pid", "arm").agg(F.bool_or("solved").alias("solved"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("one_step"))
    control = o.where("arm = 'view' and solved").select("benchmark", "pid", F.lit(True).alias("ctl"))
    new = F.col("ctl").isNull()
    return o.join(control, ["benchmark", "pid"], "left").groupBy("arm").agg(F.count_if("solved").alias("n_solved"), F.count_if("one_step").alias("n_one_step"), F.count_if(F.col("solved") & new).alias("n_won"), F.count_if(F.col("one_step") & new).alias("n_won_one_step"))


@query("distinctness", f"""WITH {_D}, s AS (SELECT * FROM dr WHERE solved) SELECT x.arm a, y.arm b, count(*) n, round(avg(CASE WHEN x.proof = y.proof THEN 1.0 ELSE 0.0 END), 6) identical, avg(CASE WHEN x.proof = y.proof THEN 1.0 ELSE 0.0 END) >= 0.95 AS duplicate
FROM s x JOIN s y ON x.benchmark = y.benchmark AND x.pid = y.pid AND x.seed = y.seed AND x.arm < y.arm GROUP BY ALL""")
def distinctness(spark, d):
    """Arms whose proofs of the problems that both solve at a seed are the same text."""
    x = draws(spark, d).where("solved").select("benchmark", "pid", "seed", "arm", "proof")
    y = x.select("benchmark", "pid", "seed", F.col("arm").alias("b"), F.col("proof").alias("proof2"))
    same = F.avg((F.col("proof") == F.col("proof2")).cast("double"))
    return x.join(y, ["benchmark", "pid", "seed"]).where("arm < b").groupBy(F.col("arm").alias("a"), "b").agg(F.count("*").alias("n"), F.round(same, 6).alias("identical"), (same >= 0.95).alias("duplicate"))


_ROOT = "rq AS (SELECT benchmark, pid, arm, avg(-value) mean, max(-value) best, count(*) n FROM a WHERE k % 2 = 0 GROUP BY ALL)"


def _roots(spark, d):
    """Every event is an entry of its problem's trace; half of them lie at the root."""
    a = attempts(spark, d).groupBy("benchmark", "pid", "arm").agg(F.collect_list(F.struct((F.col("k") % 2).alias("depth"), (-F.col("value")).alias("logprob"))).alias("trace"))
    return reports.root_candidates(a, ["benchmark", "pid", "arm"])


@query("root_candidates", f"WITH {_A}, {_ROOT} SELECT benchmark, pid, arm, n, round(mean, 6) mean, round(best, 6) best FROM rq")
def root_candidates(spark, d):
    return _roots(spark, d).withColumn("mean", F.round("mean", 6)).withColumn("best", F.round("best", 6))


@query("root_quality", f"WITH {_A}, {_ROOT} SELECT x.arm a, y.arm b, count(*) n, round(avg(y.mean - x.mean), 6) delta FROM rq x JOIN rq y ON x.benchmark = y.benchmark AND x.pid = y.pid AND x.arm <> y.arm GROUP BY ALL")
def root_quality(spark, d):
    return reports.paired_roots(_roots(spark, d))


_PK = "1 - list_reduce(list_concat([1.0::DOUBLE], list_transform(range(0, {k}), lambda i: greatest(0.0, CAST(8 - {c} - i AS DOUBLE) / (8 - i)))), lambda x, y: x * y)"
_BM = f"""cc AS (SELECT benchmark, pid, count(*) FILTER (WHERE solved AND arm = 'click') ca, count(*) FILTER (WHERE solved AND arm = 'view') cb, count(DISTINCT CASE WHEN solved THEN seed END) ce FROM dr WHERE arm IN ('click', 'view') GROUP BY ALL),
bm AS (SELECT benchmark, pid, {_PK.format(k=4, c='ce')} AS "both", {_PK.format(k=8, c='ca')} a, {_PK.format(k=8, c='cb')} b FROM cc)"""


@query("budget_matched_report", f'WITH {_D}, {_BM}, v AS (SELECT benchmark, pid, "both" - a x FROM bm), ' + _tested_sql("v", seed="budget"))
def budget_matched_report(spark, d):
    """Four draws of each arm against eight of one: difference, interval, test, and whether both agree."""
    b = reports.budget_matched(draws(spark, d), "click", "view", 4, 8)
    return reports.tested(b.select("benchmark", "pid", (F.col("both") - F.col("a")).alias("x")), _B, "budget")


@query("noise_report", f"""WITH {_D}, j AS (SELECT CASE WHEN x.arm <> y.arm THEN 'across' ELSE 'within ' || x.arm END kind, x.seed s, y.seed t, count(*) FILTER (WHERE x.solved <> y.solved) / count(*) dd, count(*) FILTER (WHERE x.solved OR y.solved) - greatest(count(*) FILTER (WHERE x.solved), count(*) FILTER (WHERE y.solved)) gain
FROM dr x JOIN dr y ON x.benchmark = y.benchmark AND x.pid = y.pid WHERE (x.arm = y.arm AND x.seed < y.seed AND x.arm IN ('click', 'view')) OR (x.arm = 'click' AND y.arm = 'view') GROUP BY ALL),
r AS (SELECT kind, count(*) n_pairs, min(dd) d_lo, avg(dd) d_mean, max(dd) d_hi, min(gain) gain_lo, avg(gain) gain_mean, max(gain) gain_hi FROM j GROUP BY kind), f AS (SELECT max(d_hi) f FROM r WHERE kind <> 'across')
SELECT kind, n_pairs, round(d_lo, 6) d_lo, round(d_mean, 6) d_mean, round(d_hi, 6) d_hi, gain_lo, round(gain_mean, 6) gain_mean, gain_hi, CASE WHEN kind = 'across' THEN d_mean > f END AS above FROM r, f""")
def noise_report(spark, d):
    return reports.noise_and_contrast(draws(spark, d), "click", "view")


_REQ = "q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'proofnet_test' WHEN 1 THEN 'fate_m' ELSE 'other' END benchmark, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'sv' WHEN 2 THEN 'li' ELSE 'fusion' END arm, 64 * (1 + p_size % 2) expansions, 16 * (1 + p_size % 3) samples, CASE WHEN p_size % 5 > 0 THEN p_size END n_problems, (p_size % 2) * 0.25::DOUBLE premise_free FROM part)"


@query("project_hours", f"""WITH {_REQ}, m(benchmark, arm, r, g) AS (VALUES {', '.join(f"('{b}', '{a}', {r}::DOUBLE, {g}::DOUBLE)" for b, a, r, g in reports.MEASURED)}), s(benchmark, sz) AS (VALUES {', '.join(f"('{b}', {n})" for b, n in reports.SIZES)}),
t(benchmark, ms) AS (VALUES {', '.join(f"('{b}', {ms}::DOUBLE)" for b, ms in reports.QUERY_MS.items())})
SELECT p_partkey, q.arm, round((r * CASE WHEN q.arm = 'fusion' THEN coalesce((ms + 520) / ms, 1.52) ELSE 1 END * expansions / 64 + g * expansions / 64 * samples / 16) * CASE WHEN premise_free > 0 THEN 1.06 ELSE 1 END * CASE WHEN expansions <> 64 OR samples <> 16 OR premise_free > 0 OR q.arm = 'fusion' THEN 1.25 ELSE 1 END * CASE WHEN n_problems > 0 THEN n_problems / coalesce(sz, n_problems) ELSE 1 END, 6) AS "hours"
FROM q LEFT JOIN m ON m.benchmark = q.benchmark AND m.arm = CASE q.arm WHEN 'fusion' THEN 'li' ELSE q.arm END LEFT JOIN s ON s.benchmark = q.benchmark LEFT JOIN t ON t.benchmark = q.benchmark""")
def project_hours(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    q = _t(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "proofnet_test").when(k % 3 == 1, "fate_m").otherwise("other").alias("benchmark"), F.when(k % 4 == 0, "none").when(k % 4 == 1, "sv").when(k % 4 == 2, "li").otherwise("fusion").alias("arm"),
                                    (64 * (1 + z % 2)).alias("expansions"), (16 * (1 + z % 3)).alias("samples"), F.when(z % 5 > 0, z).alias("n_problems"), ((z % 2) * 0.25).alias("premise_free"))
    return reports.project_hours(q).select("p_partkey", "arm", F.round("hours", 6).alias("hours"))


@query("budget_group", f"WITH {_A} SELECT benchmark, k max_expansions, CAST(seed AS INT) samples, count(*) n_runs, list_sort(list(DISTINCT arm)) arms FROM a GROUP BY ALL")
def budget_group(spark, d):
    return reports.budgets(attempts(spark, d).select("benchmark", F.col("k").alias("max_expansions"), F.col("seed").cast("int").alias("samples"), "arm"))


@query("figure_curves", f"WITH {_D}, c AS (SELECT benchmark, arm, pid, count(*) FILTER (WHERE solved) c FROM dr GROUP BY ALL), g AS (SELECT arm, kk, {_PK.format(k='kk', c='c')} p FROM c, unnest(range(1, 9)) t(kk)) SELECT arm, CAST(kk AS INT) k, CAST(kk AS BIGINT) * 64 * 16 generations, round(sum(p), 6) expected FROM g GROUP BY arm, kk")
def figure_curves(spark, d):
    """Expected number of solved problems against generations: what the pass@k figures plot."""
    c = draws(spark, d).groupBy("benchmark", "arm", "pid").agg(F.count_if("solved").alias("c")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return c.groupBy("arm", "k").agg(F.round(F.sum(stats.pass_at_k(F.lit(8), F.col("c"), F.col("k"))), 6).alias("expected")).select("arm", "k", (F.col("k").cast("long") * 64 * 16).alias("generations"), "expected")


@query("figure_unions", f"WITH {_AR} SELECT benchmark, count(*) FILTER (WHERE a AND b) AS \"both\", count(*) FILTER (WHERE a AND NOT b) only_a, count(*) FILTER (WHERE b AND NOT a) only_b, count(*) FILTER (WHERE NOT a AND NOT b) neither FROM pr GROUP BY benchmark")
def figure_unions(spark, d):
    c = lambda x: F.count_if(x)
    a, b = F.col("a"), F.col("b")
    return paired(spark, d).groupBy("benchmark").agg(c(a & b).alias("both"), c(a & ~b).alias("only_a"), c(b & ~a).alias("only_b"), c(~a & ~b).alias("neither"))


@query("table1_deltas", f"WITH {_AR}, g AS (SELECT benchmark, count(*) FILTER (WHERE solved AND arm = 'click') click, count(*) FILTER (WHERE solved AND arm = 'view') AS \"view\", count(*) FILTER (WHERE solved AND arm = 'purchase') purchase, count(DISTINCT CASE WHEN solved THEN pid END) any_arm FROM ar GROUP BY benchmark) SELECT *, \"view\" - click AS delta_view, purchase - click AS delta_purchase FROM g")
def table1_deltas(spark, d):
    a = runs.by_arm(draws(spark, d))
    g = a.groupBy("benchmark").agg(*[F.count_if(F.col("solved") & (F.col("arm") == x)).alias(x) for x in ("click", "view", "purchase")], F.countDistinct(F.when(F.col("solved"), F.col("pid"))).alias("any_arm"))
    return g.withColumn("delta_view", F.col("view") - F.col("click")).withColumn("delta_purchase", F.col("purchase") - F.col("click"))


# --- guards: each returns what it refuses -----------------------------------------------------------------------------
@query("guard_duplicates", f"WITH {_A} SELECT arm, seed, count(*) n_rows FROM a GROUP BY ALL HAVING count(*) > 1")
def guard_duplicates(spark, d):
    return guards.duplicates(attempts(spark, d), "arm", "seed")


_SET = "SELECT arm, 'k' setting, count(DISTINCT coalesce(CAST(k AS VARCHAR), 'null')) n_values FROM a GROUP BY arm HAVING count(DISTINCT coalesce(CAST(k AS VARCHAR), 'null')) > 1"


@query("guard_drift", f"WITH {_A} {_SET} UNION ALL SELECT arm, 'n_expansions', count(DISTINCT coalesce(CAST(n_expansions AS VARCHAR), 'null')) FROM a GROUP BY arm HAVING count(DISTINCT coalesce(CAST(n_expansions AS VARCHAR), 'null')) > 1")
def guard_drift(spark, d):
    return guards.drift(attempts(spark, d), ["arm"], ["k", "n_expansions"])


@query("guard_cross_arm", f"WITH {_A} SELECT benchmark, 'arm' setting, count(DISTINCT arm) n_values FROM a GROUP BY benchmark HAVING count(DISTINCT arm) > 1 UNION ALL SELECT benchmark, 'parity', count(DISTINCT user_id % 2) FROM a GROUP BY benchmark HAVING count(DISTINCT user_id % 2) > 1")
def guard_cross_arm(spark, d):
    return guards.drift(attempts(spark, d).withColumn("parity", F.col("user_id") % 2), ["benchmark"], ["arm", "parity"])


@query("guard_seed_sets", f"WITH {_A}, s AS (SELECT user_id, arm, list_sort(list(DISTINCT seed)) seeds FROM a GROUP BY ALL), o AS (SELECT user_id FROM s GROUP BY user_id HAVING count(DISTINCT seeds) > 1) SELECT user_id, arm, seeds FROM s WHERE user_id IN (SELECT user_id FROM o)")
def guard_seed_sets(spark, d):
    return guards.seed_sets(attempts(spark, d), ["user_id"])


@query("guard_unverified", "SELECT quality, toxic, CASE WHEN toxic = 1 AND quality = 0 THEN 'no report' WHEN quality = 1 AND toxic = 1 THEN 'incomplete' WHEN count(*) <> count(*) FILTER (WHERE doc_id % 2 = 0) THEN 'failures are not all listed' END reason FROM labels GROUP BY quality, toxic")
def guard_unverified(spark, d):
    g = _t(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n_failed"), F.count_if(F.col("doc_id") % 2 == 0).alias("n_listed"))
    return g.select("quality", "toxic", rundirs.unverified_reason(~((F.col("toxic") == 1) & (F.col("quality") == 0)), ~((F.col("quality") == 1) & (F.col("toxic") == 1)), F.col("n_failed"), F.col("n_listed")).alias("reason"))


@query("guard_absent_arms", f"WITH {_A}, w(arm) AS (VALUES ('click'), ('view'), ('nobody')), n AS (SELECT count(DISTINCT user_id) n_groups FROM a) SELECT w.arm, count(DISTINCT a.user_id) n_found, n_groups FROM w LEFT JOIN a ON a.arm = w.arm OR starts_with(a.arm, w.arm || '@'), n GROUP BY w.arm, n_groups HAVING count(DISTINCT a.user_id) < n_groups")
def guard_absent_arms(spark, d):
    return guards.absent_arms(attempts(spark, d), ["click", "view", "nobody"], "user_id")


@query("guard_ragged", f"WITH {_A} SELECT benchmark, count(DISTINCT k) n_sizes, count(DISTINCT (k, seed)) n_budgets FROM a GROUP BY benchmark HAVING count(DISTINCT k) > 1 OR count(DISTINCT (k, seed)) > 1")
def guard_ragged(spark, d):
    return guards.ragged(attempts(spark, d), "benchmark", "k", ["k", "seed"])


@query("guard_incomparable", f"""WITH {_A}, r AS (SELECT user_id run, any_value(benchmark) benchmark, min(arm) label, max(arm) top FROM a GROUP BY user_id), p AS (SELECT x.run a_run, y.run b_run, x.label a_label, y.label b_label, x.benchmark a_benchmark, y.benchmark b_benchmark, CASE WHEN x.top = y.top THEN 1 ELSE 0 END n_shared FROM r x JOIN r y ON x.run // 4 = y.run // 4)
SELECT a_run, b_run, CASE WHEN a_run = b_run THEN 'the same run' WHEN a_benchmark <> b_benchmark THEN 'different benchmarks' WHEN a_label = b_label THEN 'the same arm and budget' WHEN n_shared = 0 THEN 'no problem in common' END reason FROM p WHERE a_run = b_run OR a_benchmark <> b_benchmark OR a_label = b_label OR n_shared = 0""")
def guard_incomparable(spark, d):
    r = attempts(spark, d).groupBy(F.col("user_id").alias("run")).agg(F.any_value("benchmark").alias("benchmark"), F.min("arm").alias("label"), F.max("arm").alias("top")).withColumn("g", F.expr("run div 4"))
    a, b = (r.select("g", *[F.col(c).alias(f"{x}_{c}") for c in ("run", "label", "benchmark", "top")]) for x in "ab")
    p = a.join(b, "g").withColumn("n_shared", (F.col("a_top") == F.col("b_top")).cast("int"))
    return guards.incomparable(p).select("a_run", "b_run", "reason")


@query("guard_pooling", f"WITH {_A}, c AS (SELECT DISTINCT benchmark, arm, CASE WHEN seed < 4 THEN 'x' ELSE 'y' END t FROM a), g AS (SELECT count(*) n, count(DISTINCT benchmark) k, count(DISTINCT (arm, t)) c FROM c) SELECT reason FROM (SELECT unnest([CASE WHEN k < 2 THEN 'fewer than two benchmarks' END, CASE WHEN k < n THEN 'a benchmark more than once' END, CASE WHEN c > 1 THEN 'different contrasts' END]) reason FROM g) WHERE reason IS NOT NULL")
def guard_pooling(spark, d):
    c = attempts(spark, d).select("benchmark", F.col("arm").alias("baseline"), F.when(F.col("seed") < 4, "x").otherwise("y").alias("treatment")).distinct()
    return guards.unpoolable(c)


@query("guard_replicates", f"WITH {_D}, s AS (SELECT * FROM dr WHERE solved), g AS (SELECT x.arm, x.seed, y.seed other, count(*) n_both, avg(CASE WHEN x.proof = y.proof THEN 1.0 ELSE 0.0 END) identical FROM s x JOIN s y ON x.arm = y.arm AND x.benchmark = y.benchmark AND x.pid = y.pid AND x.seed < y.seed GROUP BY ALL) SELECT arm, seed, other, n_both, round(identical, 6) identical FROM g WHERE identical >= 0.25")
def guard_replicates(spark, d):
    x = draws(spark, d).where("solved").withColumn("pid", F.struct("benchmark", "pid"))
    return guards.identical_replicates(x, ["arm"], 0.25).withColumn("identical", F.round("identical", 6))


@query("guard_rows", f"""WITH {_A}, e AS (SELECT arm, pid FROM (SELECT DISTINCT arm FROM a), (SELECT DISTINCT pid FROM a WHERE k < 50)), n AS (SELECT arm, pid, count(*) r FROM a GROUP BY ALL),
j AS (SELECT arm, CASE WHEN e.x IS NULL THEN 'excess' WHEN n.r IS NULL THEN 'missing' WHEN n.r > 1 THEN 'duplicate' END fault FROM (SELECT *, 1 x FROM e) e FULL JOIN n USING (arm, pid)) SELECT arm, fault, count(*) n FROM j WHERE fault IS NOT NULL GROUP BY ALL""")
def guard_rows(spark, d):
    a = attempts(spark, d)
    due = a.select("arm").distinct().join(a.where("k < 50").select("pid").distinct(), how="cross")
    return guards.row_faults(a, due, ["arm"])


@query("guard_resume", "SELECT user_id, 'k' setting, count(DISTINCT json_extract_string(props, '$.k')) n_values FROM events GROUP BY user_id HAVING count(DISTINCT json_extract_string(props, '$.k')) > 1")
def guard_resume(spark, d):
    return guards.drifted_settings(_t(spark, d, "events").select("user_id", F.col("event_id").alias("run"), "props"), ["user_id"], "props")


@query("guard_budget", f"WITH {_A}, n AS (SELECT arm, count(DISTINCT seed) n_draws FROM a GROUP BY arm) SELECT arm, n_draws, CAST(k AS INT) k FROM n, unnest(range(1, 9)) t(k) WHERE 2 * k > n_draws")
def guard_budget(spark, d):
    n = attempts(spark, d).groupBy("arm").agg(F.countDistinct("seed").alias("n_draws")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return n.where(guards.too_many_draws(F.col("k"), F.col("n_draws")))


@query("guard_fingerprint", "SELECT count(*) || ':' || substr(sha256(string_agg(p_name || '\n', '' ORDER BY p_partkey)), 1, 16) fingerprint FROM part")
def guard_fingerprint(spark, d):
    from .queries import corpus_fingerprint

    return guards.other_fingerprint(corpus_fingerprint(spark, d), "0:")


@query("ordered_distinct", f"WITH {_A}, f AS (SELECT user_id, arm, min(event_id) first FROM a GROUP BY ALL) SELECT user_id, arm, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INT) place FROM f")
def ordered_distinct(spark, d):
    """Distinct values in order of their first appearance."""
    f = attempts(spark, d).groupBy("user_id", "arm").agg(F.min("event_id").alias("first"))
    return f.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first"))).drop("first")


@query("sorted_postings", f"SELECT w term, doc_id, count(*) tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IDENT}')) w FROM documents) GROUP BY ALL")
def sorted_postings(spark, d):
    """Postings by term, and within a term by document."""
    w = _t(spark, d, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return w.repartition("term").sortWithinPartitions("term", "doc_id")


