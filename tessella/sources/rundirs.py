"""Run folders: ``manifest.json``, ``attempts.jsonl`` and ``verification.json`` of each run, as tables; how runs are begun, finished, repaired and exported."""

from __future__ import annotations

import ast
import datetime as dt
import json
import subprocess
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import budget_label
from ..operators.runs import GuardError, last_rows
from ..operators.runs import latest as latest_rows

ATTEMPT = "problem_id string, source string, arm string, status string, proved boolean, proof array<string>, n_expansions int, n_tactics_tried int, n_lean_calls int, elapsed_s double, limit_hit string, error string"
TRACE = ATTEMPT + ", trace array<struct<depth: int, logprob: double, tactic: string, outcome: string, elapsed_s: double, error: string>>"
REPORT = ("benchmark string, complete boolean, n_claimed int, n_verified int, n_failed int, "
          "failures array<struct<problem_id: string, reason: string, proof: array<string>, errors: array<string>, command: string>>")
#: Columns that an export keeps.
KEEP = [c.split()[0] for c in ATTEMPT.split(", ")]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _rename(spark: SparkSession, source: str, target: str, replace: bool) -> None:
    """One rename that either replaces ``target`` in the same step or refuses to."""
    fs = spark._jvm.org.apache.hadoop.fs
    how = getattr(fs, "Options$Rename")
    options = spark._sc._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if replace else how.NONE
    source, target = fs.Path(source), fs.Path(target)
    qualified = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target)
    fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(qualified.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(source), qualified, options)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file, whole or not at all: written beside its place, then renamed over it in one step, so that a reader meets the old text or the new one."""
    fs, p = _fs(spark, path)
    if fs.exists(p) and not replace:
        raise GuardError(f"{path} exists")
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(beside))
    out.write(bytearray(text.encode()))
    out.close()
    _rename(spark, beside, path, replace)


def write_files(rows: DataFrame, root: str, name: str, *order: str) -> None:
    """Lines (run, value, columns of ``order``) as ``name`` in the folder of each run: a folder of part files whose names are in the lines' order.

    Runs are listed by the driver, lines are not. A run that has the file already is refused.
    """
    spark, beside = rows.sparkSession, f"{root}/_{name}.{uuid.uuid4().hex}"
    fs, p = _fs(spark, beside)
    rows.repartitionByRange("run", *order).sortWithinPartitions("run", *order).select("run", "value").write.partitionBy("run").text(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for own in fs.listStatus(p):
        folder = own.getPath().getName()
        if folder.startswith("run="):
            run = f"{root}/{unquote(folder[4:])}"
            if fs.exists(path(f"{run}/{name}")):
                raise GuardError(f"{run} has its {name} already")
            fs.mkdirs(path(run))
            fs.rename(own.getPath(), path(f"{run}/{name}"))
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"]


def stamp(now: dt.datetime | None = None) -> str:
    """UTC to the microsecond, in an order that sorts as text."""
    return (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%S%f")


def revision(folder: str = ".") -> str:
    """The short commit of ``folder`` with ``-dirty`` where files have changed, or ``unknown``."""
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, timeout=30)
    try:
        sha = run("rev-parse", "--short", "HEAD")
        return sha.stdout.strip() + ("-dirty" if run("status", "--porcelain").stdout.strip() else "") if sha.returncode == 0 else "unknown"
    except (OSError, subprocess.TimeoutExpired):
        return "unknown"


def create(spark: SparkSession, root: str, name: str, config: dict, seed: int = 0, folder: str = ".") -> str:
    """Begins a run before any work: its folder with a manifest of what is about to happen. Returns the run's id."""
    sha = revision(folder)
    run_id = f"{name}_{stamp()}_{sha}"
    manifest = {"run_id": run_id, "seed": seed, "started_utc": dt.datetime.now(dt.UTC).isoformat(), "config": config, "environment": {"spark": spark.version, "revision": sha}, "outcome": None}
    write_text(spark, f"{root}/{run_id}/manifest.json", json.dumps(manifest, indent=1), replace=False)
    return run_id


def load(spark: SparkSession, root: str, run_id: str) -> dict:
    return json.loads(read_text(spark, f"{root}/{run_id}/manifest.json"))


def finalize(spark: SparkSession, root: str, run_id: str, outcome: dict) -> None:
    """Adds the outcome to the manifest; a run is finished once."""
    manifest = load(spark, root, run_id)
    if manifest.get("outcome"):
        raise GuardError(f"{run_id} is finished already")
    manifest |= {"outcome": outcome, "finished_utc": dt.datetime.now(dt.UTC).isoformat()}
    write_text(spark, f"{root}/{run_id}/manifest.json", json.dumps(manifest, indent=1))


def _folder(name: str) -> Column:
    """The run to which a file belongs; ``name`` is a file or a folder of parts."""
    return F.url_decode(F.regexp_extract(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), rf"([^/]+)/{name.replace('.', '[.]')}(/[^/]+)?$", 1))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """run (folder), text, benchmark, arm, n_candidates, policy, seed, started, n_problems, finished, label of every run under ``root``.

    A run's label is its arm with its budget of candidates, if it has one: ``li@1k`` and ``li@50k`` are two arms. Runs that
    don't name a policy are of a time when all used the fixed repertoire.
    """
    rows = spark.read.text(f"{root}/*/manifest.json", wholetext=True).select(_folder("manifest.json").alias("run"), F.col("value").alias("text"))
    at = lambda path: F.get_json_object("text", f"$.{path}")
    out = rows.select("run", "text", at("config.benchmark").alias("benchmark"), F.coalesce(at("config.arm"), F.lit("?")).alias("arm"), at("config.n_candidates").cast("int").alias("n_candidates"),
                      F.coalesce(F.nullif(at("config.policy_kind"), F.lit("")), F.lit("repertoire")).alias("policy"), at("seed").cast("int").alias("seed"), at("started_utc").alias("started"), at("config.n_problems").cast("int").alias("n_problems"),
                      F.coalesce(at("outcome"), F.lit("")).isin("", "null", "{}", "false").__invert__().alias("finished"))
    return out.withColumn("label", run_label(F.col("arm"), F.col("n_candidates")))


def run_label(arm: Column, n_candidates: Column) -> Column:
    """``arm@budget``, or the arm alone where no budget is told."""
    return F.when(F.coalesce(n_candidates, F.lit(0)) == 0, arm).otherwise(budget_label(arm, n_candidates))


def config_text(text: Column, path: str) -> Column:
    """A configuration's value at a JSON path as text: ``True``, ``False``, ``None`` (null or missing), numbers and strings as they stand, lists and mappings as compact JSON."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    value = F.get_json_object(text, path)
    return F.when(value.isNull(), "None").when(kind == "BOOLEAN", F.initcap(value)).otherwise(value)


def matches(text: Column, specs: list[str], root: str = "$.config.") -> Column:
    """Whether a JSON text holds every ``dotted.key=value``; values are compared as text, in the way of ``config_text``. Lists and mappings may be written as Python or as JSON."""
    out = F.lit(True)
    for spec in specs:
        path, sep, value = spec.partition("=")
        if not sep or not path:
            raise ValueError(f"{spec!r} isn't key=value")
        if value[:1] in ("[", "{"):
            value = json.dumps(ast.literal_eval(value), separators=(",", ":"), ensure_ascii=False)
        out = out & (config_text(text, root + path) == value)
    return out


def discover(spark: SparkSession, root: str, benchmark: str | None = None, policy: str | None = None, specs: list[str] | None = None) -> DataFrame:
    """Finished runs of a benchmark and a policy whose configuration holds all ``specs``, in order of their folders."""
    out = manifests(spark, root).where("finished").where(matches(F.col("text"), specs or []))
    for column, value in (("benchmark", benchmark), ("policy", policy)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("run")


def latest(spark: SparkSession, root: str, policy: str = "repertoire", specs: list[str] | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """run, benchmark, arm, label, started: of each benchmark and arm the finished run of a policy that was begun last, of equal times the first by its folder.

    Only runs that have attempts and whose configuration holds all ``specs`` count. With ``sizes`` (problems of each benchmark), runs over
    a part of a benchmark don't; benchmarks that aren't named there do.
    """
    fs, p = _fs(spark, f"{root}/*/attempts.jsonl")
    have = [(f.getPath().getParent().getName(),) for f in fs.globStatus(p) or ()]
    rows = discover(spark, root, None, policy, specs).withColumn("benchmark", F.coalesce("benchmark", F.lit("?"))).withColumn("started", F.coalesce("started", F.lit("")))
    rows = rows.join(F.broadcast(spark.createDataFrame(have, "run string")), "run", "left_semi")
    if sizes:
        whole = F.coalesce(*[F.when(F.col("benchmark") == b, F.lit(n)) for b, n in sizes.items()])
        rows = rows.where(whole.isNull() | (F.coalesce("n_problems", F.lit(-1)) == whole))
    return latest_rows(rows, ["benchmark", "arm"], "started", "run").select("run", "benchmark", "arm", "label", "started")


def require_one_budget(spark: SparkSession, root: str, chosen: DataFrame) -> None:
    """Refuses runs (run) that were searched with different limits: their rates don't compare."""
    at = lambda k: F.coalesce(F.get_json_object("text", f"$.config.search.{k}"), F.lit("?")).alias(k)
    budgets = manifests(spark, root).join(chosen.select("run"), "run", "left_semi").select("run", at("max_expansions"), at("samples_per_step")).groupBy("max_expansions", "samples_per_step").agg(F.min("run").alias("run")).limit(9).collect()
    if len(budgets) > 1:
        raise GuardError("runs have different budgets: " + ", ".join(sorted(f"{r['max_expansions']} x {r['samples_per_step']} ({r['run']})" for r in budgets)))


def _lines(spark: SparkSession, root: str, name: str, run: str = "*") -> DataFrame:
    """run, line_no (from 0, blank lines counted), line of a file of every run; lines end at line feeds only. A long log is read by several tasks."""
    at = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(f"{root}/{run}/{name}").select(_folder(name).alias("run"), F.col("value").alias("line"), at["file_name"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    w = Window.partitionBy("run").orderBy("file", "block", "row")
    return rows.select("run", (F.row_number().over(w) - 1).alias("line_no"), "line").where(F.trim("line") != "")


def _parsed(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    parsed = lines.select("run", "line_no", "line", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("line").isNotNull().alias("whole"))
    ok = F.col("r._bad").isNull() & F.col("whole") & F.rtrim("line").endswith("}")
    return parsed.where(ok).select("run", "line_no", "r.*").drop("_bad"), parsed.where(~F.coalesce(ok, F.lit(False))).select("run", "line_no", F.octet_length("line").alias("n_bytes"), "line")


def attempts(spark: SparkSession, root: str, schema: str = TRACE, run: str = "*") -> tuple[DataFrame, DataFrame]:
    """Good rows of all runs (run, line_no and the columns) and bad ones (run, line_no, n_bytes, line): torn rows are neither counted nor lost."""
    return _parsed(_lines(spark, root, "attempts.jsonl", run), schema)


def reports(spark: SparkSession, root: str) -> DataFrame:
    """run and the columns of its verification report; runs without one have no row."""
    fs, p = _fs(spark, f"{root}/*/verification.json")
    if not fs.globStatus(p):
        return spark.createDataFrame([], f"run string, {REPORT}")
    whole = spark.read.text(f"{root}/*/verification.json", wholetext=True).select(_folder("verification.json").alias("run"), F.from_json("value", REPORT).alias("r"))
    return whole.select("run", "r.*")


def failed(spark: SparkSession, root: str) -> DataFrame:
    """run, problem_id of proofs that verification has refused."""
    return reports(spark, root).select("run", F.explode("failures").alias("f")).select("run", F.col("f.problem_id").alias("problem_id")).distinct()


def unverified(manifest: DataFrame, report: DataFrame) -> DataFrame:
    """run and why its report can't be relied on; null where it can."""
    j = manifest.select("run").join(report, "run", "left")
    return j.select("run", unverified_reason(F.col("n_failed").isNotNull(), F.col("complete"), F.col("n_failed"), F.size("failures")).alias("reason"))


def unverified_reason(has_report: Column, complete: Column, n_failed: Column, n_listed: Column) -> Column:
    return F.when(~has_report, "no report").when(~F.coalesce(complete, F.lit(True)), "incomplete").when(n_failed != n_listed, "failures are not all listed")


def arm(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run and problem, the last that was written; ``solved`` only where verification hasn't refused the proof (``discounted`` where it has, whose status is ``verify_failed``).

    ``attributable``: whether the steps show which premises they use, as those of the fixed repertoire alone do.
    """
    good = attempts(spark, root)[0].drop("arm")
    last = last_rows(good, "run", "problem_id")
    out = _discount(last.withColumn("solved", F.coalesce("proved", F.lit(False))), failed(spark, root)).join(_named(spark, root), "run")
    return out.withColumn("status", F.when(F.col("refused"), "verify_failed").otherwise(F.col("status"))).withColumn("attributable", F.col("policy") == "repertoire").drop("refused")


def _named(spark: SparkSession, root: str) -> DataFrame:
    return manifests(spark, root).select("run", "benchmark", "arm", "label", "policy", "seed")


def draw(spark: SparkSession, root: str) -> DataFrame:
    """run, benchmark, arm, label, policy, seed, problem_id, pid (``benchmark:problem``, so that equal ids of two benchmarks stay apart), solved by any row, discounted, proof."""
    keys = ["run", "benchmark", "arm", "label", "policy", "seed", "problem_id"]
    good = attempts(spark, root)[0].drop("arm").join(_named(spark, root), "run")
    solved = F.coalesce("proved", F.lit(False))
    once = good.groupBy(*keys).agg(F.bool_or(solved).alias("solved"), F.max_by(proof_text(F.coalesce("proof", F.array().cast("array<string>"))), F.when(solved, F.col("line_no"))).alias("proof"))
    return _discount(once, failed(spark, root)).drop("refused").withColumn("pid", F.concat_ws(":", "benchmark", "problem_id"))


def proof_text(steps: Column) -> Column:
    """The steps of a proof as one text."""
    return F.array_join(steps, "\n;;\n")


def _discount(rows: DataFrame, refused: DataFrame) -> DataFrame:
    j = rows.join(refused.withColumn("_f", F.lit(True)), ["run", "problem_id"], "left")
    bad = F.coalesce("_f", F.lit(False))
    return j.withColumn("refused", bad).withColumn("discounted", F.col("solved") & bad).withColumn("solved", F.col("solved") & ~bad).drop("_f")


def raw(spark: SparkSession, root: str) -> DataFrame:
    """Attempts as they were written with their run's label: no verification discount."""
    return attempts(spark, root)[0].drop("arm").join(_named(spark, root), "run")


def export(spark: SparkSession, root: str, path: str) -> int:
    """Attempts of finished runs without their traces, in a folder for each run, with the manifests beside them; returns the number of runs."""
    done = manifests(spark, root).where("finished")
    attempts(spark, root, ATTEMPT)[0].join(done.select("run"), "run", "left_semi").select("run", *KEEP).write.partitionBy("run").json(f"{path}/attempts")
    done.select("run", "text").write.parquet(f"{path}/manifests")
    return done.count()


def repair(spark: SparkSession, root: str, run: str, dry_run: bool = False) -> int:
    """Takes bad rows out of a run's attempts, which are a file: a byte-identical backup (``.bak``), the bad rows as they are in a file of their own, then the good rows in one rename.

    Returns the number of bad rows. Lines stay on the executors; they are never decoded, so a row that is torn inside a character stays as it is.
    """
    good, bad = _parsed(_lines(spark, root, "attempts.jsonl", run), ATTEMPT)
    n = bad.count()
    if n and not dry_run:
        path = f"{root}/{run}/attempts.jsonl"
        fs, p = _fs(spark, path)
        backup = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.bak")
        if fs.exists(backup):
            raise GuardError(f"{path}.bak exists")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, backup, False, False, spark._jsc.hadoopConfiguration())
        lines = _lines(spark, root, "attempts.jsonl", run)
        _write_lines(lines.join(bad.select("line_no"), "line_no", "left_semi"), f"{root}/{run}/attempts.bad.jsonl")
        _write_lines(lines.join(good.select("line_no"), "line_no", "left_semi"), path)
    return n


def _write_lines(lines: DataFrame, path: str) -> None:
    """One file of the lines in order, renamed into its place; a single task writes it, line by line."""
    spark, beside = lines.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.text(beside)
    fs, p = _fs(spark, beside)
    part = [f.getPath().toString() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")]
    _rename(spark, part[0], path, True)
    fs.delete(p, True)


def outcomes(good: DataFrame) -> DataFrame:
    """run, n_attempted, n_proved, rate (4 places), elapsed_s, n_twice (problems with several rows) of each run's good rows. Times are summed as decimals, so their order doesn't matter."""
    once = good.groupBy("run", "problem_id").agg(F.count("*").alias("n"), F.count_if("proved").alias("proved"), F.sum(F.col("elapsed_s").cast("decimal(20,6)")).alias("elapsed_s"))
    return once.groupBy("run").agg(F.sum("n").alias("n_attempted"), F.sum("proved").alias("n_proved"), F.round(F.sum("proved") / F.sum("n"), 4).alias("rate"), F.round(F.sum("elapsed_s"), 1).cast("double").alias("elapsed_s"), F.count_if(F.col("n") > 1).alias("n_twice"))


def outcome(good: DataFrame, n_problems: int) -> dict:
    """Counts of one run from its rows; refused if a problem has two rows, or if there are too few or too many."""
    row = outcomes(good.withColumn("run", F.lit(""))).first()
    n = row["n_attempted"] if row else 0
    if row and row["n_twice"]:
        raise GuardError(f"{row['n_twice']} problems have several rows")
    if n != n_problems:
        raise GuardError(f"{n} rows, {'fewer' if n < n_problems else 'more'} than the {n_problems} problems")
    return {"n_attempted": n, "n_proved": row["n_proved"] if row else 0, "rate": row["rate"] if row else 0.0, "elapsed_s": row["elapsed_s"] if row else None}


def same_config(before: dict, now: dict, but: tuple[str, ...] = ()) -> None:
    """Refuses to go on with a run whose configuration has changed; the keys that differ are named."""
    differ = sorted(k for k in {*before, *now} - set(but) if before.get(k) != now.get(k))
    if differ:
        raise GuardError(f"the run was begun with another configuration: {', '.join(differ)}")
