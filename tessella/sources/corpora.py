"""Readers of corpora, benchmarks, glosses and configurations."""

from __future__ import annotations

import os
import re
import warnings

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import declaration_parts, strip
from ..operators.runs import GuardError, require_rows
from . import json_array

CORPUS = "name string, kind string, statement string, module string, is_prop boolean"
#: Kinds of corpus entries, and the columns under which files hold names and glosses.
KINDS = ["theorem", "axiom", "def", "inductive", "ctor", "opaque"]
NAME_KEYS = ["formal_name", "name", "Formal name", "decl_name", "declaration"]
GLOSS_KEYS = ["informal_name", "Informal name", "informal", "informal_statement", "informal_description", "description", "docstring"]
#: Problems of each benchmark.
BENCHMARK_ROWS = {"fate_m": 141, "proofnet_test": 186, "proofnet_valid": 185, "minif2f_test": 244, "minif2f_valid": 244}


def expand(value, env=os.environ):
    """``${NAME}`` filled in from the environment, at any depth; an unknown name is refused."""
    if isinstance(value, dict):
        return {k: expand(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def fill(m: re.Match) -> str:
        if m[1] not in env:
            raise KeyError(f"the environment has no {m[1]}")
        return env[m[1]]

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", fill, value)


def load_config(path: str) -> dict:
    """A YAML mapping with names of the environment filled in."""
    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return expand(got)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus (JSON lines) in order: columns of ``CORPUS`` and ord; a bad row raises."""
    rows = spark.read.schema(CORPUS).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def corpus_filter(df: DataFrame, kinds: list[str] | None = None, props_only: bool = False, prefixes: list[str] | None = None, max_chars: int | None = 4000) -> DataFrame:
    """Rows of the given kinds, propositions only, in modules that begin with any prefix, with statements of ``max_chars`` characters at most; None leaves a filter out."""
    keep = F.lit(True)
    if kinds is not None:
        keep = keep & F.col("kind").isin(*kinds)
    if props_only:
        keep = keep & F.col("is_prop")
    if prefixes is not None:
        keep = keep & F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.col("module").startswith(p))
    if max_chars is not None:
        keep = keep & (F.length("statement") <= max_chars)
    return df.where(keep)


def read_problems(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Problems of a JSON lines file: problem_id, source, imports, preamble, declaration, informal_statement, reference_proof, raw, statement. A statement without a declaration raises; blank informal statements and proofs are none."""
    rows = spark.read.schema("id string, formal_statement string, formal_proof string, informal_statement string").option("lineSep", "\n").json(path)
    some = lambda c: F.nullif(strip(F.col(c)), F.lit("")).alias(c)
    return _problems(rows.select(F.col("id").alias("problem_id"), F.col("formal_statement").alias("text"), some("informal_statement"), some("formal_proof").alias("reference_proof")), source, True)


def _problems(rows: DataFrame, source: str, must: bool) -> DataFrame:
    d = rows.withColumn("d", declaration_parts(F.col("text")))
    declared = F.when(F.col("d.declaration").isNull(), F.raise_error(F.concat(F.lit("no declaration in "), F.col("problem_id")))).otherwise(F.col("d.declaration")) if must else F.col("d.declaration")
    rest = [c for c in rows.columns if c not in ("problem_id", "text")]
    return d.select("problem_id", F.lit(source).alias("source"), F.col("d.imports").alias("imports"), F.col("d.preamble").alias("preamble"), declared.alias("declaration"), *rest, F.col("text").alias("raw")).withColumn("statement", problem_statement(F.col("preamble"), F.col("declaration")))


def problem_statement(preamble: Column, declaration: Column) -> Column:
    return strip(F.when(F.coalesce(preamble, F.lit("")) == "", declaration).otherwise(F.concat(preamble, F.lit("\n\n"), declaration)))


def read_problem_files(spark: SparkSession, folder: str, glob: str = "putnam_*.lean", source: str = "putnam") -> DataFrame:
    """One problem for each file, in order of names, with the year and the problem in the name; files without a declaration are left out with a warning."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1).alias("problem_id"), F.col("value").alias("text"))
    parts = files.withColumn("year", F.regexp_extract("problem_id", r"_(\d{4})_", 1).cast("int")).withColumn("problem", F.regexp_extract("problem_id", r"_\d{4}_(.+)$", 1))
    rows = _problems(parts, source, False)
    if n := rows.where("declaration is null").count():
        warnings.warn(f"{n} files without a declaration", stacklevel=2)
    return rows.where("declaration is not null").orderBy("problem_id")


def load_benchmark(spark: SparkSession, name: str, root: str, check: bool = True, rows: dict[str, int] | None = None) -> DataFrame:
    """A benchmark by name; refused if it hasn't the number of problems that it should have."""
    known = rows or BENCHMARK_ROWS
    if name not in known:
        raise KeyError(f"{name} is none of {', '.join(sorted(known))}")
    out = read_problems(spark, f"{root}/{name}.jsonl", name)
    if check:
        require_rows(out, known[name])
    return out


def first_key(columns: list[str], keys: list[str]) -> str:
    for k in keys:
        if k in columns:
            return k
    raise GuardError(f"none of {keys} is there")


def read_glosses(spark: SparkSession, path: str, name_key: str | None = None, gloss_key: str | None = None) -> DataFrame:
    """name, gloss: of lines that name the same the last one holds; blank glosses are none. Names may be lists, joined by dots; no gloss at all is refused."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.isDirectory(fs):
        files = sorted(str(f.getPath()) for f in system.listStatus(fs) if f.getPath().getName().endswith(".jsonl"))
        if not files:
            raise GuardError(f"{path} holds no .jsonl file")
        path = files[0]
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())
    head = lines.orderBy("ord").select(F.json_object_keys("value").alias("k")).first()
    columns = (head["k"] if head else None) or []
    name_key, gloss_key = name_key or first_key(columns, NAME_KEYS), gloss_key or first_key(columns, GLOSS_KEYS)
    field = lambda k: F.get_json_object("value", f"$['{k}']")
    name = F.coalesce(F.array_join(F.from_json(field(name_key), "array<string>"), "."), field(name_key))
    out = last_gloss(lines.select(name.alias("name"), field(gloss_key).alias("gloss"), "ord"))
    if not out.limit(1).count():
        raise GuardError("no gloss")
    return out


def last_gloss(rows: DataFrame, name: str = "name", gloss: str = "gloss", order: str = "ord") -> DataFrame:
    """One gloss for each name: the last that isn't blank."""
    return rows.where(F.col(name).isNotNull() & (F.trim(F.coalesce(gloss, F.lit(""))) != "")).groupBy(name).agg(F.max_by(F.trim(gloss), order).alias(gloss))


def with_gloss(df: DataFrame, glosses: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with ``gloss``, empty where there is none; ``glosses`` has one row for each name."""
    return df.join(glosses, name, "left").fillna("", ["gloss"])


def gloss_coverage(df: DataFrame, glosses: DataFrame, name: str = "name", least: float = 0.05) -> DataFrame:
    """n, n_found, coverage (4 places) of the names of ``df``; refused below ``least``."""
    out = with_gloss(df.select(name), glosses, name).agg(F.count("*").alias("n"), F.count_if(F.col("gloss") != "").alias("n_found"))
    out = out.withColumn("coverage", F.round(F.col("n_found") / F.greatest("n", F.lit(1)), 4))
    return out.withColumn("coverage", F.when(F.col("coverage") < least, F.raise_error(F.concat(F.lit("glosses cover only "), F.col("coverage").cast("string")))).otherwise(F.col("coverage")))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of files that are one JSON array each, as rows; a large file is read by several tasks."""
    return json_array.read(spark, path, schema)


TRACED = "full_name string, traced_tactics array<struct<annotated_tactic: array<string>>>"


def seen_names(theorems: DataFrame, tactics: str = "traced_tactics") -> DataFrame:
    """Distinct full_name of the premises that traced tactics use: the second element of ``annotated`` holds them; shorter ones are left out."""
    steps = theorems.select(F.explode(tactics).alias("t")).where(F.size("t.annotated") >= 2)
    return steps.select(F.explode(F.from_json(F.col("t.annotated")[1], "array<struct<full_name: string>>")).alias("p")).select(F.col("p.full_name").alias("name")).where("name is not null").distinct()


#: Components of names that a compiler makes by itself, whole and numbered.
GENERATED = ["rec", "recOn", "casesOn", "brecOn", "below", "ibelow", "binductionOn", "ndrec", "ndrecOn", "noConfusion", "noConfusionType", "injEq", "inj", "sizeOf_spec", "sizeOf_inst",
             "toCtorIdx", "ofNat_toCtorIdx", "ctorIdx", "eq_def", "eq_unfold", "induct", "fun_cases", "match_def", "sizeOf_eq"]
NUMBERED = r"^(_.*|(eq_|proof_|match_)?[0-9]+)$"


def generated(name: Column) -> Column:
    """Whether any component of a dotted name, as a whole, is one that a compiler makes. A name that only begins like one (``Nat.eq_zero``) isn't."""
    return F.exists(F.split(name, r"\."), lambda c: c.isin(GENERATED) | c.rlike(NUMBERED))


def written_names(df: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """Entries that somebody has written: none that the compiler makes, neither recursors nor quotients."""
    return df.where(~generated(F.col(name)) & ~F.col(kind).isin("rec", "quot"))
