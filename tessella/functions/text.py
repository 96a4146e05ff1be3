"""Text expressions: tokens, identifiers, names, proofs. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word character of formal text, and identifiers with their unicode sub- and superscripts.
TOKEN = r"([A-Za-z0-9_']+|[^\sA-Za-z0-9_'])"
IDENTIFIER = r"([A-Za-z_][A-Za-z0-9_.'!?₀-₉¹²³]*)"
HEAD = r"^\s*([A-Za-z_][A-Za-z0-9_']*)"
#: Steps that need no premise, with their share of probability, and shapes that take one.
CLOSERS = {
    "intro x": 0.10, "intro h": 0.09, "constructor": 0.04, "assumption": 0.04, "ext": 0.03, "simp": 0.12, "aesop": 0.10, "norm_num": 0.08, "ring": 0.07, "linarith": 0.06,
    "omega": 0.05, "simp_all": 0.05, "rfl": 0.05, "positivity": 0.03, "nlinarith": 0.03, "field_simp": 0.03, "decide": 0.02, "trivial": 0.02, "tauto": 0.02,
}
TEMPLATES = {"exact {p}": 0.30, "apply {p}": 0.25, "rw [{p}]": 0.20, "rw [← {p}]": 0.10, "simp [{p}]": 0.15}
#: Areas and the words that show them, the first that matches counts.
AREAS = {
    "group theory": r"\b(Group|Subgroup|Sylow|orderOf|Perm|conj|normalizer|centralizer|IsCyclic|Solvable|QuotientGroup|MonoidHom|comm_group)\b",
    "ring / field": r"\b(Ring|Ideal|Field|Polynomial|IsDomain|IsUnit|IsNilpotent|Algebra|CharP|Subring|RingHom|IsPrime|IsIntegral|IsAlgebraic)\b",
    "linear algebra": r"\b(Module|Submodule|LinearMap|Matrix|Basis|finrank|Eigenvalue|VectorSpace|LinearIndependent)\b",
    "topology": r"\b(Topological|IsOpen|IsClosed|Continuous|Compact|Metric|Filter|nhds|IsConnected|Homeomorph)\b",
    "analysis": r"\b(Real|Complex|Tendsto|deriv|integral|Summable|HasSum|Cauchy|MeasureTheory|norm|abs)\b",
    "number theory": r"\b(Nat\.Prime|ZMod|Int\.ModEq|totient|divisors|padic|Nat\.gcd|Nat\.Coprime|legendreSym)\b",
    "order / lattice": r"\b(Lattice|PartialOrder|sSup|sInf|Galois|OrderIso|IsGLB|IsLUB)\b",
    "set / logic": r"\b(Set\.|Finset|Function\.Injective|Function\.Surjective|Equiv|Cardinal)\b",
}
#: Words that leave a proof open, and a way to prove that isn't allowed.
CHEAT = r"(^|[^A-Za-z0-9_.])(sorry|admit|sorryAx)($|[^A-Za-z0-9_])"
NATIVE = r"(^|[^A-Za-z0-9_.'])native_decide($|[^A-Za-z0-9_'])"
#: What models echo before an answer.
ECHOES = ["Assistant:", "TACTIC:", "tactic:"]


def tokens(text: Column, lowercase: bool = False, split_underscores: bool = False) -> Column:
    """Runs of word characters, or single other visible characters; with ``split_underscores`` also parts of two letters and more."""
    t = F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(TOKEN), F.lit(1))
    if not split_underscores:
        return t
    return F.flatten(F.transform(t, lambda x: F.concat(F.array(x), F.when(x.contains("_") & (F.length(x) > 1), F.filter(F.split(x, "_"), lambda p: F.length(p) >= 2)).otherwise(F.array().cast("array<string>")))))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(1))


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends; ``trim`` takes off spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def last_component(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def nonblank(steps: Column) -> Column:
    return F.filter(F.transform(steps, strip), lambda x: x != "")


def head(step: Column) -> Column:
    return F.regexp_extract(step, HEAD, 1)


def admissible(tactic: Column, longest: int = 2000) -> Column:
    """Why a step is refused, the first reason that holds; null if none does. Null steps are empty."""
    return (F.when(tactic.isNull() | (strip(tactic) == ""), "empty").when(F.length(tactic) > longest, "too long")
            .when(tactic.rlike(CHEAT), "unproved")
            .when(tactic.rlike(NATIVE), "native").when(tactic.contains("apply?"), "search"))


def area(statement: Column) -> Column:
    out = None
    for name, words in AREAS.items():
        out = F.when(statement.rlike(words), name) if out is None else out.when(statement.rlike(words), name)
    return out.otherwise("other")


def step_outcome(status: Column, goals: Column, messages: Column, severities: Column) -> Column:
    """What a step has come to: an error, a finished proof, or progress with goals left; a gap in the proof is an error."""
    said = F.concat_ws(" ", status, F.array_join(messages, " "))
    state, left = F.lower(strip(status)), F.size(goals) > 0
    open_ = state.startswith("incomplete") | state.contains("open goals")
    finished = state.startswith("completed") | (state == "done") | (state == "")
    return (F.when(F.exists(severities, lambda x: x == "error"), "error").when(said.rlike(CHEAT), "error")
            .when(open_ & ~left, "error").when(open_ | left, "progress").when(finished, "proved").otherwise("progress"))


def failure_mode(status: Column, limit_hit: Column) -> Column:
    """Why a run failed; both names of the time limit count."""
    exhausted = (F.when(limit_hit == "max_expansions", "max_expansions").when(limit_hit.isin("wall_clock", "wall_clock_s"), "wall_clock")
                 .otherwise(F.concat(F.lit("exhausted ("), F.coalesce(limit_hit, F.lit("None")), F.lit(")"))))
    return F.when(status == "exhausted", exhausted).otherwise(status)


def budget_label(arm: Column, n: Column) -> Column:
    short = F.when(n.isNull(), "?").when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))
    return F.concat(arm, F.lit("@"), short)


def clean_step(step: Column) -> Column:
    """Without white space at its ends, then without echoes, each taken off once and in order."""
    out = strip(step)
    for e in ECHOES:
        out = F.when(out.startswith(e), strip(F.substr(out, F.lit(len(e) + 1)))).otherwise(out)
    return out


#: A line that begins a declaration, behind white space, one attribute and modifiers; and one that imports.
DECLARATION = r"(?m)^\s*(?:@\[[^\]]*\]\s*)?(?:(?:private|protected|noncomputable|nonrec)\s+)*(?:theorem|lemma|example|def|instance|abbrev)\b"
IMPORT = r"(?m)^\s*import\s+\S+"


def declaration_parts(text: Column) -> Column:
    """imports, preamble and declaration of a problem file: from the first line that begins a declaration on, imports aside. Declaration is null if there is none."""
    rest = F.regexp_replace(text, IMPORT, "")
    d = F.regexp_extract(rest, rf"(?s)({DECLARATION}.*)", 1)
    before = F.when(d != "", F.substr(rest, F.lit(1), F.length(rest) - F.length(d))).otherwise(rest)
    imports = F.transform(F.regexp_extract_all(text, F.lit(f"({IMPORT})"), F.lit(1)), strip)
    return F.struct(imports.alias("imports"), strip(before).alias("preamble"), F.when(d != "", strip(d)).alias("declaration"))


def prompt_block(premises: Column, limit: int = 6) -> Column:
    """Blocks of numbered premises (name, informal_name, statement), joined by blank lines."""
    return F.array_join(F.transform(F.slice(premises, 1, limit), lambda p, i: F.concat(F.lit("ID:"), i.cast("string"), F.lit("\nFormal name: "), p["name"], F.lit("\nInformal name: "), F.coalesce(p["informal_name"], F.lit("")), F.lit("\nFormal statement: "), p["statement"])), "\n\n")
