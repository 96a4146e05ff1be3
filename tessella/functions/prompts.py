"""Prompts and statements as column expressions: what a model is shown, and what becomes of what it says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CHEAT, admissible, clean_step, identifiers, nonblank, prompt_block, strip

#: Chat formats as (what comes before the question, what comes after it).
CHATS = {
    "deepseek": ("User: ", "\n\nAssistant:"),
    "qwen": ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "qwen_chatml": ("<|im_start|>system\nPlease reason step by step, and put your final answer within \\boxed{}.<|im_end|>\n<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "internlm": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "deepseek3": ("<｜User｜>", "<｜Assistant｜>"),
}
#: The lines of a question.
INSTRUCTION = "Please generate a tactic in lean4 to solve the state."
HELPFUL = "Here're some theorems that may be helpful:"
#: Words that begin a step and name no premise, in the strict check and in the looser one.
TACTIC_WORDS = """exact apply rw rwa simp simpa intro intros refine constructor rcases obtain cases use have let show calc ring ring_nf field_simp linarith nlinarith norm_num omega decide aesop tauto trivial
exacts induction subst unfold change conv congr ext specialize by at with this fun to and or if then else from rfl""".split()
NOT_A_PREMISE = ["fun", "by", "this", "if", "let", "have", "show"]


def premise_document(name: Column, statement: Column) -> Column:
    return F.concat_ws(" ", name, statement)


def tactic_content(state: Column, premises: Column, limit: int = 6) -> Column:
    """What a model is asked. Without premises their headline stays, with an empty line below it."""
    return F.concat(F.lit(f"{INSTRUCTION}\n{HELPFUL}\n"), prompt_block(premises, limit), F.lit("\nSTATE:\n"), state, F.lit("\nTACTIC:\n"))


def chat(question: Column, kind: str = "qwen_chatml") -> Column:
    """One question in one of the ``CHATS`` formats."""
    before, after = CHATS[kind]
    return F.concat(F.lit(before), question, F.lit(after))


def last_assign(declaration: Column) -> Column:
    """Where the last ``:=`` outside all brackets begins (from 1), 0 for none."""
    chars = F.split(declaration, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("before"), F.lit(0).alias("at"), F.lit(0).alias("found"))

    def step(a, c):
        depth = a["depth"] + F.when(c.isin("(", "[", "{", "⟨"), 1).when(c.isin(")", "]", "}", "⟩"), -1).otherwise(0)
        hit = (c == "=") & (a["before"] == ":") & (a["depth"] == 0)
        return F.struct(depth.alias("depth"), c.alias("before"), (a["at"] + 1).alias("at"), F.when(hit, a["at"]).otherwise(a["found"]).alias("found"))

    return F.aggregate(chars, start, step)["found"]


def as_open(declaration: Column) -> Column:
    """The declaration with nothing proved: all behind its last assignment is left open."""
    at = last_assign(declaration)
    return F.when(at > 0, F.concat(F.rtrim(F.substr(declaration, F.lit(1), at - 1)), F.lit(" := by sorry"))).otherwise(F.concat(strip(declaration), F.lit(" := by sorry")))


def with_proof(declaration: Column, steps: Column) -> Column:
    """The declaration with a proof: its steps on lines of their own, indented by two."""
    at = last_assign(declaration)
    body = F.array_join(F.transform(nonblank(steps), lambda s: F.concat(F.lit("  "), F.replace(s, F.lit("\n"), F.lit("\n  ")))), "\n")
    return F.concat(F.when(at > 0, F.rtrim(F.substr(declaration, F.lit(1), at - 1))).otherwise(strip(declaration)), F.lit(" := by\n"), body)


def undecodable(text: Column) -> Column:
    return text.contains("�")


def contains_cheat(text: Column) -> Column:
    """Whether a step leaves the proof open."""
    return text.rlike(CHEAT)


def names_premise(step: Column, closers: list[str], repertoire: Column) -> Column:
    """Whether a step of a fixed repertoire names a premise: it is none of the closers. Null for other policies, whose steps can't be told."""
    return F.when(repertoire, ~strip(step).isin(*closers))


def one_step_name(steps: Column, loose: bool = False) -> Column:
    """The premise that a proof of one step cites by ``exact`` or ``apply``; null if there are more steps or none is cited. The strict form asks for a name that resolves: join it with the corpus."""
    own = nonblank(steps)
    cited = F.regexp_extract(own[0], r"^(exact|apply)\s+([A-Za-z_][A-Za-z0-9_.'!?₀-₉¹²³]*)", 2)
    return F.when((F.size(own) == 1) & (cited != "") & ~cited.isin(*(NOT_A_PREMISE if loose else TACTIC_WORDS)), cited)


def proposed(raw: Column) -> Column:
    """A model's answer as a step, and why it is refused: struct of step and reason."""
    step = clean_step(raw)
    return F.struct(step.alias("step"), F.when(undecodable(step), "undecodable").otherwise(admissible(step)).alias("reason"))


def mean_logprob(total: Column, n_tokens: Column) -> Column:
    return total / F.greatest(n_tokens, F.lit(1))


def node_score(total: Column, depth: Column, alpha: float = 0.5) -> Column:
    return total / F.pow(F.greatest(depth, F.lit(1)).cast("double"), F.lit(alpha))


def left_truncated(tokens: Column, most: int) -> Column:
    """The last ``most`` tokens."""
    return F.when(F.size(tokens) > most, F.slice(tokens, -most, most)).otherwise(tokens)


def cited(steps: Column) -> Column:
    """Names in a proof, each once."""
    return F.array_distinct(F.flatten(F.transform(steps, identifiers)))


