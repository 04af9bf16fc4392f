"""Prompts and training records as nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import stable_id
from .text import _col, strip, text_or_empty

#: The wrapping of prompts in a public pool of competition problems.
POOL_PREFIX = "Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem."
POOL_SUFFIX = 'Remember to put your answer on its own line after "Answer:".'
#: Fixed values of the record formats.
VIEW_NAME, VIEW_STYLE, AUDITED_STYLE = "numina_synthetic_substitution", "rule-lighteval/MATH_v2", "rule"


def fill(template: str, **columns: str | Column) -> Column:
    """``template`` with ``{name}`` replaced by columns and doubled braces by single ones; null is written None."""
    parts: list[Column] = []
    text, i = "", 0
    while i < len(template):
        if template[i : i + 2] in ("{{", "}}"):
            text, i = text + template[i], i + 2
        elif template[i] == "{":
            end = template.index("}", i)
            parts += [F.lit(text), F.coalesce(_col(columns[template[i + 1 : end]]).cast("string"), F.lit("None"))]
            text, i = "", end + 1
        else:
            text, i = text + template[i], i + 1
    return F.concat(*parts, F.lit(text))


def unwrapped_prompt(prompt: str | Column) -> Column:
    """The problem inside the first message of a pool's prompt."""
    text = strip(text_or_empty(F.try_element_at(_col(prompt), F.lit(1))["content"]))
    text = F.when(F.startswith(text, F.lit(POOL_PREFIX)), strip(text.substr(F.lit(len(POOL_PREFIX) + 1), F.length(text)))).otherwise(text)
    return F.when(F.endswith(text, F.lit(POOL_SUFFIX)), strip(text.substr(F.lit(1), F.length(text) - len(POOL_SUFFIX)))).otherwise(text)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def rlvr_record(synthetic: Column, arm: Column, ratio: Column) -> list[Column]:
    """The columns of a reinforcement record; provenance is null where the real problem is used."""
    pick = lambda name: F.when(synthetic, F.col(f"synthetic_{name}")).otherwise(F.col(f"real_{name}"))
    given = lambda name: F.when(synthetic, F.col(name)).alias(name)
    info = F.struct(
        stable_id("train", "parent_seed_id", arm).alias("sample_id"), "parent_seed_id", "source", "problem_type",
        F.when(synthetic, "synthetic").otherwise("real").alias("origin"), arm.alias("arm"), ratio.cast("double").alias("synthetic_ratio"),
        given("generator_model"), given("prompt_version"), given("quality_accept"), given("solver_matches"),
    )
    return [
        F.lit(VIEW_NAME).alias("data_source"), F.array(message("user", pick("problem"))).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit(VIEW_STYLE).alias("style"), F.coalesce(pick("answer"), F.lit("None")).alias("ground_truth")).alias("reward_model"), info.alias("extra_info"),
    ]


def sft_record(synthetic: Column, arm: Column) -> list[Column]:
    """The columns of a supervised record: the solution is followed by its boxed answer."""
    pick = lambda name: F.coalesce(F.when(synthetic, F.col(f"synthetic_{name}")).otherwise(F.col(f"real_{name}")), F.lit("None"))
    reply = F.concat(pick("solution"), F.lit("\n\n\\boxed{"), pick("answer"), F.lit("}"))
    problem = F.when(synthetic, F.col("synthetic_problem")).otherwise(F.col("real_problem"))
    return [
        stable_id("sft", "parent_seed_id", arm).alias("sample_id"), F.col("parent_seed_id"), F.when(synthetic, "synthetic").otherwise("real").alias("origin"),
        F.array(message("user", problem), message("assistant", reply)).alias("messages"),
    ]


def audited_records(name: str = "audited_math") -> dict[str, list[Column]]:
    """Columns of the supervised and reinforcement records of an audited pool with ``experimental_group``; ``name`` is its ``data_source``."""
    sft = [F.col("sample_id"), F.col("experimental_group").alias("group"), F.array(message("user", F.col("problem")), message("assistant", F.col("reference_solution"))).alias("messages")]
    rlvr = [
        F.lit(name).alias("data_source"), F.array(message("user", F.col("problem"))).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit(AUDITED_STYLE).alias("style"), F.coalesce(F.col("reference_answer"), F.lit("None")).alias("ground_truth")).alias("reward_model"),
        F.struct("sample_id", F.col("experimental_group").alias("group"), F.col("human_audit.question_valid").alias("question_valid"), "pseudo_answer_p_hat").alias("extra_info"),
    ]
    return {"sft": sft, "rlvr": rlvr}


def arm_name(ratio: str | Column) -> Column:
    return F.format_string("r%03d", (_col(ratio) * 100).cast("int"))
