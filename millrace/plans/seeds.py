"""Chains that build seed pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import UNGRADABLE
from ..functions.ids import stable_id
from ..functions.records import unwrapped_prompt
from ..functions.text import is_text_only, normalize_text, strip, text_or_empty
from ..operators.dedup import keep_first, keep_least
from ..operators.manifest import by_key
from ..operators.sampling import assign_split, canonical_order, quota_sample, quotas_with_transfer, require_quotas
from ..operators.similarity import evaluation_hits
from ..operators.staging import stage


def eligible(rows: DataFrame, problem: str, answer: str, where: Column, least_chars: int = 20) -> DataFrame:
    """Rows that meet ``where``, have a gradable answer and a long enough problem without pictures; adds ``norm``."""
    word = F.lower(strip(text_or_empty(answer)))
    gradable = (word != "") & ~word.isin(UNGRADABLE[:2])
    return rows.where(F.coalesce(where, F.lit(False)) & gradable).withColumn("norm", normalize_text(problem)).where((F.length("norm") >= least_chars) & is_text_only(problem))


@dataclass
class CanonicalSeeds:
    """The seeds and the steps that led to them."""

    fit: DataFrame
    unique: DataFrame
    contaminated: DataFrame
    quotas: DataFrame
    seeds: DataFrame

    def manifest(self) -> DataFrame:
        """``section, name, value``: the counts of each step, by source and split."""
        clean = self.unique.join(self.contaminated.select("parent_seed_id"), "parent_seed_id", "left_anti")
        count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit("counts").alias("section"), F.lit(name).alias("name"), "value")
        quotas = self.quotas.select(F.lit("source_quotas").alias("section"), F.col("source").alias("name"), F.col("quota").alias("value"))
        parts = [count(self.unique, "eligible_after_exact_dedup"), count(self.contaminated, "contaminated"), quotas]
        parts += [by_key(clean, "available_clean_by_source", "source"), by_key(self.seeds, "selected_by_source", "source"), by_key(self.seeds, "selected_by_split", "split")]
        out = count(self.fit, "eligible_before_exact_dedup")
        for part in parts:
            out = out.unionByName(part)
        return out


def canonical_plan(
    rows: DataFrame, questions: DataFrame, quotas: dict[str, int], transfer: tuple[str, str], splits: list[tuple[str, int]], rest: str, seed: int, order: str, where: Column, threshold: float = 0.8, strict: bool = False
) -> CanonicalSeeds:
    """Filter, deduplicate, decontaminate, sample by source quotas, split and sort.

    ``rows`` has ``source, problem, solution, answer, problem_type, question_type`` and an ``order`` column, unique
    and not null, that decides which of several rows with one normalised problem stays. ``strict``: a source with
    fewer rows than its quota (after the transfer) is an error.
    """
    fit = eligible(rows, "problem", "answer", where)
    marked = stage(fit.withColumns({"t1": F.xxhash64("norm"), "t2": F.xxhash64(F.lit(1), "norm")}).drop("norm"), "fit-seeds")
    unique = keep_least(marked, F.struct("t1", "t2"), order).withColumn("parent_seed_id", stable_id("numina", "source", "problem", "answer"))
    unique = stage(unique.drop("t1", "t2"), "unique-seeds")
    hits = stage(evaluation_hits(unique.select("parent_seed_id", "problem"), "parent_seed_id", "problem", questions, threshold).toDF("parent_seed_id", "hits"), "contaminated-seeds")
    clean = unique.join(hits.select("parent_seed_id"), "parent_seed_id", "left_anti")
    wanted = stage(quotas_with_transfer(clean.groupBy("source").agg(F.count("*").alias("available")), quotas, *transfer), "seed-quotas")
    if strict:
        require_quotas(wanted)
    chosen = assign_split(quota_sample(clean, "source", "parent_seed_id", wanted, seed), "parent_seed_id", splits, rest, seed + 1)
    trimmed = {c: strip(text_or_empty(c)) for c in ("problem", "solution", "answer")}
    seeds = chosen.select(
        "parent_seed_id", F.col("parent_seed_id").alias("seed_id"), "split", "source", "problem_type", "question_type", F.col("problem_type").alias("domain"),
        F.lit("competition_math").alias("difficulty"), *(t.alias(f"real_{c}") for c, t in trimmed.items()), *(t.alias(c) for c, t in trimmed.items()),
    )
    return CanonicalSeeds(marked, unique, hits, wanted, canonical_order(stage(seeds, "seeds"), ["split", "source", "parent_seed_id"]))


def pool_seeds(rows: DataFrame, source_id: Column, pool: str, order: Column) -> DataFrame:
    """Seeds of a prompt pool whose rows repeat: the first of each source id by ``order``, with its unwrapped problem."""
    first = keep_first(rows.withColumn("source_id", source_id.cast("string")), F.col("source_id"), order)
    return first.select(
        stable_id("seed", F.lit(pool), "source_id").alias("seed_id"), F.lit(pool).alias("source"), "source_id", F.coalesce("ability", F.lit("MATH")).alias("domain"),
        F.lit("rlvr_curated").alias("difficulty"), unwrapped_prompt("prompt").alias("problem"), text_or_empty("reward_model.ground_truth").alias("answer"),
    )
