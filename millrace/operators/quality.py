"""Label-free quality policy for generated problems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import is_parseable
from ..functions.text import strip, text_or_empty
from .manifest import as_section, by_key
from .similarity import earlier_duplicates, evaluation_hits, row_similarity, shingle_sets
from .staging import stage
from .votes import rollout_matches


def assess(rows: DataFrame, questions: DataFrame, threshold: float = 0.8, required_matches: int = 2, parse_mode: str = "regex") -> DataFrame:
    """Adds the policy's checks and ``quality_accept`` to solved pairs, one row per ``sample_id``.

    Similarity is the exact Jaccard index of word shingles with ``>=``, where an index of hashed bands
    would miss most pairs near the threshold and keep some below it.
    """
    cols = {"synthetic_problem", "synthetic_solution", "synthetic_answer", "real_problem", "solver_rollouts", "solver_matches", "solver_match_rate"}
    rest = [c for c in rows.columns if c not in cols]
    sets = shingle_sets(rows, "sample_id", "synthetic_problem")
    hits = evaluation_hits(rows, "sample_id", "synthetic_problem", questions, threshold, sets).toDF("sample_id", "eval_contamination_hits")
    repeats = earlier_duplicates(rows, "sample_id", "synthetic_problem", threshold, sets).toDF("sample_id", "synthetic_duplicate_hits")
    filled = F.size(F.coalesce("solver_rollouts", F.array())) > 0
    complete = [F.length(strip(text_or_empty(c))) > 0 for c in ("synthetic_problem", "synthetic_solution", "synthetic_answer")]
    checked = rows.select(
        *rest, *sorted(cols - {"solver_matches", "solver_match_rate"}), (complete[0] & complete[1] & complete[2]).alias("schema_ok"),
        is_parseable("synthetic_answer", parse_mode).alias("answer_parseable"),
        row_similarity("real_problem", "synthetic_problem").alias("parent_problem_jaccard"),
        F.when(filled, rollout_matches("solver_rollouts", "synthetic_answer")).otherwise(F.coalesce("solver_matches", F.lit(-1))).alias("solver_matches"),
        F.when(filled, rollout_matches("solver_rollouts", "synthetic_answer") / F.size("solver_rollouts")).otherwise(F.col("solver_match_rate")).alias("solver_match_rate"),
    )
    empty = F.array().cast("array<string>")
    joined = stage(checked, "checked").join(hits, "sample_id", "left").join(repeats, "sample_id", "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("eval_contamination_hits", "synthetic_duplicate_hits")}
    )
    flagged = joined.withColumns({
        "eval_contaminated": F.size("eval_contamination_hits") > 0, "synthetic_duplicate": F.size("synthetic_duplicate_hits") > 0,
        "parent_near_duplicate": F.col("parent_problem_jaccard") >= threshold, "required_solver_matches": F.lit(required_matches),
    })
    accept = "schema_ok and answer_parseable and solver_matches >= required_solver_matches and not eval_contaminated and not synthetic_duplicate and not parent_near_duplicate"
    return flagged.withColumn("quality_accept", F.expr(accept))


def quality_manifest(assessed: DataFrame) -> DataFrame:
    """``section, name, value``: the counts of :func:`failure_counts` and the rows of each source."""
    return as_section(failure_counts(assessed), "checks").unionByName(by_key(assessed, "by_source", "source"))


def failure_counts(assessed: DataFrame) -> DataFrame:
    """One row with the number of rows, of accepted ones, and of failures of each check."""
    count = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    return assessed.agg(
        F.count("*").alias("rows"), count("quality_accept", "quality_accept"), count("not schema_ok", "schema_failed"), count("not answer_parseable", "unparseable"),
        count("eval_contaminated", "eval_contaminated"), count("synthetic_duplicate", "synthetic_duplicate"), count("parent_near_duplicate", "parent_near_duplicate"),
        count("solver_matches < required_solver_matches", "solver_rejected"),
    )
