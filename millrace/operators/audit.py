"""Sampling for human audit, and merging the answers back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import parse_bool
from .sampling import take

#: The columns of an audit sheet, and those hidden from annotators on request.
SHEET = [
    "sample_id", "problem", "reference_solution", "reference_answer", "auto_valid_votes", "auto_reference_correct_votes", "auto_invalid_type", "annotator_id",
    "question_valid", "invalid_type", "unique_answer_exists", "reference_answer_correct", "difficulty", "confidence", "notes",
]
HIDDEN = ["auto_valid_votes", "auto_reference_correct_votes", "auto_invalid_type"]


def audit_sheet(rows: DataFrame, sample_size: int, seed: int, hide: bool = False) -> DataFrame:
    """A sample in the sheet's columns, all strings; what a row lacks, and what is hidden, is ''."""
    blank = lambda c: c not in rows.columns or hide and c in HIDDEN
    return take(rows, "sample_id", sample_size, seed).select(*((F.lit("") if blank(c) else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in SHEET))


def merge_audit(rows: DataFrame, sheet: DataFrame, order: str) -> DataFrame:
    """Adds or replaces ``human_audit`` where the sheet has the row's ``sample_id``; of several lines the last by ``order`` counts."""
    bools = {c: parse_bool(c) for c in ("question_valid", "unique_answer_exists", "reference_answer_correct")}
    texts = ["annotator_id", "invalid_type", "difficulty", "confidence", "notes"]
    answer = F.struct(*(bools[c].alias(c) for c in bools), *(F.col(c) for c in texts))
    last = sheet.where("sample_id is not null").groupBy("sample_id").agg(F.max_by(answer, F.col(order)).alias("_audit"))
    joined = rows.join(last, "sample_id", "left")
    old = F.col("human_audit") if "human_audit" in rows.columns else F.lit(None)
    return joined.withColumn("human_audit", F.when(F.col("_audit").isNotNull(), F.col("_audit")).otherwise(old.cast(joined.schema["_audit"].dataType))).drop("_audit")
