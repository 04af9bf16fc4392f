"""The registered queries of the core, each over its whole tables. Their SQL is in ``sql``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, ids, prompts, records, text
from ..operators import audit, dedup, manifest, model, quality, sampling, similarity, views, votes
from ..operators.staging import shared_dir, stage
from ..sources import files
from ..streaming.resume import resume_stream
from . import seeds as seed_plans

SEED = 41
QUOTAS = {"cn_contest": 500, "amc_aime": 800, "olympiads_ref": 60, "inequalities": 20, "number_theory": 20}
SPLITS = [("train", 100), ("development", 40)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _once(df: DataFrame, key: str) -> DataFrame:
    """Repeated rows once."""
    return dedup.keep_first(df, F.col(key), F.lit(0))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "numina_5k_seeds")
    return df.withColumns({c: F.lower(F.trim(c)) for c in ("split", "source", "problem_type")})


def _pairs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Generated pairs once each; given columns, only these are read."""
    df = table(spark, sf, "gpt_pairs")
    return _once(df.select("sample_id", *columns) if columns else df, "sample_id")


# Text


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_text("text").alias("norm"))


def text_only(spark: SparkSession, sf: str) -> DataFrame:
    marked = spark.createDataFrame([(-1, "see Figure 1"), (-2, "figures only"), (-3, "![x](y)"), (-4, "at http://a.b/c.PNG now"), (-5, "a diagram."), (-6, "plain")], "doc_id bigint, text string")
    rows = table(spark, sf, "documents").select("doc_id", "text").unionByName(marked)
    return rows.select("doc_id", text.is_text_only("text").alias("text_only"))


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.keep_least(docs, text.normalize_text("text"), "doc_id").select("doc_id")


def distinct_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Documents long enough and without pictures, once per normalised text, counted by language and source."""
    norm = text.normalize_text("text")
    fit = table(spark, sf, "documents").select("doc_id", "lang", "source", "text").where((F.length(norm) >= 20) & text.is_text_only("text"))
    marked = stage(fit.select("doc_id", "lang", "source", F.xxhash64(norm).alias("t1"), F.xxhash64(F.lit(1), norm).alias("t2")), "fit-documents")
    return dedup.keep_least(marked, F.struct("t1", "t2"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"))


def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gpt_pairs_quality").select("sample_id", F.size(text.shingles("synthetic_problem")).alias("n_shingles")).distinct()


# Identifiers and prompts


def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = ids.stable_id("pair", "parent_seed_id", "generator_model", "prompt_version", "reasoning_effort", "generation_index")
    cols = [made.alias("made_id"), ids.seed31("parent_seed_id", "generation_index").alias("seed"), ids.seed31("sample_id", F.lit("solver"), 0).alias("solver_seed")]
    return table(spark, sf, "gpt_pairs").select("sample_id", *cols).distinct()


def generation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    work = model.generation_jobs(_once(_seeds(spark, sf), "parent_seed_id"), prompts.GENERATE, "stub", "v1", "low", 2, _pairs(spark, sf))
    return work.select("sample_id", "generation_index", "generation_seed", "prompt")


def audit_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf, "synthetic_problem", "synthetic_solution", "synthetic_answer")
    verify = records.fill(prompts.VERIFY, problem="synthetic_problem", reference_solution="synthetic_solution", reference_answer="synthetic_answer")
    return rows.select("sample_id", verify.alias("verify_prompt"), records.fill(prompts.SOLVE, problem="synthetic_problem").alias("solve_prompt"))


# Answers


def boxed_answers(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "gpt_pairs_solved").select("sample_id", F.explode("solver_rollouts").alias("r"))
    return each.select("sample_id", "r.rollout", answers.extract_boxed("r.raw_response").alias("boxed")).distinct()


def matched_answers(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "gpt_pairs_solved").select("sample_id", "synthetic_answer", F.explode("solver_rollouts").alias("r"))
    norm = answers.normalize_answer("r.prediction").alias("norm")
    return each.select("sample_id", "r.rollout", norm, answers.answer_matches("r.prediction", "synthetic_answer").alias("matches"), answers.declared_invalid("r.prediction").alias("invalid")).distinct()


def reward_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gpt_pairs")
    valid = F.when(F.col("generation_index") == 0, False)
    cols = [answers.compute_score("synthetic_solution", "synthetic_answer").alias("score"), answers.gated_score("synthetic_solution", "synthetic_answer", valid).alias("gated")]
    return rows.select("sample_id", *cols).distinct()


def parsed_bools(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ["true", " YES ", "t", "1", "0", "No", "F", "maybe", "", None, "\tfalse\n"]], "word string")
    return words.select("word", answers.parse_bool("word").alias("value"))


def parseable_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gpt_pairs").select("sample_id", answers.is_parseable("synthetic_answer").alias("parseable")).distinct()


# Votes and rollouts


def solver_consistency(spark: SparkSession, sf: str) -> DataFrame:
    rows = _once(table(spark, sf, "gpt_pairs_solved").select("sample_id", "synthetic_answer", "solver_rollouts"), "sample_id").where("size(solver_rollouts) > 0")
    matches = votes.rollout_matches("solver_rollouts", "synthetic_answer")
    return rows.select("sample_id", matches.alias("matches"), (matches / F.size("solver_rollouts")).alias("rate"), votes.rollouts_declared_invalid("solver_rollouts").alias("declared_invalid"))


def _votes(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    """Votes that are a function of the id and the vote's number."""
    each = model.jobs(_pairs(spark, sf).select("sample_id"), n, "vote").withColumn("h", ids.seed31("sample_id", F.lit("vote"), "vote"))
    kinds = F.array(*(F.lit(k) for k in answers.VERDICT_KINDS))
    return each.select("sample_id", "vote", (F.col("h") % 3 > 0).alias("question_valid"), (F.col("h") % 5 > 1).alias("reference_answer_correct"), F.element_at(kinds, (F.col("h") % 6 + 1).cast("int")).alias("invalid_type"))


def vote_summary(spark: SparkSession, sf: str) -> DataFrame:
    return votes.vote_summary(_votes(spark, sf), "sample_id", 3)


def collected_votes(spark: SparkSession, sf: str) -> DataFrame:
    kept = votes.collected(_votes(spark, sf), "sample_id", "vote", "votes")
    return kept.select("sample_id", F.array_join(F.transform("votes", lambda v: F.concat_ws(":", v["vote"].cast("string"), v["invalid_type"])), ",").alias("kinds"))


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.jobs(_pairs(spark, sf).select("sample_id"), 8, "rollout").withColumn("hit", (ids.seed31("sample_id", F.lit("reach"), "rollout") % 3 == 0).cast("int"))
    counted = rows.groupBy("sample_id").agg(F.sum("hit").alias("hits"))
    return votes.reachability(counted, F.col("hits"), 8).drop("hits")


def regime_theory(spark: SparkSession, sf: str) -> DataFrame:
    return votes.regime_grid(spark, [4, 8, 16, 32], [0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 0.5, 0.8, 0.95, 1.0])


# Similarity and quality


def parent_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gpt_pairs_quality").select("sample_id", "real_problem", "synthetic_problem").distinct()
    return rows.select("sample_id", similarity.row_similarity("real_problem", "synthetic_problem").alias("jaccard"))


def minhash_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """The Jaccard index of parents and pairs as signatures of 64 places estimate it."""
    rows = table(spark, sf, "gpt_pairs_quality").select("sample_id", "real_problem", "synthetic_problem").distinct()
    signed = rows.select("sample_id", text.minhash("real_problem", 64).alias("a"), text.minhash("synthetic_problem", 64).alias("b"))
    return signed.select("sample_id", text.agreement("a", "b").alias("agreement"))


def _joined_hits(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("key").alias("sample_id"), F.array_join("hits", ",").alias("hits"))


def decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = _once(table(spark, sf, "gpt_pairs_quality").select("sample_id", "synthetic_problem"), "sample_id")
    probes = table(spark, sf, "eval_questions").select(F.concat(F.lit("probe_"), "eval_id").alias("sample_id"), F.concat("question", F.lit(" Give the final value.")).alias("synthetic_problem")).where("question is not null")
    return _joined_hits(similarity.evaluation_hits(rows.unionByName(probes), "sample_id", "synthetic_problem", table(spark, sf, "eval_questions")))


def earlier_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _once(table(spark, sf, "gpt_pairs_quality").select("sample_id", "synthetic_problem"), "sample_id")
    return _joined_hits(similarity.earlier_duplicates(rows, "sample_id", "synthetic_problem"))


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "gpt_pairs_solved").columns
    rows = _once(table(spark, sf, "gpt_pairs_quality").select(*names), "sample_id")
    return quality.assess(stage(rows, "solved"), table(spark, sf, "eval_questions"))


def quality_policy(spark: SparkSession, sf: str) -> DataFrame:
    flags = ["schema_ok", "answer_parseable", "eval_contaminated", "synthetic_duplicate", "parent_near_duplicate", "solver_matches", "quality_accept"]
    return _assessed(spark, sf).select("sample_id", *flags)


def quality_failures(spark: SparkSession, sf: str) -> DataFrame:
    return quality.failure_counts(_assessed(spark, sf))


# Sampling


def eligible_seeds(spark: SparkSession, sf: str) -> DataFrame:
    fit = seed_plans.eligible(_seeds(spark, sf), "real_problem", "real_answer", F.col("source").isin(list(QUOTAS)) & (F.col("question_type") == "math-word-problem"))
    return fit.select("parent_seed_id", "norm").distinct()


def source_quotas(spark: SparkSession, sf: str) -> DataFrame:
    have = _once(_seeds(spark, sf).select("parent_seed_id", "source"), "parent_seed_id").groupBy("source").agg(F.count("*").alias("available"))
    return sampling.quotas_with_transfer(have, QUOTAS, "amc_aime", "cn_contest")


def quota_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = _once(_seeds(spark, sf).select("parent_seed_id", "source"), "parent_seed_id")
    quotas = spark.createDataFrame([(s, n // 10) for s, n in QUOTAS.items()], "source string, quota bigint")
    return sampling.quota_sample(rows, "source", "parent_seed_id", quotas, SEED)


def split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = _once(_seeds(spark, sf).select("parent_seed_id"), "parent_seed_id")
    return sampling.assign_split(rows, "parent_seed_id", SPLITS, "held_out_audit", SEED)


def group_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).select("sample_id", "parent_seed_id")
    return sampling.cap_by_group(rows.where("parent_seed_id is not null"), ["parent_seed_id"], "sample_id", 2, SEED)


def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf).select("sample_id", F.col("synthetic_problem").alias("problem"), F.col("synthetic_solution").alias("reference_solution"), F.col("synthetic_answer").alias("reference_answer"))
    return audit.audit_sheet(rows, 200, SEED, hide=True)


def _view_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One assessed pair per parent, of the train split."""
    rows = table(spark, sf, "gpt_pairs_quality").where("lower(trim(split)) = 'train' and parent_seed_id is not null")
    return dedup.keep_first(rows, F.trim("parent_seed_id"), F.col("sample_id"))


def nested_positions(spark: SparkSession, sf: str) -> DataFrame:
    placed = sampling.nested_positions(_view_rows(spark, sf).select("parent_seed_id", "source", "problem_type"), "parent_seed_id", ["source", "problem_type"], SEED)
    members = [sampling.in_ratio(r).alias(f"in_{int(r * 100):03d}") for r in views.RATIOS]
    return placed.select("parent_seed_id", "position", *members)


def rlvr_views(spark: SparkSession, sf: str) -> DataFrame:
    v = views.rlvr_views(_view_rows(spark, sf), SEED)
    return v.select("data_source", "ability", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.*", "extra_info.*")


def sft_views(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return views.sft_views(_view_rows(spark, sf)).select("sample_id", "parent_seed_id", "origin", "arm", m[0]["content"].alias("ask"), m[1]["role"].alias("role"), m[1]["content"].alias("reply"))


def arm_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.arm_counts(views.rlvr_views(_view_rows(spark, sf), SEED))


# Audit and grouped datasets


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with votes, and a sheet for some of them: two lines each, of which the last counts."""
    pairs = _pairs(spark, sf).select("sample_id", F.col("synthetic_problem").alias("problem"), F.col("synthetic_solution").alias("reference_solution"), F.col("synthetic_answer").alias("reference_answer"))
    rows = pairs.join(votes.vote_summary(_votes(spark, sf), "sample_id", 3), "sample_id")
    h = ids.seed31("sample_id", F.lit("audit"))
    lines = rows.select("sample_id", h.alias("h"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line")).where("h % 4 = 0")
    word = lambda n: F.when((F.col("h") + F.col("line")) % n == 0, "no").when((F.col("h") + F.col("line")) % n == 1, "maybe").otherwise("YES")
    sheet = lines.select("sample_id", "line", word(3).alias("question_valid"), word(4).alias("unique_answer_exists"), word(5).alias("reference_answer_correct"), *(F.lit("").alias(c) for c in ("annotator_id", "invalid_type", "difficulty", "confidence", "notes")))
    return audit.merge_audit(rows, sheet, "line")


def merged_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _audited(spark, sf).select("sample_id", "human_audit.question_valid", "human_audit.unique_answer_exists", "human_audit.reference_answer_correct")


def assigned_groups(spark: SparkSession, sf: str) -> DataFrame:
    return views.with_group(_audited(spark, sf)).select("sample_id", "experimental_group")


def audited_datasets(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.with_group(_audited(spark, sf)).withColumn("pseudo_answer_p_hat", F.lit(None).cast("double"))
    made = views.audited_datasets(rows)
    sft = made["sft"].select("sample_id", "group", F.lit("sft").alias("kind"), F.col("messages")[1]["content"].alias("content"))
    rlvr = made["rlvr"].select("extra_info.sample_id", "extra_info.group", F.lit("rlvr").alias("kind"), F.col("reward_model.ground_truth").alias("content"))
    invalid = made["invalid_eval"].select("sample_id", F.col("experimental_group").alias("group"), F.lit("invalid_eval").alias("kind"), F.lit(None).cast("string").alias("content"))
    return sft.unionByName(rlvr).unionByName(invalid)


# Resume, validation, manifests


def pending_solutions(spark: SparkSession, sf: str) -> DataFrame:
    return model.pending(_pairs(spark, sf).select("sample_id", "parent_seed_id"), table(spark, sf, "gpt_pairs_solved"))


def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    plain = dedup.duplicates(table(spark, sf, "gpt_pairs"), "sample_id")
    return plain.unionByName(dedup.duplicates(table(spark, sf, "rlvr"), "extra_info.sample_id"))


def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "gpt_pairs").select(F.to_json(F.struct("sample_id", "split", "generated_at", "synthetic_solution")).alias("value"))
    return manifest.missing_keys(lines, "value", ["sample_id", "split", "generated_at", "absent"])


def generator_usage(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.usage(table(spark, sf, "gpt_pairs"), "token_usage")


def solver_usage(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.nested_usage(table(spark, sf, "gpt_pairs_solved"), "solver_rollouts")


def release_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.release_manifest(table(spark, sf, "gpt_pairs"), table(spark, sf, "gpt_pairs_quality"))


def counts_by_split_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gpt_pairs").groupBy("split", "source").agg(F.count("*").alias("rows"), F.count_distinct("parent_seed_id").alias("parents"))


# Whole chains


def _canonical(spark: SparkSession, sf: str) -> seed_plans.CanonicalSeeds:
    raw = _once(table(spark, sf, "numina_5k_seeds"), "parent_seed_id").select("source", "problem", "solution", "answer", "problem_type", "question_type", F.col("parent_seed_id").alias("arrival"))
    raw = raw.withColumn("source", F.lower(F.trim("source")))
    quotas = {s: n // 10 for s, n in QUOTAS.items()}
    return seed_plans.canonical_plan(raw, table(spark, sf, "eval_questions"), quotas, ("amc_aime", "cn_contest"), SPLITS, "held_out_audit", SEED, "arrival", F.col("source").isin(list(QUOTAS)) & (F.col("question_type") == "math-word-problem"))


def canonical_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _canonical(spark, sf).seeds.select("parent_seed_id", "split", "source", "real_answer")


def seed_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _canonical(spark, sf).manifest()


def pool_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return seed_plans.pool_seeds(table(spark, sf, "rlvr"), F.col("extra_info.parent_seed_id"), "pool", F.struct("extra_info.sample_id", F.col("prompt")[0]["content"])).select("seed_id", "source_id", "domain", "problem")


def repaired_json(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.json_repair import json_fields

    rows = table(spark, sf, "gpt_pairs").select("sample_id", "raw_response").distinct()
    return rows.select("sample_id", json_fields(F.col("raw_response"), model.FIELDS).alias("v")).select("sample_id", "v.ok", "v.problem", "v.reference_answer")


_AT = "2026-01-01T00:00:00+00:00"


def _generated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, model.HashProvider]:
    """Pairs and failures of the stand-in provider: one job for each seed, in two rounds."""
    provider = model.HashProvider()
    work = model.generation_jobs(_once(_seeds(spark, sf), "parent_seed_id"), prompts.GENERATE, provider.name, "v1", "low", 1)
    good, failed = model.generate_in_rounds(work, provider, rounds=2, at=F.lit(_AT))
    return good, failed, provider


def generated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pair row, its struct of usage as columns."""
    good = _generated(spark, sf)[0]
    return good.select(*(c for c in good.columns if c != "token_usage"), "token_usage.*")


def generation_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _generated(spark, sf)[1]


def generation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Generation, then three rollouts of each pair, in rounds; pairs whose solver failed come out with the error."""
    good, _, provider = _generated(spark, sf)
    solved, failed = model.in_rounds(good, lambda rest: model.solve(rest, provider, prompts.SOLVE, 3, at=F.lit(_AT)), rounds=2)
    tokens = F.aggregate("solver_rollouts", F.lit(0).cast("bigint"), lambda s, r: s + r["token_usage"]["total_tokens"])
    predictions = F.array_join(F.transform("solver_rollouts", lambda r: r["prediction"]), ",")
    done = solved.select(
        "sample_id", "schema_attempts", "solver_model", "solver_rollouts_k", "solver_matches", "solver_match_rate", "solver_declared_invalid", predictions.alias("predictions"), tokens.alias("tokens"),
        "solved_at", *(F.lit(None).cast("string").alias(c) for c in ("error_type", "error", "failed_at")),
    )
    return done.unionByName(failed, allowMissingColumns=True)


def failure_log(spark: SparkSession, sf: str) -> DataFrame:
    return model.log_lines(_generated(spark, sf)[1])


def verdict_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written as JSON, some of it broken, parsed into votes and summed up."""
    made = _votes(spark, sf)
    reply = F.when(F.col("vote") == 2, F.lit("no verdict")).otherwise(F.to_json(F.struct("question_valid", "reference_answer_correct", "invalid_type", F.lit("0.5").alias("confidence"))))
    return votes.vote_summary(model.parsed_votes(made.select("sample_id", "vote", reply.alias("response"))), "sample_id", 3)


def limited_solutions(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 pending pairs by id."""
    todo = model.pending(_pairs(spark, sf).select("sample_id"), table(spark, sf, "gpt_pairs_solved"))
    return sampling.first_by(todo, "sample_id", 50)


def quality_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_manifest(_assessed(spark, sf))


def view_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return views.view_manifest(views.rlvr_views(_view_rows(spark, sf), SEED))


def invalid_records(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated ids and missing keys of pairs and views, as lines of one log."""
    pairs = table(spark, sf, "gpt_pairs").select(F.to_json(F.struct("sample_id", "split")).alias("value"))
    view = table(spark, sf, "rlvr").select(F.to_json(F.struct("extra_info", F.lit("").alias("sample_id"))).alias("value"))
    return manifest.invalid_records(pairs.unionByName(view), "value", ["sample_id", "extra_info"])


def quota_shortages(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that lack rows for their quota, after the transfer."""
    return source_quotas(spark, sf).where("available < quota")


# Files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def appended_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log written in two parts, read back."""
    rows, path = table(spark, sf, "gpt_pairs").select("sample_id", "split", "generation_index"), _folder(spark, "log")
    for part in ("generation_index = 0", "not coalesce(generation_index = 0, false)"):
        files.write_jsonl(rows.where(part), path, mode="append")
    return files.read_jsonl(spark, path, rows.schema)


def view_files(spark: SparkSession, sf: str) -> DataFrame:
    """The views in both formats and the Parquet export of the JSON lines, counted by arm as read back."""
    made, path = views.rlvr_views(_view_rows(spark, sf), SEED), _folder(spark, "views")
    files.write_view(made, f"{path}/rlvr")
    files.export_parquet(spark, f"{path}/rlvr.jsonl", f"{path}/export.parquet", made.schema)
    read = {"parquet": spark.read.schema(made.schema).parquet(f"{path}/rlvr.parquet"), "jsonl": files.read_jsonl(spark, f"{path}/rlvr.jsonl", made.schema), "export": files.read_columns(spark, f"{path}/export.parquet", ["reward_model", "extra_info"])}
    out = None
    for name, df in read.items():
        one = df.groupBy("extra_info.arm").agg(F.count("*").alias("rows"), F.count_if(F.col("extra_info.origin") == "synthetic").alias("synthetic"), F.sum(F.length("reward_model.ground_truth")).alias("answer_chars")).withColumn("format", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def evaluation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written as one set of lines and one of an array under ``data``, read back with their numbers."""
    root = _folder(spark, "evaluation")
    rows = table(spark, sf, "eval_questions").where("question is not null").orderBy("eval_id", "question")
    lines = rows.select(F.to_json(F.struct(F.lit("").alias("problem"), F.col("question").alias("query"))).alias("value"))
    lines.coalesce(1).write.text(f"{root}/math/test.jsonl")
    items = F.transform(F.array_sort(F.collect_list(F.struct("eval_id", "question"))), lambda r: F.struct(r["question"].alias("problem")))
    rows.agg(F.to_json(F.struct(items.alias("data"))).alias("value")).coalesce(1).write.text(f"{root}/amc23/test.json")
    return files.evaluation_questions(spark, root)


def sheet_files(spark: SparkSession, sf: str) -> DataFrame:
    """The audit sheet written for a spreadsheet and read back."""
    path = _folder(spark, "sheet")
    files.write_sheet(audit_sample(spark, sf), path)
    return files.read_sheet(spark, path)


def theory_file(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "theory")
    files.write_sheet(regime_theory(spark, sf), path, mark=False)
    return files.read_sheet(spark, path).select(F.col("k").cast("int"), *(F.col(c).cast("double") for c in ("p", "dead", "active", "saturated")))


def _artifacts(spark: SparkSession, sf: str) -> str:
    root = _folder(spark, "artifacts")
    table(spark, sf, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(f"{root}/regions")
    table(spark, sf, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(f"{root}/nations")
    return root


def artifact_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and digests of written files; one that is named but absent is left out."""
    found = files.artifact_digests(spark, _artifacts(spark, sf), ["regions", "nations", "absent"])
    return found.select(F.element_at(F.split("name", "/"), 1).alias("name"), "bytes", "sha256")


def snapshot_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose digest is not the one expected."""
    root = _artifacts(spark, sf)
    have = files.file_digests(spark, f"{root}/*").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.element_at(F.split("path", "/"), -2).alias("name"), "sha256")
    expected = have.select(F.col("file").alias("name"), F.when(F.col("name") == "regions", "0").otherwise(F.col("sha256")).alias("sha256"))
    expected = expected.unionByName(spark.createDataFrame([("gone", "0")], "name string, sha256 string"))
    wrong = files.digest_mismatches(spark, f"{root}/*", expected)
    return wrong.select(F.when(F.col("name") == "gone", "gone").otherwise("changed").alias("kind"), "found")


def projected_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Some columns of a table, the rest never read."""
    return files.read_columns(spark, f"{sf}/gpt_pairs.parquet", ["sample_id", "split", "claimed_domain"]).distinct()


def number_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as answers and flags: a 0 says nothing, unlike the text."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.col("n_regionkey").cast("string").alias("word"))
    return rows.select(
        "n_nationkey", answers.normalize_answer("n_regionkey").alias("norm"), answers.parse_bool("n_regionkey").alias("flag"), answers.normalize_answer("word").alias("word_norm"), answers.parse_bool("word").alias("word_flag"),
        answers.answer_matches("n_regionkey", "word").alias("same"),
    )


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "gpt_pairs_solved")
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema).select("sample_id", "synthetic_problem", "solver_match_rate", "solver_matches", F.size("solver_rollouts").alias("rollouts"))


def resumed_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf, "gpt_pairs")
    rows.select("sample_id", "synthetic_answer").write.parquet(f"{base}/in")
    work = lambda b: b.select("sample_id", answers.normalize_answer("synthetic_answer").alias("norm"))
    resume_stream(spark, f"{base}/in", "sample_id string, synthetic_answer string", "sample_id", work, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


_ALL = [
    distinct_by_source, normalize_text, text_only, exact_dedup, shingle_counts, stable_ids, generation_prompts, audit_prompts, boxed_answers, matched_answers,
    reward_scores, parsed_bools, parseable_answers, solver_consistency, vote_summary, collected_votes, reachability, regime_theory, parent_jaccard,
    decontamination, earlier_duplicates, quality_policy, quality_failures, eligible_seeds, source_quotas, quota_sample, split_assignment, group_caps,
    audit_sample, nested_positions, rlvr_views, sft_views, arm_counts, merged_audit, assigned_groups, audited_datasets, pending_solutions, duplicate_ids,
    missing_keys, generator_usage, solver_usage, release_manifest, counts_by_split_source, canonical_seeds, pool_seeds, repaired_json, generation_chain,
    verdict_chain, jsonl_round_trip, resumed_stream, generated_pairs, generation_failures, failure_log, seed_manifest, quality_manifest, view_manifest, invalid_records,
    limited_solutions, quota_shortages, appended_log, view_files, evaluation_files, sheet_files, theory_file, artifact_digests, snapshot_mismatches, projected_pairs, number_answers, minhash_agreement,
]
QUERIES = {f.__name__: f for f in _ALL}
