"""The whole run: generation and solving in rounds with gates, assessment, views and manifests, each stage written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import manifest, model, quality, views
from ..operators.staging import stage
from ..sources import files


def run(
    seeds: DataFrame, questions: DataFrame, generator: model.Provider, solver: model.Provider, root: str, version: str = "v1", effort: str = "low", copies: int = 1, rounds: int = 8, rollouts: int = 3, split: str = "train", expected: int = 0, seed: int = 0, at: Column | None = None
) -> DataFrame:
    """Writes under ``root`` and returns the release's manifest, ``section, name, value``.

    Pairs that an earlier, broken-off run wrote to ``root`` are not asked for again. A stage in which some sample
    still fails after ``rounds`` rounds ends the run with an error (see :func:`model.gate`); what it made and its
    failures are kept, so that the next run goes on from there. ``expected``: rows that the views must have (0: any).
    """
    spark = seeds.sparkSession
    pairs_at, solved_at, quality_at = f"{root}/raw/pairs.parquet", f"{root}/interim/solved.parquet", f"{root}/interim/quality.parquet"

    def continued(path: str, wanted: DataFrame, once, name: str) -> DataFrame:
        """The stage's whole table: what is there and what the rounds add; the gate closes it."""
        done = files.if_there(spark, path)
        made, failed = model.in_rounds(wanted if done is None else model.pending(wanted, done), once, rounds)
        made.write.mode("append").parquet(path)
        files.write_jsonl(failed, path.replace(".parquet", "_failures.jsonl"), mode="append")
        return model.gate(spark.read.parquet(path), wanted, name)

    work = stage(model.generation_jobs(seeds, prompts.GENERATE, generator.name, version, effort, copies), "jobs")
    pairs = continued(pairs_at, work, lambda rest: model.generate(rest, generator, at=at), "generation")
    solved = continued(solved_at, pairs, lambda rest: model.solve(rest, solver, prompts.SOLVE, rollouts, effort=effort, at=at), "solving")
    quality.assess(solved, questions).write.mode("overwrite").parquet(quality_at)
    assessed = spark.read.parquet(quality_at)

    rows = assessed.where(F.col("split") == split)
    views.check_rows(rows, expected=expected, required=("quality_accept", "parent_problem_jaccard"))
    made = views.rlvr_views(rows, seed)
    files.write_view(made, f"{root}/processed/rlvr")
    files.write_jsonl(views.sft_views(rows), f"{root}/processed/sft.jsonl")

    counts = manifest.as_section(manifest.release_manifest(pairs, assessed).select("rows", "unique_parent_seeds", "quality_accept", *(f"{w}_{f}" for w in ("generator", "solver") for f in manifest.TOKEN_FIELDS)), "release")
    out = counts.unionByName(manifest.by_key(pairs, "by_split", "split")).unionByName(manifest.by_key(pairs, "by_source", "source"))
    out = out.unionByName(quality.quality_manifest(assessed)).unionByName(views.view_manifest(made))
    files.write_jsonl(out, f"{root}/manifest.jsonl")
    digests = files.artifact_digests(spark, root, ["raw/pairs.parquet", "interim/quality.parquet", "processed/rlvr.parquet", "processed/rlvr.jsonl", "processed/sft.jsonl", "manifest.jsonl"])
    files.write_jsonl(digests, f"{root}/digests.jsonl")
    return files.read_jsonl(spark, f"{root}/manifest.jsonl", "section string, name string, value bigint")
