"""Model-backed operators behind an injected provider, and resuming them.

A provider is any object with ``name`` and ``complete(prompts, system, seeds)``, which returns a
:class:`Reply` (or plain text, or None for a failed call) for each prompt. It runs in Arrow batches on the
executors. What it returns is written before it is parted into results and failures: reading an unwritten
partition twice would repeat paid calls, and a model that answers differently could lose a row or double it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import answer_matches, declared_invalid, extract_boxed, parse_bool, verdict_kind
from ..functions.ids import seed31, stable_id
from ..functions.json_repair import Repair, extract_json_object, json_fields
from ..functions.records import fill
from ..functions.text import strip, text_or_empty
from .dedup import drop_matching
from .staging import stage

FIELDS = ["problem", "reference_solution", "reference_answer", "claimed_domain", "claimed_difficulty"]
GENERATOR_SYSTEM, SOLVER_SYSTEM = "Return only one valid JSON object.", "Solve independently. Follow the requested boxed-answer format."
#: Errors are cut to so many characters where they are stored, and to so many in a log line.
STORED_ERROR, LOGGED_ERROR = 4000, 300

_REPLY = "response string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, request_attempts int, error_type string, error string"
_REPLY_COLUMNS = [f.split()[0] for f in _REPLY.split(", ")]


@dataclass
class Reply:
    """A model's text with its usage, or, where ``text`` is None, the error of the last attempt."""

    text: str | None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    total_tokens: int | None = None
    attempts: int = 1
    error_type: str | None = None
    error: str | None = None


class Provider(Protocol):
    name: str

    def complete(self, prompts: list[str], system: str, seeds: list[int]) -> list[Reply | str | None]: ...


def as_reply(given: Reply | str | None) -> Reply:
    if isinstance(given, Reply):
        return given
    return Reply(given) if given is not None else Reply(None, error_type="RuntimeError", error="the call failed")


class HashProvider:
    """A deterministic stand-in: answers and usage are a function of prompt and seed only."""

    name = "hash-stub"

    def __init__(self, reliable: bool = False):
        self.reliable = reliable  # then no call and no reply fails

    def complete(self, prompts: list[str], system: str, seeds: list[int]) -> list[Reply]:
        out = []
        for p, s in zip(prompts, seeds):
            n = int(hashlib.sha256(f"{s}\x1f{p}".encode()).hexdigest()[:6], 16)
            if "boxed" in system:
                if n % 17 == 0 and not self.reliable:
                    out.append(Reply(None, attempts=3, error_type="TimeoutError", error="no reply"))
                    continue
                text = f"We find \\boxed{{{n % 5}}}."
            elif n % 3 == 0 and not self.reliable:
                text = "I would rather talk about something else"
            else:
                text = f'```json\n{{"problem": "Find \\frac{{{n}}}{{7}}.", "reference_solution": "Take {n} modulo 5.", "reference_answer": "{n % 5}", "claimed_domain": "Algebra", "claimed_difficulty": "{"" if n % 13 == 0 and not self.reliable else "olympiad"}"}}\n```'
            out.append(Reply(text, n % 100, n % 50, n % 100 + n % 50))
        return out


def jobs(rows: DataFrame, copies: int, name: str = "index") -> DataFrame:
    """Each row ``copies`` times with its number from 0."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) if copies > 0 else rows.limit(0).withColumn(name, F.lit(0))


def pending(rows: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    return drop_matching(rows, done, [key])


def generation_jobs(seeds: DataFrame, template: str, model: str, prompt_version: str, effort: str, copies: int, done: DataFrame | None = None) -> DataFrame:
    """Seeds with ``sample_id``, ``generation_index``, ``generation_seed``, the settings and ``prompt``, without those already done.

    This is also the dry run: nothing is called until :func:`generate` gets it.
    """
    each = jobs(seeds, copies, "generation_index")
    each = each.withColumns({
        "sample_id": stable_id("pair", "parent_seed_id", F.lit(model), F.lit(prompt_version), F.lit(effort), "generation_index"),
        "generation_seed": seed31("parent_seed_id", "generation_index"), "prompt": fill(template, domain="domain", difficulty="difficulty", problem="problem"),
        "prompt_version": F.lit(prompt_version), "reasoning_effort": F.lit(effort),
    })
    return each if done is None else pending(each, done)


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _reply_frame(replies: list[Reply]) -> dict[str, list]:
    """The columns of ``_REPLY``, errors cut."""
    return dict(zip(_REPLY_COLUMNS, map(list, zip(*((r.text, r.prompt_tokens, r.completion_tokens, r.total_tokens, r.attempts, r.error_type, r.error and r.error[:STORED_ERROR]) for r in replies)))) if replies else {c: [] for c in _REPLY_COLUMNS})


def _usage() -> Column:
    return F.struct("prompt_tokens", "completion_tokens", "total_tokens").alias("token_usage")


def _now(at: Column | None, name: str) -> Column:
    """A time as text, in UTC; ``at`` replaces the clock."""
    return (F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") if at is None else at.cast("string")).alias(name)


def generate(
    work: DataFrame, provider: Provider, retries: int = 2, written: Callable[[DataFrame], DataFrame] = lambda df: stage(df, "generated"), temperature: float = 0.9, at: Column | None = None, repair: Repair | None = None
) -> tuple[DataFrame, DataFrame]:
    """(generated, failures) of :func:`generation_jobs`.

    A response that does not parse or lacks a field is asked for again with the next seed, up to
    ``retries`` times; then the row goes to the failures with all its errors, cut at 4000 characters. A
    failed call is not asked for again here (the provider has retried it): its row fails with the call's error.
    ``written`` writes the replies and reads them again before they are parted.

    generated: the columns of ``work`` but the prompt and the seed's own ``problem``, ``solution``, ``answer``,
    ``domain``, ``difficulty`` and ``seed_id``, then the problem, solution and answer made, the model and its
    settings, usage of the accepted reply, attempts, time and raw reply. failures: the job's names, settings,
    time and error.
    """
    keep = [c for c in work.columns if c != "prompt"]
    ddl = f"{_ddl(work, keep)}, " + ", ".join(f"`_{f}` string" for f in FIELDS) + f", {_REPLY}, schema_attempts int"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed: list[dict | None] = [None] * len(b)
            last: list[Reply] = [Reply(None)] * len(b)
            broken = [False] * len(b)
            attempts, errors, base = [0] * len(b), [[] for _ in range(len(b))], b["generation_seed"].tolist()
            for attempt in range(retries + 1):
                todo = [i for i, p in enumerate(parsed) if p is None and not broken[i]]
                for i, reply in zip(todo, provider.complete([b["prompt"].iloc[i] for i in todo], GENERATOR_SYSTEM, [base[i] + attempt for i in todo]) if todo else []):
                    last[i], attempts[i] = as_reply(reply), attempt + 1
                    if last[i].text is None:
                        broken[i] = True
                        errors[i].append(last[i].error or "the call failed")
                        continue
                    try:
                        value = extract_json_object(last[i].text, repair)
                        if missing := [f for f in FIELDS if not str(value.get(f, "")).strip()]:
                            raise ValueError(f"missing fields {missing}")
                        parsed[i] = value
                    except ValueError as e:
                        errors[i].append(str(e))
            out = b[keep].copy()
            out["generation_seed"] = [s + max(0, a - 1) for s, a in zip(base, attempts)]
            for f in FIELDS:
                out[f"_{f}"] = [None if p is None else str(p[f]).strip() for p in parsed]
            for c, values in _reply_frame(last).items():
                out[c] = values
            out["error"] = ["; ".join(e)[:STORED_ERROR] if p is None else None for p, e in zip(parsed, errors)]
            out["error_type"] = [None if p is not None else (r.error_type or "RuntimeError") for p, r in zip(parsed, last)]
            out["schema_attempts"] = attempts
            for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
                out[c] = pd.array(out[c], dtype="Int64")
            yield out

    done = written(work.select(*keep, "prompt").mapInPandas(call, ddl))
    names = dict(zip(FIELDS, ["synthetic_problem", "synthetic_solution", "synthetic_answer", "claimed_domain", "claimed_difficulty"]))
    dropped = {*names.values(), "problem", "solution", "answer", "domain", "difficulty", "seed_id"}
    good = done.where("error is null").select(
        *(c for c in keep if c not in dropped), *(F.col(f"_{f}").alias(to) for f, to in names.items()), F.lit(provider.name).alias("generator_model"),
        F.lit(temperature).alias("generation_temperature"), _usage(), "request_attempts", "schema_attempts", _now(at, "generated_at"), F.col("response").alias("raw_response"),
    )
    named = [c for c in ("sample_id", "parent_seed_id", "split", "prompt_version", "generation_index") if c in keep]
    return good, done.where("error is not null").select(*named, F.lit(provider.name).alias("generator_model"), _now(at, "failed_at"), "error_type", "error")


def in_rounds(work: DataFrame, once: Callable[[DataFrame], tuple[DataFrame, DataFrame]], rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(results, failures): what fails in a round of ``once`` is asked for again in the next, ``rounds`` times in all at most.

    ``once`` must write what it gets from the model, so that nothing is asked for twice. The failures are
    those of the last round.
    """
    good = None
    for _ in range(max(1, rounds)):
        made, failed = once(work if good is None else pending(work, good))
        good = made if good is None else good.unionByName(made)
        if failed.isEmpty():
            break
    return good, failed


def generate_in_rounds(work: DataFrame, provider: Provider, rounds: int = 8, retries: int = 2, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`generate` in rounds."""
    return in_rounds(work, lambda rest: generate(rest, provider, retries, at=at), rounds)


def gate(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``rows``, if they have as many different ``sample_id`` as ``wanted``; else an error that ends the run."""
    has, target = (df.agg(F.count_distinct("sample_id")).first()[0] for df in (rows, wanted))
    if has != target:
        raise RuntimeError(f"{name} incomplete: {has}/{target}")
    return rows


def completions(work: DataFrame, provider: Provider, system: str) -> DataFrame:
    """``work`` (with ``prompt`` and ``seed``) plus the columns of a reply; not yet written."""
    ddl = f"{_ddl(work, work.columns)}, {_REPLY}"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = _reply_frame([as_reply(r) for r in provider.complete(b["prompt"].tolist(), system, b["seed"].tolist())])
            yield b.assign(**{c: pd.array(v, dtype="Int64") if c.endswith("tokens") else v for c, v in made.items()})

    return work.mapInPandas(call, ddl)


def rollouts(rows: DataFrame, provider: Provider, template: str, problem: str, answer: str, k: int) -> DataFrame:
    """A written table of one row per row and rollout: ``sample_id, rollout, prediction, matches_reference, declared_invalid, raw_response, token_usage, error_type, error``.

    A rollout whose call failed has a null response and prediction and its error; it is no wrong answer.
    """
    each = jobs(rows.select("sample_id", F.col(problem).alias("problem"), F.col(answer).alias("answer")), k, "rollout")
    each = each.withColumns({"prompt": fill(template, problem="problem"), "seed": seed31("sample_id", F.lit("solver"), "rollout")})
    done = stage(completions(each.select("sample_id", "rollout", "answer", "prompt", "seed"), provider, SOLVER_SYSTEM), "rollouts")
    read = done.withColumn("prediction", extract_boxed("response"))
    return read.select(
        "sample_id", "rollout", "prediction", answer_matches("prediction", "answer").alias("matches_reference"), declared_invalid("prediction").alias("declared_invalid"),
        F.col("response").alias("raw_response"), _usage(), "error_type", "error",
    )


def solve(rows: DataFrame, provider: Provider, template: str, k: int = 3, temperature: float = 0.7, effort: str | None = None, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(solved, failures) of pairs: solved pairs have the solver's settings, its rollouts as an array and their sums.

    A pair with a failed call goes to the failures (``sample_id, error_type, error, failed_at``), as its counts
    would say more about the outage than about the pair; it can be asked for again. ``rows`` has one row a ``sample_id``.
    """
    each = rollouts(rows, provider, template, "synthetic_problem", "synthetic_answer", k)
    kept = F.struct("rollout", "prediction", "matches_reference", "declared_invalid", "raw_response", "token_usage")
    summed = each.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(kept)).alias("solver_rollouts"),  # k structs
        F.count_if("matches_reference").cast("int").alias("solver_matches"), F.count_if("declared_invalid").cast("int").alias("solver_declared_invalid"),
        F.min(F.when(F.col("raw_response").isNull(), F.struct("rollout", F.coalesce("error_type", F.lit("RuntimeError")).alias("error_type"), F.coalesce("error", F.lit("the call failed")).alias("error")))).alias("failure"),
    )
    summed = stage(summed, "solved")
    settings = [F.lit(provider.name).alias("solver_model"), F.lit(temperature).alias("solver_temperature"), F.lit(effort).alias("solver_reasoning_effort"), F.lit(k).alias("solver_rollouts_k")]
    made = summed.where("failure is null").select("sample_id", *settings, "solver_matches", (F.col("solver_matches") / k).alias("solver_match_rate"), "solver_declared_invalid", "solver_rollouts", _now(at, "solved_at"))
    return rows.join(made, "sample_id"), summed.where("failure is not null").select("sample_id", "failure.error_type", "failure.error", _now(at, "failed_at"))


def parsed_votes(responses: DataFrame, response: str | Column = "response") -> DataFrame:
    """``sample_id, vote`` and the verdict's fields; a response that does not parse is a vote against."""
    fields = ["question_valid", "unique_answer_exists", "reference_answer_correct", "invalid_type", "confidence", "short_reason"]
    read = responses.withColumn("v", json_fields(F.col(response) if isinstance(response, str) else response, fields))
    number = F.when(F.col("v.confidence").isNull(), 0.0).otherwise(F.col("v.confidence").try_cast("double"))
    good = F.col("v.ok") & number.isNotNull()
    true = lambda f: (good & F.coalesce(parse_bool(f"v.{f}"), F.lit(False))).alias(f)
    return read.select(
        "sample_id", "vote", *map(true, fields[:3]), F.when(good, verdict_kind("v.invalid_type")).otherwise("other_invalid").alias("invalid_type"),
        F.when(good, number).otherwise(0.0).alias("confidence"),
        F.when(good, F.substring(text_or_empty("v.short_reason"), 1, 1000)).otherwise("unparseable verifier response").alias("short_reason"),
    )


def log_lines(failures: DataFrame) -> DataFrame:
    """``line``: one JSON line a failure, its error cut to 300 characters."""
    return failures.select(F.to_json(F.struct(F.lit("failed").alias("status"), "sample_id", F.substring("error", 1, LOGGED_ERROR).alias("error"))).alias("line"))


def has_fields(fields: list[str]) -> Column:
    """Whether all fields are filled."""
    out = F.lit(True)
    for f in fields:
        out = out & (F.length(strip(text_or_empty(f))) > 0)
    return out
