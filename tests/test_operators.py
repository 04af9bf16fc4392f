import pytest
from pyspark.sql import functions as F

from millrace.functions import prompts
from millrace.operators import audit, dedup, manifest, model, sampling, similarity, views, votes
from millrace.operators.ranks import ranked


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_keep_first_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, o int, v string")
    assert rows(dedup.keep_first(df, F.col("k"), F.col("o"))) == [("a", 1, "y"), (None, 3, "z")]
    assert rows(dedup.keep_first(df.limit(0), F.col("k"), F.col("o"))) == []
    assert rows(dedup.duplicates(df, "k")) == [("a", 2)]


def test_ranked_equals_window(spark):
    from pyspark.sql import Window

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") % 7).alias("w"))
    got = ranked(df, ["g"], F.floor(F.col("id") / 100), ["id"], "w")
    w = Window.partitionBy("g").orderBy("id")
    want = df.select("g", "id", "w", (F.row_number().over(w) - 1).alias("rank"), F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    assert rows(got.select("g", "id", "w", "rank", "before")) == rows(want)


def test_mode_tie_goes_to_first_vote(spark):
    kinds = ["z", "a", "z", "a"]
    df = spark.createDataFrame([("s", i, True, i == 0, k) for i, k in enumerate(kinds)], "sample_id string, vote int, question_valid boolean, reference_answer_correct boolean, invalid_type string")
    r = votes.vote_summary(df, "sample_id", 4).first()
    assert r.auto_invalid_type == "z" and r.auto_unanimous_valid and not r.auto_majority_reference_correct and r.auto_valid_votes == 4


def test_nested_positions(spark):
    data = [(f"p{i}", "s" if i < 8 else "t", "Algebra") for i in range(12)]
    df = spark.createDataFrame(data, "parent_seed_id string, source string, problem_type string")
    placed = sampling.nested_positions(df, "parent_seed_id", ["source", "problem_type"], 7)
    sets = [{r[0] for r in placed.where(sampling.in_ratio(x)).select("parent_seed_id").collect()} for x in (0, 0.25, 0.5, 0.75, 1)]
    assert [len(s) for s in sets] == [0, 3, 6, 9, 12] and all(a <= b for a, b in zip(sets, sets[1:]))
    half = spark.createDataFrame([("a", 2, 10)], "k string, position bigint, total bigint").select(sampling.in_ratio(0.25))
    assert half.first()[0]  # 2.5 rounds to 2


def test_views(spark):
    data = [(f"p{i}", "s", None, f"real {i}", "R", "0", f"syn {i}", "S", "1", "m", "v", i % 2 == 0, 2) for i in range(4)]
    cols = "parent_seed_id string, source string, problem_type string, real_problem string, real_solution string, real_answer string, synthetic_problem string, synthetic_solution string, synthetic_answer string, generator_model string, prompt_version string, quality_accept boolean, solver_matches int"
    df = spark.createDataFrame(data, cols)
    views.check_rows(df, expected=4)
    with pytest.raises(ValueError):
        views.check_rows(df.unionByName(df))
    made = views.rlvr_views(df, 7)
    counts = {r.arm: (r.rows, r.synthetic) for r in views.arm_counts(made).collect()}
    assert counts == {"r000": (4, 0), "r025": (4, 1), "r050": (4, 2), "r075": (4, 3), "r100": (4, 4), "fallback": (4, 2)}
    real = made.where("extra_info.arm = 'r000'").first()
    assert real.extra_info.generator_model is None and real.reward_model.ground_truth == "0"
    sft = views.sft_views(df).where("arm = 'raw_synthetic' and parent_seed_id = 'p0'").first()
    assert sft.messages[1].content == "S\n\n\\boxed{1}"


def test_groups_and_audit(spark):
    pool = spark.createDataFrame([("a", "p", True, True), ("b", "p", True, True), ("c", "p", None, None), ("d", "p", True, True)], "sample_id string, problem string, auto_unanimous_valid boolean, auto_majority_reference_correct boolean")
    lines = [("a", "x", "no", 1), ("a", "x", "yes", 2), ("d", "y", "False", 3)]
    sheet = spark.createDataFrame([(i, n, v, "", v, "", "", "", "", o) for i, n, v, o in lines], "sample_id string, annotator_id string, question_valid string, invalid_type string, reference_answer_correct string, unique_answer_exists string, difficulty string, confidence string, notes string, line int")
    merged = audit.merge_audit(pool, sheet, "line")
    got = {r.sample_id: r.experimental_group for r in views.with_group(merged).collect()}
    assert got == {"a": "valid_correct", "b": "auto_verified", "c": "raw_unverified", "d": "invalid_pseudo"}
    assert audit.audit_sheet(pool, 2, 1, hide=True).columns == audit.SHEET


def test_similarity_joins(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour"
    data = [("a", base), ("b", base + " more"), ("c", base.upper()), ("d", "something else that is quite different from it"), ("e", ""), ("f", None)]
    df = spark.createDataFrame(data, "k string, t string")
    got = {r.key: list(r.hits) for r in similarity.earlier_duplicates(df, "k", "t").collect()}
    assert got == {"b": ["a"], "c": ["a", "b"]}
    questions = spark.createDataFrame([("q1", base + " more"), ("q2", None), ("q3", "Something else, that is quite different from it!")], "eval_id string, question string")
    hits = {r.key: list(r.hits) for r in similarity.evaluation_hits(df, "k", "t", questions).collect()}
    assert hits == {"a": ["q1"], "b": ["exact"], "c": ["q1"], "d": ["exact"]}


def test_quota_transfer(spark):
    have = spark.createDataFrame([("a", 3), ("b", 50)], "source string, available bigint")
    got = {r.source: r.quota for r in sampling.quotas_with_transfer(have, {"a": 10, "b": 20}, "a", "b").collect()}
    assert got == {"a": 3, "b": 27}


def test_generation_retries_and_failures(spark):
    class Once:
        name = "once"

        def complete(self, prompts, system, seeds):
            good = '{"problem": "P", "reference_solution": "S", "reference_answer": "1", "claimed_domain": "D", "claimed_difficulty": "E"}'
            return [good if s % 2 else "broken" if "p0" in p else "nothing" for p, s in zip(prompts, seeds)]

    seeds = spark.createDataFrame([(f"p{i}", "d", "e", f"p{i}") for i in range(6)], "parent_seed_id string, domain string, difficulty string, problem string")
    work = model.generation_jobs(seeds, prompts.GENERATE, "once", "v", "low", 1)
    good, failed = model.generate(work, Once(), retries=0)
    n, m = good.count(), failed.count()
    assert n + m == 6
    good, failed = model.generate(work, Once(), retries=1)
    assert good.count() == 6 and failed.count() == 0 and {r[0] for r in good.select("synthetic_answer").collect()} == {"1"}
    assert model.generation_jobs(seeds, prompts.GENERATE, "once", "v", "low", 1, good).count() == 0


def test_parsed_votes(spark):
    df = spark.createDataFrame([("s", 0, '{"question_valid": "yes", "invalid_type": "odd", "confidence": 0.5}'), ("s", 1, "junk"), ("s", 2, '{"question_valid": true, "confidence": "high"}')], "sample_id string, vote int, response string")
    got = {r.vote: (r.question_valid, r.invalid_type, r.confidence) for r in model.parsed_votes(df).collect()}
    assert got == {0: (True, "other_invalid", 0.5), 1: (False, "other_invalid", 0.0), 2: (False, "other_invalid", 0.0)}


def test_manifest_on_empty(spark):
    df = spark.createDataFrame([], "token_usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>")
    assert tuple(manifest.usage(df, "token_usage").first()) == (0, 0, 0)


def test_failed_generations_are_asked_for_again(spark, tmp_path):
    import pytest

    from millrace.operators import model

    class Moody(model.HashProvider):
        """Fails each prompt until it has been asked as often as its number says."""

        def complete(self, prompts, system, seeds):
            out = []
            for p in prompts:
                asked = tmp_path / p
                asked.write_text(asked.read_text() + "x" if asked.exists() else "x")
                good = '{"problem": "p", "reference_solution": "s", "reference_answer": "a", "claimed_domain": "d", "claimed_difficulty": "e"}'
                out.append(good if len(asked.read_text()) >= int(p) else None)
            return out

    work = spark.createDataFrame([(f"s{i}", f"p{i}", 0, i, str(i)) for i in (1, 2, 4, 9)], "sample_id string, parent_seed_id string, generation_index int, generation_seed bigint, prompt string")
    good, failed = model.generate_in_rounds(work, Moody(), rounds=5, retries=0)
    assert sorted(r.sample_id for r in good.collect()) == ["s1", "s2", "s4"] and [r.sample_id for r in failed.collect()] == ["s9"]
    assert {p.name: len(p.read_text()) for p in tmp_path.iterdir()} == {"1": 1, "2": 2, "4": 4, "9": 5}
    with pytest.raises(RuntimeError, match="3/4"):
        model.gate(good, work, "generation")
    assert model.gate(good, good, "generation").count() == 3


def _work(spark, n):
    seeds = spark.createDataFrame([(f"p{i}", "train", "d", "e", f"problem {i}") for i in range(n)], "parent_seed_id string, split string, domain string, difficulty string, problem string")
    return model.generation_jobs(seeds, prompts.GENERATE, "hash-stub", "v", "low", 1)


def test_no_prompt_is_sent_twice(spark, tmp_path):
    class Counting(model.HashProvider):
        """Counts its calls in files, as its batches run in other processes."""

        def __init__(self, folder):
            super().__init__()
            self.folder = folder

        def complete(self, prompts, system, seeds):
            import uuid

            for p in prompts:
                (self.folder / uuid.uuid4().hex).write_text(p)
            return super().complete(prompts, system, seeds)

    good, failed = model.generate(_work(spark, 30), Counting(tmp_path), retries=0)
    assert good.count() + failed.count() == 30 and good.count() and failed.count()
    assert good.count() + failed.count() == 30 and len(list(tmp_path.iterdir())) == 30
    row = failed.first()
    assert row.error_type == "RuntimeError" and row.error and row.failed_at.endswith("+00:00") and row.split == "train"
    made = good.first()
    assert made.token_usage.total_tokens == made.token_usage.prompt_tokens + made.token_usage.completion_tokens and made.generation_temperature == 0.9 and made.prompt_version == "v"
    solved, lost = model.solve(good, Counting(tmp_path), prompts.SOLVE, 2)
    n = good.count()
    assert solved.count() + lost.count() == n and solved.count() + lost.count() == n
    assert len(list(tmp_path.iterdir())) == 30 + 2 * n


def test_an_outage_is_no_wrong_answer(spark):
    class Half:
        name = "half"

        def complete(self, prompts, system, seeds):
            return [model.Reply(None, attempts=6, error_type="TimeoutError", error="x" * 5000) if "b" in p else "so \\boxed{1}" for p in prompts]

    pairs = spark.createDataFrame([("1", "a", "1"), ("2", "b", "1")], "sample_id string, synthetic_problem string, synthetic_answer string")
    solved, failed = model.solve(pairs, Half(), "{problem}", 3, effort="low", at=F.lit("now"))
    s, f = solved.first(), failed.first()
    assert (s.sample_id, s.solver_matches, s.solver_match_rate, s.solver_rollouts_k, len(s.solver_rollouts), s.solved_at) == ("1", 3, 1.0, 3, 3, "now")
    assert s.solver_rollouts[0].prediction == "1" and s.solver_rollouts[2].rollout == 2
    assert (f.sample_id, f.error_type, len(f.error)) == ("2", "TimeoutError", 4000) and solved.count() == failed.count() == 1
    assert len(model.log_lines(failed).first().line) < 400
    empty = model.solve(pairs.limit(0), Half(), "{problem}", 3)
    assert empty[0].count() == 0 == empty[1].count()


def test_fatal_shortages_and_invalid_records(spark):
    have = spark.createDataFrame([("a", 3), ("b", 50)], "source string, available bigint")
    assert sampling.require_quotas(sampling.quotas_with_transfer(have, {"a": 10, "b": 20}, "a", "b")).count() == 2
    with pytest.raises(ValueError, match="a 3/10"):
        sampling.require_quotas(sampling.quotas_with_transfer(have, {"a": 10, "b": 20}, "b", "a"))
    lines = spark.createDataFrame([('{"sample_id": "x"}',), ('{"sample_id": "", "extra_info": {"sample_id": "x"}}',), ('{"sample_id": null}',), ('{"id": 1}',)], "value string")
    found = manifest.invalid_records(lines, "value", ["sample_id"])
    assert rows(found) == [("missing key", "sample_id", 1), ("repeated id", "x", 2)]
    with pytest.raises(ValueError, match="repeated id x"):
        manifest.require_valid(found)
    manifest.require_valid(found.limit(0))


def test_take_and_first_by(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, v int")
    some = {r.k for r in sampling.take(df, "k", 7, 1).collect()}
    assert len(some) == 7 and {r.k for r in sampling.take(df.repartition(9), "k", 7, 1).collect()} == some
    assert sampling.take(df, "k", 0, 1).count() == 0 == sampling.take(df.limit(0), "k", 5, 1).count() and sampling.take(df, "k", 90, 1).count() == 50
    assert [r.k for r in sampling.first_by(df, "k", 2).collect()] == ["k0", "k1"] and sampling.first_by(df, "k", 0).count() == 50
    assert [r.v for r in sampling.canonical_order(df.where("v < 3"), ["v"]).collect()] == [0, 1, 2]


def test_keep_least(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "z"), (4, None, "w"), (5, "", "v")], "i int, k string, v string")
    assert rows(dedup.keep_least(df, F.col("k"), "i").select("i", "v")) == [(1, "y"), (2, "z"), (5, "v")]
    assert dedup.keep_least(df.limit(0), F.col("k"), "i").count() == 0


def test_hot_runs_meet_in_cells(spark):
    """Near copies of one text, so that every run is hot: split or not, all pairs are found once."""
    from millrace.operators import setjoin

    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    data = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(30)] = f"x{i}"
        data.append((f"k{i:03d}", " ".join(w), i % 3 == 0))
    df = spark.createDataFrame(data * 2, "key string, text string, held boolean")
    sets = setjoin.run_sets(df, "text", ["key", "held"])
    for cell in (5, 8192):
        got = rows(setjoin.similar_classes(sets, 0.6, cell=cell).select("a1", "a2", "b1", "b2", "similarity"))
        want = 0
        sides = {}
        for k, t, held in data:
            w = t.split()
            sides[k] = ({tuple(w[i : i + 5]) for i in range(26)}, held)
        keys = sorted(sides)
        want = sum(len(sides[a][0] & sides[b][0]) / len(sides[a][0] | sides[b][0]) >= 0.6 for i, a in enumerate(keys) for b in keys[:i])
        assert len(got) == len(set(got)) == want > 1000
        across = setjoin.similar_classes(sets, 0.6, "held", "not held", cell=cell).count()
        assert across == sum(len(sides[a][0] & sides[b][0]) / len(sides[a][0] | sides[b][0]) >= 0.6 for a in keys for b in keys if sides[a][1] and not sides[b][1])


def test_a_cluster_needs_a_shared_folder():
    from millrace.operators.staging import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_whole_run(spark, tmp_path):
    from millrace.plans import pipeline

    seeds = spark.createDataFrame([(f"p{i}", "train" if i < 6 else "development", "s", "Algebra", "math-word-problem", "d", "e", f"problem {i}", f"problem {i}", "S", "1") for i in range(8)], "parent_seed_id string, split string, source string, problem_type string, question_type string, domain string, difficulty string, problem string, real_problem string, real_solution string, real_answer string")
    questions = spark.createDataFrame([("q", "what is asked here")], "eval_id string, question string")
    root = str(tmp_path / "release")
    shaky, sure = model.HashProvider(), model.HashProvider(reliable=True)
    with pytest.raises(RuntimeError, match="generation incomplete: [1-7]/8"):
        pipeline.run(seeds, questions, shaky, sure, root, rounds=1, seed=3)
    kept = spark.read.parquet(f"{root}/raw/pairs.parquet").count()
    got = {(r.section, r.name): r.value for r in pipeline.run(seeds, questions, sure, sure, root, expected=6, seed=3).collect()}
    assert got["release", "rows"] == 8 and got["by_split", "train"] == 6 and got["arms.r050", "synthetic"] == 3 and got["arms.r100", "rows"] == 6 and got["checks", "rows"] == 8
    assert 0 < kept < 8 and got["release", "solver_total_tokens"] > 0
    named = [r.name for r in spark.read.json(f"{root}/digests.jsonl").collect()]
    assert any(n.startswith("processed/rlvr.parquet/part-") for n in named) and any(n.startswith("manifest.jsonl/part-") for n in named)
    failures = spark.read.json(f"{root}/raw/pairs_failures.jsonl")
    assert failures.count() == 8 - kept
    with pytest.raises(ValueError):
        pipeline.run(seeds, questions, sure, sure, root, expected=7)
