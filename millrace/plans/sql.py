"""DuckDB SQL for the core's queries, over the same tables."""

from __future__ import annotations

from ..functions import prompts
from ..functions.json_repair import LATEX_COMMANDS
from .catalog import QUOTAS, SEED, SPLITS

_SPACE = r"[\s\x{a0}\x{2000}-\x{200a}\x{3000}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern in (r"https?://\S+", r"\\(?:left|right|displaystyle|textstyle)", r"[^a-z0-9\x{4e00}-\x{9fff}]+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out})"


def shingles(n: str) -> str:
    """Of a normalised text."""
    w = f"string_split({n}, ' ')"
    runs = f"list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i+4], ' '))"
    return f"CASE WHEN {n} = '' THEN []::VARCHAR[] WHEN len({w}) < 5 THEN [{n}] ELSE list_distinct({runs}) END"


def joined(*parts: str) -> str:
    return " || chr(31) || ".join(f"coalesce(({p})::VARCHAR, 'None')" for p in parts)


def stable(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substr(sha256({joined(*parts)}), 1, 16)"


def seed31(*parts: str) -> str:
    return f"(('0x' || substr(sha256({joined(*parts)}), 1, 8))::BIGINT & 2147483647)"


def rank(key: str) -> str:
    return f"sha256('{SEED}' || chr(31) || {key})"


def answer(x: str) -> str:
    return rf"regexp_replace(replace(replace(replace(replace(lower({strip(f"coalesce({x}, '')")}), '\dfrac', '\frac'), '\tfrac', '\frac'), '$', ''), ' ', ''), '[.,;:]+$', '')"


def fallback(x: str) -> str:
    return f"regexp_replace(replace(replace(lower({x}), '$', ''), ' ', ''), '[.,;:]+$', '')"


def boxed(x: str) -> str:
    r"""For braces nested up to five deep."""
    inner = r"[^{}]*"
    for _ in range(5):
        inner = rf"(?:[^{{}}]|\{{{inner}\}})*"
    tail = rf"list_last(string_split({x}, '\boxed{{'))"
    return rf"CASE WHEN contains({x}, '\boxed{{') AND regexp_matches({tail}, '(?s)^{inner}\}}') THEN {strip(rf"regexp_extract({tail}, '(?s)^({inner})\}}', 1)")} END"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def filled(template: str, **columns: str) -> str:
    parts, rest = [], template.replace("{{", "\0").replace("}}", "\1")
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [literal(head), f"coalesce({columns[name]}, 'None')"]
    parts.append(literal(rest))
    return " || ".join(p.replace("\0", "{").replace("\1", "}") for p in parts)


def picked(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(map(literal, words))})"


_TEXT_ONLY = r"NOT regexp_matches(coalesce(text, ''), '(?i)!\[|https?://\S+\.(?:png|jpe?g|gif|svg)|(?:^|[^0-9A-Za-z_À-ɏ一-鿿])(?:figure|diagram)(?:[^0-9A-Za-z_À-ɏ一-鿿]|$)')"
_SEEDS = "(SELECT DISTINCT parent_seed_id, lower(trim(source, ' ')) AS source FROM numina_5k_seeds)"
_VALUES = ", ".join(f"('{s}', {n})" for s, n in QUOTAS.items())
_TENTHS = ", ".join(f"('{s}', {n // 10})" for s, n in QUOTAS.items())
_PAIRS = "(SELECT DISTINCT sample_id, parent_seed_id, synthetic_problem, synthetic_solution, synthetic_answer FROM gpt_pairs)"
_KINDS = "['valid','underdetermined','contradictory','infeasible','ambiguous_expression','other_invalid']"
_VOTES = f"""votes AS (SELECT sample_id, vote, h % 3 > 0 AS question_valid, h % 5 > 1 AS reference_answer_correct, {_KINDS}[(h % 6 + 1)::INT] AS invalid_type
  FROM (SELECT sample_id, vote, {seed31("sample_id", "'vote'", "vote")} AS h FROM (SELECT DISTINCT sample_id FROM gpt_pairs), (SELECT unnest(range(3)) AS vote)))"""


def _summary(votes: str) -> str:
    return f"""kinds AS (SELECT sample_id, invalid_type, count(*) AS n, min(vote) AS first FROM {votes} GROUP BY ALL),
  best AS (SELECT sample_id, invalid_type FROM kinds QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, first) = 1),
  summary AS (SELECT sample_id, count(*) FILTER (question_valid) AS auto_valid_votes, count(*) FILTER (reference_answer_correct) AS auto_reference_correct_votes FROM {votes} GROUP BY sample_id),
  voted AS (SELECT s.*, b.invalid_type AS auto_invalid_type, auto_valid_votes > 1.5 AS auto_majority_valid, auto_valid_votes = 3 AS auto_unanimous_valid, auto_reference_correct_votes > 1.5 AS auto_majority_reference_correct FROM summary s JOIN best b USING (sample_id))"""


_SUMMARY = _summary("votes")
_LINE = "CASE WHEN (h + line) % {n} = 0 THEN false WHEN (h + line) % {n} = 1 THEN NULL ELSE true END"
_AUDIT = f"""audit AS (SELECT sample_id, {_LINE.format(n=3)} AS question_valid, {_LINE.format(n=4)} AS unique_answer_exists, {_LINE.format(n=5)} AS reference_answer_correct
  FROM (SELECT DISTINCT sample_id, {seed31("sample_id", "'audit'")} AS h, 2 AS line FROM gpt_pairs) WHERE h % 4 = 0),
  audited AS (SELECT v.*, a.question_valid, a.unique_answer_exists, a.reference_answer_correct FROM voted v LEFT JOIN audit a USING (sample_id)),
  grouped AS (SELECT *, CASE WHEN question_valid AND reference_answer_correct THEN 'valid_correct' WHEN NOT question_valid THEN 'invalid_pseudo' WHEN auto_unanimous_valid AND auto_majority_reference_correct THEN 'auto_verified' ELSE 'raw_unverified' END AS experimental_group FROM audited)"""
_QUALITY = "(SELECT DISTINCT sample_id, synthetic_problem FROM gpt_pairs_quality)"


def _sets(name: str, rows: str, key: str, text: str) -> str:
    return f"""{name}_n AS MATERIALIZED (SELECT {key} AS key, {norm(text)} AS norm FROM {rows}),
  {name}_s AS MATERIALIZED (SELECT key, norm, {shingles("norm")} AS runs FROM {name}_n),
  {name}_e AS MATERIALIZED (SELECT key, len(runs) AS n, unnest(runs) AS run FROM {name}_s)"""


def _similar(a: str, b: str, extra: str = "") -> str:
    return f"SELECT x.key AS a, y.key AS b FROM {a}_e x JOIN {b}_e y ON x.run = y.run {extra} GROUP BY x.key, y.key, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.8"


_QUESTIONS = "(SELECT DISTINCT eval_id, question FROM eval_questions WHERE question IS NOT NULL AND question <> '')"


def _contamination(rows: str) -> str:
    return f"""{_sets("c", rows, "sample_id", "synthetic_problem")}, {_sets("q", _QUESTIONS, "eval_id", "question")},
  exact AS (SELECT key FROM c_s WHERE norm IN (SELECT norm FROM q_s)), near AS ({_similar("c", "q")}),
  eval_hits AS (SELECT key AS sample_id, 'exact' AS hits FROM exact UNION ALL SELECT a, string_agg(DISTINCT b, ',' ORDER BY b) FROM near WHERE a NOT IN (SELECT key FROM exact) GROUP BY a)"""


def _repeats(sets: str) -> str:
    return f"""firsts AS (SELECT norm, min(key) AS first FROM {sets}_s WHERE norm <> '' GROUP BY norm),
  f_e AS MATERIALIZED (SELECT e.* FROM {sets}_e e JOIN firsts f ON e.key = f.first), close AS ({_similar("f", "f", "AND x.key <> y.key")}),
  links AS (SELECT a, b FROM close UNION SELECT first, first FROM firsts),
  repeat_hits AS (SELECT s.key AS sample_id, string_agg(DISTINCT l.b, ',' ORDER BY l.b) AS hits FROM {sets}_s s JOIN firsts f USING (norm) JOIN links l ON l.a = f.first WHERE l.b < s.key GROUP BY s.key)"""


_MATCHES = f"len(list_filter(coalesce(solver_rollouts, []), lambda r: r.prediction IS NOT NULL AND synthetic_answer IS NOT NULL AND {answer('r.prediction')} <> '' AND {answer('r.prediction')} = {answer('synthetic_answer')}))"
_PARSEABLE = rf"({strip("coalesce(synthetic_answer, '')")} <> '' AND lower({strip("coalesce(synthetic_answer, '')")}) NOT IN ('proof', 'notfound', 'invalid') AND regexp_matches({strip("coalesce(synthetic_answer, '')")}, '[0-9a-zA-Z\\]'))"
_PARENT = f"""parent AS (SELECT sample_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0.0 END AS jaccard
  FROM (SELECT sample_id, {shingles("x")} AS a, {shingles("y")} AS b FROM (SELECT DISTINCT sample_id, {norm("real_problem")} AS x, {norm("synthetic_problem")} AS y FROM gpt_pairs_quality)))"""
_POLICY = f"""{_contamination(_QUALITY)}, {_repeats("c")}, {_PARENT},
  checked AS (SELECT sample_id, {strip("coalesce(synthetic_problem, '')")} <> '' AND {strip("coalesce(synthetic_solution, '')")} <> '' AND {strip("coalesce(synthetic_answer, '')")} <> '' AS schema_ok, {_PARSEABLE} AS answer_parseable,
    CASE WHEN len(coalesce(solver_rollouts, [])) > 0 THEN {_MATCHES} ELSE coalesce(solver_matches, -1) END AS solver_matches FROM gpt_pairs_quality QUALIFY row_number() OVER (PARTITION BY sample_id) = 1),
  flagged AS (SELECT c.*, e.hits IS NOT NULL AS eval_contaminated, r.hits IS NOT NULL AS synthetic_duplicate, p.jaccard >= 0.8 AS parent_near_duplicate FROM checked c LEFT JOIN eval_hits e USING (sample_id) LEFT JOIN repeat_hits r USING (sample_id) JOIN parent p USING (sample_id)),
  policy AS (SELECT *, schema_ok AND answer_parseable AND solver_matches >= 2 AND NOT eval_contaminated AND NOT synthetic_duplicate AND NOT parent_near_duplicate AS quality_accept FROM flagged)"""

_VIEW = f"""view_rows AS (SELECT * FROM gpt_pairs_quality WHERE lower(trim(split, ' ')) = 'train' AND parent_seed_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(parent_seed_id, ' ') ORDER BY sample_id) = 1),
  strata AS (SELECT *, (row_number() OVER w - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY coalesce(source, 'None'), coalesce(problem_type, 'None')) AS q FROM view_rows WINDOW w AS (PARTITION BY coalesce(source, 'None'), coalesce(problem_type, 'None') ORDER BY {rank("parent_seed_id")}, parent_seed_id)),
  placed AS (SELECT *, row_number() OVER (ORDER BY q, {rank("parent_seed_id")}, parent_seed_id) AS position, count(*) OVER () AS total FROM strata)"""
_ARMS = "(VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0), (-1.0)) t(ratio)"
_RLVR = f"""{_VIEW}, armed AS (SELECT *, CASE WHEN ratio < 0 THEN 'fallback' ELSE printf('r%03d', (ratio * 100)::INT) END AS arm, CASE WHEN ratio < 0 THEN coalesce(quality_accept, false) ELSE position <= round_even(total * ratio, 0) END AS syn FROM placed, {_ARMS}),
  rlvr_made AS (SELECT 'numina_synthetic_substitution' AS data_source, 'math' AS ability, 'user' AS role, CASE WHEN syn THEN synthetic_problem ELSE real_problem END AS content, 'rule-lighteval/MATH_v2' AS style,
    coalesce(CASE WHEN syn THEN synthetic_answer ELSE real_answer END, 'None') AS ground_truth, {stable("train", "parent_seed_id", "arm")} AS sample_id, parent_seed_id, source, problem_type, CASE WHEN syn THEN 'synthetic' ELSE 'real' END AS origin, arm, ratio AS synthetic_ratio,
    CASE WHEN syn THEN generator_model END AS generator_model, CASE WHEN syn THEN prompt_version END AS prompt_version, CASE WHEN syn THEN quality_accept END AS quality_accept, CASE WHEN syn THEN solver_matches END AS solver_matches FROM armed)"""


def _split(rank_: str) -> str:
    out, end = "", 0
    for name, n in SPLITS:
        end += n
        out += f" WHEN {rank_} <= {end} THEN '{name}'"
    return f"CASE{out} ELSE 'held_out_audit' END"


_CANON = f"""raw AS (SELECT DISTINCT ON (parent_seed_id) parent_seed_id AS arrival, lower(trim(source, ' ')) AS source, problem, solution, answer, question_type FROM numina_5k_seeds),
  fit AS (SELECT *, {norm("problem")} AS norm FROM raw WHERE {picked("source", list(QUOTAS))} AND question_type = 'math-word-problem' AND lower({strip("coalesce(answer, '')")}) NOT IN ('', 'proof', 'notfound')),
  once AS (SELECT *, {stable("numina", "source", "problem", "answer")} AS parent_seed_id FROM fit WHERE length(norm) >= 20 AND {_TEXT_ONLY.replace("(text,", "(problem,")} QUALIFY row_number() OVER (PARTITION BY norm ORDER BY arrival) = 1),
  {_contamination("(SELECT parent_seed_id AS sample_id, problem AS synthetic_problem FROM once)")},
  clean AS (SELECT * FROM once WHERE parent_seed_id NOT IN (SELECT sample_id FROM eval_hits)),
  wanted AS (SELECT source, requested, coalesce(available, 0) AS available FROM (VALUES {_TENTHS}) v(source, requested) LEFT JOIN (SELECT source, count(*) AS available FROM clean GROUP BY source) USING (source)),
  moved AS (SELECT greatest(0, max(requested - available) FILTER (source = 'amc_aime')) AS m FROM wanted),
  quotas AS (SELECT source, requested + CASE source WHEN 'amc_aime' THEN -m WHEN 'cn_contest' THEN m ELSE 0 END AS quota FROM wanted, moved),
  chosen AS (SELECT c.* FROM clean c JOIN quotas q USING (source) QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY {rank("parent_seed_id")}, parent_seed_id) <= any_value(q.quota) OVER (PARTITION BY c.source))"""


def _stub(seed: str, prompt: str) -> str:
    """The stand-in provider's number."""
    return f"('0x' || substr(sha256({seed} || chr(31) || {prompt}), 1, 6))::BIGINT"


_AT = "'2026-01-01T00:00:00+00:00'"
_GENERATED = f"""jobs AS (SELECT *, {stable("pair", "parent_seed_id", "'hash-stub'", "'v1'", "'low'", "0")} AS sample_id, {seed31("parent_seed_id", "0")} AS base, {filled(prompts.GENERATE, domain="domain", difficulty="difficulty", problem="problem")} AS prompt
    FROM (SELECT DISTINCT parent_seed_id, lower(trim(split, ' ')) AS split, lower(trim(source, ' ')) AS source, lower(trim(problem_type, ' ')) AS problem_type, question_type, domain, difficulty, problem, real_problem, real_solution, real_answer FROM numina_5k_seeds)),
  tries AS (SELECT sample_id, a, {_stub("(base + a)", "prompt")} AS n FROM jobs, (SELECT unnest(range(3)) AS a)),
  judged AS (SELECT *, n % 3 <> 0 AND n % 13 <> 0 AS good, CASE WHEN n % 3 = 0 THEN 'the response holds no JSON object' ELSE 'missing fields [''claimed_difficulty'']' END AS err FROM tries),
  first_good AS (SELECT sample_id, min(a) AS a FROM judged WHERE good GROUP BY sample_id),
  made AS (SELECT j.*, f.a, t.n FROM jobs j JOIN first_good f USING (sample_id) JOIN tries t ON t.sample_id = j.sample_id AND t.a = f.a),
  failed AS (SELECT sample_id, string_agg(err, '; ' ORDER BY a) AS error FROM judged WHERE sample_id NOT IN (SELECT sample_id FROM first_good) GROUP BY sample_id)"""
_RAW = r"""'```json' || chr(10) || '{"problem": "Find \frac{' || n || '}{7}.", "reference_solution": "Take ' || n || ' modulo 5.", "reference_answer": "' || n % 5 || '", "claimed_domain": "Algebra", "claimed_difficulty": "olympiad"}' || chr(10) || '```'"""
_SOLVED = rf"""{_GENERATED}, rolled AS (SELECT sample_id, a, n, r, {_stub(seed31("sample_id", "'solver'", "r"), filled(prompts.SOLVE, problem=r"('Find \frac{' || n || '}{7}.')"))} AS m FROM made, (SELECT unnest(range(3)) AS r)),
  solved AS (SELECT sample_id, any_value(a) AS a, bool_or(m % 17 = 0) AS broken, count(*) FILTER (m % 5 = n % 5) AS matches, string_agg(m % 5, ',' ORDER BY r) AS predictions, sum(m % 100 + m % 50) AS tokens FROM rolled GROUP BY sample_id)"""
_SECTIONS = lambda of, names: " UNION ALL ".join(f"SELECT '{of}' AS section, '{n}' AS name, {v}::BIGINT AS value FROM {t}" for n, v, t in names)
_REGIONS, _NATIONS = (f"(SELECT string_agg({c} || chr(10), '' ORDER BY {c}) AS content FROM {t})" for c, t in (("r_name", "region"), ("n_name", "nation")))
_COMMANDS = rf"(^|[^\\])\\((?:(?:{'|'.join(LATEX_COMMANDS)})\b)|[()\[\]])"
_DOUBLED = rf"regexp_replace(regexp_replace({{x}}, '{_COMMANDS}', '\1\\\\\2', 'g'), '{_COMMANDS}', '\1\\\\\2', 'g')"
_ESCAPED = r"""regexp_replace({x}, '\\([^\\"/bfnrtu]|$)', '\\\\\1', 'g')"""
_REPAIRED = rf"""opened AS (SELECT DISTINCT sample_id, raw_response, {strip("coalesce(raw_response, '')")} AS s FROM gpt_pairs),
  body AS (SELECT *, regexp_replace(regexp_replace(s, '^```(?:json)?\s*', ''), '\s*```$', '') AS t FROM opened),
  cut AS (SELECT *, strpos(t, '{{') AS i, length(t) - strpos(reverse(t), '}}') + 1 AS j FROM body),
  one AS (SELECT *, {_DOUBLED.format(x="substr(t, i, j - i + 1)")} AS x FROM cut WHERE i > 0 AND strpos(t, '}}') > 0 AND i < j),
  two AS (SELECT *, CASE WHEN json_valid(x) THEN x WHEN json_valid({_ESCAPED.format(x="x")}) THEN {_ESCAPED.format(x="x")} END AS y FROM one)"""

SQL: dict[str, str] = {
    "distinct_by_source": f"SELECT lang, source, count(*) AS n FROM (SELECT * FROM (SELECT doc_id, lang, source, text, {norm('text')} AS norm FROM documents) WHERE length(norm) >= 20 AND {_TEXT_ONLY} QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1) GROUP BY lang, source",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "text_only": f"SELECT doc_id, {_TEXT_ONLY} AS text_only FROM (SELECT doc_id, text FROM documents UNION ALL VALUES (-1, 'see Figure 1'), (-2, 'figures only'), (-3, '![x](y)'), (-4, 'at http://a.b/c.PNG now'), (-5, 'a diagram.'), (-6, 'plain'))",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {norm('text')}",
    "shingle_counts": f"SELECT DISTINCT sample_id, len({shingles('n')})::INT AS n_shingles FROM (SELECT sample_id, {norm('synthetic_problem')} AS n FROM gpt_pairs_quality)",
    "stable_ids": f"SELECT DISTINCT sample_id, {stable('pair', 'parent_seed_id', 'generator_model', 'prompt_version', 'reasoning_effort', 'generation_index')} AS made_id, {seed31('parent_seed_id', 'generation_index')} AS seed, {seed31('sample_id', chr(39) + 'solver' + chr(39), '0')} AS solver_seed FROM gpt_pairs",
    "generation_prompts": f"SELECT * FROM (SELECT {stable('pair', 'parent_seed_id', chr(39) + 'stub' + chr(39), chr(39) + 'v1' + chr(39), chr(39) + 'low' + chr(39), 'generation_index')} AS sample_id, generation_index, {seed31('parent_seed_id', 'generation_index')} AS generation_seed, {filled(prompts.GENERATE, domain='domain', difficulty='difficulty', problem='problem')} AS prompt FROM (SELECT DISTINCT parent_seed_id, domain, difficulty, problem FROM numina_5k_seeds), (SELECT unnest(range(2))::INT AS generation_index)) WHERE sample_id NOT IN (SELECT sample_id FROM gpt_pairs)",
    "audit_prompts": f"SELECT sample_id, {filled(prompts.VERIFY, problem='synthetic_problem', reference_solution='synthetic_solution', reference_answer='synthetic_answer')} AS verify_prompt, {filled(prompts.SOLVE, problem='synthetic_problem')} AS solve_prompt FROM {_PAIRS}",
    "boxed_answers": f"SELECT DISTINCT sample_id, r.rollout AS rollout, {boxed('r.raw_response')} AS boxed FROM (SELECT sample_id, unnest(solver_rollouts) AS r FROM gpt_pairs_solved)",
    "matched_answers": f"SELECT DISTINCT sample_id, r.rollout AS rollout, {answer('r.prediction')} AS norm, r.prediction IS NOT NULL AND synthetic_answer IS NOT NULL AND {answer('r.prediction')} <> '' AND {answer('r.prediction')} = {answer('synthetic_answer')} AS matches, upper({strip('coalesce(r.prediction, ' + chr(39) * 2 + ')')}) = 'INVALID' AS invalid FROM (SELECT sample_id, synthetic_answer, unnest(solver_rollouts) AS r FROM gpt_pairs_solved)",
    "reward_scores": f"SELECT DISTINCT sample_id, score, CASE WHEN generation_index = 0 THEN 0.0::DOUBLE ELSE score END AS gated FROM (SELECT sample_id, generation_index, CASE WHEN b <> '' AND {fallback('b')} = {fallback('synthetic_answer')} THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM (SELECT *, {boxed('coalesce(synthetic_solution, ' + chr(39) * 2 + ')')} AS b FROM gpt_pairs))",
    "parsed_bools": "SELECT word, CASE WHEN w IN ('1','true','yes','y','t') THEN true WHEN w IN ('0','false','no','n','f') THEN false END AS value FROM (SELECT word, lower(" + strip("coalesce(word, '')") + ") AS w FROM (VALUES ('true'), (' YES '), ('t'), ('1'), ('0'), ('No'), ('F'), ('maybe'), (''), (NULL), (chr(9) || 'false' || chr(10))) v(word))",
    "parseable_answers": f"SELECT DISTINCT sample_id, {_PARSEABLE} AS parseable FROM gpt_pairs",
    "solver_consistency": f"SELECT sample_id, {_MATCHES}::INT AS matches, {_MATCHES} / len(solver_rollouts) AS rate, len(list_filter(solver_rollouts, lambda r: upper({strip('coalesce(r.prediction, ' + chr(39) * 2 + ')')}) = 'INVALID'))::INT AS declared_invalid FROM gpt_pairs_solved WHERE len(solver_rollouts) > 0 QUALIFY row_number() OVER (PARTITION BY sample_id) = 1",
    "vote_summary": f"WITH {_VOTES}, {_SUMMARY} SELECT * FROM voted",
    "collected_votes": f"WITH {_VOTES} SELECT sample_id, string_agg(vote || ':' || invalid_type, ',' ORDER BY vote) AS kinds FROM votes GROUP BY sample_id",
    "reachability": f"WITH c AS (SELECT sample_id, count(*) FILTER ({seed31('sample_id', chr(39) + 'reach' + chr(39), 'rollout')} % 3 = 0) AS m FROM (SELECT DISTINCT sample_id FROM gpt_pairs), (SELECT unnest(range(8)) AS rollout) GROUP BY sample_id) SELECT sample_id, m AS pseudo_answer_matches, m / 8 AS pseudo_answer_p_hat, CASE WHEN m = 0 THEN 'dead' WHEN m = 8 THEN 'pseudo_saturated' ELSE 'deceptive_active' END AS observed_group_regime, pow(1 - m / 8, 8) AS predicted_dead_probability, 1 - pow(1 - m / 8, 8) - pow(m / 8, 8) AS predicted_active_probability, pow(m / 8, 8) AS predicted_saturated_probability FROM c",
    "regime_theory": "SELECT k::INT AS k, p, pow(1 - p, k) AS dead, 1 - pow(1 - p, k) - pow(p, k) AS active, pow(p, k) AS saturated FROM (VALUES (4), (8), (16), (32)) a(k), (VALUES (0.0::DOUBLE), (0.001), (0.003), (0.01), (0.03), (0.1), (0.3), (0.5), (0.8), (0.95), (1.0)) b(p)",
    "parent_jaccard": f"WITH {_PARENT} SELECT sample_id, jaccard FROM parent",
    "minhash_agreement": f"""WITH m AS (SELECT list({seed31("'a'", 'i')} + 1 ORDER BY i) AS a, list({seed31("'b'", 'i')} ORDER BY i) AS b FROM (SELECT unnest(range(64)) AS i)),
      t AS (SELECT sample_id, list_transform({shingles("x")}, lambda s: {seed31("s")}) AS x, list_transform({shingles("y")}, lambda s: {seed31("s")}) AS y FROM (SELECT DISTINCT sample_id, {norm("real_problem")} AS x, {norm("synthetic_problem")} AS y FROM gpt_pairs_quality)),
      s AS (SELECT sample_id, list_transform(range(1, 65), lambda i: list_min(list_transform(x, lambda h: (a[i] * h + b[i]) % 2147483647))) AS p, list_transform(range(1, 65), lambda i: list_min(list_transform(y, lambda h: (a[i] * h + b[i]) % 2147483647))) AS q, len(x) > 0 AND len(y) > 0 AS ok FROM t, m)
      SELECT sample_id, CASE WHEN ok THEN len(list_filter(range(1, 65), lambda i: p[i] = q[i])) / 64 ELSE 0.0 END AS agreement FROM s""",
    "decontamination": f"WITH cand AS (SELECT * FROM {_QUALITY} UNION ALL SELECT DISTINCT 'probe_' || eval_id, question || ' Give the final value.' FROM eval_questions WHERE question IS NOT NULL), {_contamination('cand')} SELECT * FROM eval_hits",
    "earlier_duplicates": f"WITH {_sets('c', _QUALITY, 'sample_id', 'synthetic_problem')}, {_repeats('c')} SELECT * FROM repeat_hits",
    "quality_policy": f"WITH {_POLICY} SELECT sample_id, schema_ok, answer_parseable, eval_contaminated, synthetic_duplicate, parent_near_duplicate, solver_matches::INT AS solver_matches, quality_accept FROM policy",
    "quality_failures": f"WITH {_POLICY} SELECT count(*) AS rows, count(*) FILTER (quality_accept) AS quality_accept, count(*) FILTER (NOT schema_ok) AS schema_failed, count(*) FILTER (NOT answer_parseable) AS unparseable, count(*) FILTER (eval_contaminated) AS eval_contaminated, count(*) FILTER (synthetic_duplicate) AS synthetic_duplicate, count(*) FILTER (parent_near_duplicate) AS parent_near_duplicate, count(*) FILTER (solver_matches < 2) AS solver_rejected FROM policy",
    "eligible_seeds": f"SELECT DISTINCT parent_seed_id, norm FROM (SELECT parent_seed_id, real_problem AS text, {norm('real_problem')} AS norm FROM numina_5k_seeds WHERE {picked('lower(trim(source))', list(QUOTAS))} AND question_type = 'math-word-problem' AND lower({strip('coalesce(real_answer, ' + chr(39) * 2 + ')')}) NOT IN ('', 'proof', 'notfound')) WHERE length(norm) >= 20 AND {_TEXT_ONLY}",
    "source_quotas": f"WITH w AS (SELECT source, requested, coalesce(available, 0) AS available FROM (VALUES {_VALUES}) v(source, requested) LEFT JOIN (SELECT source, count(*) AS available FROM {_SEEDS} GROUP BY source) USING (source)), m AS (SELECT greatest(0, max(requested - available) FILTER (source = 'amc_aime')) AS m FROM w) SELECT source, available, requested + CASE source WHEN 'amc_aime' THEN -m WHEN 'cn_contest' THEN m ELSE 0 END AS quota FROM w, m",
    "quota_sample": f"SELECT source, parent_seed_id FROM (SELECT s.*, quota, row_number() OVER (PARTITION BY s.source ORDER BY {rank('parent_seed_id')}, parent_seed_id) AS r FROM {_SEEDS} s JOIN (VALUES {_TENTHS}) v(source, quota) USING (source)) WHERE r <= quota",
    "split_assignment": f"SELECT parent_seed_id, {_split('r')} AS split FROM (SELECT parent_seed_id, row_number() OVER (ORDER BY {rank('parent_seed_id')}, parent_seed_id) AS r FROM (SELECT DISTINCT parent_seed_id FROM numina_5k_seeds))",
    "group_caps": f"SELECT sample_id, parent_seed_id FROM (SELECT DISTINCT sample_id, parent_seed_id FROM gpt_pairs WHERE parent_seed_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY parent_seed_id ORDER BY {rank('sample_id')}, sample_id) <= 2",
    "audit_sample": f"SELECT sample_id, coalesce(synthetic_problem, '') AS problem, coalesce(synthetic_solution, '') AS reference_solution, coalesce(synthetic_answer, '') AS reference_answer, '' AS auto_valid_votes, '' AS auto_reference_correct_votes, '' AS auto_invalid_type, '' AS annotator_id, '' AS question_valid, '' AS invalid_type, '' AS unique_answer_exists, '' AS reference_answer_correct, '' AS difficulty, '' AS confidence, '' AS notes FROM {_PAIRS} ORDER BY {rank('sample_id')}, sample_id LIMIT 200",
    "nested_positions": f"WITH {_VIEW} SELECT parent_seed_id, position, " + ", ".join(f"position <= round_even(total * {r}::DOUBLE, 0) AS in_{int(r * 100):03d}" for r in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM placed",
    "rlvr_views": f"WITH {_RLVR} SELECT * FROM rlvr_made",
    "sft_views": f"WITH {_VIEW}, armed AS (SELECT *, CASE arm WHEN 'fallback' THEN coalesce(quality_accept, false) ELSE arm = 'raw_synthetic' END AS syn FROM view_rows, (VALUES ('real'), ('raw_synthetic'), ('fallback')) t(arm)) SELECT {stable('sft', 'parent_seed_id', 'arm')} AS sample_id, parent_seed_id, CASE WHEN syn THEN 'synthetic' ELSE 'real' END AS origin, arm, CASE WHEN syn THEN synthetic_problem ELSE real_problem END AS ask, 'assistant' AS role, coalesce(CASE WHEN syn THEN synthetic_solution ELSE real_solution END, 'None') || chr(10) || chr(10) || '\\boxed{{' || coalesce(CASE WHEN syn THEN synthetic_answer ELSE real_answer END, 'None') || '}}' AS reply FROM armed",
    "arm_counts": f"WITH {_RLVR} SELECT arm, source, count(*) AS rows, count(*) FILTER (origin = 'synthetic') AS synthetic FROM rlvr_made GROUP BY arm, source",
    "merged_audit": f"WITH {_VOTES}, {_SUMMARY}, {_AUDIT} SELECT sample_id, question_valid, unique_answer_exists, reference_answer_correct FROM audited",
    "assigned_groups": f"WITH {_VOTES}, {_SUMMARY}, {_AUDIT} SELECT sample_id, experimental_group FROM grouped",
    "audited_datasets": f"""WITH {_VOTES}, {_SUMMARY}, {_AUDIT}, g AS (SELECT g.*, p.synthetic_solution, p.synthetic_answer FROM grouped g JOIN {_PAIRS} p USING (sample_id)) SELECT sample_id, experimental_group AS "group", 'sft' AS kind, synthetic_solution AS content FROM g UNION ALL SELECT sample_id, experimental_group, 'rlvr', coalesce(synthetic_answer, 'None') FROM g UNION ALL SELECT sample_id, experimental_group, 'invalid_eval', NULL FROM g WHERE question_valid = false""",
    "pending_solutions": "SELECT DISTINCT sample_id, parent_seed_id FROM gpt_pairs WHERE sample_id NOT IN (SELECT sample_id FROM gpt_pairs_solved)",
    "duplicate_ids": "SELECT sample_id AS id, count(*) AS n FROM gpt_pairs WHERE sample_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT extra_info.sample_id, count(*) FROM rlvr WHERE extra_info.sample_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "missing_keys": "SELECT k AS key, CASE k WHEN 'sample_id' THEN count(*) - count(sample_id) WHEN 'split' THEN count(*) - count(split) WHEN 'generated_at' THEN count(*) - count(generated_at) ELSE count(*) END AS missing FROM gpt_pairs, (VALUES ('sample_id'), ('split'), ('generated_at'), ('absent')) t(k) GROUP BY k",
    "generator_usage": "SELECT sum(coalesce(token_usage.prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(token_usage.completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(token_usage.total_tokens, 0))::BIGINT AS total_tokens FROM gpt_pairs",
    "solver_usage": "SELECT sum(coalesce(r.token_usage.prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(r.token_usage.completion_tokens, 0))::BIGINT AS completion_tokens, sum(coalesce(r.token_usage.total_tokens, 0))::BIGINT AS total_tokens FROM (SELECT unnest(solver_rollouts) AS r FROM gpt_pairs_solved)",
    "release_manifest": """SELECT p.*, q.*, s.* FROM (SELECT count(*) AS rows, count(DISTINCT parent_seed_id) AS unique_parent_seeds, string_agg(DISTINCT generator_model, ',' ORDER BY generator_model) AS generator_model, string_agg(DISTINCT prompt_version, ',' ORDER BY prompt_version) AS prompt_version, string_agg(DISTINCT reasoning_effort, ',' ORDER BY reasoning_effort) AS reasoning_effort,
      sum(coalesce(token_usage.prompt_tokens, 0))::BIGINT AS generator_prompt_tokens, sum(coalesce(token_usage.completion_tokens, 0))::BIGINT AS generator_completion_tokens, sum(coalesce(token_usage.total_tokens, 0))::BIGINT AS generator_total_tokens FROM gpt_pairs) p,
      (SELECT string_agg(DISTINCT solver_model, ',' ORDER BY solver_model) AS solver_model, count(*) FILTER (coalesce(quality_accept, false)) AS quality_accept, avg(coalesce(quality_accept, false)::INT) AS quality_accept_rate FROM gpt_pairs_quality) q,
      (SELECT sum(coalesce(r.token_usage.prompt_tokens, 0))::BIGINT AS solver_prompt_tokens, sum(coalesce(r.token_usage.completion_tokens, 0))::BIGINT AS solver_completion_tokens, sum(coalesce(r.token_usage.total_tokens, 0))::BIGINT AS solver_total_tokens FROM (SELECT unnest(solver_rollouts) AS r FROM gpt_pairs_quality)) s""",
    "counts_by_split_source": "SELECT split, source, count(*) AS rows, count(DISTINCT parent_seed_id) AS parents FROM gpt_pairs GROUP BY split, source",
    "canonical_seeds": f"WITH {_CANON} SELECT parent_seed_id, {_split('row_number() OVER (ORDER BY ' + rank('parent_seed_id').replace(str(SEED), str(SEED + 1)) + ', parent_seed_id)')} AS split, source, {strip('coalesce(answer, ' + chr(39) * 2 + ')')} AS real_answer FROM chosen",
    "pool_seeds": f"SELECT {stable('seed', chr(39) + 'pool' + chr(39), 'source_id')} AS seed_id, source_id, coalesce(ability, 'MATH') AS domain, {strip('coalesce(content, ' + chr(39) * 2 + ')')} AS problem FROM (SELECT extra_info.parent_seed_id AS source_id, extra_info.sample_id AS sample_id, prompt[1].content AS content, ability FROM rlvr) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sample_id NULLS FIRST, content NULLS FIRST) = 1",
    "verdict_chain": f"WITH {_VOTES}, read AS (SELECT sample_id, vote, vote <> 2 AND question_valid AS question_valid, vote <> 2 AND reference_answer_correct AS reference_answer_correct, CASE WHEN vote = 2 THEN 'other_invalid' ELSE invalid_type END AS invalid_type FROM votes), {_summary('read')} SELECT * FROM voted",
    "jsonl_round_trip": "SELECT sample_id, synthetic_problem, solver_match_rate, solver_matches, len(solver_rollouts)::INT AS rollouts FROM gpt_pairs_solved",
    "generated_pairs": f"""WITH {_GENERATED} SELECT parent_seed_id, split, source, problem_type, question_type, real_problem, real_solution, real_answer, 0 AS generation_index, sample_id, base + a AS generation_seed, 'v1' AS prompt_version, 'low' AS reasoning_effort,
      'Find \\frac{{' || n || '}}{{7}}.' AS synthetic_problem, 'Take ' || n || ' modulo 5.' AS synthetic_solution, (n % 5)::VARCHAR AS synthetic_answer, 'Algebra' AS claimed_domain, 'olympiad' AS claimed_difficulty, 'hash-stub' AS generator_model, 0.9::DOUBLE AS generation_temperature,
      n % 100 AS prompt_tokens, n % 50 AS completion_tokens, n % 100 + n % 50 AS total_tokens, 1 AS request_attempts, (a + 1)::INT AS schema_attempts, {_AT} AS generated_at, {_RAW} AS raw_response FROM made""",
    "generation_failures": f"WITH {_GENERATED} SELECT sample_id, parent_seed_id, split, 'v1' AS prompt_version, 0 AS generation_index, 'hash-stub' AS generator_model, {_AT} AS failed_at, 'RuntimeError' AS error_type, error FROM failed JOIN jobs USING (sample_id)",
    "failure_log": f"""WITH {_GENERATED} SELECT '{{"status":"failed","sample_id":"' || sample_id || '","error":"' || error || '"}}' AS line FROM failed""",
    "generation_chain": f"""WITH {_SOLVED} SELECT sample_id, (a + 1)::INT AS schema_attempts, 'hash-stub' AS solver_model, 3 AS solver_rollouts_k, matches::INT AS solver_matches, matches / 3 AS solver_match_rate, 0 AS solver_declared_invalid, predictions, tokens::BIGINT AS tokens, {_AT} AS solved_at,
      NULL::VARCHAR AS error_type, NULL::VARCHAR AS error, NULL::VARCHAR AS failed_at FROM solved WHERE NOT broken UNION ALL SELECT sample_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'TimeoutError', 'no reply', {_AT} FROM solved WHERE broken""",
    "repaired_json": f"WITH {_REPAIRED} SELECT o.sample_id, y IS NOT NULL AS ok, y ->> '$.problem' AS problem, y ->> '$.reference_answer' AS reference_answer FROM opened o LEFT JOIN two t ON o.sample_id = t.sample_id AND o.raw_response IS NOT DISTINCT FROM t.raw_response",
    "seed_manifest": f"""WITH {_CANON}, steps AS ({_SECTIONS("counts", [("eligible_before_exact_dedup", "count(*)", "fit WHERE length(norm) >= 20 AND " + _TEXT_ONLY.replace("(text,", "(problem,")), ("eligible_after_exact_dedup", "count(*)", "once"), ("contaminated", "count(DISTINCT sample_id)", "eval_hits")])}),
      done AS (SELECT source, {_split('row_number() OVER (ORDER BY ' + rank('parent_seed_id').replace(str(SEED), str(SEED + 1), 1) + ', parent_seed_id)')} AS split FROM chosen)
      SELECT * FROM steps UNION ALL SELECT 'source_quotas', source, quota FROM quotas UNION ALL SELECT 'available_clean_by_source', source, count(*) FROM clean GROUP BY source UNION ALL SELECT 'selected_by_source', source, count(*) FROM done GROUP BY source UNION ALL SELECT 'selected_by_split', split, count(*) FROM done GROUP BY split""",
    "quality_manifest": f"""WITH {_POLICY}, checks AS ({_SECTIONS("checks", [("rows", "count(*)", "policy"), *((n, f"count(*) FILTER ({w})", "policy") for n, w in (("quality_accept", "quality_accept"), ("schema_failed", "NOT schema_ok"), ("unparseable", "NOT answer_parseable"), ("eval_contaminated", "eval_contaminated"), ("synthetic_duplicate", "synthetic_duplicate"), ("parent_near_duplicate", "parent_near_duplicate"), ("solver_rejected", "solver_matches < 2")))])})
      SELECT * FROM checks UNION ALL SELECT 'by_source', coalesce(source, 'None'), count(DISTINCT sample_id) FROM gpt_pairs_quality GROUP BY 2""",
    "view_manifest": f"WITH {_RLVR} SELECT 'arms.' || arm AS section, 'rows' AS name, count(*) AS value FROM rlvr_made GROUP BY arm UNION ALL SELECT 'arms.' || arm, 'synthetic', count(*) FILTER (origin = 'synthetic') FROM rlvr_made GROUP BY arm UNION ALL SELECT 'arms.' || arm || '.by_source', coalesce(source, 'None'), count(*) FROM rlvr_made WHERE arm <> 'fallback' GROUP BY arm, coalesce(source, 'None')",
    "invalid_records": "WITH ids AS (SELECT sample_id AS id FROM gpt_pairs UNION ALL SELECT extra_info.sample_id FROM rlvr) SELECT 'repeated id' AS problem, id AS name, count(*) AS n FROM ids WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing key', 'extra_info', count(*) FROM gpt_pairs UNION ALL SELECT 'missing key', 'sample_id', n FROM (SELECT count(*) FILTER (sample_id IS NULL) AS n FROM gpt_pairs) WHERE n > 0",
    "limited_solutions": "SELECT DISTINCT sample_id FROM gpt_pairs WHERE sample_id NOT IN (SELECT sample_id FROM gpt_pairs_solved) ORDER BY sample_id LIMIT 50",
    "appended_log": "SELECT sample_id, split, generation_index FROM gpt_pairs",
    "view_files": f"WITH {_RLVR} SELECT arm, count(*) AS rows, count(*) FILTER (origin = 'synthetic') AS synthetic, sum(length(ground_truth))::BIGINT AS answer_chars, format FROM rlvr_made, (VALUES ('parquet'), ('jsonl'), ('export')) f(format) GROUP BY arm, format",
    "evaluation_files": "SELECT s || ':' || n AS eval_id, question FROM (SELECT question, row_number() OVER (ORDER BY eval_id, question) - 1 AS n FROM eval_questions WHERE question IS NOT NULL), (VALUES ('math'), ('amc23')) v(s) WHERE question <> ''",
    "artifact_digests": f"SELECT 'regions' AS name, length(content) AS bytes, sha256(content) AS sha256 FROM {_REGIONS} UNION ALL SELECT 'nations', length(content), sha256(content) FROM {_NATIONS}",
    "snapshot_mismatches": f"SELECT 'changed' AS kind, sha256(content) AS found FROM {_REGIONS} UNION ALL SELECT 'gone', NULL",
    "projected_pairs": "SELECT DISTINCT sample_id, split, claimed_domain FROM gpt_pairs",
    "number_answers": "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE n_regionkey::VARCHAR END AS norm, CASE WHEN n_regionkey = 1 THEN true END AS flag, n_regionkey::VARCHAR AS word_norm, CASE n_regionkey WHEN 0 THEN false WHEN 1 THEN true END AS word_flag, n_regionkey <> 0 AS same FROM nation",
    "resumed_stream": f"SELECT DISTINCT sample_id, {answer('synthetic_answer')} AS norm FROM gpt_pairs",
}
SQL["sheet_files"], SQL["theory_file"] = SQL["audit_sample"], SQL["regime_theory"]
SQL["quota_shortages"] = f"SELECT * FROM ({SQL['source_quotas']}) WHERE available < quota"
