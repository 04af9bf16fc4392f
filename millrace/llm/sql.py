"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def words(x: str) -> str:
    return _WORDS.format(x=x)


def _run_sets(rows: str, key: str, text: str) -> str:
    """``s(key, runs)`` and ``e(key, n, run)``: the distinct five-word runs of each text with words."""
    return f"""w AS (SELECT DISTINCT {key} AS key, {words(text)} AS w FROM {rows} WHERE {text} IS NOT NULL),
  s AS MATERIALIZED (SELECT key, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS runs FROM w WHERE len(w) > 0),
  e AS MATERIALIZED (SELECT key, len(runs) AS n, unnest(runs) AS run FROM s)"""


_PAIRS = "SELECT x.key AS a, y.key AS b FROM e x JOIN e y ON x.run = y.run AND x.key < y.key GROUP BY x.key, y.key, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= {t}"

_N = "(SELECT count(DISTINCT parent_seed_id) // 5 AS n FROM numina_5k_seeds)"
_LEAVES = f"""goals AS (SELECT DISTINCT source AS as_source, problem_type AS as_type, lower(trim(source, ' ')) AS source, lower(trim(problem_type, ' ')) AS problem_type, coalesce(target_share, 0) AS target_share, coalesce(min_rows, 0) AS min_rows FROM seed_targets),
  known AS (SELECT parent_seed_id, min(row(s, t)) AS leaf FROM (SELECT parent_seed_id, lower(trim(source, ' ')) AS s, lower(trim(problem_type, ' ')) AS t FROM numina_5k_seeds) k SEMI JOIN goals g ON g.source = k.s AND g.problem_type = k.t WHERE parent_seed_id IS NOT NULL GROUP BY parent_seed_id),
  have AS (SELECT leaf[1] AS source, leaf[2] AS problem_type, count(*) AS available FROM known GROUP BY 1, 2),
  leaves AS (SELECT g.*, greatest(min_rows, floor(target_share * n + 0.5)::BIGINT) AS quota, coalesce(available, 0) AS available FROM goals g LEFT JOIN have h USING (source, problem_type), {_N}),
  l0 AS (SELECT *, least(quota, available) AS drawn, quota - least(quota, available) AS unmet FROM leaves)"""


def _level(out: str, of: str, node: str) -> str:
    part = f"PARTITION BY {node}" if node else ""
    window = f"WINDOW nd AS ({part}), al AS ({part} ORDER BY source, problem_type ROWS UNBOUNDED PRECEDING)"
    return f"""{out}_t AS (SELECT *, available - drawn AS spare, sum(unmet) OVER nd AS u, sum(available - drawn) OVER nd AS s, sum(unmet) OVER al AS cu, sum(available - drawn) OVER al AS cs FROM {of} {window}),
  {out} AS (SELECT * EXCLUDE (drawn, unmet, spare, u, s, cu, cs), drawn + (least(u, s) * cs // greatest(s, 1) - least(u, s) * (cs - spare) // greatest(s, 1))::BIGINT AS drawn, unmet - (least(u, s) * cu // greatest(u, 1) - least(u, s) * (cu - unmet) // greatest(u, 1))::BIGINT AS unmet FROM {out}_t)"""


_PLAN = f"{_LEAVES}, {_level('l1', 'l0', 'source')}, {_level('l2', 'l1', '')}"
_REPETITION = f"""t AS (SELECT sample_id, 'synthetic_solution' AS field_name, {words('synthetic_solution')} AS w FROM (SELECT DISTINCT sample_id, synthetic_solution FROM gpt_pairs WHERE synthetic_solution IS NOT NULL)
  UNION ALL SELECT sample_id, 'raw_response', {words('raw_response')} FROM (SELECT DISTINCT sample_id, raw_response FROM gpt_pairs_solved WHERE raw_response IS NOT NULL)),
  r AS (SELECT sample_id, field_name, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS run FROM t WHERE len(w) >= 20),
  c AS (SELECT sample_id, field_name, run, count(*) AS n FROM r GROUP BY ALL)"""
_DRAW = "('0x' || substr(sha256('7' || chr(31) || '0' || chr(31) || id), 1, 13))::BIGINT / 4503599627370496.0"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_LEAVES} SELECT as_source AS source, as_type AS problem_type FROM leaves WHERE available < quota",
    "p1_report": f"WITH {_PLAN} SELECT as_source AS source, as_type AS problem_type, target_share, min_rows, quota, available, drawn, greatest(quota - available, 0) AS short, unmet FROM l2",
    "p1_sample": f"""WITH {_PLAN}, ranked AS (SELECT parent_seed_id, leaf[1] AS source, leaf[2] AS problem_type, row_number() OVER (PARTITION BY leaf ORDER BY sha256('7' || chr(31) || parent_seed_id), parent_seed_id) - 1 AS rank FROM known)
      SELECT r.parent_seed_id, r.source, r.problem_type, r.rank FROM ranked r JOIN l2 USING (source, problem_type) WHERE rank < drawn""",
    "p2_found": f"""WITH splits AS (SELECT trim(parent_seed_id, ' ') AS parent, min(lower(trim(split, ' '))) AS split FROM numina_5k_seeds GROUP BY 1 HAVING min(lower(trim(split, ' '))) <> ''),
      every AS (SELECT parent_seed_id AS key, trim(parent_seed_id, ' ') AS parent, real_problem AS text FROM numina_5k_seeds UNION ALL SELECT sample_id, trim(parent_seed_id, ' '), synthetic_problem FROM gpt_pairs),
      rec AS (SELECT DISTINCT key, text, split FROM every JOIN splits USING (parent)), {_run_sets('rec', 'key', 'text')}, near AS ({_PAIRS.format(t=0.6)}), side AS (SELECT DISTINCT key, split = 'train' AS train FROM rec)
      SELECT a AS key_a, b AS key_b FROM near JOIN side x ON x.key = a JOIN side y ON y.key = b WHERE x.train <> y.train""",
    "p2_report": f"""WITH splits AS (SELECT trim(parent_seed_id, ' ') AS parent, min(lower(trim(split, ' '))) AS split, min(lower(trim(source, ' '))) AS source FROM numina_5k_seeds GROUP BY 1 HAVING min(lower(trim(split, ' '))) <> ''),
      every AS (SELECT parent_seed_id AS key, trim(parent_seed_id, ' ') AS parent, real_problem AS text FROM numina_5k_seeds UNION ALL SELECT sample_id, trim(parent_seed_id, ' '), synthetic_problem FROM gpt_pairs),
      rec AS (SELECT DISTINCT key, text, split, source FROM every JOIN splits USING (parent)), {_run_sets('rec', 'key', 'text')}, side AS (SELECT key, any_value(split) AS split, any_value(source) AS source, any_value(split) = 'train' AS train FROM rec GROUP BY key),
      near AS (SELECT x.key AS a, count(*) / (x.n + y.n - count(*)) AS similarity FROM e x JOIN e y ON x.run = y.run JOIN side p ON p.key = x.key JOIN side q ON q.key = y.key WHERE NOT p.train AND q.train GROUP BY x.key, y.key, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.8),
      best AS (SELECT a AS key, max(similarity) AS best FROM near GROUP BY a)
      SELECT split, source, count(*) AS records, count(best) AS overlapping, count(*) FILTER (best = 1) AS exact FROM s JOIN side USING (key) LEFT JOIN best USING (key) WHERE NOT train GROUP BY split, source""",
    "p3_found": f"WITH {_run_sets('gpt_pairs_quality', 'sample_id', 'synthetic_problem')} SELECT a AS sample_a, b AS sample_b FROM ({_PAIRS.format(t=0.6)})",
    "p3_groups": f"""WITH RECURSIVE {_run_sets('gpt_pairs_quality', 'sample_id', 'synthetic_problem')}, near AS MATERIALIZED ({_PAIRS.format(t=0.8)}),
      two_way AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach(key, other) AS (SELECT key, key FROM s UNION SELECT r.key, b.b FROM reach r JOIN two_way b ON b.a = r.other),
      class AS (SELECT key, array_to_string(list_sort(runs), '|') AS c FROM s), sizes AS (SELECT c, count(*) AS copies FROM class GROUP BY c),
      links AS (SELECT b.a AS key, count(DISTINCT y.c) FILTER (y.c <> x.c) AS links FROM two_way b JOIN class x ON x.key = b.a JOIN class y ON y.key = b.b GROUP BY b.a)
      SELECT r.key AS sample_id, min(r.other) AS group_id, any_value(z.copies) AS copies, coalesce(any_value(l.links), 0) AS links FROM reach r JOIN class x USING (key) JOIN sizes z USING (c) LEFT JOIN links l USING (key) GROUP BY r.key""",
    "p4_found": "SELECT extra_info.parent_seed_id AS parent_seed_id FROM rlvr WHERE extra_info.parent_seed_id IS NOT NULL AND extra_info.synthetic_ratio >= 0 GROUP BY 1 HAVING min(extra_info.synthetic_ratio) FILTER (extra_info.origin = 'synthetic') < max(extra_info.synthetic_ratio) FILTER (extra_info.origin = 'real')",
    "p4_selection": f"""WITH first AS (SELECT trim(parent_seed_id, ' ') AS id, min(substr(generated_at, 1, 7)) AS epoch FROM gpt_pairs WHERE parent_seed_id IS NOT NULL GROUP BY 1),
      rated AS (SELECT *, CASE epoch WHEN '2026-01' THEN 0.5::DOUBLE WHEN '2026-02' THEN 0.4 WHEN '2026-03' THEN 0.3 ELSE 0.2 END AS rate FROM first) SELECT id AS parent_seed_id, epoch, rate FROM rated WHERE {_DRAW} < rate""",
    "p6_found": f"WITH {_REPETITION} SELECT sample_id, field_name FROM c GROUP BY ALL HAVING sum(n) FILTER (n > 1) / sum(n) >= 0.4",
    "p6_shares": f"""WITH x AS (SELECT DISTINCT sample_id, 'synthetic_solution' AS field_name, synthetic_solution AS text FROM gpt_pairs WHERE synthetic_solution IS NOT NULL UNION ALL SELECT DISTINCT sample_id, 'raw_response', raw_response FROM gpt_pairs_solved WHERE raw_response IS NOT NULL),
      t AS MATERIALIZED (SELECT row_number() OVER () AS k, *, {words('text')} AS w FROM x),
      r AS (SELECT k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS v, 1 AS size FROM t WHERE len(w) >= 5),
      s AS (SELECT k, unnest(regexp_split_to_array(lower(text), '[.!?。！？\n]')) AS part FROM t), l AS (SELECT k, unnest(string_split(lower(text), chr(10))) AS part FROM t),
      pieces AS (SELECT 'run' AS kind, k, v, size FROM r UNION ALL SELECT 'sentence', k, array_to_string({words('part')}, ' '), len({words('part')}) FROM s UNION ALL SELECT 'line', k, array_to_string({words('part')}, ' '), len({words('part')}) FROM l),
      sums AS (SELECT kind, k, v, count(*) AS n, sum(size) AS size FROM pieces WHERE size > 0 GROUP BY ALL), shares AS (SELECT kind, k, coalesce(sum(size) FILTER (n > 1), 0) / sum(size) AS share FROM sums GROUP BY ALL)
      SELECT DISTINCT sample_id, field_name, len(w)::INT AS words, coalesce(r.share, 0)::DOUBLE AS run_share, coalesce(s.share, 0)::DOUBLE AS sentence_share, coalesce(l.share, 0)::DOUBLE AS line_share
      FROM t LEFT JOIN shares r ON r.k = t.k AND r.kind = 'run' LEFT JOIN shares s ON s.k = t.k AND s.kind = 'sentence' LEFT JOIN shares l ON l.k = t.k AND l.kind = 'line'""",
    "p7_found": f"""WITH q AS (SELECT DISTINCT eval_id, {words('question')} AS w FROM eval_questions WHERE question IS NOT NULL), qs AS (SELECT eval_id, least(12, len(w)) AS n, w FROM q WHERE len(w) > 0),
      runs AS (SELECT eval_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS run FROM qs), d AS (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
      sizes AS (SELECT DISTINCT n FROM qs), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS run FROM d, sizes)
      SELECT DISTINCT doc_id, eval_id FROM g JOIN runs USING (run)""",
    "p8_found": "WITH d AS (SELECT lower(trim(source, ' ')) AS source, sum(length(text)) AS size FROM documents GROUP BY 1), t AS (SELECT DISTINCT * FROM mix_targets) SELECT t.source FROM t LEFT JOIN d ON d.source = lower(trim(t.source, ' ')) WHERE coalesce(max_repeats, 1) * coalesce(size, 0) < target_share * (SELECT sum(length(text)) FROM documents)",
    "p9_shared": """WITH d AS (SELECT doc_id, text, coalesce(length(text), 0) AS n FROM documents), g AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM d, (SELECT unnest(range(1, (SELECT max(n) FROM d))) AS i) WHERE n >= 200 AND i <= n - 199),
      c AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)), w AS (SELECT doc_id, i FROM g SEMI JOIN c USING (h)),
      m AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS head FROM w), k AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m),
      s AS (SELECT doc_id, part, max(i) - min(i) + 200 AS size FROM k GROUP BY ALL), t AS (SELECT doc_id, sum(size)::BIGINT AS shared_chars, max(size)::BIGINT AS longest FROM s GROUP BY doc_id)
      SELECT doc_id, n::INT AS n_chars, coalesce(shared_chars, 0)::BIGINT AS shared_chars, coalesce(longest, 0)::BIGINT AS longest FROM d LEFT JOIN t USING (doc_id) WHERE doc_id IS NOT NULL""",
    "p9_found": "WITH g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, length(text) - 198), lambda i: md5(substr(text, i, 200))))) AS h FROM documents WHERE length(text) >= 200), c AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM g SEMI JOIN c USING (h)",
}
