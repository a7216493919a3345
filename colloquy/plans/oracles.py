"""The queries restated in SQL over the same tables, for comparison in DuckDB."""

from __future__ import annotations

from colloquy.functions import text as X
from colloquy.operators.scenarios import SCENARIO_IDS, TASKS
from colloquy.plans.tables import MODELS, NEW_STAMP, OLD_STAMP, SHARD_ITEMS, STAMP

BUDGET = 500
WORD_BUDGET = 300
SFT_LENGTH = 1_500


def pick(values, number: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[CAST({number} AS BIGINT) % {len(values)} + 1]"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


# --- conversations ----------------------------------------------------------

_ALIAS = """
t AS (
  SELECT conv_id, turn, text AS content,
    CASE WHEN conv_id % 11 = 0 AND role = 'user' THEN NULL
         WHEN conv_id % 2 = 1 AND role = 'user' THEN 'human'
         WHEN conv_id % 2 = 1 AND role = 'assistant' THEN 'gpt'
         ELSE role END AS role
  FROM conversations)"""

_PARTS = """
parts AS (
  SELECT conv_id,
    coalesce(min_by(text, turn) FILTER (role = 'system'), '') AS system,
    coalesce(max_by(text, turn) FILTER (role = 'user'), '') AS "user",
    coalesce(max_by(text, turn) FILTER (role = 'assistant'), '') AS assistant
  FROM conversations GROUP BY conv_id)"""

_HEADERS = f"""
headers AS (
  SELECT DISTINCT conv_id,
    CASE WHEN conv_id % 3 = 0 THEN 'c' || conv_id END AS id,
    CASE WHEN conv_id % 4 <> 0 THEN 'src' || (conv_id % 5) END AS source,
    CASE WHEN conv_id % 2 = 0 THEN {pick(TASKS, 'conv_id')} END AS task_type
  FROM conversations)"""

_CORPUS = f"""{_PARTS}, {_HEADERS},
corpus AS (
  SELECT coalesce(h.source, 'unknown') || '::' || coalesce(h.id, CAST(h.conv_id AS VARCHAR)) AS id,
    h.conv_id AS index, p."user" AS text, p."user", p.assistant AS workflow, h.source
  FROM parts p JOIN headers h USING (conv_id)
  WHERE p."user" <> '' AND p.assistant <> '')"""

# Word-bucket vectors of (key, text) rows in ``src``.
_EMBED = r"""
words AS (
  SELECT key, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM src),
counts AS (
  SELECT key, CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 64 AS dim, count(*) AS n
  FROM words GROUP BY ALL),
norms AS (SELECT key, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM counts GROUP BY key)"""

_HITS = (
    f"""{_CORPUS},
src AS (SELECT 'q' || conv_id AS key, "user" AS text FROM parts
        UNION ALL SELECT 'r' || id, text FROM corpus),
{_EMBED},
vec AS (
  SELECT k.key, list(coalesce(c.n / m.norm, 0.0) ORDER BY d.dim) AS v
  FROM src k CROSS JOIN range(64) d(dim)
  LEFT JOIN counts c ON c.key = k.key AND c.dim = d.dim
  LEFT JOIN norms m ON m.key = k.key GROUP BY k.key),
sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM vec),
pairs AS (
  SELECT h.conv_id, c.id AS record_id,
    round(list_dot_product(q.v, r.v) / (r.norm * q.norm + 1e-9), 12) AS score
  FROM headers h JOIN corpus c
    ON c.id <> coalesce(h.source, 'unknown') || '::' || coalesce(h.id, CAST(h.conv_id AS VARCHAR))
  JOIN sized q ON q.key = 'q' || h.conv_id JOIN sized r ON r.key = 'r' || c.id),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, record_id) AS rank
  FROM pairs QUALIFY rank <= 2)"""
)


def blocks(separator: str) -> str:
    return f"""{_HITS},
blocks AS (
  SELECT conv_id, count(*) AS n_examples,
    string_agg('### Example ' || rank || E'\\nQuestion:\\n' || c."user"
      || E'\\n\\nWorkflow:\\n' || c.workflow || E'\\n', E'{separator}' ORDER BY rank) AS block
  FROM hits JOIN corpus c ON c.id = record_id GROUP BY conv_id)"""


def _prompt(header: str, separator: str) -> str:
    return f"""WITH {blocks(separator)}
SELECT conv_id, 'system' AS role_1, system || E'{header}' || coalesce(block, '') AS content_1,
  'user' AS role_2, "user" AS content_2
FROM parts LEFT JOIN blocks USING (conv_id)"""


def _last(condition: str, how: str, name: str) -> str:
    return f"""WITH {_ALIAS}
SELECT conv_id, coalesce({how}(content, turn) FILTER ({condition}), '') AS "{name}"
FROM t GROUP BY conv_id"""


# --- budget -----------------------------------------------------------------

def _fit(size: str, tokens, budget: int) -> str:
    """``size`` of a turn, ``tokens`` of a sum of sizes."""
    return f"""
sized AS (
  SELECT conv_id, turn, role, text,
    {size} AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r
  FROM conversations),
conv AS (
  SELECT conv_id, list(c ORDER BY r) AS cs, count(*) AS n, sum(c) AS total,
    max(CASE WHEN r = 0 AND role = 'system' THEN 1 ELSE 0 END) AS s
  FROM sized GROUP BY conv_id),
cand AS (
  SELECT conv_id, k,
    {tokens('CASE WHEN s = 1 THEN cs[1] ELSE 0 END + list_sum(cs[s + 2 * k + 1:])')} AS tokens
  FROM (SELECT *, unnest(range(1, CAST((n - s) // 2 AS BIGINT))) AS k FROM conv
        WHERE (n - s) % 2 = 0)),
first_fit AS (
  SELECT conv_id, min(k) AS k, arg_min(tokens, k) AS tokens
  FROM cand WHERE tokens <= {budget} GROUP BY conv_id),
fit AS (
  SELECT conv_id, n, s,
    {tokens('total')} AS before, f.k, f.tokens,
    CASE WHEN {tokens('total')} <= {budget} THEN 'full'
         WHEN n - s < 2 OR (n - s) % 2 <> 0 THEN 'malformed'
         WHEN f.k IS NOT NULL THEN 'drop_' || f.k || '_demo'
         ELSE 'dropped' END AS tag
  FROM conv LEFT JOIN first_fit f USING (conv_id)),
fitted AS (
  SELECT *, CASE WHEN tag LIKE 'drop\\_%' ESCAPE '\\' THEN k ELSE 0 END AS gone FROM fit),
kept AS (
  SELECT conv_id, tag, role, text,
    CASE WHEN s = 1 AND r = 0 THEN 0 ELSE r - 2 * gone END AS turn
  FROM sized JOIN fitted USING (conv_id)
  WHERE tag NOT IN ('dropped', 'malformed') AND ((s = 1 AND r = 0) OR r >= s + 2 * gone))"""

_FIT = _fit("length(role) + length(text) + 3", lambda x: f"greatest(1, ({x} - 1) // 4)", BUDGET)
_FIT_WORDS = _fit(r"len(regexp_extract_all(role || ': ' || text, '[^\x20\x09-\x0D]+'))", str, WORD_BUDGET)

_EXAMPLES = rf"""{_FIT},
rendered AS (
  SELECT conv_id,
    string_agg('<|' || role || E'|>\n' || text || E'\n', '' ORDER BY turn) AS full_text,
    coalesce(string_agg('<|' || role || E'|>\n' || text || E'\n', '' ORDER BY turn)
      FILTER (turn < n_kept - 1), '') || E'<|assistant|>\n' AS prefix_text,
    max(n_kept) AS n_kept,
    arg_max(role, turn) AS last_role
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_kept FROM kept)
  GROUP BY conv_id),
cut AS (
  SELECT *, left(full_text, {SFT_LENGTH}) AS f, left(prefix_text, {SFT_LENGTH}) AS p FROM rendered),
prefixed AS (
  SELECT *,
    CASE WHEN length(p) < length(f) AND starts_with(f, p) THEN length(p)
         ELSE (SELECT count(*) FROM range(1, least(length(f), length(p)) + 1) g(i)
               WHERE left(f, i) = left(p, i)) END AS np
  FROM cut),
ex AS (
  SELECT *,
    CASE WHEN n_kept < 2 OR last_role <> 'assistant' THEN 'no_answer'
         WHEN length(f) = 0 THEN 'empty'
         WHEN np >= length(f) THEN 'no_label' ELSE 'kept' END AS reason,
    list_transform(range(1, length(f) + 1), lambda i: unicode(f[i])) AS ids
  FROM prefixed)"""


def _padded(ids: str, fill: str) -> str:
    return f"list_concat({ids}, list_transform(range(0, (8 - len({ids}) % 8) % 8), lambda i: {fill}))"


_LABELS = "list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= np THEN -100 ELSE ids[i] END)"

# --- documents as items -----------------------------------------------------

_ITEMS = r"""
items AS (
  SELECT doc_id,
    CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS id,
    CASE WHEN doc_id % 7 <> 0 THEN source END AS source, lang AS task_type,
    CAST(3 AS BIGINT) AS n_messages,
    md5('system: ' || lang || E'\nuser: ' || split_part(text, E'\n', 1)
        || E'\nassistant: ' || text) AS text_md5
  FROM documents)"""

# --- workflows --------------------------------------------------------------


def _edges(n: str) -> str:
    return f"""CASE WHEN {n} > 0 THEN list_concat(['(START,1)'],
      list_transform(range(1, {n}), lambda i: '(' || i || ',' || (i + 1) || ')'),
      ['(' || {n} || ',END)'],
      CASE WHEN o % 3 = 0 AND {n} >= 3 THEN ['(1,3)'] ELSE [] END)
    ELSE ['(START,END)'] END"""


def _text(labels: str, edges: str) -> str:
    return f"""E'Node:\\n' || array_to_string(list_transform({labels},
      lambda x, i: i || ': ' || x), E'\\n') || E'\\nEdge: ' || array_to_string({edges}, ' ')"""


_PAIRS = f"""
lines AS (
  SELECT l_orderkey AS o, p_name AS label,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
      l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS r
  FROM lineitem JOIN part ON p_partkey = l_partkey),
grouped AS (
  SELECT o, list(label ORDER BY r) AS labels,
    CAST(count(*) AS BIGINT) AS n
  FROM lines GROUP BY ALL),
edged AS (
  SELECT *, {_edges('n')} AS e0, {_edges('(n - 1)')} AS e_less, {_edges('(n + 1)')} AS e_more
  FROM grouped),
pairs AS (
  SELECT o, {pick(TASKS, 'o')} AS task, o * 1048576 AS idx,
    {pick(MODELS, 'o')} AS model,
    CASE WHEN o % 3 = 2 THEN 'i0'
         WHEN o % 3 = 1 AND (o // 3) % 4 = 3 THEN 'sft'
         ELSE {pick(SCENARIO_IDS, 'o // 3')} END AS scenario,
    '{STAMP}' AS stamp,
    {_text('labels', 'e0')} AS gold_workflow,
    CASE o % 10
      WHEN 0 THEN ''
      WHEN 1 THEN 'There is nothing to plan here, so no steps follow.'
      WHEN 2 THEN {_text('list_concat(labels[2:], labels[1:1])', 'e0')}
      WHEN 3 THEN {_text('labels[1:n - 1]', 'e_less')}
      WHEN 4 THEN {_text('labels', "list_filter(e0, lambda x: x <> '(1,2)')")}
      WHEN 5 THEN {_text("list_concat(['replaced step'], labels[2:])", 'e0')}
      WHEN 6 THEN {_text('list_reverse(labels)', 'e0')}
      WHEN 7 THEN {_text('list_concat(labels, labels[n:n])', 'e_more')}
      ELSE {_text('labels', 'e0')} END AS pred_workflow
  FROM edged)"""


def _nodes_of(side: str) -> str:
    node = r"(?m)^[ \t]*(\d+)[ \t]*:[ \t]*(\S.*)$"
    text = f"{side}_workflow"
    return f"""
{side}_n AS (
  SELECT task, idx, row_number() OVER (PARTITION BY task, idx ORDER BY i) AS pos, no, label
  FROM (SELECT task, idx, i, CAST(nos[i] AS BIGINT) AS no, trim(labels[i]) AS label
        FROM (SELECT task, idx, nos, labels, unnest(range(1, len(nos) + 1)) AS i
              FROM (SELECT task, idx, regexp_extract_all({text}, '{node}', 1) AS nos,
                           regexp_extract_all({text}, '{node}', 2) AS labels FROM pairs)))
  WHERE label NOT IN ('START', 'END'))"""


def _edges_of(side: str) -> str:
    edge = r"\(\s*(START|\d+)\s*,\s*(END|\d+)\s*\)"
    text = f"{side}_workflow"
    return f"""
{side}_e AS (
  SELECT task, idx, i AS pos, a[i] AS src, b[i] AS dst
  FROM (SELECT task, idx, a, b, unnest(range(1, len(a) + 1)) AS i
        FROM (SELECT task, idx, regexp_extract_all({text}, '{edge}', 1) AS a,
                     regexp_extract_all({text}, '{edge}', 2) AS b FROM pairs)))"""


_MATCH = f"""{_PAIRS}, {_nodes_of('gold')}, {_nodes_of('pred')},
gold_k AS (SELECT *, row_number() OVER (PARTITION BY task, idx, lower(label) ORDER BY pos) AS occ FROM gold_n),
pred_k AS (SELECT *, row_number() OVER (PARTITION BY task, idx, lower(label) ORDER BY pos) AS occ FROM pred_n),
matches AS (
  SELECT p.task, p.idx, p.pos AS pred_pos, g.pos AS gold_pos, p.no AS pred_no, g.no AS gold_no
  FROM pred_k p JOIN gold_k g ON p.task = g.task AND p.idx = g.idx
    AND lower(p.label) = lower(g.label) AND p.occ = g.occ),
sizes AS (
  SELECT task, idx, model, scenario, coalesce(gn, 0) AS gn, coalesce(pn, 0) AS pn,
    CASE WHEN coalesce(pn, 0) = 0 OR coalesce(gn, 0) = 0 THEN 'unparseable' ELSE 'evaluated' END AS status
  FROM pairs
  LEFT JOIN (SELECT task, idx, count(*) AS gn FROM gold_n GROUP BY ALL) USING (task, idx)
  LEFT JOIN (SELECT task, idx, count(*) AS pn FROM pred_n GROUP BY ALL) USING (task, idx))"""


def _scores(hits: str, n_pred: str = "pn", n_gold: str = "gn") -> str:
    """P, R and F1 of ``sizes`` rows joined with ``found`` (task, idx, hits)."""
    return f"""
scored AS (
  SELECT task, idx, model, scenario, status,
    CASE WHEN status = 'evaluated' THEN coalesce({hits} / nullif({n_pred}, 0), 0) END AS precision,
    CASE WHEN status = 'evaluated' THEN coalesce({hits} / nullif({n_gold}, 0), 0) END AS recall,
    CASE WHEN status = 'evaluated' THEN coalesce(
      2.0 * ({hits} / nullif({n_pred}, 0)) * ({hits} / nullif({n_gold}, 0))
      / nullif(({hits} / nullif({n_pred}, 0)) + ({hits} / nullif({n_gold}, 0)), 0), 0) END AS f1_score
  FROM sizes LEFT JOIN found USING (task, idx))"""


_LIS = """
runs AS (
  SELECT task, idx, pred_pos, gold_pos, 1 AS len FROM matches
  UNION
  SELECT m.task, m.idx, m.pred_pos, m.gold_pos, r.len + 1
  FROM runs r JOIN matches m ON m.task = r.task AND m.idx = r.idx
    AND m.pred_pos > r.pred_pos AND m.gold_pos > r.gold_pos),
longest AS (SELECT task, idx, max(len) AS hits FROM runs GROUP BY ALL)"""

_CHAIN = f"""{_MATCH}, {_LIS},
found AS (SELECT * FROM longest),
{_scores('coalesce(hits, 0)')}"""

_ENDS = """
ends AS (
  SELECT task, idx, CAST(pred_no AS VARCHAR) AS pred_end, CAST(gold_no AS VARCHAR) AS gold_end FROM matches
  UNION ALL
  SELECT task, idx, e, e FROM pairs CROSS JOIN (VALUES ('START'), ('END')) v(e))"""

_SHARED = f"""{_MATCH}, {_edges_of('gold')}, {_edges_of('pred')}, {_ENDS},
found AS (
  SELECT task, idx, max(ne_p) AS ne_p, max(ne_g) AS ne_g, sum(shared) AS shared FROM (
    SELECT task, idx, count(DISTINCT (src, dst)) AS ne_p, 0 AS ne_g, 0 AS shared FROM pred_e GROUP BY ALL
    UNION ALL
    SELECT task, idx, 0, count(DISTINCT (src, dst)), 0 FROM gold_e GROUP BY ALL
    UNION ALL
    SELECT p.task, p.idx, 0, 0, count(DISTINCT (p.src, p.dst))
    FROM pred_e p
    JOIN ends a ON a.task = p.task AND a.idx = p.idx AND a.pred_end = p.src
    JOIN ends b ON b.task = p.task AND b.idx = p.idx AND b.pred_end = p.dst
    JOIN gold_e g ON g.task = p.task AND g.idx = p.idx AND g.src = a.gold_end AND g.dst = b.gold_end
    GROUP BY ALL)
  GROUP BY ALL),
{_scores('coalesce(shared, 0)', 'ne_p', 'ne_g')}"""

# Fewest matched nodes to remove, by trying every set of nodes.
_GRAPH_FOUND = f"""{_MATCH}, {_edges_of('gold')}, {_edges_of('pred')},
inner_gold AS (
  SELECT DISTINCT g.task, g.idx, a.gold_pos AS x, b.gold_pos AS y FROM gold_e g
  JOIN matches a ON a.task = g.task AND a.idx = g.idx AND CAST(a.gold_no AS VARCHAR) = g.src
  JOIN matches b ON b.task = g.task AND b.idx = g.idx AND CAST(b.gold_no AS VARCHAR) = g.dst),
inner_pred AS (
  SELECT DISTINCT p.task, p.idx, a.gold_pos AS x, b.gold_pos AS y FROM pred_e p
  JOIN matches a ON a.task = p.task AND a.idx = p.idx AND CAST(a.pred_no AS VARCHAR) = p.src
  JOIN matches b ON b.task = p.task AND b.idx = p.idx AND CAST(b.pred_no AS VARCHAR) = p.dst),
clash AS (
  (SELECT * FROM inner_gold EXCEPT SELECT * FROM inner_pred)
  UNION ALL (SELECT * FROM inner_pred EXCEPT SELECT * FROM inner_gold)),
masks AS (
  SELECT task, idx, list((1::BIGINT << (x - 1)) | (1::BIGINT << (y - 1))) AS cs,
    max(greatest(x, y)) AS width
  FROM clash GROUP BY ALL),
covers AS (
  SELECT task, idx, min(bit_count(s)) AS removed
  FROM (SELECT task, idx, cs, unnest(range(0, 1::BIGINT << width)) AS s FROM masks)
  WHERE len(list_filter(cs, lambda c: (c & s) = 0)) = 0 GROUP BY ALL),
found AS (
  SELECT task, idx, count(*) - coalesce(max(removed), 0) AS hits
  FROM matches LEFT JOIN covers USING (task, idx) GROUP BY ALL),
{_scores('coalesce(hits, 0)')}"""

_BRANCHING = _PAIRS[: _PAIRS.index("edged AS (")] + f"""
formed AS (
  SELECT *, list_transform(range(1, n), lambda i: '(' || i || ',' || (i + 1) || ')') AS chain,
    list_transform(range(1, n - 1), lambda i: '(' || i || ',' || (i + 2) || ')') AS strands, o // 10 % 6 AS form
  FROM grouped),
edged AS (
  SELECT *, list_concat(['(START,1)'], CASE form
    WHEN 0 THEN chain
    WHEN 1 THEN list_transform(range(2, n + 1), lambda i: '(1,' || i || ')')
    WHEN 2 THEN []
    WHEN 3 THEN strands
    WHEN 4 THEN list_concat(chain, ['(' || n || ',1)'])
    ELSE list_concat(strands, ['(' || n || ',99)']) END) AS e FROM formed),
predicted AS (
  SELECT *, CASE WHEN form = 5 THEN list_concat(e, ['(1,1)']) ELSE e END AS pe,
    CASE o % 4 WHEN 0 THEN list_reverse(labels) WHEN 1 THEN list_concat(labels[2:], labels[1:1])
      WHEN 2 THEN list_concat(labels[3:], labels[1:2]) ELSE labels END AS pl FROM edged),
pairs AS (
  SELECT o, {pick(TASKS, 'o')} AS task, o * 1048576 AS idx, 'model-a' AS model, 'i0' AS scenario,
    {_text('labels', 'e')} AS gold_workflow,
    CASE WHEN o % 11 = 0 THEN '' ELSE {_text('pl', 'pe')} END AS pred_workflow
  FROM predicted)"""

# Paths between places of gold nodes, and their most edges; one of as many edges as there
# are nodes comes twice to a node.
_WAYS = f"""{_edges_of('gold')},
steps AS (
  SELECT DISTINCT e.task, e.idx, a.pos AS a, b.pos AS b FROM gold_e e
  JOIN gold_n a ON a.task = e.task AND a.idx = e.idx AND CAST(a.no AS VARCHAR) = e.src
  JOIN gold_n b ON b.task = e.task AND b.idx = e.idx AND CAST(b.no AS VARCHAR) = e.dst),
reach AS (
  SELECT * FROM steps
  UNION
  SELECT r.task, r.idx, r.a, s.b FROM reach r JOIN steps s ON s.task = r.task AND s.idx = r.idx AND s.a = r.b),
cyclic AS (SELECT DISTINCT task, idx FROM reach WHERE a = b)"""

_LEVELS = f"""{_BRANCHING}, {_nodes_of('gold')}, {_WAYS},
walks AS (
  SELECT task, idx, pos, 0 AS len FROM gold_n
  UNION
  SELECT w.task, w.idx, s.b, len + 1 FROM walks w JOIN steps s ON s.task = w.task AND s.idx = w.idx AND s.a = w.pos
  WHERE (w.task, w.idx) NOT IN (SELECT (task, idx) FROM cyclic))"""

_ANY_ORDER = f"""{_MATCH.replace(_PAIRS, _BRANCHING).replace('sizes AS (', 'given AS (')}, {_WAYS}, {_LIS},
sizes AS (
  SELECT given.* REPLACE (CASE WHEN status = 'evaluated' AND cyclic.idx IS NOT NULL THEN 'runtime' ELSE status END AS status)
  FROM given LEFT JOIN cyclic USING (task, idx)),
clash AS (
  SELECT m.task, m.idx, m.gold_pos AS x, k.gold_pos AS y FROM matches m
  JOIN matches k ON k.task = m.task AND k.idx = m.idx AND m.pred_pos < k.pred_pos
  JOIN reach r ON r.task = m.task AND r.idx = m.idx AND r.a = k.gold_pos AND r.b = m.gold_pos),
{_GRAPH_FOUND[_GRAPH_FOUND.index('masks AS ('):]},
listed AS (
  SELECT task, idx, CASE WHEN status = 'evaluated' THEN
    round(coalesce(2.0 * coalesce(hits, 0) / (pn + gn), 0), 6) END AS listed_f1
  FROM given LEFT JOIN longest USING (task, idx))"""

_SCORE_SELECT = """
SELECT task, idx, status, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1_score, 6) AS f1_score FROM scored"""


def _rename(sql: str, suffix: str) -> str:
    """The score steps once more under other names, for a query with both."""
    for name in ("found", "scored"):
        sql = sql.replace(f"{name} AS (", f"{name}_{suffix} AS (").replace(
            f"JOIN {name} ", f"JOIN {name}_{suffix} "
        )
    return sql


_NODE_PART = f"{_LIS}, found AS (SELECT * FROM longest), {_scores('coalesce(hits, 0)')}"
_GRAPH_PART = _GRAPH_FOUND[len(_MATCH) + 1 :]
_RESULTS = f"""{_MATCH}, {_rename(_NODE_PART, 'node')}, {_rename(_GRAPH_PART, 'graph')},
results AS (
  SELECT model, scenario, task, eval_type,
    round(sum(coalesce(precision, 0)) / count(*), 6) AS precision,
    round(sum(coalesce(recall, 0)) / count(*), 6) AS recall,
    round(sum(coalesce(f1_score, 0)) / count(*), 6) AS f1_score,
    count(*) AS n_total,
    count(*) FILTER (status = 'evaluated') AS n_evaluated,
    count(*) FILTER (status = 'unparseable') AS n_skipped_unparseable,
    count(*) FILTER (status = 'runtime') AS n_skipped_runtime
  FROM (SELECT *, 'node' AS eval_type FROM scored_node
        UNION ALL SELECT *, 'graph' FROM scored_graph)
  GROUP BY ALL)"""

_TASK_ROWS = ", ".join(f"('{t}')" for t in TASKS)
_MATRIX = f"""{_RESULTS},
cells AS (
  SELECT model, scenario, task, eval_type
  FROM (VALUES ('model-a'), ('model-b'), ('model-c')) m(model),
    (VALUES ('i0'), ('rag'), ('sft'), ('sft_rag')) s(scenario),
    (VALUES {_TASK_ROWS}) t(task), (VALUES ('node'), ('graph')) e(eval_type)
  WHERE model <> 'model-c' OR scenario = 'i0'),
matrix AS (
  SELECT model, scenario, task, eval_type,
    CASE WHEN n_total IS NULL THEN 'pending' ELSE 'done' END AS status,
    CASE WHEN n_total IS NULL THEN 'eval_results/' || model || '/' || task || '/' || scenario
      || '_' || eval_type || '.json' END AS expected_output,
    precision, recall, f1_score, n_total, n_evaluated, n_skipped_unparseable, n_skipped_runtime
  FROM cells LEFT JOIN results USING (model, scenario, task, eval_type))"""

_INPUTS = f"""{_PAIRS},
gold AS (SELECT task, idx, gold_workflow FROM pairs),
pred AS (
  SELECT model, scenario, task, idx + CASE WHEN o % 89 = 0 THEN 524288 ELSE 0 END AS idx,
    CASE WHEN o % 97 <> 0 THEN pred_workflow END AS pred_workflow
  FROM pairs)"""

# The pairs of the newest stored runs: where model-b has a later run, its even orders.
_LATEST_PAIRS = _PAIRS.replace("\npairs AS (", "\nall_pairs AS (") + """,
pairs AS (
  SELECT * FROM all_pairs QUALIFY model <> 'model-b' OR o % 2 = 0
    OR NOT bool_or(o % 2 = 0) OVER (PARTITION BY model, scenario, task))"""

# --- runs and fingerprints --------------------------------------------------

_RUNS = f"""
runs AS (
  SELECT event_id, model, task, scenario, stamp,
    'predictions/' || model || '/' || task || '/graph_eval_' || scenario
      || coalesce('_' || stamp, '') || '.json' AS path
  FROM (SELECT event_id, {pick(MODELS, 'user_id')} AS model, {pick(TASKS, 'event_id')} AS task,
      CASE event_type WHEN 'click' THEN 'rag' WHEN 'signup' THEN 'sft'
        WHEN 'purchase' THEN 'sft_rag' ELSE 'i0' END AS scenario,
      CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y%m%d_%H%M%S') END AS stamp
    FROM events))"""


def _fingerprint(table: str, columns: list[str], name: str) -> str:
    marked = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, 'n')" for c in columns)
    slice_of = "CAST('0x' || substr(d, {}, 8) AS BIGINT)"
    slices = " || ',' || ".join(
        f"CAST(coalesce({f}({slice_of.format(1 + 8 * i)}), 0) AS VARCHAR)"
        for i in range(8) for f in ("bit_xor", "sum")
    )
    return f"""{name} AS (
  SELECT sha256({slices}) AS fingerprint, count(*) AS n_rows
  FROM (SELECT sha256({marked}) AS d FROM {table}))"""


_TURNS = ["conv_id", "turn", "role", "text"]
_NOW = _fingerprint("conversations", _TURNS, "now")
_CHANGED = _fingerprint(
    "(SELECT conv_id, turn, role, text || '!' AS text FROM conversations)", _TURNS, "changed"
)


def _topk(exclude: str = "TRUE") -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e),
s AS (
  SELECT q.vec_id, m.vec_id AS record_id,
    round(list_dot_product(q.v, m.v) / (m.norm * q.norm + 1e-9), 12) AS score
  FROM n q, n m WHERE {exclude}),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, record_id) AS rank FROM s)
SELECT vec_id, rank, record_id, round(score, 6) AS score FROM r WHERE rank <= 5"""


_NOT_BARRED = "m.vec_id NOT IN (q.vec_id, q.vec_id + 1)"

_ECHO = f"""{_PARTS},
echoed AS (
  SELECT conv_id,
    CASE WHEN length("user") % 7 = 0 THEN '' WHEN length("user") % 7 = 1 THEN ''
      ELSE {strip("'model-a: ' || \"user\"")} END AS workflow,
    CASE WHEN length("user") % 7 = 0 THEN 'ValueError: unlucky length'
      WHEN length("user") % 7 = 1 THEN 'RuntimeError: empty answer' END AS error
  FROM parts)"""

ORACLES: dict[str, str] = {
    "scan_train": f"""WITH {_ITEMS}
SELECT row_number() OVER (ORDER BY doc_id // {SHARD_ITEMS}, doc_id) - 1 AS idx,
  id, source, task_type, n_messages, text_md5 FROM items""",
    "scan_gold_tasks": f"""WITH {_ITEMS}
SELECT {pick(TASKS, 'doc_id')} AS task,
  row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1 AS idx,
  id, source, task_type, n_messages, text_md5 FROM items""",
    "task_counts": f"""SELECT {pick(TASKS, 'doc_id')} AS task, count(*) AS n_items
FROM documents GROUP BY 1 UNION ALL SELECT 'nothing', 0""",
    "predictions_roundtrip": f"""WITH {_PAIRS}
SELECT model, scenario, task, stamp, idx, md5(pred_workflow) AS workflow_md5,
  CASE WHEN pred_workflow = '' THEN 'RuntimeError: empty answer' END AS error FROM pairs""",
    "predictions_rerun": f"""WITH {_PAIRS}
SELECT model, scenario, task, stamp, idx, md5(pred_workflow) AS workflow_md5,
  CASE WHEN pred_workflow = '' THEN 'RuntimeError: empty answer' END AS error FROM pairs""",
    "predictions_export": f"""WITH {_ITEMS}, answers AS (
  SELECT *, {pick(MODELS, 'doc_id // 7')} AS model, {pick(TASKS, 'doc_id')} AS task FROM items)
SELECT model, 'rag' AS scenario, task, CASE WHEN doc_id // 7 % 3 < 2 THEN '{STAMP}' END AS stamp,
  row_number() OVER (PARTITION BY model, task ORDER BY doc_id) - 1 AS idx, id AS query_id, source AS query_source,
  CASE WHEN doc_id % 10 > 0 THEN '\\"{{' || doc_id ELSE '' END AS workflow FROM answers""",
    "scan_prediction_files": f"""WITH {_PAIRS}
SELECT model, scenario, task, stamp,
  row_number() OVER (PARTITION BY model, scenario, task, stamp ORDER BY idx) - 1 AS idx,
  CAST(idx AS VARCHAR) AS query_id, md5(pred_workflow) AS workflow_md5 FROM pairs""",
    "latest_predictions": f"""WITH {_PAIRS}, stored AS (
  SELECT model, scenario, task, stamp, idx, pred_workflow AS w FROM pairs
  UNION ALL SELECT model, scenario, task, '{OLD_STAMP}', idx, 'old ' || pred_workflow FROM pairs WHERE task <> 'os'
  UNION ALL SELECT model, scenario, task, '{NEW_STAMP}', idx, pred_workflow FROM pairs
    WHERE model = 'model-b' AND o % 2 = 0)
SELECT model, scenario, task, stamp, idx, md5(w) AS workflow_md5 FROM stored
QUALIFY stamp = max(stamp) OVER (PARTITION BY model, scenario, task)""",
    "eval_results_roundtrip": f"""WITH RECURSIVE {_RESULTS} SELECT *, '{STAMP}' AS stamp FROM results""",
    "eval_latest": f"WITH RECURSIVE {_MATRIX.replace(_PAIRS, _LATEST_PAIRS)} SELECT * FROM matrix",
    "scenario_from_path": f"""WITH {_RUNS}
SELECT event_id, path, CASE WHEN stamp IS NOT NULL THEN scenario END AS scenario, stamp FROM runs""",
    "latest_run": f"""WITH {_RUNS}
SELECT DISTINCT model, task, scenario, stamp, path FROM (
  SELECT *, row_number() OVER (PARTITION BY model, task, scenario
    ORDER BY stamp DESC NULLS LAST) AS rn FROM runs) WHERE rn = 1""",
    "index_roundtrip": f"""WITH {_NOW}, {_CORPUS},
src AS (SELECT id AS key, text FROM corpus), {_EMBED}
SELECT id, index, source, md5(text) AS text_md5, md5(workflow) AS workflow_md5,
  CAST(64 AS BIGINT) AS dim,
  CAST(norm IS NOT NULL AS DOUBLE) AS norm,
  'hashing-md5-64' AS embedding_model, CAST(2 AS BIGINT) AS top_k,
  count(*) OVER () AS num_vectors, fingerprint
FROM corpus LEFT JOIN norms ON key = id CROSS JOIN now""",
    "index_refresh": f"""WITH {_CORPUS},
now AS (SELECT text, text || CASE WHEN index % 100 = 7 THEN ' revised' ELSE '' END AS later FROM corpus),
seen AS (
  SELECT count(*) AS n, count(DISTINCT text) AS n_old, count(DISTINCT later) AS n_new,
    count(DISTINCT later) FILTER (later NOT IN (SELECT text FROM now)) AS n_fresh,
    count(*) FILTER (text LIKE '% revised') AS old_revised, count(*) FILTER (later LIKE '% revised') AS new_revised
  FROM now)
SELECT CAST(1 AS BIGINT) AS version, n AS num_vectors, n_old AS n_texts, n_old AS n_embedded, n AS n_right,
  old_revised AS n_revised FROM seen
UNION ALL SELECT 2, n, n_new, n_fresh, n, new_revised FROM seen
UNION ALL SELECT 3, n, n_new, 0, n, new_revised FROM seen""",
    "corpus_fingerprint": f"""WITH {_fingerprint('documents', ['doc_id', 'text', 'lang', 'source'], 'f')}
SELECT * FROM f""",
    "index_staleness": f"""WITH {_NOW}, {_CHANGED}
SELECT 'same' AS "case", FALSE AS is_stale, 'fresh' AS reason, fingerprint FROM now
UNION ALL SELECT 'changed', TRUE, 'train set changed', fingerprint FROM changed
UNION ALL SELECT 'encoder', TRUE, 'embedding model changed', fingerprint FROM now
UNION ALL SELECT 'forced', TRUE, 'forced', fingerprint FROM now
UNION ALL SELECT 'absent', TRUE, 'absent', fingerprint FROM now""",
    "sft_sink": f"""WITH {_FIT}
SELECT md5(string_agg(role || ': ' || text, E'\\n' ORDER BY turn)) AS text_md5,
  count(*) AS n_messages FROM kept GROUP BY conv_id""",
    "sft_reload": r"""SELECT doc_id, CAST(3 AS BIGINT) AS n_messages,
  md5(E'system: \nuser: ' || split_part(text, E'\n', 1) || E'\nassistant: ' || text) AS text_md5
FROM documents WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0""",
    "run_metadata": f"""WITH {_PAIRS},
per AS (
  SELECT model, scenario, stamp, task, count(*) FILTER (pred_workflow = '') AS bad
  FROM pairs GROUP BY ALL)
SELECT model, stamp, '2025-03-14T09:26:53+00:00' AS started_at,
  '2025-03-14T10:41:00+00:00' AS finished_at,
  scenario IN ('sft', 'sft_rag') AS finetuned, scenario IN ('rag', 'sft_rag') AS rag,
  CAST(NULL AS BIGINT) AS "limit",
  string_agg(task, ',' ORDER BY task) AS tasks,
  CAST(sum(bad) AS BIGINT) AS n_skipped,
  coalesce(string_agg(task, ',' ORDER BY task) FILTER (bad > 0), '') AS skipped_tasks,
  string_agg('predictions/' || model || '/' || scenario || '/' || task || '/' || stamp, ','
    ORDER BY task) AS predictions
FROM per GROUP BY model, scenario, stamp""",
    "conv_assemble": """SELECT conv_id, turn,
  CASE WHEN conv_id % 4 < 2 AND role = 'user' THEN 'human'
       WHEN conv_id % 4 < 2 AND role = 'assistant' THEN 'gpt' ELSE role END AS role,
  text AS content FROM conversations""",
    "role_normalize": f"""WITH {_ALIAS}
SELECT conv_id, turn, content, CASE WHEN role IS NULL OR role = 'human' THEN 'user'
  WHEN role = 'gpt' THEN 'assistant' ELSE role END AS role FROM t""",
    "last_user": _last("role IN ('user', 'human')", "max_by", "user"),
    "last_assistant": _last("role IN ('assistant', 'gpt')", "max_by", "assistant"),
    "system_message": _last("role = 'system'", "min_by", "system"),
    "gold_workflow": _last("TRUE", "max_by", "gold_workflow"),
    "example_text": f"""WITH {_PARTS}
SELECT conv_id, {strip('''concat_ws(E'\\n', nullif(assistant, ''), nullif("user", ''))''')} AS text,
  {strip('"user"')} AS query_text FROM parts""",
    "rag_corpus": f"WITH {_CORPUS} SELECT * FROM corpus",
    "rag_corpus_legacy": f"""WITH {_PARTS}, {_HEADERS}
SELECT coalesce(id, CAST(conv_id AS VARCHAR)) AS id, conv_id AS index, "user",
  assistant AS workflow, coalesce(task_type, source) AS task_type
FROM parts JOIN headers USING (conv_id)
WHERE {strip('"user"')} <> '' AND assistant <> ''""",
    "limit_per_task": f"""SELECT DISTINCT conv_id, {pick(TASKS, 'conv_id')} AS task, conv_id // 7 AS idx
FROM conversations WHERE conv_id // 7 < 5""",
    "hash_embed": f"""WITH src AS (SELECT doc_id AS key, text FROM documents), {_EMBED}
SELECT key AS doc_id, CAST(dim AS BIGINT) AS dim, round(n / norm, 6) AS weight
FROM counts JOIN norms USING (key)""",
    "topk_cosine": _topk(),
    "topk_exclude": _topk(_NOT_BARRED),
    "topk_scan_corpus": _topk(),
    "topk_blocked": _topk(_NOT_BARRED),
    "fewshot_block": f"WITH {blocks(chr(92) + 'n')} SELECT conv_id, block, n_examples FROM blocks",
    "prompt_base": f"""WITH {_PARTS}
SELECT conv_id, 'system' AS role_1, system AS content_1, 'user' AS role_2, "user" AS content_2 FROM parts""",
    "prompt_rag": _prompt(f"\\n\\n{X.RAG_HEADER}\\n\\n", "\\n"),
    "prompt_joined": _prompt(f"\\n\\n{X.JOINED_HEADER}\\n", "\\n\\n"),
    "prompt_inject": f"""WITH {blocks(chr(92) + 'n')},
first_user AS (
  SELECT conv_id, min(turn) FILTER (role = 'user') AS first_at FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN turn >= first_at THEN turn + 1 ELSE turn END AS turn, role, text AS content
FROM conversations JOIN first_user USING (conv_id)
UNION ALL
SELECT conv_id, first_at, 'system', E'{X.INJECT_HEADER}\\n\\n' || coalesce(block, '')
FROM first_user LEFT JOIN blocks USING (conv_id) WHERE first_at IS NOT NULL""",
    "plain_text": """SELECT conv_id, turn,
  CAST(sum(length(role) + length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn)
    - (length(role) + length(text) + 3) AS BIGINT) AS start,
  role || ': ' || text AS line FROM conversations""",
    "token_estimate": """SELECT conv_id, length(s) AS n_chars, n_turns, greatest(1, length(s) // 4) AS tokens
FROM (SELECT conv_id, string_agg(role || ': ' || text, E'\\n' ORDER BY turn) AS s,
  count(*) AS n_turns FROM conversations GROUP BY conv_id)""",
    "budget_fit": f"""WITH {_FIT}
SELECT conv_id, n AS n_turns, tag, CAST(gone AS BIGINT) AS n_dropped,
  CAST(before AS BIGINT) AS tokens_before,
  CAST(CASE WHEN tag = 'full' THEN before WHEN tag LIKE 'drop\\_%' ESCAPE '\\' THEN tokens END AS BIGINT) AS tokens_after
FROM fitted""",
    "budget_messages": f"""WITH {_FIT}
SELECT conv_id, tag, turn, role, text AS content FROM kept""",
    "budget_outcomes": f"WITH {_FIT} SELECT tag, count(*) AS n FROM fitted GROUP BY tag",
    "budget_stats": f"""WITH {_FIT}
SELECT count(*) AS total,
  count(*) FILTER (tag NOT IN ('dropped', 'malformed')) AS kept,
  count(*) FILTER (tag IN ('dropped', 'malformed')) AS dropped,
  count(*) FILTER (starts_with(tag, 'drop_')) AS truncated,
  count(*) FILTER (tag = 'full') AS "full", CAST({BUDGET} AS BIGINT) AS max_tokens,
  (SELECT string_agg(tag || '=' || n, ',' ORDER BY tag)
   FROM (SELECT tag, count(*) AS n FROM fitted GROUP BY tag)) AS outcomes,
  'chars/4' AS tokenizer,
  round(100.0 * count(*) FILTER (tag IN ('dropped', 'malformed')) / greatest(count(*), 1), 6) AS drop_pct
FROM fitted""",
    "sft_dataset": f"""WITH {_FIT.replace('FROM conversations', '''FROM (SELECT conv_id, turn, text,
  CASE WHEN role IN ('user', 'human') THEN 'user' WHEN role IN ('assistant', 'gpt') THEN 'assistant'
  ELSE role END AS role FROM conversations)''')}
SELECT conv_id, tag, count(*) AS n_messages,
  string_agg(role || ': ' || text, E'\\n' ORDER BY turn) AS text FROM kept GROUP BY ALL""",
    "sft_dataset_tokenizer": f"""WITH {_FIT_WORDS.replace('FROM conversations', '''FROM (SELECT conv_id, turn, text,
  CASE WHEN role IN ('user', 'human') THEN 'user' WHEN role IN ('assistant', 'gpt') THEN 'assistant'
  ELSE role END AS role FROM conversations)''')}
SELECT conv_id, tag, count(*) AS n_messages,
  string_agg(role || ': ' || text, E'\\n' ORDER BY turn) AS text FROM kept GROUP BY ALL""",
    "masked_examples": f"""WITH {_EXAMPLES}
SELECT conv_id, reason,
  CASE WHEN reason = 'kept' THEN len(ids) END AS n_ids,
  CASE WHEN reason = 'kept' THEN array_to_string(ids, ',') END AS input_ids,
  CASE WHEN reason = 'kept' THEN array_to_string(list_transform(ids, lambda x: 1), ',') END AS attention_mask,
  CASE WHEN reason = 'kept' THEN array_to_string({_LABELS}, ',') END AS labels
FROM ex""",
    "masked_examples_once": f"""WITH {_EXAMPLES}
SELECT conv_id, reason,
  CASE WHEN reason = 'kept' THEN len(ids) END AS n_ids,
  CASE WHEN reason = 'kept' THEN array_to_string(ids, ',') END AS input_ids,
  CASE WHEN reason = 'kept' THEN array_to_string(list_transform(ids, lambda x: 1), ',') END AS attention_mask,
  CASE WHEN reason = 'kept' THEN array_to_string({_LABELS}, ',') END AS labels
FROM ex""",
    "mask_report": f"""WITH {_EXAMPLES}
SELECT count(*) AS n_total, count(*) FILTER (reason = 'kept') AS n_kept,
  count(*) FILTER (reason <> 'kept') AS n_skipped,
  count(*) FILTER (reason = 'no_answer') AS n_no_answer,
  count(*) FILTER (reason = 'empty') AS n_empty,
  count(*) FILTER (reason = 'no_label') AS n_no_label FROM ex""",
    "pad_examples": f"""WITH {_EXAMPLES}
SELECT conv_id, len({_padded('ids', '0')}) AS n_ids,
  array_to_string({_padded('ids', '0')}, ',') AS input_ids,
  array_to_string({_padded('list_transform(ids, lambda x: 1)', '0')}, ',') AS attention_mask,
  array_to_string({_padded(_LABELS, '-100')}, ',') AS labels
FROM ex WHERE reason = 'kept'""",
    "predict_nn_copy": f"""WITH {_HITS}
SELECT h.conv_id, {strip("coalesce(c.workflow, '')")} AS workflow,
  CASE WHEN {strip("coalesce(c.workflow, '')")} = '' THEN 'RuntimeError: empty answer' END AS error
FROM headers h LEFT JOIN hits ON hits.conv_id = h.conv_id AND rank = 1
LEFT JOIN corpus c ON c.id = record_id""",
    "predict_fail_isolated": f"WITH {_ECHO} SELECT * FROM echoed",
    "predict_resume": f"""WITH {_ECHO},
asked AS (
  SELECT conv_id, workflow, error, CASE WHEN bool_or(conv_id % 2 = 0) OVER (PARTITION BY system, "user")
    THEN 'first' ELSE 'second' END AS run, md5(system) || md5("user") AS prompt
  FROM echoed JOIN parts USING (conv_id)),
made AS (SELECT run, count(DISTINCT prompt) AS n_made FROM asked GROUP BY run)
SELECT conv_id, workflow, error, run, n_made FROM asked JOIN made USING (run)""",
    "skip_counts": f"""WITH {_ECHO}
SELECT {pick(TASKS, 'conv_id')} AS task, count(*) AS n_skipped
FROM echoed WHERE error IS NOT NULL GROUP BY 1""",
    "workflow_nodes": f"WITH {_PAIRS}, {_nodes_of('pred')} SELECT task, idx, pos, no, label FROM pred_n",
    "workflow_edges": f"""WITH {_PAIRS}, {_nodes_of('pred')}, {_edges_of('pred')},
known AS (
  SELECT task, idx, list(CAST(no AS VARCHAR)) AS nos FROM pred_n GROUP BY ALL)
SELECT e.task, e.idx, pos, src, dst, src = dst AS is_self_loop,
  (src IN ('START', 'END') OR coalesce(list_contains(nos, src), FALSE))
  AND (dst IN ('START', 'END') OR coalesce(list_contains(nos, dst), FALSE)) AS ends_known
FROM pred_e e LEFT JOIN known USING (task, idx)""",
    "node_match": f"WITH {_MATCH} SELECT task, idx, pred_pos, gold_pos FROM matches",
    "chain_score": f"WITH RECURSIVE {_CHAIN} {_SCORE_SELECT}",
    "chain_score_any_order": f"WITH RECURSIVE {_CHAIN} {_SCORE_SELECT}",
    "branching_edges": f"""WITH {_BRANCHING}, {_nodes_of('pred')}, {_edges_of('pred')},
known AS (SELECT task, idx, list(CAST(no AS VARCHAR)) AS nos FROM pred_n GROUP BY ALL)
SELECT e.task, e.idx, pos, src, dst, src = dst AS is_self_loop,
  (src = 'START' OR coalesce(list_contains(nos, src), FALSE))
  AND (dst = 'END' OR coalesce(list_contains(nos, dst), FALSE)) AS ends_known
FROM pred_e e LEFT JOIN known USING (task, idx)""",
    "branching_levels": f"""WITH RECURSIVE {_LEVELS}
SELECT w.task, w.idx, pos, CASE WHEN c.idx IS NULL THEN CAST(max(len) AS BIGINT) END AS level,
  c.idx IS NOT NULL AS is_cyclic
FROM walks w LEFT JOIN cyclic c USING (task, idx) GROUP BY w.task, w.idx, pos, c.idx""",
    "branching_chain": f"""WITH RECURSIVE {_ANY_ORDER} {_SCORE_SELECT.replace('FROM scored', ', listed_f1 FROM scored JOIN listed USING (task, idx)')}""",
    "branching_graph": f"WITH {_GRAPH_FOUND.replace(_PAIRS, _BRANCHING)} {_SCORE_SELECT}",
    "edge_overlap": f"WITH {_SHARED} {_SCORE_SELECT}",
    "graph_score": f"WITH {_GRAPH_FOUND} {_SCORE_SELECT}",
    "eval_status": f"WITH {_MATCH} SELECT task, idx, status FROM sizes",
    "eval_aggregate": f"WITH RECURSIVE {_RESULTS} SELECT * FROM results",
    "eval_matrix": f"WITH RECURSIVE {_MATRIX} SELECT * FROM matrix",
    "eval_result_files": f"WITH RECURSIVE {_MATRIX} SELECT * FROM matrix",
    "eval_matrix_pivot": f"""WITH RECURSIVE {_MATRIX}
SELECT model, task, eval_type, {', '.join(f"max(f1_score) FILTER (scenario = '{s}') AS {s}" for s in SCENARIO_IDS)}
FROM matrix GROUP BY ALL""",
    "validate_inputs": f"""WITH {_INPUTS},
ng AS (SELECT task, count(DISTINCT idx) AS n_gold, count(*) - count(DISTINCT idx) AS duplicate_gold FROM gold GROUP BY task),
given AS (
  SELECT model, scenario, task, idx, pred_workflow AS w FROM pred
  UNION ALL SELECT 'model-full', 'i0', CASE WHEN task = 'os' THEN 'untold' ELSE task END, idx, gold_workflow FROM gold
  UNION ALL SELECT 'model-twice', 'i0', task, idx, gold_workflow FROM gold
  UNION ALL SELECT 'model-twice', 'i0', task, idx, gold_workflow FROM gold WHERE (idx // 1048576) % 97 = 0),
r AS (
  SELECT model, scenario, p.task, count(*) AS n_pred, count(*) FILTER (w IS NULL) AS null_workflow,
    count(DISTINCT p.idx) FILTER (g.idx IS NOT NULL) AS found,
    count(DISTINCT p.idx) FILTER (g.idx IS NULL) AS extra_pred,
    count(*) - count(DISTINCT p.idx) AS duplicate_pred
  FROM given p LEFT JOIN gold g ON g.task = p.task AND g.idx = p.idx GROUP BY ALL
  UNION ALL SELECT 'model-none', 'i0', task, 0, 0, 0, 0, 0 FROM ng),
c AS (
  SELECT r.*, coalesce(n_gold, 0) AS n_gold, coalesce(duplicate_gold, 0) AS duplicate_gold,
    coalesce(n_gold, 0) - found AS missing_pred
  FROM r LEFT JOIN ng USING (task))
SELECT model, scenario, task, n_gold, n_pred, missing_pred, extra_pred, duplicate_gold, duplicate_pred, null_workflow,
  CASE WHEN n_gold = 0 THEN 'missing_gold' WHEN n_pred = 0 THEN 'missing_run'
    WHEN null_workflow > 0 THEN 'missing_workflow' WHEN missing_pred > 0 OR extra_pred > 0 THEN 'count_mismatch'
    WHEN duplicate_gold > 0 OR duplicate_pred > 0 THEN 'duplicates' ELSE 'ok' END AS status
FROM c""",
    "pair_gold_pred": f"""WITH {_INPUTS}
SELECT model, scenario, task, idx, md5(gold_workflow) AS gold_md5, md5(pred_workflow) AS pred_md5
FROM gold JOIN pred USING (task, idx)""",
    "scenario_name": f"""WITH {_RUNS}
SELECT event_id, scenario, scenario IN ('rag', 'sft_rag') AS use_rag,
  scenario IN ('sft', 'sft_rag') AS use_sft_checkpoint FROM runs""",
}
