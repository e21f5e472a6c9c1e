"""SQL (DuckDB dialect) that each query must agree with, over the same tables."""

from __future__ import annotations

from vigilog.functions import prompts
from vigilog.functions.text import WHITESPACE
from vigilog.operators.sinks import HEAVY_RULE, LIGHT_RULE
from workload.models import CONTEXT_RULES, FAILS_ON, TEXT_RULES
from workload.queries import DIVERSE_SIZE, DOCS_PER_FILE, HEAD_LINES, K, NPROBE, OVERSAMPLE
from workload.tables import PIVOTS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = "||".join(f"chr({ord(c)})" for c in WHITESPACE)


def strip(column: str) -> str:
    return f"trim({column}, {SPACES})"


def key(id_col: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {id_col})"


DOCS = """docs AS (
  SELECT d.doc_id, d.text AS log_message, d.source, d.lang,
         CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low' WHEN d.lang = 'fr' THEN 'dirb' WHEN d.lang = 'es' THEN 'dns_scan'
         ELSE 'normal_log' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LINES = """lines AS (
  SELECT doc_id, source, unnest(parts) AS value, generate_subscripts(parts, 1) AS line_no
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))"""
SPLIT = f"""docs_split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {key('doc_id')}, doc_id) <= ceil(0.2::DOUBLE * count(*) OVER ())
            THEN 'eval' ELSE 'train' END AS split
  FROM docs)"""


def clean(cap: int | None, extra: str = "") -> str:
    limit = "" if cap is None else f"AND line_no <= {cap}"
    return f"clean AS (SELECT * REPLACE ({strip('value')} AS value) FROM {extra or 'lines'} WHERE regexp_matches(value, '[A-Za-z0-9]') {limit})"


# --- vectors -------------------------------------------------------------------------------------

ENTRIES = """tok AS (
  SELECT doc_id, unnest([t FOR t IN string_split_regex(lower(log_message), '[^a-z0-9]+') IF t <> '']) AS t FROM docs),
entries AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 384 AS b, count(*) AS c FROM tok GROUP BY 1, 2),
unit AS (SELECT doc_id, b, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE AS w FROM entries),
embedded AS (SELECT DISTINCT doc_id FROM unit)"""

EMB = f"""numbered AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding::DOUBLE[] AS e,
         row_number() OVER (ORDER BY {key('vec_id')}, vec_id) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS held
  FROM embeddings),
normed AS (SELECT *, sqrt(list_sum([t * t FOR t IN e])) AS norm FROM numbered),
units AS (SELECT vec_id, label, held, [CAST(t / norm AS FLOAT) FOR t IN e]::DOUBLE[] AS v FROM normed WHERE norm > 0),
q AS (SELECT vec_id AS qid, label, v FROM units WHERE held),
x AS (SELECT vec_id AS doc_id, label, v FROM units WHERE NOT held),
scores AS (
  SELECT q.qid, x.doc_id, x.label, round((1 + list_dot_product(q.v, x.v)) / 2, 6) AS score FROM q CROSS JOIN x)"""

CELLS = f"""p AS (
  SELECT row_number() OVER (ORDER BY {key('doc_id')}, doc_id) AS cell, v FROM x
  QUALIFY row_number() OVER (ORDER BY {key('doc_id')}, doc_id) <= {PIVOTS}),
placed AS (
  SELECT doc_id, cell FROM (SELECT x.doc_id, p.cell, round((1 + list_dot_product(x.v, p.v)) / 2, 6) AS s FROM x CROSS JOIN p)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, cell) = 1),
visits AS (
  SELECT qid, cell FROM (
    SELECT q.qid, p.cell, round((1 + list_dot_product(q.v, p.v)) / 2, 6) AS s FROM q CROSS JOIN p
    WHERE p.cell IN (SELECT cell FROM placed))
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, cell) <= {NPROBE})"""


def top(scores: str, k: int, name: str = "hits") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT qid, doc_id, label, score,
    row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS hit_rank FROM {scores}) WHERE hit_rank <= {k})"""


def shorter(term: str) -> str:
    return (
        f"CASE WHEN contains({term}, '-') THEN string_split({term}, '-')[2] "
        f"WHEN contains({term}, '_') THEN string_split({term}, '_')[2] END"
    )


TERM_LIST = "[t FOR t IN string_split_regex(lower(source), '[^a-z0-9_]+') IF t <> '']"


def scoped_hits(index: str, queries: str, tag: str = "", relax: bool = True, k: int = K) -> str:
    """Hits of ``queries`` (doc_id, source) in ``index`` (doc_id, source, label), both embedded."""
    known = f"(SELECT term FROM terms{tag})"
    scope = (
        f"CASE WHEN s0 IN {known} THEN s0 WHEN s1 IN {known} THEN s1 WHEN s2 IN {known} THEN s2 ELSE '*' END"
        if relax
        else "coalesce(s0, '*')"
    )
    return f"""terms{tag} AS (SELECT DISTINCT doc_id, unnest({TERM_LIST}) AS term FROM {index}),
chain1{tag} AS (SELECT doc_id, source AS s0, {shorter('source')} AS s1 FROM {queries}),
chain2{tag} AS (SELECT *, {shorter('s1')} AS s2 FROM chain1{tag}),
asked{tag} AS (SELECT doc_id AS qid, {scope} AS scope FROM chain2{tag}),
pairs{tag} AS (
  SELECT a.qid, i.doc_id FROM asked{tag} a CROSS JOIN {index} i WHERE a.scope = '*'
  UNION ALL SELECT a.qid, t.doc_id FROM asked{tag} a JOIN terms{tag} t ON a.scope = t.term),
dots{tag} AS (
  SELECT a.doc_id AS qid, b.doc_id, sum(a.w * b.w) AS dot
  FROM unit a JOIN unit b ON a.b = b.b
  WHERE a.doc_id IN (SELECT doc_id FROM {queries}) AND b.doc_id IN (SELECT doc_id FROM {index})
  GROUP BY 1, 2),
scores{tag} AS (
  SELECT p.qid, p.doc_id, i.label, round((1 + coalesce(d.dot, 0)) / 2, 6) AS score
  FROM pairs{tag} p JOIN {index} i ON p.doc_id = i.doc_id LEFT JOIN dots{tag} d ON d.qid = p.qid AND d.doc_id = p.doc_id),
{top(f'scores{tag}', k, f'hits{tag}')}"""


def doc_hits(asked: str = "source", indexed: str = "source", relax: bool = True, k: int = K) -> str:
    return f"""{DOCS}, {SPLIT}, {ENTRIES},
queries AS (SELECT doc_id, log_message, label, {asked} AS source FROM docs_split WHERE split = 'eval'),
embedded_queries AS (SELECT * FROM queries WHERE doc_id IN (SELECT doc_id FROM embedded)),
idx AS (SELECT doc_id, log_message, label, {indexed} AS source FROM docs_split
        WHERE split = 'train' AND doc_id IN (SELECT doc_id FROM embedded)),
{scoped_hits('idx', 'embedded_queries', '', relax, k)}"""


def votes(hits: str = "hits", tag: str = "", by: str = "qid") -> str:
    return f"""votes{tag} AS (
  SELECT {by}, label, round(sum(score), 6) AS votes, min(hit_rank) AS first_rank FROM {hits} GROUP BY ALL),
win{tag} AS (
  SELECT {by}, label AS predicted FROM votes{tag}
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY votes DESC, first_rank) = 1)"""


def report(scored: str, by: str = "", tag: str = "") -> str:
    """Per-class and overall report of ``scored`` (<by>, label, predicted)."""
    own = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""conf{tag} AS (
  SELECT {own}label, predicted, count(*) AS n FROM {scored}
  WHERE label IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL),
sides{tag} AS (
  SELECT {own}label, CASE WHEN label = predicted THEN n ELSE 0 END AS tp, 0 AS p, n AS s FROM conf{tag}
  UNION ALL SELECT {own}predicted, 0, n, 0 FROM conf{tag}),
sums{tag} AS (
  SELECT {own}label, sum(tp)::BIGINT AS tp, sum(p)::BIGINT AS p, sum(s)::BIGINT AS support FROM sides{tag} GROUP BY ALL),
rated{tag} AS (
  SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp::DOUBLE / p END AS precision,
            CASE WHEN support = 0 THEN 0 ELSE tp::DOUBLE / support END AS recall FROM sums{tag}),
rep{tag} AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rated{tag}),
overall{tag} AS (
  SELECT {own}sum(tp)::DOUBLE / sum(support) AS accuracy,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS support
  FROM rep{tag} {group})"""


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


REPORT_OUT = f"SELECT label, {r6('precision', 'recall', 'f1')}, support FROM rep"
HITS_OUT = "SELECT qid, doc_id, label, score, hit_rank FROM hits"
EMB_HITS = f"WITH {EMB}, {top('scores', K)}"
EMB_SCORED = f"{EMB_HITS}, {votes()}, scored AS (SELECT q.qid, q.label, w.predicted FROM q JOIN win w ON q.qid = w.qid)"
KNN_SCORED = (
    f"{doc_hits()}, {votes()}, knn_scored AS "
    "(SELECT q.doc_id AS qid, q.log_message, q.label, w.predicted FROM queries q LEFT JOIN win w ON q.doc_id = w.qid)"
)


def rules(text: str, pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {lit(w)}) THEN {lit(l)}" for w, l in pairs) + " ELSE 'normal_log' END"


MESSAGE = f"{lit(prompts.INDENT + 'source: ')} || source || ' ,log message: \"' || log_message || {lit(chr(34) + chr(10) + prompts.INDENT)}"
DIRECT_USER = f"{lit(chr(10))} || {MESSAGE}"
CONTEXT = """ctx AS (
  SELECT h.qid, to_json(list({'log': i.log_message, 'label': h.label, 'score': h.score} ORDER BY h.hit_rank))::VARCHAR AS context
  FROM hits h JOIN idx i ON h.doc_id = i.doc_id GROUP BY h.qid),
prompted AS (SELECT q.*, coalesce(c.context, '[]') AS context FROM queries q LEFT JOIN ctx c ON q.doc_id = c.qid)"""
CONTEXT_USER = (
    f"{lit('Context logs:' + chr(10) + prompts.INDENT)} || context || "
    f"{lit(chr(10) * 2 + prompts.INDENT + 'Classify:' + chr(10))} || {MESSAGE}"
)
MODEL_SCORED = f"model_scored AS (SELECT doc_id AS qid, label, CASE WHEN NOT contains({DIRECT_USER}, {lit(FAILS_ON)}) THEN {rules(DIRECT_USER, TEXT_RULES)} END AS predicted FROM docs_split WHERE split = 'eval')"
CONTEXT_SCORED = f"{CONTEXT}, context_scored AS (SELECT doc_id AS qid, label, {rules(CONTEXT_USER, CONTEXT_RULES)} AS predicted FROM prompted)"
THREE = f"""WITH {KNN_SCORED}, {MODEL_SCORED}, {CONTEXT_SCORED}, all_scored AS (
  SELECT 'knn' AS model, label, predicted FROM knn_scored
  UNION ALL SELECT 'model', label, predicted FROM model_scored
  UNION ALL SELECT 'model_context', label, predicted FROM context_scored), {report('all_scored', 'model')}"""

ALERT_LINES = """alert_lines AS (
  SELECT event_id, event_type, props, value < 1 AS bad, (props::JSON->>'k')::BIGINT AS k,
    '{"event_id": ' || event_id || ', "type": "' || event_type || '", "props": ' || props
      || CASE WHEN value < 1 THEN '' ELSE '}' END AS value
  FROM events)"""
ALERT_STATUS = """alert_status AS (
  SELECT *, CASE WHEN event_type IN ('error', 'click') THEN 'success'
    WHEN event_type IN ('view', 'purchase') THEN 'validation_error'
    WHEN k < 25 THEN 'api_error' WHEN k < 50 THEN 'json_error' WHEN k < 75 THEN 'format_error'
    ELSE 'processing_error' END AS status,
    CASE event_type WHEN 'error' THEN 'DoS Attack' WHEN 'click' THEN 'Benign' END AS predicted,
    CASE event_type WHEN 'error' THEN 0.9::DOUBLE WHEN 'click' THEN 0.75::DOUBLE END AS confidence
  FROM alert_lines WHERE NOT bad)"""

STATUS = """replies AS (
  SELECT event_id, event_type, value AS seconds, substr(md5(event_id::VARCHAR), 1, 1) AS d FROM events),
read AS (
  SELECT event_id, seconds,
    CASE WHEN d IN ('0', '3', '6', '7') THEN 'processing_error' WHEN d = '1' THEN 'api_error' WHEN d = '2' THEN 'unknown_error'
         WHEN d IN ('4', '5') THEN 'format_error' WHEN d = '8' THEN 'json_error'
         WHEN d IN ('9', 'a', 'd', 'e', 'f') THEN 'validation_error' ELSE 'success' END AS status,
    CASE WHEN d IN ('b', 'c') THEN event_type END AS predicted,
    CASE WHEN d IN ('b', 'c') THEN 'why' END AS explanation
  FROM replies)"""

ORACLES: dict[str, str] = {
    "scan_lines": f"""WITH {LINES}, filed AS (
  SELECT source, doc_id // {DOCS_PER_FILE} AS file_no, value,
    row_number() OVER (PARTITION BY source, doc_id // {DOCS_PER_FILE} ORDER BY doc_id, line_no) AS line_no FROM lines),
{clean(None, 'filed')}
SELECT source, file_no, line_no, value AS log_message FROM clean""",
    "head_lines": f"WITH {LINES}, {clean(HEAD_LINES)} SELECT doc_id, line_no, value FROM clean",
    "letter_filter": f"WITH {LINES} SELECT doc_id, line_no, value FROM lines WHERE regexp_matches(value, '[a-zA-Z]')",
    "sidecar_labels": f"""WITH {LINES}, d AS (
  SELECT doc_id, line_no, substr(md5(doc_id || '|' || line_no), 1, 1) AS h FROM lines)
SELECT doc_id, line_no, CASE WHEN h = '0' THEN 'dup' WHEN h IN ('1', '2', '3') THEN 'service_scan'
  WHEN h = '4' THEN 'dnsteal | attacker' WHEN h IN ('5', '7') THEN '' ELSE 'normal_log' END AS label FROM d""",
    "sidecar_long": f"""WITH {LINES} SELECT doc_id, doc_id * 1000000 + line_no AS line_no,
  CASE WHEN (doc_id * 1000000 + line_no) % 2 = 1 THEN 'dirb' ELSE 'dnsteal' END AS label FROM lines""",
    "log_tree": f"""WITH {LINES}, filed AS (
  SELECT source, replace(value, chr(13), ' ') AS value, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS line_no
  FROM lines WHERE replace(source, 'src', '')::INT % 5 < 3),
{clean(None, 'filed')}
SELECT source, line_no, md5(value) AS message_md5, CASE WHEN line_no % 7 = 0 THEN 'dnsteal' ELSE 'normal_log' END AS label FROM clean""",
    "path_source": """SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS source,
  page_id % 5 <> 0 AND (page_id % 5 = 1 OR contains(url, '/en/') OR contains(url, 'logs')) AND NOT contains(url, 'attacker') AS kept FROM pages""",
    "event_times": """SELECT event_id, CASE event_type
  WHEN 'view' THEN epoch_us(make_timestamp(2022, month(ts), day(ts), hour(ts), minute(ts), floor(second(ts))))
  WHEN 'click' THEN (epoch_us(ts) // 1000000 - 3600) * 1000000
  WHEN 'purchase' THEN (epoch_us(ts) // 1000000) * 1000000 + 250000 END AS epoch_micros FROM events""",
    "csv_dataset": f"""WITH {LINES}, {clean(None)}
SELECT value AS log_message, source, CASE WHEN length(value) > 40 THEN 'normal_log' END AS label FROM clean""",
    "value_counts": f"""WITH {DOCS} SELECT 'label' AS field, label AS value, count(*) AS n FROM docs GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM docs WHERE source IS NOT NULL GROUP BY ALL""",
    "class_counts": f"""WITH {DOCS} SELECT count(*) AS total, count(*) FILTER (label = 'normal_log') AS normal,
  count(*) FILTER (label <> 'normal_log') AS other FROM docs""",
    "distinct_sources": "SELECT DISTINCT source FROM documents",
    "seeded_shuffle": f"SELECT doc_id, {key('doc_id', 73)} AS order_key FROM documents",
    "preview": f"WITH {DOCS} SELECT doc_id, source, label FROM docs ORDER BY doc_id LIMIT 5",
    "random_split": f"WITH {DOCS}, {SPLIT} SELECT doc_id, split FROM docs_split",
    "stratified_split": f"""WITH {DOCS}, sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM docs GROUP BY label),
share AS (SELECT *, total - ceil(0.2::DOUBLE * total)::BIGINT AS train_total FROM sizes),
based AS (SELECT *, floor(n * train_total / total) AS base, round(n * train_total / total - floor(n * train_total / total), 9) AS rest FROM share),
quota AS (SELECT label, n - base
  - CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= train_total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM based)
SELECT d.doc_id, d.label, CASE WHEN row_number() OVER (PARTITION BY d.label ORDER BY {key('d.doc_id')}, d.doc_id) <= quota
  THEN 'eval' ELSE 'train' END AS split FROM docs d JOIN quota USING (label)""",
    "downsample_uniform": f"""WITH {DOCS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label = 'normal_log' ORDER BY {key('doc_id')}, doc_id) AS rn,
    count(*) OVER (PARTITION BY label = 'normal_log') AS n FROM docs)
SELECT doc_id, source, label FROM ranked WHERE label <> 'normal_log' OR rn > floor(0.8::DOUBLE * n)""",
    "downsample_preserve": f"""WITH {DOCS}, normal AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {key('doc_id')}, doc_id) = 1 AS first FROM docs WHERE label = 'normal_log'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY {key('doc_id')}, doc_id) AS rn,
  count(*) OVER () AS n, count(*) FILTER (first) OVER () AS s FROM normal)
SELECT doc_id, source, label FROM ranked WHERE first OR rn <= greatest(floor(n * 0.5::DOUBLE), s) - s
UNION ALL SELECT doc_id, source, label FROM docs WHERE label <> 'normal_log'""",
    "diverse_sample": f"""WITH {DOCS}, marked AS (
  SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY {key('doc_id')}, doc_id) > 1 AS later FROM docs)
SELECT doc_id, source, label FROM marked ORDER BY later, {key('doc_id')}, doc_id LIMIT {DIVERSE_SIZE}""",
    "coverage_missing": f"""WITH {DOCS}, named AS (SELECT * REPLACE (source || '-' || lang AS source) FROM docs), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label = 'normal_log' ORDER BY {key('doc_id')}, doc_id) AS rn,
    count(*) OVER (PARTITION BY label = 'normal_log') AS n FROM named),
sample AS (SELECT * FROM ranked WHERE label <> 'normal_log' OR rn > floor(0.95::DOUBLE * n))
SELECT DISTINCT source, 'any' AS missing FROM named WHERE source NOT IN (SELECT source FROM sample)
UNION ALL SELECT DISTINCT source, 'normal' FROM named WHERE label = 'normal_log'
  AND source NOT IN (SELECT source FROM sample WHERE label = 'normal_log')""",
    "split_files": None,
    "downsample_files": None,
    "knn_recall": f"""WITH {doc_hits()} SELECT count(*) AS queries, sum(least({K}, (SELECT count(*) FROM idx)))::BIGINT AS hits,
  true AS enough FROM embedded_queries""",
    "knn_no_match": f"""WITH {doc_hits("CASE WHEN lang = 'de' THEN '**' ELSE source END", relax=False)}, {votes()}
SELECT q.doc_id AS qid, w.predicted, CASE WHEN w.predicted IS NULL THEN 'no_match' ELSE 'success' END AS status, 'filled' AS index
FROM queries q LEFT JOIN win w ON q.doc_id = w.qid
UNION ALL SELECT doc_id, NULL, 'no_match', 'empty' FROM queries""",
    "ingest_counts": f"""WITH {DOCS} SELECT source, count(*) AS n FROM docs WHERE source IS NOT NULL GROUP BY source""",
    "hash_embed": f"WITH {DOCS}, {ENTRIES} SELECT doc_id, b AS bucket, round(w, 6) AS weight FROM unit",
    "token_counts": f"""WITH {DOCS}, {ENTRIES}, sums AS (SELECT doc_id, sum(c)::BIGINT AS t, count(*) AS b FROM entries GROUP BY 1)
SELECT d.doc_id, coalesce(t, 0) AS n_tokens, coalesce(b, 0) AS n_buckets FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id""",
    "source_terms": f"""WITH named AS (SELECT doc_id, upper(lang) || '-' || source || '_x.log' AS source FROM documents),
c1 AS (SELECT *, {shorter('source')} AS s1 FROM named), c2 AS (SELECT *, {shorter('s1')} AS s2 FROM c1)
SELECT doc_id, array_to_string({TERM_LIST}, ' ') AS tokens, concat_ws(' > ', source, s1, s2, '*') AS chain FROM c2""",
    "knn_exact": f"{EMB_HITS} {HITS_OUT}",
    "knn_ivf": f"""WITH {EMB}, {CELLS}, near AS (
  SELECT s.* FROM scores s JOIN placed d ON s.doc_id = d.doc_id JOIN visits v ON v.qid = s.qid AND v.cell = d.cell),
{top('near', K)} {HITS_OUT}""",
    "knn_quantized": f"""WITH {EMB}, {CELLS}, bits AS (
  SELECT s.*, list_sum([CASE WHEN (t[1] > 0) <> (t[2] > 0) THEN 1 ELSE 0 END FOR t IN list_zip(q.v, x.v)]) AS differ
  FROM scores s JOIN placed d ON s.doc_id = d.doc_id JOIN visits v ON v.qid = s.qid AND v.cell = d.cell
  JOIN q ON q.qid = s.qid JOIN x ON x.doc_id = s.doc_id),
near AS (SELECT * FROM bits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY differ, doc_id) <= {K * OVERSAMPLE}),
{top('near', K)} {HITS_OUT}""",
    "knn_rotated_bits": f"""WITH {EMB} SELECT qid, least({K}, (SELECT count(*) FROM x))::BIGINT AS hits, true AS enough
FROM q WHERE (SELECT count(*) FROM x) > 0""",
    "knn_graph": f"""WITH {EMB} SELECT qid, least({K}, (SELECT count(*) FROM x))::BIGINT AS hits, true AS enough
FROM q WHERE (SELECT count(*) FROM x) > 0""",
    "knn_source_filter": "WITH "
    + doc_hits("CASE WHEN lang = 'de' THEN upper(source) ELSE source END", "'Inet-' || source", relax=False)
    + " "
    + HITS_OUT,
    "knn_stored_filter": "WITH "
    + doc_hits("CASE WHEN lang = 'de' THEN upper(source) ELSE source END", "'Inet-' || source", relax=False)
    + " "
    + HITS_OUT,
    "index_terms": f"""WITH {DOCS}, {SPLIT}, {ENTRIES},
idx AS (SELECT doc_id, label, 'Inet-' || source AS source FROM docs_split WHERE split = 'train' AND doc_id IN (SELECT doc_id FROM embedded))
SELECT term, source, batch, count(*) AS documents
FROM (SELECT unnest({TERM_LIST}) AS term, source, CASE WHEN label = 'normal_log' THEN 'normal' ELSE 'attacks' END AS batch FROM idx)
GROUP BY ALL""",
    "knn_source_relax": "WITH "
    + doc_hits(
        "CASE WHEN lang = 'en' THEN 'web-' || source WHEN lang = 'fr' THEN 'a_' || source WHEN lang = 'de' THEN upper(source) END",
        "CASE WHEN lang = 'fr' THEN 'Inet-' || source ELSE source END",
    )
    + " SELECT qid, h.doc_id, CASE WHEN i.source LIKE '%src3' THEN 'No Label' ELSE h.label END AS label, score, hit_rank "
    + "FROM hits h JOIN idx i ON h.doc_id = i.doc_id",
    "knn_two_hits": f"WITH {doc_hits(k=2)} {HITS_OUT}",
    "index_append": f"""WITH {DOCS}, {ENTRIES}
SELECT doc_id, source, label, CASE WHEN label = 'normal_log' THEN 'normal' ELSE 'attacks' END AS batch,
  384::BIGINT AS dim, length(log_message) AS n_chars FROM docs WHERE doc_id IN (SELECT doc_id FROM embedded)""",
    "knn_vote": f"{EMB_SCORED} SELECT qid, label, predicted, 'success' AS status FROM scored",
    "vote_share": f"""{EMB_HITS}, {votes()}
SELECT qid, label, votes, round(votes / sum(votes) OVER (PARTITION BY qid) * 100, 6) AS share FROM votes""",
    "normal_dominance": f"""WITH {doc_hits()}, {votes()}, sums AS (
  SELECT qid, round(coalesce(sum(votes) FILTER (label = 'normal_log'), 0), 6) AS normal_votes,
    round(sum(votes), 6) AS all_votes, bool_or(label <> 'normal_log') AS any_attack FROM votes GROUP BY qid)
SELECT *, normal_votes <= round(all_votes - normal_votes, 6) AS normal_not_dominant FROM sums""",
    "k_sweep": f"""WITH {EMB}, {top('scores', 7)}, swept AS (
  SELECT k, h.* FROM hits h JOIN (SELECT unnest([3, 5, 7])::BIGINT AS k) ks ON h.hit_rank <= k), {votes('swept', by='k, qid')},
scored AS (SELECT w.k, q.label, w.predicted FROM q JOIN win w ON q.qid = w.qid), {report('scored', 'k')}
SELECT k, {r6('accuracy', 'weighted_f1')}, support FROM overall""",
    "confusion": f"{EMB_SCORED}, {report('scored')} SELECT label, predicted, n FROM conf",
    "confusion_dense": f"{EMB_SCORED}, {report('scored')} SELECT label, "
    + ", ".join(f"coalesce(sum(n) FILTER (predicted = '{i}'), 0)::BIGINT AS as_{i}" for i in range(10))
    + " FROM conf GROUP BY label",
    "class_report": f"{EMB_SCORED}, {report('scored')} {REPORT_OUT}",
    "overall_report": f"""{EMB_SCORED}, {report('scored')} SELECT {r6('accuracy', 'macro_precision', 'macro_recall', 'macro_f1',
  'weighted_precision', 'weighted_recall', 'weighted_f1')}, support FROM overall""",
    "report_file": f"""{EMB_SCORED}, {report('scored')}
SELECT 'knn' AS model, label AS key, {r6('precision', 'recall', 'f1')}, support FROM rep
UNION ALL SELECT 'knn', 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), NULL FROM overall
UNION ALL SELECT 'knn', 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), support FROM overall
UNION ALL SELECT 'knn', 'weighted avg', round(weighted_precision, 6), round(weighted_recall, 6), round(weighted_f1, 6), support FROM overall""",
    "binary_report": f"""WITH {KNN_SCORED}, two AS (
  SELECT CASE WHEN contains(label, 'normal') THEN 'normal_log' ELSE 'attack_log' END AS label,
    CASE WHEN contains(predicted, 'normal') THEN 'normal_log' WHEN predicted IS NOT NULL THEN 'attack_log' END AS predicted
  FROM knn_scored), {report('two')} {REPORT_OUT}""",
    "alerts": f"""WITH {KNN_SCORED} SELECT qid, md5('Log query: ' || log_message || chr(10) || 'Label: ' || predicted || chr(10)
  || 'Explanation: voted by {K}' || chr(10) || '{HEAVY_RULE}') AS entry_md5
FROM knn_scored WHERE NOT contains(predicted, 'normal')""",
    "vote_share_text": f"""WITH {doc_hits()}, {votes()}, shares AS (
  SELECT *, votes / sum(votes) OVER (PARTITION BY qid) * 100 AS share FROM votes),
body AS (SELECT qid, string_agg('Label: ' || label || ', Score: ' || printf('%.2f', share) || '%' || chr(10) || '{LIGHT_RULE}', chr(10)
  ORDER BY first_rank) AS body FROM shares GROUP BY qid)
SELECT b.qid, md5('{HEAVY_RULE}' || chr(10) || 'Log query: ' || q.log_message || chr(10) || '{HEAVY_RULE}' || chr(10) || body) AS entry_md5
FROM body b JOIN queries q ON b.qid = q.doc_id""",
    "prompt_direct": f"WITH {DOCS} SELECT doc_id, md5({lit(prompts.DIRECT_SYSTEM)}) AS system_md5, md5({DIRECT_USER}) AS user_md5 FROM docs",
    "prompt_binary": f"""WITH {DOCS} SELECT doc_id, md5({lit(prompts.BINARY + chr(10) + prompts.SCHEMA_NOTE)}) AS system_md5,
  md5('log message: "' || log_message || '"') AS user_md5 FROM docs""",
    "prompt_closed": f"""WITH {DOCS} SELECT doc_id, md5({lit(prompts.CLOSED_SYSTEM)}) AS system_md5,
  md5(' source: ' || source || ' ,log message: "' || log_message || '"') AS user_md5 FROM docs""",
    "prompt_binary_context": f"""WITH {doc_hits()}, {CONTEXT} SELECT doc_id AS qid, 'binary' AS form,
  md5({lit(prompts.BINARY + '.' + prompts.BINARY_CONTEXT)} || context || {lit(chr(10) + prompts.SCHEMA_NOTE)}) AS system_md5,
  md5('log message: "' || log_message || '"') AS user_md5 FROM prompted
UNION ALL SELECT doc_id, 'labelled', md5({lit(prompts.NEIGHBOURS_SYSTEM)} || context || {lit(prompts.SCHEMA_NOTE)}),
  md5('Source: ' || source || ', log message: "' || log_message || '"') FROM prompted""",
    "prompt_context": f"""WITH {doc_hits()}, {CONTEXT} SELECT doc_id AS qid, md5({lit(prompts.CONTEXT_SYSTEM)}) AS system_md5,
  md5({CONTEXT_USER}) AS user_md5 FROM prompted""",
    "prompt_alert": f"""WITH {ALERT_LINES} SELECT event_id, md5('Judge the alert.') AS system_md5, md5({lit(prompts.ALERT_HEAD)}
  || '{{' || chr(10) || '  "event_id": ' || event_id || ',' || chr(10) || '  "type": "' || event_type || '",' || chr(10)
  || '  "props": {{' || chr(10) || '    "k": ' || k || chr(10) || '  }}' || chr(10) || '}}' || {lit(prompts.ALERT_TAIL)}) AS user_md5
FROM alert_lines WHERE NOT bad""",
    "malformed_alerts": f"WITH {ALERT_LINES} SELECT event_id, value FROM alert_lines WHERE bad",
    "response_status": f"WITH {STATUS} SELECT event_id, status, predicted, explanation, seconds FROM read",
    "strict_labels": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'success' ELSE 'validation_error' END AS status,
  CASE WHEN event_type = 'error' THEN 'dirb' END AS predicted FROM events""",
    "run_summary": f"""WITH {STATUS} SELECT count(*) AS attempted, count(*) FILTER (status = 'success') AS successful,
  count(*) FILTER (status <> 'success') AS failed, round(avg(seconds), 6) AS avg_seconds FROM read""",
    "status_counts": f"WITH {STATUS} SELECT status, count(*) AS n FROM read GROUP BY status",
    "knn_eval": f"WITH {KNN_SCORED}, {report('knn_scored')} {REPORT_OUT}",
    "model_eval": f"WITH {DOCS}, {SPLIT}, {MODEL_SCORED}, {report('model_scored')} {REPORT_OUT}",
    "context_eval": f"WITH {doc_hits()}, {CONTEXT_SCORED}, {report('context_scored')} {REPORT_OUT}",
    "compare_models": THREE
    + " SELECT label, "
    + ", ".join(f"round(coalesce(max(f1) FILTER (model = '{m}'), 0), 6) AS {m}" for m in ("knn", "model", "model_context"))
    + " FROM rep GROUP BY label",
    "overall_compare": f"{THREE} SELECT model, {r6('accuracy', 'weighted_precision', 'weighted_recall', 'weighted_f1')} FROM overall",
    "model_metrics": f"WITH {KNN_SCORED}, {report('knn_scored')} SELECT label, {r6('precision', 'recall', 'f1')} FROM rep WHERE label <> 'low'",
    "alert_reeval": f"""WITH {ALERT_LINES}, {ALERT_STATUS} SELECT event_id, status, predicted,
  CASE WHEN status = 'success' THEN 'by type' END AS explanation, confidence FROM alert_status""",
    "alert_result_lines": f"""WITH {ALERT_LINES}, {ALERT_STATUS} SELECT event_id, status,
  CASE status WHEN 'format_error' THEN 'Unexpected LLM response format' WHEN 'json_error' THEN 'JSONDecodeError: the content is not one JSON value'
    WHEN 'validation_error' THEN CASE event_type WHEN 'view' THEN 'ValidationError: final_attack_label is none of the known labels'
      ELSE 'ValidationError: confidence is no number from 0 to 1' END WHEN 'api_error' THEN 'LLM API request failed'
    WHEN 'processing_error' THEN 'TimeoutError: no reply' END AS error,
  CASE status WHEN 'format_error' THEN 200 WHEN 'api_error' THEN 500 END::BIGINT AS status_code,
  CASE WHEN status = 'json_error' THEN 'nope'
    WHEN event_type = 'view' THEN '{{"final_attack_label": "Nothing", "explanation": "by type", "confidence": 0.5}}'
    WHEN event_type = 'purchase' THEN '{{"final_attack_label": "Botnet Attack", "explanation": "by type", "confidence": 1.5}}' END AS raw_response,
  CASE WHEN status = 'api_error' THEN 'overloaded' END AS response_text,
  predicted AS final_attack_label, 0.5::DOUBLE AS inference_time_sec FROM alert_status""",
    "stream_feedback": f"""WITH {DOCS}, {SPLIT}, {ENTRIES}, known AS (SELECT * FROM docs_split WHERE doc_id IN (SELECT doc_id FROM embedded)),
idx1 AS (SELECT doc_id, source, label FROM known WHERE split = 'train'),
wave1 AS (SELECT doc_id, source FROM known WHERE split = 'eval' AND lang = 'en'),
wave2 AS (SELECT doc_id, source FROM known WHERE split = 'eval' AND lang <> 'en'),
{scoped_hits('idx1', 'wave1', '1')}, {votes('hits1', '1')},
idx2 AS (SELECT * FROM idx1 UNION ALL SELECT w.doc_id, w.source, p.predicted FROM wave1 w JOIN win1 p ON w.doc_id = p.qid),
{scoped_hits('idx2', 'wave2', '2')}, {votes('hits2', '2')}
SELECT doc_id, label, 'train' AS batch FROM idx1
UNION ALL SELECT qid, predicted, 'stream-0' FROM win1 UNION ALL SELECT qid, predicted, 'stream-1' FROM win2""",
}
ORACLES["split_files"] = ORACLES["stratified_split"]
ORACLES["downsample_files"] = (
    "WITH sample AS (" + ORACLES["downsample_preserve"] + ") SELECT md5(replace(replace(text, chr(10), '\\n'), chr(13), '\\r')) AS message_md5, "
    "s.source, s.label FROM sample s JOIN documents d ON s.doc_id = d.doc_id"
)
ORACLES["stream_alerts"] = (
    ORACLES["stream_feedback"].split("SELECT doc_id, label, 'train' AS batch FROM idx1")[0]
    + "SELECT qid, predicted, 'stream-0' AS batch FROM win1 WHERE NOT contains(predicted, 'normal') "
    "UNION ALL SELECT qid, predicted, 'stream-1' FROM win2 WHERE NOT contains(predicted, 'normal')"
)
