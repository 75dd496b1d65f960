"""DuckDB SQL equal to each registered query (views: the test tables).

Written as plain, naive SQL: cross joins, ``contains`` and sorts where the
Spark side uses broadcast-and-map or n-gram joins, so the two are independent.
"""

from __future__ import annotations

from docket.functions.route import SUBJECTS
from docket.plans.testdata import BENCH_TOPICS, QUESTION_LEADS

FILE_INDEX = """
  SELECT page_id AS pos, regexp_replace(url, '^[a-z]+://', '') || '.pdf' AS path, url AS link
  FROM pages"""

COLL = """
  SELECT d.doc_id AS id, d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.pdf' AS source,
         d.text AS content, e.embedding AS v
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"""

HITS = f"""
  coll AS ({COLL}),
  q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings),
  d AS (SELECT q.qid, c.id,
               round(list_sum(list_transform(list_zip(q.v, c.v),
                     lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 6) + 0.0 AS dist
        FROM q CROSS JOIN coll c),
  hits AS (SELECT qid, id, dist,
                  CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rk
           FROM d QUALIFY rk <= 5)"""

CLEAN = "trim(regexp_replace(regexp_replace({x}, '[^\\x20-\\x7E\\n]', '', 'g'), '[ \\n]+', ' ', 'g'))"

SQL: dict[str, str] = {}

SQL["knn_top5"] = f"WITH {HITS} SELECT qid, id, dist, rk FROM hits"

SQL["rag_context"] = f"""
WITH {HITS}
SELECT h.qid,
       {CLEAN.format(x="string_agg(coalesce(c.content, ''), chr(10) ORDER BY h.rk)")} AS context,
       count(*) AS n_hits
FROM hits h JOIN coll c ON h.id = c.id
GROUP BY h.qid"""

SQL["top_source_link"] = f"""
WITH {HITS}, fidx AS ({FILE_INDEX}),
top AS (SELECT h.qid, nullif(c.source, '') AS src FROM hits h JOIN coll c ON h.id = c.id WHERE h.rk = 1),
link AS (SELECT t.qid, arg_min(f.link, f.pos) AS source_link
         FROM top t JOIN fidx f ON contains(lower(f.path), lower(t.src)) GROUP BY t.qid)
SELECT t.qid, regexp_replace(t.src, '(?i)\\.pdf$', '') AS source_label, l.source_link
FROM top t LEFT JOIN link l ON t.qid = l.qid"""

SQL["clean_context"] = f"SELECT doc_id, {CLEAN.format(x='text')} AS cleaned FROM documents"

SQL["snippet_sample"] = """
SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 300), '\\s+', ' ', 'g') AS snippet
FROM documents ORDER BY doc_id LIMIT 3"""

_DOCNAME = "source || '/' || lang || '_' || CAST(doc_id AS VARCHAR) || '.txt'"
_BASE = "regexp_extract({n}, '([^\\\\/]*)$', 1)"

SQL["chunk_fixed"] = f"""
WITH docs AS (
  SELECT {_BASE.format(n=_DOCNAME)} AS source, doc_id AS doc_index, text
  FROM documents WHERE regexp_matches(text, '\\S')),
w AS (
  SELECT source, doc_index, i AS chunk_id, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS content
  FROM docs, range(0, CASE WHEN length(text) <= 1200 THEN 1
                           ELSE CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT) + 1 END) r(i))
SELECT sha1(source || CAST(doc_index AS VARCHAR) || CAST(chunk_id AS VARCHAR) || content) AS id,
       source, doc_index, CAST(chunk_id AS INTEGER) AS chunk_id, content
FROM w"""

_NL = "[^\\n\\r\\x{2028}\\x{2029}]"

SQL["tag_runs"] = f"""
WITH t AS (SELECT page_id, regexp_extract_all(html, '<p>({_NL}*?)</p>', 1) AS arr FROM pages)
SELECT page_id, CAST(unnest(range(len(arr))) AS BIGINT) AS run_pos, unnest(arr) AS run
FROM t WHERE len(arr) > 0"""

SQL["safe_names"] = """
SELECT page_id, regexp_replace(url, '[\\\\/:"*?<>|]+', '_', 'g') AS safe_name FROM pages"""

SQL["render_answer"] = f"""
WITH a AS (SELECT conv_id, turn, coalesce('*note* ' || text || chr(10) || '* first' || chr(10) || '* second' || chr(10) || chr(10)
             || '1. one' || chr(10) || '22. two' || chr(10) || chr(10) || chr(10) || 'end ', '') AS s
           FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, regexp_replace(s, '\\*({_NL}*?)\\*', '<strong>\\1</strong>', 'g') AS s FROM a),
c AS (SELECT conv_id, turn, regexp_replace(s, '(?m)^\\* ({_NL}*)$', '<li>\\1</li>', 'g') AS s FROM b),
d AS (SELECT conv_id, turn, regexp_replace(s, '(?m)^[0-9]+\\. ({_NL}*)$', '<li>\\1</li>', 'g') AS s FROM c),
e AS (SELECT conv_id, turn, regexp_replace(s, '(<li>[\\s\\S]*?</li>)', '<ul>\\1</ul>', 'g') AS s FROM d),
f AS (SELECT conv_id, turn, regexp_replace(regexp_replace(s, '\\n{{2,}}', '<br><br>', 'g'), '\\n', '<br>', 'g') AS s FROM e)
SELECT conv_id, turn, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS html FROM f"""


def _list(vals) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"


_SUBJ_NAMES = [s.name for s in SUBJECTS]

NOTES_INDEX = f"""
  SELECT page_id AS pos,
         ({_list(_SUBJ_NAMES + ['misc'])})[page_id % {len(SUBJECTS) + 1} + 1] || ' module '
         || CAST(page_id % 6 AS VARCHAR) || ' ' || CAST(page_id % 4 + 1 AS VARCHAR) || 'th sem '
         || regexp_replace(url, '^[a-z]+://', '') || '.pdf' AS path,
         url AS link
  FROM pages"""

BENCH_Q = f"""
  SELECT item_id AS qid,
         text || ' ' || ({_list(BENCH_TOPICS)})[item_id % {len(BENCH_TOPICS)} + 1] || ' module '
         || CAST(item_id % 7 AS VARCHAR) || ' ' || CAST(item_id % 5 AS VARCHAR) || 'th sem notes' AS question
  FROM benchmark"""

CHAT_Q = f"""
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid,
         ({_list(QUESTION_LEADS)})[conv_id % {len(QUESTION_LEADS)} + 1] || ' ' || text || ' module '
         || CAST(turn % 5 AS VARCHAR) || ' ' || CAST(conv_id % 5 AS VARCHAR) || 'th sem' AS question
  FROM conversations WHERE role = 'user'"""


def _subject_case(x: str) -> str:
    parts = []
    for s in SUBJECTS:
        cond = " OR ".join(f"contains({x}, '{k}')" for k in s.keywords)
        parts.append(f"WHEN {cond} THEN '{s.name}'")
    return "CASE " + " ".join(parts) + " END"


def _classify_case(x: str) -> str:
    from docket.functions.route import CLASSIFY_RULES
    parts = [f"WHEN regexp_matches({x}, '{pat}') THEN '{cat}'" for cat, pat in CLASSIFY_RULES]
    return "CASE " + " ".join(parts) + " ELSE 'OTHER' END"


FIELDS = f"""
  SELECT qid, question, lower(question) AS lq,
         TRY_CAST(nullif(regexp_extract(question, '(?i)module\\s*[-_ ]*([0-9]+)', 1), '') AS BIGINT) AS module,
         TRY_CAST(nullif(regexp_extract(question, '(?i)([0-9]+)\\s*(st|nd|rd|th)?\\s*sem', 1), '') AS BIGINT) AS semester,
         {_subject_case('lower(question)')} AS subject
  FROM {{src}}"""

SQL["route_fields"] = f"""
WITH q AS ({CHAT_Q}), f AS ({FIELDS.format(src='q')})
SELECT qid, module, semester, subject, {_classify_case('lq')} AS category FROM f"""

_PASS = """
  (q.module IS NULL OR q.module = 0
   OR contains(f.lp, 'module ' || CAST(q.module AS VARCHAR)) OR contains(f.lp, 'module_' || CAST(q.module AS VARCHAR))
   OR contains(f.lp, 'mod ' || CAST(q.module AS VARCHAR)) OR contains(f.lp, CAST(q.module AS VARCHAR) || '.'))
  AND (q.semester IS NULL OR q.semester = 0
   OR contains(f.lp, CAST(q.semester AS VARCHAR) || 'rd sem') OR contains(f.lp, CAST(q.semester AS VARCHAR) || 'th sem')
   OR contains(f.lp, CAST(q.semester AS VARCHAR) || 'nd sem') OR contains(f.lp, CAST(q.semester AS VARCHAR) || 'st sem'))
  AND (q.subject IS NULL OR contains(f.lp, q.subject))"""

_NOFILTER = "((q.module IS NULL OR q.module = 0) AND (q.semester IS NULL OR q.semester = 0) AND q.subject IS NULL)"

def _cands(qsrc: str) -> str:
    return f"""
  qb AS ({qsrc}), q AS ({FIELDS.format(src='qb')}),
  f AS (SELECT pos, path, link, lower(path) AS lp FROM ({NOTES_INDEX})),
  pairs AS (SELECT q.qid, f.pos, f.path, f.link FROM q, f WHERE NOT {_NOFILTER} AND {_PASS})"""


_CANDS = _cands(BENCH_Q)

SQL["candidate_files"] = f"""
WITH {_CANDS}
SELECT qid, pos, path, link, false AS all_files FROM pairs
UNION ALL
SELECT qid, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), true
FROM q WHERE qid NOT IN (SELECT qid FROM pairs)"""

SQL["candidate_summary"] = f"""
WITH {_CANDS},
  agg AS (SELECT qid, count(*) AS n, arg_min(path, pos) AS fp, min(pos) AS fpos FROM pairs GROUP BY qid),
  tot AS (SELECT count(*) AS n, arg_min(path, pos) AS fp, min(pos) AS fpos FROM f)
SELECT q.qid,
       CASE WHEN a.qid IS NULL THEN t.n ELSE a.n END AS n_candidates,
       CASE WHEN a.qid IS NULL THEN t.fpos ELSE a.fpos END AS first_pos,
       CASE WHEN a.qid IS NULL THEN t.fp ELSE a.fp END AS first_path,
       a.qid IS NULL AS all_files
FROM q LEFT JOIN agg a ON q.qid = a.qid CROSS JOIN tot t"""

SQL["candidate_sets"] = f"""
WITH {_CANDS}
SELECT q.qid, count(p.pos) AS n_candidates, md5(string_agg(CAST(p.pos AS VARCHAR), ',' ORDER BY p.pos)) AS positions_md5
FROM q LEFT JOIN pairs p ON p.qid = q.qid GROUP BY q.qid"""


def _fuzzy(qsrc: str) -> str:
    """CTEs ending in ``best(qid, path, link, rating)``."""
    return f"""{_cands(qsrc)},
  pool AS (
    SELECT q.qid, f.pos, f.path, f.link,
           regexp_replace(q.lq, '\\s+', '', 'g') AS qs, regexp_replace(f.lp, '\\s+', '', 'g') AS fs
    FROM q, f
    WHERE (q.qid, f.pos) IN (SELECT qid, pos FROM pairs) OR q.qid NOT IN (SELECT qid FROM pairs)),
  qbg AS (SELECT qid, bg, row_number() OVER (PARTITION BY qid, bg ORDER BY i) AS occ
          FROM (SELECT DISTINCT qid, qs FROM pool) t,
               LATERAL (SELECT i, substr(t.qs, i, 2) AS bg FROM range(1, length(t.qs)) r(i))),
  fbg AS (SELECT pos, bg, row_number() OVER (PARTITION BY pos, bg ORDER BY i) AS occ
          FROM (SELECT DISTINCT pos, fs FROM pool) t,
               LATERAL (SELECT i, substr(t.fs, i, 2) AS bg FROM range(1, length(t.fs)) r(i))),
  inter AS (SELECT a.qid, b.pos, count(*) AS n FROM qbg a JOIN fbg b ON a.bg = b.bg AND a.occ = b.occ
            GROUP BY a.qid, b.pos),
  scored AS (
    SELECT p.qid, p.pos, p.path, p.link,
           CASE WHEN p.qs = p.fs THEN 1.0
                WHEN length(p.qs) < 2 OR length(p.fs) < 2 THEN 0.0
                ELSE 2.0 * coalesce(i.n, 0) / (length(p.qs) + length(p.fs) - 2) END AS rating
    FROM pool p LEFT JOIN inter i ON p.qid = i.qid AND p.pos = i.pos),
  best AS (SELECT qid, path, link, round(rating, 6) AS rating FROM scored
           QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rating DESC, pos) = 1)"""


SQL["fuzzy_best"] = f"WITH {_fuzzy(BENCH_Q)} SELECT * FROM best"


SQL["recent_questions"] = """
WITH u4 AS (SELECT conv_id, turn * 4 + j AS turn,
                   CASE j WHEN 0 THEN text WHEN 1 THEN ' ' || text || '  ' WHEN 2 THEN '  ' ELSE text || ' again' END AS text
            FROM conversations, range(4) r(j) WHERE role = 'user'),
u AS (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM u4),
nb AS (SELECT * FROM u WHERE q IS NOT NULL AND q <> ''),
k AS (SELECT *, lag(q) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM nb),
kept AS (SELECT conv_id, turn, q FROM k WHERE prev IS NULL OR prev <> q),
r AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS rk, q
      FROM kept)
SELECT conv_id, rk, q AS question,
       CASE WHEN length(q) > 60 THEN substr(q, 1, 60) || '…' ELSE q END AS label
FROM r WHERE rk <= 8"""

TREE = f"""
  e AS (SELECT path, min(pos) AS pos, arg_max(link, pos) AS link FROM ({FILE_INDEX}) GROUP BY path),
  p AS (SELECT pos, link,
               list_filter(list_transform(string_split(path, '/'),
                                          lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                           lambda x: x <> '') AS parts
        FROM e WHERE path IS NOT NULL AND path <> ''),
  n AS (SELECT pos, link, len(parts) AS n, i, parts[i] AS name,
               array_to_string(parts[1:i], '/') AS node,
               CASE WHEN i > 1 THEN array_to_string(parts[1:i - 1], '/') END AS parent_path
        FROM p, range(1, len(parts) + 1) r(i) WHERE len(parts) > 0),
  g AS (SELECT node, any_value(name) AS name, any_value(parent_path) AS parent_path,
               any_value(i) AS depth, bool_or(i = n) AS f,
               arg_max(CASE WHEN i = n THEN link END, CASE WHEN i = n THEN pos END) AS lk,
               arg_min(i = n, pos) AS fe, bool_or(i < n) AS th
        FROM n GROUP BY node),
  tree AS (SELECT node AS path, parent_path, CAST(depth AS BIGINT) AS depth, name,
                  CASE WHEN f THEN 'file' ELSE 'folder' END AS type,
                  CASE WHEN f THEN lk END AS link, fe AND th AS conflict FROM g)"""

SQL["library_tree"] = f"WITH {TREE} SELECT * FROM tree"

SQL["folder_children"] = f"""
WITH {TREE}
SELECT parent_path AS path, count(*) AS n_children, count(*) FILTER (WHERE type = 'file') AS n_files,
       min(name) AS first_child
FROM tree WHERE parent_path IS NOT NULL GROUP BY parent_path"""

SQL["folder_closure"] = f"""
WITH RECURSIVE {TREE},
  ent AS (SELECT path AS id, parent_path AS parent_id, name, type = 'folder' AS is_folder FROM tree),
  walk(id, path, depth, is_folder, name, anc, ord) AS (
    SELECT id, name, 1, is_folder, name, [id], [{{'n': name, 'i': id}}] FROM ent WHERE parent_id IS NULL
    UNION ALL
    SELECT e.id, w.path || '/' || e.name, w.depth + 1, e.is_folder, e.name,
           list_append(w.anc, e.id), list_append(w.ord, {{'n': e.name, 'i': e.id}})
    FROM walk w JOIN ent e ON e.parent_id = w.id
    WHERE w.is_folder AND NOT list_contains(w.anc, e.id)),
  files AS (SELECT id, path, CAST(depth AS BIGINT) AS depth, ord,
                   regexp_replace(name, '[\\\\/:"*?<>|]+', '_', 'g') AS safe_name
            FROM walk WHERE NOT is_folder),
  win AS (SELECT safe_name, max(ord) AS w FROM files GROUP BY safe_name)
SELECT f.id, f.path, f.depth, f.safe_name, f.ord = w.w AS kept
FROM files f JOIN win w ON f.safe_name = w.safe_name"""

SQL["lookup_file"] = f"""
WITH n AS ({NOTES_INDEX}),
  stored AS (SELECT DISTINCT regexp_extract(path, '([^\\\\/]*)$', 1) AS name FROM n),
  req AS (SELECT pos AS req_id,
                 CASE WHEN pos % 3 = 0 THEN regexp_extract(path, '([^\\\\/]*)$', 1)
                      WHEN pos % 3 = 1 THEN regexp_extract(path, '([^\\\\/]*)$', 1) || '.bak'
                      ELSE '' END AS name FROM n)
SELECT r.req_id, r.name,
       CASE WHEN r.name IS NULL OR r.name = '' THEN 'missing'
            WHEN s.name IS NOT NULL THEN 'ok' ELSE 'not_found' END AS status,
       CASE WHEN r.name <> '' AND s.name IS NOT NULL THEN 'http://localhost:3000/files/' || r.name END AS file_url
FROM req r LEFT JOIN stored s ON r.name = s.name"""

SQL["pack_batches"] = f"""
WITH c AS ({COLL}), r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM c)
SELECT CAST(pos // 300 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n_rows,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids_csv,
       CAST(sum(length(content)) AS BIGINT) AS doc_chars,
       string_agg(source || '|' || (id % 7) || '|' || id, ',' ORDER BY pos) AS metadata_csv,
       string_agg(CAST(list_reduce(list_prepend(0, list_transform(v, lambda x: floor(x::DOUBLE * 4096)::BIGINT)),
                                   lambda a, x: a * 3 % 1000003 + x) AS VARCHAR), ',' ORDER BY pos) AS vector_codes
FROM r GROUP BY 1"""

SQL["file_index_read"] = f"""
WITH i AS ({FILE_INDEX}),
e AS (SELECT pos, path, link FROM i UNION ALL SELECT pos + 1099511627776, path, link || '#2' FROM i WHERE pos % 10 = 0),
r AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, path, link FROM e)
SELECT min(pos) AS pos, path, arg_max(link, pos) AS link FROM r GROUP BY path"""

SQL["rows_written"] = """
SELECT form, doc_id, lang, source, n_chars, md5(text) AS text_md5
FROM documents, (VALUES ('parquet'), ('json')) f(form)"""

SQL["parity"] = """
SELECT CASE WHEN e.vec_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side,
       coalesce(d.doc_id, e.vec_id) AS id
FROM documents d FULL OUTER JOIN embeddings e ON d.doc_id = e.vec_id
WHERE d.doc_id IS NULL OR e.vec_id IS NULL"""

SQL["upsert_new"] = """
WITH d AS (SELECT doc_id AS id, min({'source': source, 'n_chars': n_chars}) AS r FROM documents GROUP BY doc_id)
SELECT id, r.source AS source, r.n_chars AS n_chars FROM d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.id)"""

SQL["hash_embed"] = """
WITH t AS (SELECT item_id, unnest(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+')) AS tok FROM benchmark),
c AS (SELECT item_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket, CAST(count(*) AS DOUBLE) AS cnt
      FROM t WHERE tok <> '' GROUP BY 1, 2)
SELECT item_id, bucket, round(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY item_id)), 6) AS weight FROM c"""

SQL["stage_counts"] = """
SELECT 'documents' AS stage, count(*) AS n FROM documents
UNION ALL
SELECT 'chunks', CAST(sum(CASE WHEN NOT regexp_matches(text, '\\S') THEN 0
                               WHEN length(text) <= 1200 THEN 1
                               ELSE CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT) + 1 END) AS BIGINT)
FROM documents
UNION ALL
SELECT 'collection', count(*) FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"""


def _sql_str(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _hash_dense(src: str, id_col: str, text_col: str, name: str) -> str:
    return f"""
  {name}_t AS (SELECT {id_col} AS id, unnest(string_split_regex(lower({text_col}), '[ \\t\\n\\x0b\\f\\r]+')) AS tok FROM {src}),
  {name}_c AS (SELECT id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS b, CAST(count(*) AS DOUBLE) AS c
               FROM {name}_t WHERE tok <> '' GROUP BY 1, 2),
  {name}_n AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM {name}_c),
  {name}_v AS (SELECT s.{id_col} AS id, list(coalesce(n.w, 0.0) ORDER BY r.i) AS v
               FROM {src} s CROSS JOIN range(64) r(i) LEFT JOIN {name}_n n ON n.id = s.{id_col} AND n.b = r.i
               GROUP BY s.{id_col})"""


def _answer_sql(recursive: bool = False) -> str:
    from docket.functions.route import REPLY_FOUND, REPLY_NOT_FOUND, REPLY_OTHER
    from docket.operators.context import PROMPT_TEMPLATE
    head, tail = PROMPT_TEMPLATE.split("{context}")
    mid, end = tail.split("{question}")
    docs = """
  adocs AS (SELECT regexp_extract(lang || '/' || CAST(doc_id AS VARCHAR) || '.pdf', '([^\\\\/]*)$', 1) AS source,
                   doc_id AS doc_index, text FROM documents WHERE regexp_matches(text, '\\S')),
  aw AS (SELECT source, doc_index, i AS chunk_id, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS content
         FROM adocs, range(0, CASE WHEN length(text) <= 1200 THEN 1
                                   ELSE CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT) + 1 END) r(i)),
  ach AS (SELECT sha1(source || CAST(doc_index AS VARCHAR) || CAST(chunk_id AS VARCHAR) || content) AS id,
                 source, content FROM aw)"""
    if recursive:
        docs = (_recursive_chunks("lang || '/' || CAST(doc_id AS VARCHAR) || '.pdf'")
                + ",\n  ach AS (SELECT id, source, content FROM rc_out)")
    return f"""
WITH qraw AS ({CHAT_Q}),
  cls AS (SELECT qid, question, {_classify_case('lower(question)')} AS category FROM qraw),
  {_fuzzy("SELECT qid, question FROM cls WHERE category = 'DIRECT_NOTES_REQUEST'")},
  ask AS (SELECT qid, question FROM cls WHERE category = 'NOTES_QUERY'),
  {docs},
  {_hash_dense('ach', 'id', 'content', 'cv')},
  {_hash_dense('ask', 'qid', 'question', 'qv')},
  dist AS (SELECT q.id AS qid, c.id,
                  round(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) + 0.0 AS d
           FROM qv_v q CROSS JOIN cv_v c),
  hits AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM dist QUALIFY rk <= {K_CHAT}),
  ctx AS (SELECT h.qid, {CLEAN.format(x="string_agg(coalesce(c.content, ''), chr(10) ORDER BY h.rk)")} AS context
          FROM hits h JOIN ach c ON h.id = c.id GROUP BY h.qid),
  top AS (SELECT h.qid, nullif(c.source, '') AS src FROM hits h JOIN ach c ON h.id = c.id WHERE h.rk = 1),
  nidx AS ({NOTES_INDEX}),
  lnk AS (SELECT t.qid, arg_min(f.link, f.pos) AS link FROM top t JOIN nidx f ON contains(lower(f.path), lower(t.src))
          GROUP BY t.qid)
SELECT qid, question, category, NULL::VARCHAR AS answer, NULL::VARCHAR AS source_label,
       NULL::VARCHAR AS source_link, NULL::VARCHAR AS context, NULL::VARCHAR AS prompt
FROM cls WHERE category = 'SMALL_TALK'
UNION ALL
SELECT qid, question, 'OTHER', {_sql_str(REPLY_OTHER)}, NULL, NULL, NULL, NULL
FROM cls WHERE category NOT IN ('SMALL_TALK', 'DIRECT_NOTES_REQUEST', 'NOTES_QUERY')
UNION ALL
SELECT c.qid, c.question, c.category,
       CASE WHEN nullif(b.link, '') IS NOT NULL THEN {_sql_str(REPLY_FOUND)} ELSE {_sql_str(REPLY_NOT_FOUND)} END,
       CASE WHEN nullif(b.link, '') IS NOT NULL THEN b.path END,
       CASE WHEN nullif(b.link, '') IS NOT NULL THEN b.link END, NULL, NULL
FROM cls c LEFT JOIN best b ON c.qid = b.qid WHERE c.category = 'DIRECT_NOTES_REQUEST'
UNION ALL
SELECT a.qid, a.question, 'NOTES_QUERY', NULL,
       regexp_replace(t.src, '(?i)\\.pdf$', ''), l.link, coalesce(x.context, ''),
       {_sql_str(head)} || coalesce(x.context, '') || {_sql_str(mid)} || a.question || {_sql_str(end)}
FROM ask a LEFT JOIN ctx x ON a.qid = x.qid LEFT JOIN top t ON a.qid = t.qid LEFT JOIN lnk l ON a.qid = l.qid"""


K_CHAT = 5
SQL["answer_batch"] = _answer_sql()


SQL["dispatch"] = f"""
WITH qraw AS ({CHAT_Q}),
  cls AS (SELECT qid, question, {_classify_case('lower(question)')} AS category FROM qraw),
  {_fuzzy("SELECT qid, question FROM cls WHERE category = 'DIRECT_NOTES_REQUEST'")}
SELECT c.qid,
       CASE WHEN c.category IN ('SMALL_TALK', 'DIRECT_NOTES_REQUEST', 'NOTES_QUERY') THEN c.category
            ELSE 'OTHER' END AS category,
       CASE WHEN c.category = 'DIRECT_NOTES_REQUEST' THEN
              CASE WHEN nullif(b.link, '') IS NOT NULL THEN 'Here are the notes.' ELSE 'Not in notes.' END
            WHEN c.category IN ('SMALL_TALK', 'NOTES_QUERY') THEN NULL
            ELSE {_sql_str(__import__('docket.functions.route', fromlist=['x']).REPLY_OTHER)} END AS answer,
       CASE WHEN c.category = 'DIRECT_NOTES_REQUEST' AND nullif(b.link, '') IS NOT NULL THEN b.path END AS source_label,
       CASE WHEN c.category = 'DIRECT_NOTES_REQUEST' AND nullif(b.link, '') IS NOT NULL THEN b.link END AS source_link
FROM cls c LEFT JOIN best b ON c.qid = b.qid"""

SQL["knn_cosine"] = f"""
WITH coll AS ({COLL}),
  q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings),
  d AS (SELECT q.qid, c.id,
               round(1.0 - list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
                     / (sqrt(list_sum(list_transform(q.v, lambda x: x::DOUBLE * x::DOUBLE)))
                        * sqrt(list_sum(list_transform(c.v, lambda x: x::DOUBLE * x::DOUBLE)))), 6) + 0.0 AS dist
        FROM q CROSS JOIN coll c)
SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rk
FROM d QUALIFY rk <= 5"""

SQL["pair_distance"] = f"""
WITH coll AS ({COLL}), {_hash_dense('coll', 'id', 'content', 'hv')},
  p AS (SELECT c.id, c.v AS a, h.v AS b FROM coll c JOIN hv_v h ON c.id = h.id),
  s AS (SELECT id,
               list_sum(list_transform(list_zip(a, b), lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2]))) AS l2,
               list_sum(list_transform(list_zip(a, b), lambda x: x[1]::DOUBLE * x[2])) AS dot,
               sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE))) AS na,
               sqrt(list_sum(list_transform(b, lambda x: x * x))) AS nb
        FROM p)
SELECT id, round(l2, 6) + 0.0 AS l2sq, round(1.0 - dot, 6) + 0.0 AS ip,
       round(1.0 - dot / (na * nb), 6) + 0.0 AS cosine FROM s"""


def _recursive_chunks(name_expr: str) -> str:
    """CTEs ending in ``rc_out(id, source, doc_index, chunk_id, content)``: C1 (1200/200)
    over ``documents`` in SQL.

    Pieces keep their separator in front ('\\n' if the text has one, else ' ',
    else characters); a run of short pieces is one packing group, and a piece
    of 1200+ characters is split again on spaces (else characters) into a group
    of its own.  The packing window is always a contiguous range of a group's
    pieces, so with prefix sums each chunk's end is the last piece that still
    fits and the next start is the first piece whose suffix fits the overlap
    (ASOF joins); only the short chain from chunk to chunk is recursive.
    Words of 1200+ characters inside a long line, and blank-line paragraphs,
    do not occur in the test tables and are not handled here.
    """
    return f"""
  rc_d AS (
    SELECT regexp_extract({name_expr}, '([^\\\\/]*)$', 1) AS src, doc_id, text,
           CASE WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, ' ') THEN ' ' ELSE '' END AS sep
    FROM documents WHERE regexp_matches(text, '\\S')),
  rc_p1 AS (
    SELECT doc_id, src, j AS i1, CASE WHEN j = 1 THEN parts[j] ELSE sep || parts[j] END AS piece
    FROM (SELECT doc_id, src, sep, string_split(text, sep) AS parts FROM rc_d WHERE sep <> '') t,
         range(1, len(parts) + 1) r(j)
    UNION ALL
    SELECT doc_id, src, j, substr(text, j, 1) FROM rc_d, range(1, length(text) + 1) r(j) WHERE sep = ''),
  rc_p1n AS (SELECT *, length(piece) >= 1200 AS lng FROM rc_p1 WHERE piece <> ''),
  rc_p1g AS (
    SELECT *, sum(CASE WHEN lng OR prev_lng THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY i1 ROWS UNBOUNDED PRECEDING) AS grp
    FROM (SELECT *, coalesce(lag(lng) OVER (PARTITION BY doc_id ORDER BY i1), false) AS prev_lng FROM rc_p1n)),
  rc_p2 AS (
    SELECT doc_id, src, grp, i1 AS o1, 1 AS o2, piece FROM rc_p1g WHERE NOT lng
    UNION ALL
    SELECT doc_id, src, grp, i1, j, CASE WHEN j = 1 THEN parts[j] ELSE ' ' || parts[j] END
    FROM (SELECT doc_id, src, grp, i1, string_split(piece, ' ') AS parts
          FROM rc_p1g WHERE lng AND contains(piece, ' ')) t, range(1, len(parts) + 1) r(j)
    UNION ALL
    SELECT doc_id, src, grp, i1, j, substr(piece, j, 1)
    FROM rc_p1g, range(1, length(piece) + 1) r(j) WHERE lng AND NOT contains(piece, ' ')),
  rc_pc AS (SELECT doc_id, src, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY o1, o2) AS k,
                   piece, length(piece) AS n FROM rc_p2 WHERE piece <> ''),
  rc_pcs AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, grp ORDER BY k ROWS UNBOUNDED PRECEDING) AS cs
             FROM rc_pc),
  rc_pcs2 AS (SELECT *, cs - n AS cs_prev, lead(n) OVER (PARTITION BY doc_id, grp ORDER BY k) AS n_next,
                     cs - least(200, 1200 - lead(n) OVER (PARTITION BY doc_id, grp ORDER BY k)) AS thr,
                     cs - n + 1200 AS fit FROM rc_pcs),
  rc_emap AS MATERIALIZED (
    SELECT a.doc_id, a.grp, a.k AS s, b.k AS e
    FROM rc_pcs2 a ASOF JOIN rc_pcs2 b ON a.doc_id = b.doc_id AND a.grp = b.grp AND a.fit >= b.cs),
  rc_smap AS MATERIALIZED (
    SELECT a.doc_id, a.grp, a.k AS e, b.k AS i0
    FROM (SELECT * FROM rc_pcs2 WHERE n_next IS NOT NULL) a
    ASOF JOIN rc_pcs2 b ON a.doc_id = b.doc_id AND a.grp = b.grp AND a.thr <= b.cs_prev),
  rc_step AS MATERIALIZED (
    SELECT em.doc_id, em.grp, em.s, em.e,
           CASE WHEN sm.i0 IS NULL THEN NULL ELSE greatest(em.s, sm.i0) END AS s_next
    FROM rc_emap em LEFT JOIN rc_smap sm ON sm.doc_id = em.doc_id AND sm.grp = em.grp AND sm.e = em.e),
  rc_chain AS (
    WITH RECURSIVE ch(doc_id, grp, c, s) AS (
      SELECT DISTINCT doc_id, grp, 1, CAST(1 AS BIGINT) FROM rc_pcs2
      UNION ALL
      SELECT ch.doc_id, ch.grp, ch.c + 1, st.s_next
      FROM ch JOIN rc_step st ON st.doc_id = ch.doc_id AND st.grp = ch.grp AND st.s = ch.s
      WHERE st.s_next IS NOT NULL)
    SELECT ch.doc_id, ch.grp, ch.c, ch.s, st.e
    FROM ch JOIN rc_step st ON st.doc_id = ch.doc_id AND st.grp = ch.grp AND st.s = ch.s),
  rc_txt AS (
    SELECT c.doc_id, c.grp, c.c, any_value(p.src) AS src,
           regexp_replace(string_agg(p.piece, '' ORDER BY p.k), '^\\s+|\\s+$', '', 'g') AS content
    FROM rc_chain c JOIN rc_pc p ON p.doc_id = c.doc_id AND p.grp = c.grp AND p.k BETWEEN c.s AND c.e
    GROUP BY c.doc_id, c.grp, c.c),
  rc_ok AS (
    SELECT src, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp, c) - 1 AS INTEGER) AS chunk_id,
           content FROM rc_txt WHERE content <> ''),
  rc_out AS (
    SELECT sha1(src || CAST(doc_id AS VARCHAR) || CAST(chunk_id AS VARCHAR) || content) AS id,
           src AS source, doc_id AS doc_index, chunk_id, content FROM rc_ok)"""


SQL["chunk_recursive"] = f"WITH {_recursive_chunks(_DOCNAME)} SELECT * FROM rc_out"


SQL["snippets"] = """
SELECT doc_id, regexp_replace(substr(coalesce(text, ''), 1, 300), '\\s+', ' ', 'g') AS snippet FROM documents"""

SQL["document_names"] = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN coalesce(nullif(source, ''), 'unknown')
                               WHEN 1 THEN coalesce(nullif(lang, ''), 'unknown') ELSE 'unknown' END AS name,
       length(coalesce(text, ''))::BIGINT AS n_chars FROM documents"""

SQL["collection_records"] = """
WITH r AS (SELECT d.doc_id AS id, d.lang || '/' || CAST(d.doc_id AS VARCHAR) || '.pdf' AS source, len(e.embedding) AS dim
           FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT id, 'doc_' || CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS pos_id, dim::BIGINT AS dim, source,
       source AS pdf, '/pdf/' || source AS pdf_url, '' AS module, 'http://localhost:3000/files/' || source AS url FROM r"""

SQL["whole_replies"] = """
SELECT conv_id, turn, upper(regexp_replace(chr(32) || chr(10) || replace(text, 'ß', 'ss') || chr(9) || chr(32) || chr(10),
                                           '^\\s+|\\s+$', '', 'g')) AS reply FROM conversations"""

SQL["answer_forms"] = f"""
WITH a AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS z, text FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id, turn, CASE WHEN z IN (0, 1) OR text = '' THEN NULL ELSE text END AS answer,
             CASE WHEN z IN (1, 2) THEN NULL ELSE 'label' END AS label,
             CASE WHEN z IN (2, 3) THEN NULL ELSE 'http://x/y' END AS link FROM a),
g AS (SELECT *, coalesce(answer, 'No answer provided.') AS s FROM f),
h AS (SELECT *, regexp_replace(s, '\\*({_NL}*?)\\*', '<strong>\\1</strong>', 'g') AS s1 FROM g),
i AS (SELECT *, regexp_replace(regexp_replace(s1, '(?m)^\\* ({_NL}*)$', '<li>\\1</li>', 'g'), '(?m)^[0-9]+\\. ({_NL}*)$', '<li>\\1</li>', 'g') AS s2 FROM h),
k AS (SELECT *, regexp_replace(s2, '(<li>[\\s\\S]*?</li>)', '<ul>\\1</ul>', 'g') AS s3 FROM i),
l AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s3, '\\n{{2,}}', '<br><br>', 'g'), '\\n', '<br>', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM k)
SELECT conv_id, turn, coalesce(answer, 'No answer returned') AS answer, coalesce(label, 'No source label') AS source_label,
       coalesce(link, 'No source link') AS source_link,
       md5(body || CASE WHEN link IS NULL THEN '' ELSE '<br><br><div><strong>Source PDF:</strong> <a href="' || link
           || '" target="_blank">' || coalesce(label, 'Open PDF') || '</a></div>' END) AS html_md5 FROM l"""

SQL["collection_size"] = "SELECT count(*) AS n FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"

SQL["top_folders"] = f"WITH {TREE} SELECT path, name, type FROM tree WHERE parent_path IS NULL"

SQL["top1_source"] = f"""
WITH {HITS} SELECT q.qid, c.source AS file FROM q LEFT JOIN hits h ON h.qid = q.qid AND h.rk = 1 LEFT JOIN coll c ON c.id = h.id"""

SQL["archive_text"] = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\n\\r<>&]', ' ', 'g') AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.pptx' ELSE '.docx' END AS name,
       CASE WHEN doc_id % 2 = 0 THEN t || chr(10) || 'doc' || chr(10) || CAST(doc_id AS VARCHAR) || chr(10)
            ELSE t || chr(10) || chr(10) || 'doc ' || CAST(doc_id AS VARCHAR) END AS text, 'ok' AS status FROM d"""

SQL["upsert_twice"] = """
WITH d AS (SELECT doc_id AS id, min({'source': source, 'n_chars': n_chars}) AS r FROM documents GROUP BY doc_id)
SELECT id, r.source AS source, r.n_chars AS n_chars, 0::BIGINT AS added_last FROM d"""

SQL["answer_batch_recursive"] = _answer_sql(recursive=True)

SQL["whole_docs"] = """
WITH d AS (SELECT concat_ws('-', source, CAST(doc_id AS VARCHAR)) AS name, md5(coalesce(text, '')) AS text_md5 FROM documents)
SELECT name, text_md5 FROM d UNION ALL SELECT name || '-null', md5('') FROM d UNION ALL SELECT name || '-empty', md5('') FROM d"""

SQL["json_rows"] = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"

SQL["file_bytes"] = "SELECT sum(strlen(coalesce(text, '')) + 1)::BIGINT AS n_bytes FROM documents"

# nodes in the order of a walk: each opens its text, and closes it behind all its children
SQL["tree_json"] = f"""
WITH {TREE},
nd AS (SELECT path, name, type, link, string_split(path, '/') AS k FROM tree),
o AS (SELECT k[1] AS top, k, row_number() OVER (PARTITION BY k[:-2] ORDER BY k) AS nth, len(k) AS d, name, type, link FROM nd),
ev AS (SELECT top, list_append(list_transform(k, lambda x: '1' || x), '0') AS ord,
             CASE WHEN d = 1 THEN '' ELSE (CASE WHEN nth > 1 THEN ',' ELSE '' END) || to_json(name)::VARCHAR || ':' END
             || '{{"type":"' || type || '","name":' || to_json(name)::VARCHAR
             || CASE WHEN type = 'file' THEN ',"link":' || coalesce(to_json(link)::VARCHAR, 'null') ELSE ',"children":{{' END AS t FROM o
      UNION ALL
      SELECT top, list_append(list_transform(k, lambda x: '1' || x), '2'), CASE WHEN type = 'file' THEN '}}' ELSE '}}}}' END FROM o)
SELECT top AS name, string_agg(t, '' ORDER BY ord) AS json FROM ev GROUP BY top"""

SQL["model_lengths"] = """
SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars,
       (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::BIGINT AS n_spaces FROM documents"""

SQL["answer_stream"] = SQL["answer_batch"]

SQL["ingest_archives"] = f"""
WITH a AS ({SQL["archive_text"]}),
w AS (SELECT name AS source, i AS chunk_id, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1200) AS content
      FROM a, range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 1200) / 1000.0) AS BIGINT) + 1 END) r(i)),
k AS (SELECT source, chunk_id, unnest(string_split_regex(lower(content), '[ \\t\\n\\x0b\\f\\r]+')) AS tok FROM w),
c AS (SELECT source, chunk_id, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS b, CAST(count(*) AS DOUBLE) AS n
      FROM k WHERE tok <> '' GROUP BY 1, 2, 3),
m AS (SELECT source, chunk_id, map(list(b), list(n)) AS m, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1, 2)
SELECT w.source, CAST(w.chunk_id AS INTEGER) AS chunk_id, content, '/pdf/' || w.source AS pdf_url, 'hash-64' AS embedder,
       array_to_string(list_transform(range(64), lambda i: CAST(round(coalesce(m.m[i] / m.norm, 0) * 10000) AS BIGINT)::VARCHAR), ',') AS vector_code
FROM w LEFT JOIN m ON m.source = w.source AND m.chunk_id = w.chunk_id"""
