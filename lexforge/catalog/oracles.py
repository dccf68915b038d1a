"""DuckDB SQL for the queries of this package that SQL can express.

Lambdas are written ``lambda x: ...``; regular expressions keep to what RE2 has. The test
tables hold no characters that Unicode's white space and RE2's would treat differently.
"""

from __future__ import annotations

_SCORE = "CASE WHEN value / 100 <= 1.2 THEN value / 100 END"

#: Lines as the cleaner sees them, with what decides their fate.
_LINES = r"""
raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents
), stripped AS (
  SELECT doc_id, k, regexp_replace(regexp_replace(l, '^\s+', ''), '\s+$', '') AS l FROM raw
), candidate AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY k) AS n FROM stripped
  WHERE l <> '' AND NOT regexp_full_match(l, '第\s*\d+\s*页|-\s*\d+\s*-|Page\s*\d+|page\s*\d+') AND regexp_matches(l, '[\pL\pN]')
), few AS (
  SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM candidate WHERE n <= 3 OR length(l) < 2
), kept AS (
  SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM few WHERE before IS DISTINCT FROM l
)
"""

#: Cleaned document texts.
_CLEANED = _LINES + r""", cleaned AS (
  SELECT d.doc_id, d.source, CASE WHEN d.text = '' THEN '' ELSE coalesce(regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', ''), '') END AS content
  FROM documents d LEFT JOIN (SELECT doc_id, string_agg(regexp_replace(l, ' {2,}', ' ', 'g'), chr(10) || chr(10) ORDER BY pos) AS t FROM kept GROUP BY doc_id) USING (doc_id)
)
"""


def _tokens(table: str, key: str, text: str, name: str) -> str:
    """(name, token, length), a row per token."""
    return rf"""(SELECT {name}, unnest(w) AS token, len(w) AS length FROM (
      SELECT {key} AS {name}, list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda x: x <> '') AS w FROM {table}))"""


def _bm25(docs: str, doc_key: str, doc_text: str, queries: str, query_key: str, query_text: str, p: str = "") -> str:
    return rf"""
{p}post AS (
  SELECT doc, token, count(*) AS tf, any_value(length) AS length FROM {_tokens(docs, doc_key, doc_text, 'doc')} GROUP BY doc, token
), {p}size AS (
  SELECT count(*) AS n_docs, avg(len(list_filter(regexp_split_to_array(lower({doc_text}), '\s+'), lambda x: x <> ''))) AS mean_length FROM {docs}
), {p}idf AS (
  SELECT token, count(*) AS df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {p}post, {p}size GROUP BY token
), {p}asked AS (
  SELECT query, token, count(*) AS weight FROM {_tokens(queries, query_key, query_text, 'query')} GROUP BY query, token
), {p}bm25 AS (
  SELECT query, doc, round(sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 9) AS score
  FROM {p}post JOIN {p}idf USING (token) JOIN {p}asked USING (token), {p}size GROUP BY query, doc
)"""


def _parents(text: str, docs: str, key: str = "doc_id", extra: str = "") -> str:
    return f"""parents AS (
  SELECT {key}, {extra} {key}::VARCHAR || '_' || i || '_parent' AS id, i AS chunk_index, total_chunks, substr({text}, i * 1940 + 1, 2000) AS content
  FROM (SELECT *, unnest(range(total_chunks)) AS i FROM (SELECT *, ((length({text}) + 1939) // 1940)::INT AS total_chunks FROM {docs}))
)"""


_CHILDREN = """children AS (
  SELECT * EXCLUDE (id, content, chunk_index, total_chunks), id AS parent_id, content AS parent_content, i AS chunk_index, id || '_' || i || '_child' AS id, substr(content, i * 340 + 1, 400) AS content
  FROM (SELECT *, unnest(range(((length(content) + 339) // 340)::INT)) AS i FROM parents)
)"""

_DENSE = """dense AS (
  SELECT query, doc, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (
      SELECT q.vec_id AS query, v.vec_id AS doc, round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score
      FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 {where})) WHERE rank <= 16
)"""
_DENSE_ALL = _DENSE.replace("{where}", "")

_HITS = _DENSE_ALL + """, hits AS (
  SELECT query, doc AS id, 'c' || doc AS content, score, label::VARCHAR AS source, 'p' || (doc // 5) AS parent_id, 'text of p' || (doc // 5) AS parent_content, rank
  FROM dense JOIN embeddings ON doc = vec_id
)"""

_TO_PARENTS = _HITS + """, grouped AS (
  SELECT query, parent_id AS id, arg_min(parent_content, rank) AS content, arg_min(source, rank) AS source, max(score) AS score,
         list(content ORDER BY score DESC, rank)[1] AS rerank_content, list(id ORDER BY rank)[1:5] AS children_ids, min(rank) AS place
  FROM hits GROUP BY query, parent_id
), parent_rows AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rank FROM grouped
)"""

_METRICS = f"""m AS (
  SELECT 'q' || (event_id % 997) AS question, event_type AS judge, event_id % 7 AS chunk, event_id AS position,
         CASE WHEN event_id % 11 > 0 THEN s END AS faithfulness, s AS answer_relevancy, CASE WHEN event_id % 13 > 0 THEN s END AS context_precision, s / 4 AS context_recall
  FROM (SELECT *, {_SCORE} AS s FROM events)
), ok AS (
  SELECT *, coalesce(faithfulness BETWEEN 0 AND 1 AND answer_relevancy BETWEEN 0 AND 1 AND context_precision BETWEEN 0 AND 1 AND context_recall BETWEEN 0 AND 1, false) AS good FROM m
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY question, good ORDER BY chunk, position) AS n FROM ok
)"""

_PAIRS = f"""s AS (
  SELECT event_id, 'q' || (event_id // 2) AS q, CASE WHEN f BETWEEN 0 AND 1 THEN f END AS f, CASE WHEN a BETWEEN 0 AND 1 THEN a END AS a
  FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN {_SCORE} END AS f, ({_SCORE}) / 2 AS a FROM events)
), pairs AS (
  SELECT q, o.f AS oF, o.a AS oAR, g.f AS gF, g.a AS gAR FROM (SELECT DISTINCT q FROM s)
  LEFT JOIN (SELECT * FROM s WHERE event_id % 2 = 0) o USING (q) LEFT JOIN (SELECT * FROM s WHERE event_id % 2 = 1) g USING (q)
)"""

_CACHE = """stored AS (
  SELECT 'k' || event_id AS key, event_type AS value, CASE WHEN value < 90 THEN ts END AS expires_at FROM events WHERE value >= 40
)"""

_FAQ = "faq AS (SELECT item_id AS id, text AS question, 'a: ' || substr(text, 1, 20) AS answer FROM benchmark)"
_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"

ORACLES: dict[str, str] = {
    "clean_lines_keep": f"WITH {_LINES} SELECT doc_id, pos::INT AS pos, l AS line FROM kept",
    "clean_document_text": f"WITH {_CLEANED} SELECT doc_id, content FROM cleaned",
    "doc_title": r"""
WITH l AS (
  SELECT doc_id, k, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS x FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))[1:10]) AS x, unnest(range(len(string_split(text, chr(10))[1:10]))) AS k FROM documents)
), f AS (
  SELECT doc_id, arg_min(x, k) AS x FROM l
  WHERE (x LIKE '# %' AND length(x) < 100) OR (length(x) < 50 AND regexp_matches(x, '^\p{Lu}') AND x NOT LIKE '%.' AND len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) < 10)
  GROUP BY doc_id
)
SELECT doc_id, CASE WHEN x LIKE '# %' AND length(x) < 100 THEN trim(substr(x, 3)) ELSE x END AS title FROM documents LEFT JOIN f USING (doc_id)""",
    "doc_keywords_top5": r"""
WITH t AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 1) AS w FROM documents)
), g AS (
  SELECT doc_id, word, count(*) AS n, min(i) AS first FROM t GROUP BY doc_id, word
), r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) - 1 AS rank FROM g
)
SELECT doc_id, rank::INT AS rank, word FROM r WHERE rank < 5""",
    "doc_counts": r"SELECT doc_id, length(text)::INT AS char_count, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS word_count FROM documents",
    "faq_cleaned": r"""
WITH c AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ ', ''), ' $', '') AS t, text FROM benchmark)
SELECT t AS question, t AS answer, 's' AS source, 'd' AS doc_name, length('作者：x 浏览专业版 ' || text || ' 版权所有。')::INT AS length_before, true AS changed FROM c""",
    "cleaning_statistics": r"""
WITH c AS (SELECT regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ ', ''), ' $', '') AS t, text FROM benchmark)
SELECT count(*) AS total, count(*) AS kept, 0::BIGINT AS dropped, count(*) FILTER (WHERE t <> text) AS changed, round(avg(length(text)), 6) AS mean_before, round(avg(length(t)), 6) AS mean_after FROM c""",
    "filter_source_length": "SELECT doc_id, source FROM documents WHERE source = 'src1' AND length(text) >= 100",
    "score_threshold": f"SELECT event_id, round(s, 6) AS score FROM (SELECT event_id, {_SCORE} AS s FROM events) WHERE s >= 0.5",
    "chunk_parents": f"WITH {_parents('text', 'documents')} SELECT doc_id, id, chunk_index::INT AS chunk_index, total_chunks, content FROM parents",
    "chunk_children": f"WITH {_parents('text', 'documents')}, {_CHILDREN} SELECT doc_id, id, parent_id, chunk_index::INT AS chunk_index, content FROM children",
    "chunk_structure_audit": f"""
WITH {_parents('text', 'documents')}, {_CHILDREN}, n AS (SELECT (SELECT count(*) FROM parents) AS parents, (SELECT count(*) FROM children) AS children)
SELECT parents + children AS total, parents, children, 0::BIGINT AS without_text, 0::BIGINT AS dangling, children > 0 AS sound, round(children / parents, 4) AS ratio FROM n""",
    "dedupe_chunks": "SELECT md5(text) AS id, min(doc_id) AS seq, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)",
    "chunk_type_repair": "SELECT vec_id AS id, CASE WHEN vec_id % 3 > 0 THEN 'p' || (vec_id // 5) END AS parent_id, CASE WHEN vec_id % 3 > 0 THEN 'child' ELSE 'parent' END AS chunk_type FROM embeddings",
    "l1_split": """
SELECT doc_id AS query, 'h' || doc_id || '_' || i || '_l1child' AS id, 'h' || doc_id AS parent_id, i::INT AS piece, substr(text, i * 340 + 1, 400) AS content
FROM (SELECT *, unnest(range(greatest((length(text) + 339) // 340, 1)::INT)) AS i FROM documents)""",
    "bm25_idf": f"WITH {_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bm25_top5": f"""
WITH {_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25)
SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "bm25_softmax": f"""
WITH {_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25 WHERE score > 0),
t AS (SELECT *, max(score) OVER (PARTITION BY query) AS top, count(*) OVER (PARTITION BY query) AS found FROM r WHERE rank <= 5),
e AS (SELECT *, exp(score - top) AS e FROM t)
SELECT query, doc, rank::INT AS rank, round(e / (sum(e) OVER (PARTITION BY query) + greatest(least(n_docs, 5) - found, 0) * exp(-top)), 6) AS probability FROM e, size""",
    "faq_exact_gate": f"""
WITH {_FAQ}, q AS (SELECT item_id AS query, CASE WHEN item_id % 2 = 0 THEN '  ' || text || chr(10) ELSE text || ' x' END AS question FROM benchmark)
SELECT query, id AS faq_id, answer FROM q JOIN faq ON {_TRIM.format('q.question')} = {_TRIM.format('faq.question')} AND {_TRIM.format('q.question')} <> ''""",
    "faq_ranked_gate": f"""
WITH {_FAQ}, {_bm25('benchmark', 'item_id', 'text', 'benchmark', 'item_id', 'text')}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25 WHERE score > 0),
p AS (SELECT *, exp(score - max(score) OVER (PARTITION BY query)) / sum(exp(score - top)) OVER (PARTITION BY query) AS p FROM (SELECT *, max(score) OVER (PARTITION BY query) AS top FROM r WHERE rank <= 5))
SELECT p.query, faq.id AS faq_id, faq.answer, 0.95::DOUBLE AS confidence, 'faq' AS intent, 'faq_fast_channel' AS strategy, 'faq:v3:' || md5({_TRIM.format('b.text')}) AS cache_key
FROM p JOIN faq ON p.doc = faq.id JOIN benchmark b ON p.query = b.item_id
WHERE p.rank = 1 AND p.p >= 0.5 AND {_TRIM.format('b.text')} = {_TRIM.format('faq.question')}""",
    "faq_category_stats": "SELECT event_type AS category, count(*) AS n, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS recent FROM events GROUP BY event_type",
    "faq_upsert": f"WITH {_FAQ} SELECT id, question, CASE WHEN length(question) < 80 THEN 'new' WHEN length(question) < 140 THEN 'old' ELSE answer END AS answer FROM faq WHERE length(question) < 80 OR length(question) >= 120",
    "bm25_best_all_pairs": f"WITH {_bm25('documents', 'doc_id', 'text', 'benchmark', 'item_id', 'text')} SELECT query, count(*) AS n, round(max(score), 6) AS best FROM bm25 GROUP BY query",
    "dense_topk": f"WITH {_DENSE_ALL} SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM dense",
    "dense_topk_filtered": f"WITH {_DENSE.replace('{where}', 'AND v.label = 3')} SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM dense",
    "sparse_topk": f"""
WITH d AS (SELECT doc, token, ln(1 + count(*)) AS w FROM {_tokens('documents', 'doc_id', 'text', 'doc')} GROUP BY doc, token),
q AS (SELECT query, token, ln(1 + count(*)) AS w FROM {_tokens('benchmark', 'item_id', 'text', 'query')} GROUP BY query, token),
s AS (SELECT query, doc, round(sum(d.w * q.w), 9) AS score FROM d JOIN q USING (token) GROUP BY query, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 16""",
    "hybrid_fusion_topk": f"""
WITH {_DENSE_ALL}, {_bm25('documents', 'doc_id', 'text', '(SELECT item_id * 100 AS item_id, text FROM benchmark)', 'item_id', 'text')},
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25 WHERE query IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)) WHERE rank <= 16),
f AS (SELECT query, doc, coalesce(0.5 + atan(d.score) / pi(), 0) + 0.7 * coalesce(0.5 + atan(s.score) / pi(), 0) AS score FROM dense d FULL JOIN sparse s USING (query, doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f)
SELECT query, doc, round(score, 6) AS score FROM r WHERE rank <= 16""",
    "title_anchor_match": """
WITH t AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:3][-2:], ' ') AS title FROM documents),
h AS (SELECT item_id AS query, title FROM benchmark JOIN t ON contains(text, title) AND length(title) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY length(title) DESC, title) AS rank FROM h)
SELECT query, title, rank::INT AS rank FROM r WHERE rank <= 2""",
    "multi_query_merge": f"""
WITH {_DENSE_ALL}, b AS (SELECT query % 300 AS "group", doc AS id, max(score) AS score FROM dense GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, id) AS rank FROM b)
SELECT "group", id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 16""",
    "small_to_big_parents": f"""
WITH {_TO_PARENTS} SELECT query, id, content, rerank_content, source, array_to_string(children_ids, ',') AS children_ids, rank::INT AS rank, round(score, 6) AS score FROM parent_rows""",
    "ingest_rows": f"""
WITH {_CLEANED}, {_parents('content', 'cleaned', extra='source,')}, {_CHILDREN}
SELECT id, 'parent' AS chunk_type, source, md5(content) AS hash_id, 64::INT AS n_dense FROM parents UNION ALL SELECT id, 'child', source, md5(content), 64 FROM children""",
    "sampled_fragment": r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: NOT starts_with(x, '#') AND length(x) >= 30) AS l FROM documents),
b AS (SELECT doc_id, array_to_string(l, chr(10)) AS b FROM l),
w AS (SELECT doc_id, substr(b, (('0x' || substr(md5(doc_id || ':0'), 1, 15))::BIGINT % greatest(length(b) - 1599, 1) + 1)::BIGINT, 1600) AS w FROM b),
f AS (SELECT doc_id, CASE WHEN instr(w, '。') BETWEEN 1 AND 120 THEN substr(w, instr(w, '。') + 1) ELSE w END AS fragment FROM w)
SELECT doc_id, length(fragment)::INT AS n, fragment FROM f""",
    "cache_key_sha256": r"""
SELECT item_id AS query, 'query:v3:' || sha256('[' || to_json(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''))::VARCHAR || ', null, "direct", []]') AS key FROM benchmark""",
    "html_article_text": r"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages),
t AS (SELECT page_id, list_transform(regexp_split_to_array(a, '(?s)<!--.*?-->|<[a-zA-Z/][^>]*>'), lambda x: replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&lt', '<'), '&gt;', '>'), '&gt', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '&amp', '&')) AS t FROM a)
SELECT page_id, array_to_string(list_filter(list_transform(t, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> ''), chr(10)) AS text FROM t""",
    "html_article_markdown": r"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS a FROM pages),
h AS (SELECT page_id, title, trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1), '&lt;', '<'), '&lt', '<'), '&gt;', '>'), '&gt', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '&amp', '&'), ' ' || chr(10)) AS h1, regexp_replace(a, '(?s)^.*?</h1>', '') AS rest FROM a),
m AS (SELECT page_id, title, CASE WHEN h1 = title OR h1 = '' THEN '' ELSE '## ' || h1 || chr(10) || chr(10) END
  || replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(rest, '</?p>', chr(10) || chr(10), 'g'), '<br>', chr(10), 'g'), '</?b>', '', 'g'), '&lt;', '<'), '&lt', '<'), '&gt;', '>'), '&gt', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&'), '&amp', '&') AS m FROM h)
SELECT page_id, '# ' || title || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(m, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') || chr(10) AS markdown FROM m""",
    "markdown_normalized": r"""
SELECT doc_id, regexp_replace('# a' || regexp_replace(chr(10) || chr(10) || coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '\s+$', '') AS content FROM documents""",
    "small_to_big_lexical": f"""
WITH {_CLEANED}, {_parents('content', 'cleaned', extra='source,')}, {_CHILDREN}, {_bm25('children', 'id', 'content', 'benchmark', 'item_id', 'text')},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm25) WHERE rank <= 16),
g AS (SELECT query, parent_id AS id, max(score) AS score, min(rank) AS place FROM top JOIN children c ON top.doc = c.id GROUP BY query, parent_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, place) AS rank FROM g)
SELECT query, id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 2""",
    "subquery_merge": f"""
WITH {_TO_PARENTS}, b AS (SELECT query % 300 AS "group", query // 300 AS branch, * FROM parent_rows),
u AS (SELECT "group", id, branch, rank, unnest(children_ids) AS c, unnest(range(len(children_ids))) AS k FROM b),
f AS (SELECT "group", id, string_agg(c::VARCHAR, ',' ORDER BY branch, rank, k) AS children_ids FROM (SELECT *, row_number() OVER (PARTITION BY "group", id, c ORDER BY branch, rank, k) AS n FROM u) WHERE n = 1 GROUP BY "group", id),
g AS (SELECT "group", id, max(score) AS score, list(rerank_content ORDER BY score DESC, branch, rank)[1] AS rerank_content, min(struct_pack(a := branch, b := rank)) AS place FROM b GROUP BY "group", id),
r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, place) AS rank FROM g)
SELECT "group", id, rank::INT AS rank, rerank_content, children_ids, round(score, 6) AS score FROM r JOIN f USING ("group", id)""",
    "tiered_levels": """
SELECT vec_id AS query, CASE WHEN vec_id % 900 = 0 THEN 2 WHEN vec_id % 300 = 0 THEN 0 WHEN vec_id % 300 = 100 THEN 1 ELSE 2 END AS degrade_level,
       NOT (vec_id % 300 = 0 AND vec_id % 900 <> 0) AS degraded,
       CASE WHEN vec_id % 900 = 0 THEN 'retrieval_error' WHEN vec_id % 300 = 0 THEN '' WHEN vec_id % 300 = 100 THEN 'child_recall_empty' ELSE 'no_recall' END AS degrade_reason,
       CASE WHEN vec_id % 300 = 0 THEN 4 ELSE 0 END::BIGINT AS orphan_count
FROM embeddings WHERE vec_id % 100 = 0""",
    "merged_levels": """
WITH s AS (SELECT vec_id % 700 AS "group", vec_id // 700 AS branch, (vec_id // 100) % 3 AS level, 'r' || ((vec_id // 100) % 3) AS reason, (vec_id // 100) % 2 AS n_docs FROM embeddings WHERE vec_id % 100 = 0),
g AS (SELECT "group", coalesce(max(level) FILTER (WHERE n_docs > 0), max(level)) AS degrade_level, count(*)::BIGINT AS orphan_count FROM s GROUP BY "group")
SELECT "group", degrade_level::INT AS degrade_level, (SELECT arg_min(reason, branch) FROM s WHERE s."group" = g."group" AND s.level = g.degrade_level) AS degrade_reason, orphan_count FROM g""",
    "recovered_parents": f"""
WITH {_HITS}, g AS (SELECT query, parent_id AS id, max(score) AS score, arg_min(parent_content, rank) AS content, count(*) AS children_count FROM hits GROUP BY query, parent_id)
SELECT query, id, content, children_count, (row_number() OVER (PARTITION BY query ORDER BY score DESC, id))::INT AS rank, round(score, 6) AS score FROM g""",
    "rerank_group_scores": f"WITH {_HITS} SELECT query, parent_id, count(*) AS children_count, round(greatest(0, max(score - 0.9)), 6) AS max_score FROM hits GROUP BY query, parent_id",
    "rerank_top2": f"""
WITH {_TO_PARENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (rank = 3) DESC, length(content) - rank / 100 DESC, rank) AS k FROM parent_rows)
SELECT query, id, k::INT AS rank FROM r WHERE k <= 2""",
    "context_blocks": f"""
WITH {_TO_PARENTS} SELECT query, string_agg('【知识来源' || rank || '】' || chr(10) || CASE WHEN source <> 'unknown' THEN '【文档标题：' || source || '】' || chr(10) ELSE '' END || content, chr(10) || chr(10) ORDER BY rank) AS context
FROM parent_rows WHERE rank <= 2 GROUP BY query""",
    "degrade_metrics": "SELECT count(*) AS total, round(count(*) FILTER (WHERE event_id % 3 = 1) / count(*), 4) AS l1_rate, round(count(*) FILTER (WHERE event_id % 3 = 2) / count(*), 4) AS l2_rate FROM events",
    "valid_score_mean": f"""
SELECT event_type, round(avg(s) FILTER (WHERE s BETWEEN 0 AND 1), 6) AS mean_score, count(*) FILTER (WHERE s BETWEEN 0 AND 1) AS n_valid, count(*) FILTER (WHERE s = 0) AS n_zero
FROM (SELECT *, {_SCORE} AS s FROM events) GROUP BY event_type""",
    "complete_pair_rows": f"WITH {_PAIRS} SELECT q, round(oF, 6) AS oF, round(oAR, 6) AS oAR, round(gF, 6) AS gF, round(gAR, 6) AS gAR FROM pairs",
    "metric_summary": f"""
WITH {_METRICS} SELECT count(*) AS total, count(*) FILTER (WHERE good) AS complete_count, count(*) FILTER (WHERE faithfulness BETWEEN 0 AND 1) AS n_faithfulness,
  count(*) FILTER (WHERE answer_relevancy BETWEEN 0 AND 1) AS n_answer_relevancy, count(*) FILTER (WHERE context_precision BETWEEN 0 AND 1) AS n_context_precision, count(*) FILTER (WHERE context_recall BETWEEN 0 AND 1) AS n_context_recall FROM ok""",
    "merge_reports_dedupe": f"WITH {_METRICS} SELECT question, judge, chunk, position FROM placed WHERE good AND n = 1",
    "merge_reports_counts": f"WITH {_METRICS} SELECT count(*) FILTER (WHERE good AND n = 1) AS total, count(*) FILTER (WHERE NOT good) AS invalid, count(*) FILTER (WHERE good AND n > 1) AS duplicate FROM placed",
    "judge_means": f"WITH {_METRICS} SELECT judge, count(*) AS n, round(avg(faithfulness), 6) AS faithfulness, round(avg(context_recall), 6) AS context_recall FROM placed WHERE good AND n = 1 GROUP BY judge",
    "retry_fill": f"""
WITH {_METRICS}, f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY question ORDER BY position) = 1), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY question ORDER BY position DESC) = 1)
SELECT f.question, f.position, coalesce(f.faithfulness BETWEEN 0 AND 1, false) OR coalesce(l.answer_relevancy BETWEEN 0 AND 1, false) AS has_faithfulness,
       coalesce(f.context_precision BETWEEN 0 AND 1, false) OR coalesce(l.context_precision BETWEEN 0 AND 1, false) AS has_precision FROM f JOIN l USING (question)""",
    "composite_score": f"WITH {_METRICS} SELECT position, round((0.0 + faithfulness + answer_relevancy + context_precision + context_recall) / 4, 9) AS composite FROM m",
    "judge_cell_counts": f"""
WITH {_METRICS}, c AS (SELECT judge, unnest(['faithfulness', 'answer_relevancy', 'context_precision', 'context_recall']) AS metric, unnest([faithfulness, answer_relevancy, context_precision, context_recall]) AS v FROM m)
SELECT judge, metric, count(*) AS n FROM c WHERE v BETWEEN 0 AND 1 GROUP BY judge, metric""",
    "score_histogram": f"""
SELECT CASE WHEN s IS NULL THEN 'none' WHEN s = 0 THEN '=0' WHEN s < 0.2 THEN '<0.2' WHEN s < 0.4 THEN '<0.4' WHEN s < 0.6 THEN '<0.6' WHEN s < 0.8 THEN '<0.8' ELSE '>=0.8' END AS bucket, count(*) AS n
FROM (SELECT {_SCORE} AS s FROM events) GROUP BY 1""",
    "quartile_strata": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, (SELECT max(b) FROM range(4) t(b) WHERE i >= b * n // 4)::INT AS stratum FROM r""",
    "stratum_sample": "SELECT s::INT AS stratum, 5::BIGINT AS n FROM range(4) t(s)",
    "round_robin_slices": "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3)::INT AS slice FROM conversations",
    "contiguous_chunks": "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::INT AS chunk FROM conversations",
    "equal_chunks": "SELECT conv_id, turn, (ntile(2) OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk FROM conversations",
    "todo_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "asked_semi_join": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "resume_union": "SELECT doc_id, 'cached' AS origin FROM labels UNION ALL SELECT doc_id, 'fresh' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "ground_truth_join": """
WITH t AS (SELECT text AS q, 't' || max(doc_id) AS g FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT doc_id, coalesce(g, '') AS ground_truth FROM documents LEFT JOIN t ON text = q""",
    "frozen_context_check": "SELECT 'q' || doc_id AS question, source || ',' || lang AS contexts FROM documents",
    "template_cross_join": "SELECT r_name || ' has ' || n_name AS text FROM region, nation",
    "arm_coverage": "SELECT 1::BIGINT AS missing, 0::BIGINT AS extra, false AS complete",
    "stratified_split_counts": """
WITH n AS (SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality), t AS (SELECT label, n, least(greatest(floor(n * 0.9), 1), n - 1)::BIGINT AS k FROM n)
SELECT label, 'train' AS part, k AS n FROM t UNION ALL SELECT label, 'validation', n - k FROM t""",
    "balanced_counts": "WITH n AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY toxic) SELECT label, (SELECT min(n) FROM n) AS n FROM n",
    "intent_distinct_samples": "SELECT (length(t) % 2)::INT AS label, count(*) AS n FROM (SELECT DISTINCT regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM documents) GROUP BY 1",
    "probe_substitution": """
WITH p AS (SELECT doc_id, text, CASE WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'de') THEN 'de' WHEN contains(text, 'en') THEN 'en' END AS o FROM documents)
SELECT doc_id, md5(coalesce(substr(text, 1, instr(text, o) - 1) || upper(o) || substr(text, instr(text, o) + length(o)), '')) AS probe_md5, o IS NULL AS "none" FROM p""",
    "confusion_counts": "SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL",
    "accuracy_report": """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 - toxic) AS good, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS hit, count(*) FILTER (WHERE toxic = 0) AS said, count(*) FILTER (WHERE quality = 1) AS true_n FROM labels)
SELECT n, round(good / n, 4) AS accuracy, round(hit / said, 4) AS "precision", round(hit / true_n, 4) AS recall, round(2 * hit / (said + true_n), 4) AS f1 FROM c""",
    "strategy_timing": "SELECT event_type AS strategy, count(*) FILTER (WHERE event_id % 4 > 0) AS success_count, round(avg(value), 6) AS avg_time FROM events GROUP BY event_type",
    "run_statistics": """
SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 5 = 0 OR text = '') AS empty_answers, count(*) FILTER (WHERE doc_id % 3 = 0) AS empty_contexts, count(*) FILTER (WHERE doc_id % 7 = 0) AS degraded,
       round(avg(CASE WHEN doc_id % 3 > 0 THEN 1.0 ELSE 0.0 END), 2) AS mean_contexts FROM documents""",
    "provenance_flags": "SELECT string_agg(lang, ',' ORDER BY lang) AS models, bool_or(lang = 'en') AS self_judge FROM (SELECT DISTINCT lang FROM documents)",
    "report_with_average": """
SELECT 'q' || doc_id AS question, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic, 0 AS is_average FROM labels
UNION ALL SELECT '__average__', round(avg(quality), 4), round(avg(toxic), 4), 1 FROM labels""",
    "cache_key_md5": f"SELECT item_id AS query, 'faq:v3:' || md5({_TRIM.format('text')}) AS key FROM benchmark",
    "text_helpers": r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ ', ''), ' $', '')) AS clean_md5, CASE WHEN length(text) <= 20 THEN text ELSE substr(text, 1, 17) || '...' END AS short,
       false AS zh, regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[^\x00-\x7F]') AS en,
       floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 0.75)::BIGINT AS tokens,
       round(CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE doc_id / (doc_id % 3) END, 6) AS ratio FROM documents""",
    "strategy_names": "SELECT item_id AS query, ['direct', 'hyde', 'subquery', 'backtracking', 'backtracking', 'direct'][item_id % 6 + 1] AS strategy FROM benchmark",
    "sub_question_lines": rf"""
SELECT item_id AS query, 0 AS pos, CASE WHEN item_id % 2 = 0 THEN {_TRIM.format("substr(replace(text, chr(10), ' '), 1, 10)")} ELSE substr(text, 1, 10) END AS part FROM benchmark
UNION ALL SELECT item_id, 1, 'b' FROM benchmark WHERE item_id % 2 = 0""",
    "judge_json_scores": "SELECT item_id AS query, CASE item_id % 6 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE END AS score FROM benchmark",
    "qa_pair_parse": "SELECT item_id AS query, 'q' || item_id AS question, 'a' AS reference_answer FROM benchmark",
    "review_validation": "SELECT item_id AS query, CASE WHEN item_id % 3 > 0 THEN 'ok' END AS answer FROM benchmark",
    "evidence_numbering": r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, len(p)::INT AS n, md5(array_to_string(list_transform(p, lambda x, i: '【证据' || i || '】' || chr(10) || x), chr(10) || chr(10))) AS md5 FROM p""",
    "source_answers": """
WITH r AS (SELECT source, doc_id, '【' || source || '】' || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '…' ELSE text END AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT source, string_agg(t, chr(10) || chr(10) ORDER BY n) AS answer FROM r WHERE n <= 2 GROUP BY source""",
    "session_last5": """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id AS session_id, event_id AS id, (least(n, 5) - b + 1)::INT AS position FROM r WHERE b <= 5""",
    "prompt_last3": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM r WHERE b <= 3 GROUP BY conv_id""",
    "prior_messages": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b > 1",
    "cache_alive": f"""
WITH {_CACHE} SELECT value, count(*) AS n, count(*) FILTER (WHERE expires_at IS NULL) AS forever FROM stored
WHERE expires_at IS NULL OR expires_at > (SELECT min(ts) FROM events WHERE event_type = 'error') GROUP BY value""",
    "cache_put_get": f"""
WITH {_CACHE}, fresh AS (SELECT 'k' || event_id AS key FROM events WHERE value < 20)
SELECT 'k' || e.event_id AS key, CASE WHEN f.key IS NOT NULL THEN 'new' WHEN s.key NOT LIKE 'k9%' THEN s.value END AS value
FROM events e LEFT JOIN fresh f ON f.key = 'k' || e.event_id LEFT JOIN stored s ON s.key = 'k' || e.event_id""",
    "cache_counters": """
WITH a AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'other' END AS key, n_nationkey AS amount FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT key, sum(amount) AS a FROM a GROUP BY key)
SELECT key, (coalesce(CASE WHEN r_name IS NOT NULL THEN 10 END, 0) + coalesce(a, 0))::BIGINT::VARCHAR AS value FROM t FULL JOIN (SELECT r_name, r_name AS key FROM region) USING (key)""",
    "routed_answers": """
SELECT item_id AS query, CASE WHEN length(text) < 80 THEN 'cached' WHEN length(text) < 120 THEN 'a: ' || substr(text, 1, 20) ELSE 'deep' END AS answer,
       CASE WHEN length(text) < 80 THEN 'cache' WHEN length(text) < 120 THEN 'faq' ELSE 'deep' END AS stage, 0 AS degrade_level FROM benchmark""",
    "strategy_branches": """
SELECT item_id AS query, 0 AS branch, CASE item_id % 4 WHEN 1 THEN 'h' WHEN 2 THEN 'a' ELSE substr(text, 1, 8) END AS text FROM benchmark
UNION ALL SELECT item_id, 1, 'b' FROM benchmark WHERE item_id % 4 = 2""",
    "store_prepared": """
SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 4 > 0 THEN 'p' || (vec_id // 5) ELSE '' END AS parent_id, '' AS parent_content, CASE WHEN vec_id % 2 > 0 THEN 's' ELSE 'unknown' END AS source, 7::BIGINT AS timestamp,
       CASE WHEN vec_id % 4 > 0 THEN 'child' ELSE 'parent' END AS chunk_type FROM embeddings""",
    "store_info": f"WITH {_parents('text', 'documents')}, {_CHILDREN} SELECT (SELECT count(*) FROM parents) + (SELECT count(*) FROM children) AS n_rows, (SELECT count(*) FROM parents) AS n_parent, (SELECT count(*) FROM children) AS n_child",
    "safe_file_names": """
WITH h AS (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) || '_x' AS s FROM pages)
SELECT page_id::VARCHAR AS topic_id, CASE WHEN row_number() OVER (PARTITION BY lower(s) ORDER BY page_id) = 1 THEN s ELSE s || '_' || page_id END || '.md' AS file_name FROM h""",
    "source_labels": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '://([^/]*)', 1) ELSE 'a' END AS source FROM pages",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
