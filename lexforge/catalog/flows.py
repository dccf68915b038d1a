"""Queries of evaluation flows, routing, sources and markup, each with its SQL beside it.

All run over the driver's tables; markup that these lack is made of the texts in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, parsing, segment, text as tx
from ..operators import cache, cleaning, evaluation, html_text, inverted, ivf, lexical, merging, sampling, sessions, vectors
from ..plans import ingest, route
from ..shared import Workspace
from ..sources import files
from . import oracles
from .oracles import _DENSE, _DENSE_ALL, _HITS, _METRICS, _PAIRS, _tokens
from .queries import _child_hits, _metric_rows, _pairs, _weights, documents, questions, r6, score_rows, table, vector_queries, vector_rows

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTRY[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- evaluation

@query(f"""
WITH {_PAIRS} SELECT count(*) AS n, round(avg(oF), 4) AS original_F, round(avg(oAR), 4) AS original_AR, round(avg(gF), 4) AS grounded_F, round(avg(gAR), 4) AS grounded_AR,
  round(avg(gF - oF), 4) AS delta_F, round(avg(gAR - oAR), 4) AS delta_AR
FROM pairs WHERE oF IS NOT NULL AND oAR IS NOT NULL AND gF IS NOT NULL AND gAR IS NOT NULL""")
def complete_pair_summary(spark, sf):
    return evaluation.pair_summary(_pairs(spark, sf))


_MEANS = ", ".join(f"avg({m}) FILTER (WHERE {m} BETWEEN 0 AND 1) AS {m}" for m in evaluation.METRICS)


@query(f"""
WITH {_METRICS}, a AS (SELECT {_MEANS} FROM m)
SELECT {', '.join(f'round({m}, 4) AS {m}' for m in evaluation.METRICS)}, round((faithfulness + answer_relevancy + context_precision + context_recall) / 4, 4) AS composite FROM a""")
def relay_merge(spark, sf):
    return evaluation.merge_relay(_metric_rows(spark, sf))


@query(f"WITH {_METRICS} SELECT judge, round(avg(coalesce(faithfulness, 0)), 4) AS faithfulness, round(avg(coalesce(answer_relevancy, 0)), 4) AS answer_relevancy FROM m GROUP BY judge")
def legacy_zero_means(spark, sf):
    return evaluation.legacy_judge_means(_metric_rows(spark, sf))


@query(f"""
WITH {_METRICS} SELECT {', '.join(f'round(avg({m}) FILTER (WHERE {m} BETWEEN 0 AND 1), 4) AS {m}, count(*) FILTER (WHERE {m} BETWEEN 0 AND 1) AS n_{m}' for m in evaluation.METRICS)},
  round(avg((faithfulness + answer_relevancy + context_precision + context_recall) / 4) FILTER (WHERE good), 4) AS composite FROM ok""")
def retry_merge(spark, sf):
    return evaluation.merge_retries(_metric_rows(spark, sf))


@query(f"""
WITH {_METRICS} SELECT position, {', '.join(f'CASE WHEN {m} BETWEEN 0 AND 1 THEN {m} END AS {m}' for m in evaluation.METRICS)} FROM m""")
def plain_merge(spark, sf):
    rows = _metric_rows(spark, sf).withColumn("engine", F.lit("e"))
    out = evaluation.merge_plain([rows.where(F.col("chunk") == k) for k in range(7)])
    return out.select("position", *evaluation.METRICS)


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source ELSE lang END AS contexts FROM documents""")
def contexts_filled(spark, sf):
    d = documents(spark, sf).withColumn("question", F.col("doc_id").cast("string"))
    answers = d.select("doc_id", "question", F.when(F.col("doc_id") % 3 > 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("contexts"))
    out = evaluation.with_contexts(answers, d.select("question", F.array("lang").alias("contexts")))
    return out.select("doc_id", F.array_join("contexts", ",").alias("contexts"))


@query("""
SELECT (SELECT CASE WHEN bool_and(length(text) > 0) THEN 4 ELSE 2 END FROM benchmark)::INT AS n_all, (SELECT CASE WHEN bool_and(length(text) > 100) THEN 4 ELSE 2 END FROM benchmark)::INT AS n_long""")
def metrics_chosen(spark, sf):
    q = questions(spark, sf)
    of = lambda truth, name: evaluation.metrics_for(q.select(truth.alias("ground_truth"))).select(F.size("metrics").alias(name))
    return of(F.col("question"), "n_all").join(of(F.when(F.length("question") > 100, F.col("question")), "n_long"))


@query("""
SELECT item_id AS query, trim(text, chr(10) || ' ') AS question, '' AS answer, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::INT AS n_contexts, CASE WHEN item_id % 3 = 0 THEN 'r' ELSE 'g' END AS ground_truth FROM benchmark""")
def items_normalized(spark, sf):
    q = questions(spark, sf).withColumn("ground_truth", F.when(F.col("query") % 3 == 0, "  ").otherwise(" g ")).withColumn("reference_answer", F.lit("r"))
    q = q.select("query", F.concat(F.lit(" "), "question", F.lit("\n")).alias("question"), F.lit(None).cast("string").alias("answer"), F.when(F.col("query") % 2 == 0, F.lit("c")).alias("contexts"), "ground_truth", "reference_answer")
    one = evaluation.normalized_items(q).withColumnRenamed("question", "stripped")
    return q.select("query", F.trim(F.regexp_replace("question", "\n$", "")).alias("stripped")).join(one, "stripped").select("query", F.col("stripped").alias("question"), "answer", F.size("contexts").alias("n_contexts"), "ground_truth")


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE value >= 20) AS before, count(*) FILTER (WHERE value >= 60) AS after, count(*) FILTER (WHERE value >= 60) AS both FROM events""")
def probe_counters(spark, sf):
    e = table(spark, sf, "events")
    return evaluation.probe_counts(e.select((F.col("value") >= 20).alias("accepted_before"), (F.col("value") >= 60).alias("accepted_after")))


@query(f"""
WITH {_METRICS} SELECT CASE WHEN position < 44 THEN 'first' ELSE 'rest' END AS part, count(*) AS n, {', '.join(f'round(avg({m}), 4) AS {m}' for m in evaluation.METRICS)}
FROM m WHERE faithfulness > 0 OR answer_relevancy > 0 OR context_precision > 0 OR context_recall > 0 GROUP BY 1""")
def first_and_rest_means(spark, sf):
    return evaluation.split_means(_metric_rows(spark, sf), "position")


@query(f"""
WITH {_PAIRS}, d AS (SELECT v AS d, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT round(gF - oF, 4) AS v FROM pairs) WHERE v IS NOT NULL),
n AS (SELECT count(*) AS n, avg(d) AS mean FROM d), x AS (SELECT b, k, (b * 48271 + k * 69621 + 42) % 2147483647 AS x FROM range(5000) t(b), (SELECT unnest(range(n)) AS k FROM n)),
y AS (SELECT b, k, (x * x + x * 16807 + k) % 2147483647 AS x FROM x), z AS (SELECT b, (x * x + x * 48271 + b) % 2147483647 % n AS i FROM y, n),
r AS (SELECT list_sort(list(m)) AS a FROM (SELECT avg(d) AS m FROM z JOIN d USING (i) GROUP BY b))
SELECT n, round(mean, 6) AS mean_diff, round(a[126], 6) AS low, round(a[4875], 6) AS high FROM n, r""")
def paired_bootstrap_ci(spark, sf):
    out = evaluation.paired_bootstrap(_pairs(spark, sf).select(F.col("dF").alias("diff")))
    return out.select(F.col("n"), *[r6(F.col(c), c) for c in ("mean_diff", "low", "high")])


# -------------------------------------------------- sampling, sessions, text

@query("SELECT event_id, (SELECT max(b) FROM range(4) t(b) WHERE i >= b * n // 4)::INT AS stratum FROM (SELECT *, row_number() OVER (ORDER BY value, event_id) - 1 AS i, count(*) OVER () AS n FROM events)")
def quartiles_of_all(spark, sf):
    return sampling.quartiles(table(spark, sf, "events").select("event_id", "value"), "value", "event_id").select("event_id", "stratum")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT r.event_id, (i % 7)::INT AS slice, (i // 25)::INT AS chunk, (ntile(9) OVER (ORDER BY event_id) - 1)::INT AS part FROM r""")
def slices_of_all(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    out = sampling.round_robin(e, "event_id", 7).join(sampling.chunks_by_size(e, "event_id", 25), "event_id")
    return out.join(sampling.chunks_by_count(e, "event_id", 9).withColumnRenamed("chunk", "part"), "event_id")


@query("SELECT place::BIGINT AS place, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events) WHERE place IN (1, 5, 1000)")
def rows_at_places(spark, sf):
    return sampling.at_indices(table(spark, sf, "events").select("event_id"), "event_id", [5, 1, 1000])


@query("""
WITH a AS (SELECT user_id, event_id, ts FROM events UNION ALL SELECT user_id, max(event_id) + 1000000000, max(ts) + INTERVAL 1 HOUR FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM a) SELECT user_id AS session_id, event_id AS id FROM r WHERE b <= 5""")
def session_appended(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").cast("long").alias("id"), F.col("ts").alias("timestamp"))
    new = e.groupBy("session_id").agg((F.max("id") + 1_000_000_000).alias("id"), (F.max("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("timestamp"))
    return sessions.appended(e, new).select("session_id", "id")


@query("""
SELECT doc_id, CASE WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE n::VARCHAR END AS number, CASE WHEN s < 1 THEN printf('%.0fms', s * 1000) WHEN s < 60 THEN printf('%.2fs', s) ELSE printf('%.1fmin', s / 60) END AS time
FROM (SELECT doc_id, doc_id % 900 * 103 AS n, (doc_id % 700 + 0.3127) / 7 AS s FROM documents WHERE doc_id % 900 * 103 % 100 <> 50)""")
def formatted_numbers(spark, sf):
    n = F.col("doc_id") % 900 * 103
    d = documents(spark, sf).where(n % 100 != 50)  # halves are rounded up here and to even there
    return d.select("doc_id", tx.format_number(n).alias("number"), tx.format_time((F.col("doc_id") % 700 + 0.3127) / 7).alias("time"))


@query("""
SELECT item_id AS query, (CASE item_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE NULL END)::DOUBLE AS score FROM benchmark""")
def judge_scores_lenient(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ('so {"F": 0.5, "x": 1} end', '{"F": "0.25"}', '{"F": true}', "no json"))), (F.col("query") % 4 + 1).cast("int"))
    return questions(spark, sf).select("query", parsing.judge_scores_lenient(raw, "F").alias("score"))


@query("SELECT n_nationkey, n_name AS entity FROM nation")
def entities_cleaned(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", tx.clean_entity(F.concat("n_name", F.lit("（别名）(alias).md"))).alias("entity"))


# ------------------------------------------------------------ routing, cache

@query("""
SELECT k AS i, CASE WHEN k IN (2, 7) THEN 'g' WHEN k = 6 THEN 'x' END AS answer, CASE k WHEN 2 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 2 END::INT AS level,
  CASE k WHEN 0 THEN 'intent_error' WHEN 1 THEN 'generation_error' WHEN 2 THEN '' WHEN 3 THEN 'no_recall' WHEN 4 THEN 'rerank_error' WHEN 5 THEN 'empty_context' WHEN 6 THEN 'generation_error' ELSE 'child_recall_empty' END AS reason
FROM (SELECT n_nationkey::INT AS k FROM nation) WHERE k < 8""")
def deep_channel_outcomes(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("i")).where("i < 8")
    i = F.col("i")
    out = route.deep_outcome(
        general=i.isin(1, 2), classified=i > 0, level=F.when(i == 3, 2).when(i == 7, 1).otherwise(0), reason=F.when(i == 3, "no_recall").when(i == 7, "child_recall_empty").otherwise(""),
        reranked=i != 4, context=F.when(i != 5, "c"), generated=F.when(~i.isin(1, 6), "g"), excerpt=F.lit("x"),
    )
    return n.select("i", out.alias("o")).select("i", "o.answer", F.col("o.degrade_level").alias("level"), F.col("o.degrade_reason").alias("reason"))


@query("SELECT 'k' || item_id AS key, json_object('answer', 'a', 'intent', 'i', 'strategy', 's', 'confidence', 0.5, 'degrade_level', (item_id % 3)::INT, 'degrade_reason', '')::VARCHAR AS value FROM benchmark WHERE item_id % 5 > 0 AND item_id % 3 < 2")
def answers_cached(spark, sf):
    q = questions(spark, sf)
    answers = q.select("query", F.lit("a").alias("answer"), F.when(F.col("query") % 5 > 0, "deep").otherwise("cache").alias("stage"), F.lit("i").alias("intent"), F.lit("s").alias("strategy"), F.lit(0.5).alias("confidence"), (F.col("query") % 3).cast("int").alias("degrade_level"), F.lit("").alias("degrade_reason"))
    return route.to_cache(answers, q.select("query", F.concat(F.lit("k"), F.col("query").cast("string")).alias("cache_key")))


@query("""
WITH r AS (SELECT r_name AS key, string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT key, '["old",' || l || ']' AS value FROM r""")
def cache_lists(spark, sf):
    have = table(spark, sf, "region").select(F.col("r_name").alias("key"), F.lit('["old"]').alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    items = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("key"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("item"))
    return cache.list_push(have, items).select("key", "value")


@query("SELECT r_name AS key, arg_max(n_name, n_nationkey) AS a, 'kept' AS b FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def cache_hashes(spark, sf):
    """A region's nations write to one field of one key in turn; the last one's name stays, beside the field nobody wrote."""
    have = table(spark, sf, "region").select(F.col("r_name").alias("key"), F.lit('{"a": "old", "b": "kept"}').alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fields = nations.select(F.col("r_name").alias("key"), F.lit("a").alias("field"), F.col("n_name").alias("value"), F.col("n_nationkey").alias("seq"))
    out = cache.hash_set(have, fields)
    return out.select("key", F.get_json_object("value", "$.a").alias("a"), F.get_json_object("value", "$.b").alias("b"))


@query("SELECT service, up FROM (VALUES ('store', true), ('cache', false), ('all', false)) v(service, up)")
def service_health(spark, sf):
    def broken() -> bool:
        raise OSError("no connection")

    return route.health(spark, {"store": lambda: table(spark, sf, "region").limit(1).count() == 1, "cache": broken})


# ---------------------------------------------------------------- segments

def _vocabulary(spark, sf):
    """Words of the questions with their counts: a dictionary whose size is checked."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query()  # a path over a lattice: tests hold it against all paths
def segmented_documents(spark, sf):
    cut = segment.segmenter(_vocabulary(spark, sf), segment.ANY)
    rows = inverted.spread(documents(spark, sf).select("doc_id", F.regexp_replace("content", r"(?U)\s+", "").alias("text")))
    rows = rows.select("doc_id", cut(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("segmented"))


@query()
def bm25_segmented_top5(spark, sf):
    d, q = documents(spark, sf), questions(spark, sf)
    out = lexical.ranked(d, q, "doc_id", "content", "query", "question", 5, tokens=segment.segmenter(_vocabulary(spark, sf)))
    return out.select("query", "doc", "rank", r6(F.col("score"), "score"))


# ---------------------------------------------------------------- vectors by lists

def _ivf(spark, sf, probes=None, where=None):
    index = ivf.build(vector_rows(spark, sf), "id", "embedding")
    probes = probes or max(ivf.Lists.probes, ivf.probes_for(index, spark))
    out = ivf.search(index, vector_queries(spark, sf), "query", "embedding", probes=probes, where=where)
    return out.select("query", "doc", "rank", r6(F.col("score"), "score"))


@query()  # which lists are read is k-means' choice: tests measure recall
def ivf_topk(spark, sf):
    return _ivf(spark, sf)


@query(f"WITH {_DENSE_ALL} SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM dense")
def ivf_all_lists_topk(spark, sf):
    return _ivf(spark, sf, ivf.Lists.count)


@query(f"WITH {_DENSE.replace('{where}', 'AND v.label = 3')} SELECT query, doc, rank::INT AS rank, round(score, 6) AS score FROM dense")
def ivf_filtered_topk(spark, sf):
    return _ivf(spark, sf, ivf.Lists.count, F.col("label") == 3)


# ----------------------------------------------------------------- retrieval

@query(f"""
WITH d AS (SELECT doc, token, ln(1 + count(*)) AS w FROM {_tokens('documents', 'doc_id', 'text', 'doc')} GROUP BY doc, token),
q AS (SELECT query, token, ln(1 + count(*)) AS w FROM {_tokens('benchmark', 'item_id', 'text', 'query')} GROUP BY query, token),
p AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query ORDER BY w, token) > floor(0.2 * count(*) OVER (PARTITION BY query))),
s AS (SELECT query, doc, sum(d.w * p.w) AS score FROM d JOIN p USING (token) GROUP BY query, doc)
SELECT query, count(*) AS n, round(max(score), 3) AS best FROM s GROUP BY query""")
def sparse_dropped(spark, sf):
    out = vectors.sparse_scores(_weights(documents(spark, sf), "doc_id", "content", "doc"), _weights(questions(spark, sf), "query", "question", "query"), drop=0.2)
    return out.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 3).alias("best"))


@query("SELECT vec_id AS query, 1::INT AS rank, 'a' || vec_id AS id, true AS topic_anchor FROM embeddings WHERE vec_id % 100 = 0")
def anchors_first(spark, sf):
    hits = _child_hits(spark, sf).select("query", F.col("id").cast("string").alias("id"), "rank")
    front = vector_queries(spark, sf).select("query", F.concat(F.lit("a"), "query").alias("id"), F.lit(1).alias("rank"))
    return vectors.anchored(hits, front).where("rank = 1").select("query", "rank", "id", "topic_anchor")


@query("SELECT vec_id AS query, k::INT AS rank, k::INT AS was FROM embeddings, range(1, 3) t(k) WHERE vec_id % 100 = 0")
def rerank_with_bad_scores(spark, sf):
    """A query with a score that is missing keeps its first parents as they were."""
    p = merging.to_parents(_child_hits(spark, sf)).withColumn("was", F.col("rank"))
    out = merging.rerank(p, F.when(F.col("rank") > 1, F.col("rank").cast("double")), strict=False)
    return out.select("query", F.col("rank").cast("int").alias("rank"), F.col("was").cast("int").alias("was"))


@query(f"""
WITH {_HITS}, a AS (
  SELECT query, parent_id AS id, max(score) AS score, min(rank) AS place, least(count(*), 5) AS n FROM hits WHERE query % 300 = 0 AND query % 900 <> 0 AND rank % 4 <> 0 GROUP BY query, parent_id
  UNION ALL SELECT query, id::VARCHAR, score, rank, 1 FROM hits WHERE query % 300 = 100 AND rank <= 5)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, place)::INT AS rank, n::INT AS n_children, round(score, 6) AS score FROM a""")
def tiered_parents(spark, sf):
    """Parents of child hits, or of the pieces of relaxed hits; none of a query whose search failed or found nothing."""
    hits = _child_hits(spark, sf).withColumn("id", F.col("id").cast("string"))
    q = vector_queries(spark, sf).select("query")
    child = hits.where("query % 300 = 0").withColumn("parent_id", F.when(F.col("rank") % 4 == 0, "").otherwise(F.col("parent_id")))
    wide = hits.where("query % 300 = 100").withColumn("parent_id", F.lit(""))
    _, parents = merging.tiered(q, child, wide, q.where("query % 900 = 0"))
    return parents.select("query", "id", F.col("rank").cast("int").alias("rank"), F.size("children_ids").alias("n_children"), r6(F.col("score"), "score"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 > 0")
def child_rows(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 > 0, "p").alias("parent_id"), F.lit("child").alias("chunk_type"))
    return v.where(cleaning.is_child(v)).select("id")


# ------------------------------------------------------------ files, markup

@query("SELECT item_id::VARCHAR AS item, md5(text || chr(10)) AS content, length(text) + 1 AS char_count, 'txt' AS file_type FROM benchmark")
def files_ingested(spark, sf):
    """Each text of ``benchmark`` as a file in a folder of its own, found and read again."""
    folder = Workspace(spark, "ingest").path("raw")
    table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").option("lineSep", "\n").text(folder)
    found, _ = files.read_documents(spark, folder)
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).alias("item"), F.md5("content").alias("content"), F.col("char_count").cast("long").alias("char_count"), "file_type")


def _letters(spark, sf):
    """Each document's runs of letters A to Z, those of the whole text."""
    return inverted.spread(documents(spark, sf).select("doc_id", "content")).select("doc_id", F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))


_LETTERS = "w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents)"


@query(f"""
WITH {_LETTERS}
SELECT doc_id, array_to_string(list_concat(['# D' || doc_id, '', '- [top]'], list_transform(w, lambda x, i: CASE WHEN i % 3 = 0 THEN '- ' || x || '_' || i WHEN i % 3 = 1 THEN '- ' || x ELSE '- ' || x || ' ' || x END)), chr(10)) AS content FROM w""")
def markdown_of_documents(spark, sf):
    """Markdown written from each whole text (links with titles, links by reference, subscripts in HTML), ingested by its file type."""
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    at = lambda i: (i + 1).cast("string")
    item = lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("- "), x, F.lit("<sub>"), at(i), F.lit("</sub>"))).when((i + 1) % 3 == 1, F.concat(F.lit("- ["), x, F.lit("](http://h.example/(a)/"), at(i), F.lit(' "of it")'))).otherwise(F.concat(F.lit("- <b>"), x, F.lit("</b> ["), x, F.lit("][far]")))
    lines = F.concat(F.array(F.concat(F.lit("# ["), name, F.lit("](http://h.example)")), F.lit(""), F.lit("- [top]")), F.transform("w", item), F.array(F.lit(""), F.lit("[far]: http://h.example/far"), F.lit("")))
    rows = _letters(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("content"), F.lit("markdown").alias("file_type"))
    return ingest.clean(rows).select("doc_id", "content")


@query(f"""
WITH {_LETTERS}
SELECT doc_id, array_to_string(list_concat(['D' || doc_id, '', '| word | at\\|of | at\\|of |', '| --- | --- | --- |'], list_transform(w, lambda x, i: '| ' || x || ' | ' || i || ' | ' || length(x) || ' |' || chr(10) || '| ' || x || ' | - | - |')), chr(10)) AS content FROM w""")
def tables_of_documents(spark, sf):
    """A table in HTML of each whole text's words, with cells across rows and columns, as a pipe table."""
    row = lambda x, i: F.concat(F.lit('<tr><td rowspan="2">'), x, F.lit("</td><td>"), (i + 1).cast("string"), F.lit("</td><td>"), F.length(x).cast("string"), F.lit('</td></tr><tr><td colspan="2">-</td></tr>'))
    table_ = F.concat(F.lit("<table><caption>D"), F.col("doc_id").cast("string"), F.lit('</caption><tr><th>word</th><th colspan="2">at|of</th></tr>'), F.array_join(F.transform("w", row), ""), F.lit("</table>"))
    return _letters(spark, sf).select("doc_id", html_text.markdown_text(table_).alias("content"))


@query("SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), lambda x: '- ' || x), chr(10) || chr(10)) AS menu FROM pages")
def page_menus(spark, sf):
    """The list of links in each page's menu as a Markdown list of their names."""
    menu = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<nav>(.*?)</nav>", 1)
    return table(spark, sf, "pages").select("page_id", html_text.markdown_text(menu).alias("menu"))


#: Beginnings of the lines that open a chapter.
CHAPTERS = ("Th", "La ", "Es", "Di")


@query(f"""
WITH x AS ({oracles.oracle_sql()["html_article_text"]}),
l AS (SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS l FROM x)
SELECT page_id, regexp_replace(trim(array_to_string(list_transform(l, lambda s: CASE WHEN {" OR ".join(f"starts_with(s, '{c}')" for c in CHAPTERS)} THEN chr(10) || '## ' || s ELSE s END), chr(10)), ' ' || chr(10)), '\\s{{3,}}', ' ', 'g') AS text FROM l""")
def page_chapters(spark, sf):
    """The older extraction of each page's article: lines, with chapters as headings."""
    return table(spark, sf, "pages").select("page_id", html_text.html_chapters(F.col("html"), CHAPTERS).alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) % 2 = 0), chr(10)), '!?\[([^\]]*)\]\([^\n]*?\)', '\1', 'g') AS md FROM documents),
e AS (SELECT *, regexp_replace(md, '[^\pL\pM\p{Nd}]+', '', 'g') AS bare FROM d)
SELECT doc_id, (len(list_filter(lines, lambda x: regexp_replace(x, '[^\pL\pM\p{Nd}]+', '', 'g') <> '' AND NOT contains(bare, regexp_replace(x, '[^\pL\pM\p{Nd}]+', '', 'g'))))
  + len(list_filter(list_distinct(regexp_extract_all(text, '(?:^|[^0-9.])([+-]?[0-9]+(?:\.[0-9]+)?(?:/[0-9]+)?)', 1)), lambda n: NOT contains(md, n))))::INT AS n_missing FROM e""")
def integrity_missing(spark, sf):
    """Lines as headings, and numbers, of each whole text that are lost where only lines of even length are kept."""
    lines = F.split("content", "\n")
    kept = F.array_join(F.filter(lines, lambda x: F.length(x) % 2 == 0), "\n")
    return documents(spark, sf).select("doc_id", F.size(cleaning.missing_parts(F.col("content"), lines, kept)).alias("n_missing"))


@query()
def intent_classifier_predict(spark, sf):
    """Trained on the labelled documents outside of a fifth held out, asked for all."""
    d = documents(spark, sf).select("doc_id", F.col("content").alias("text"))
    known = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return models.predict_intent(models.train_intent(known), d).select("doc_id", "intent", r6(F.col("intent_probability"), "intent_probability"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
