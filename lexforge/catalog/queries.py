"""Queries over the driver's tables, one or more per operator of the survey.

Each takes (spark, sf_dir). Floating results are rounded to six places (four where the
operator itself rounds), so that sums in another order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import models, parsing, scores as sc, text as tx
from ..operators import cache, chunking, cleaning, evaluation, html_text, inverted, lexical, merging, sampling, sessions, vectors
from ..plans import ingest, retrieve, route
from ..shared import written
from ..sources import corpus, reports, stores

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), "lang", "source")


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors as chunks: five children a parent."""
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("id"), "embedding", "label", F.concat(F.lit("p"), F.expr("vec_id div 5")).alias("parent_id"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that are searched for among all of ``vector_rows``: the contract's query set."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scores: a value over 100 is a score; values out of range are invalid ones."""
    e = table(spark, sf, "events")
    value = F.col("value") / 100
    return e.select("event_id", "user_id", "event_type", F.when(value <= 1.2, value).alias("score"))


# ------------------------------------------------------- cleaning (B)

@query
def clean_lines_keep(spark, sf):
    d = documents(spark, sf)
    lines = d.withColumn("l", F.filter(cleaning.candidate_lines(F.col("content")), cleaning.has_letter))
    return lines.select("doc_id", F.posexplode(cleaning.clean_lines(F.col("l"))).alias("pos", "line"))


@query
def clean_document_text(spark, sf):
    return cleaning.clean_documents(documents(spark, sf)).select("doc_id", "content")


@query
def doc_title(spark, sf):
    return documents(spark, sf).select("doc_id", cleaning.title(F.col("content")).alias("title"))


@query
def doc_keywords_top5(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(cleaning.keywords(F.col("content"))).alias("rank", "word"))


@query
def doc_counts(spark, sf):
    return cleaning.with_metadata(documents(spark, sf)).select("doc_id", "char_count", "word_count")


@query
def faq_cleaned(spark, sf):
    d = table(spark, sf, "benchmark").select(F.col("text").alias("question"), F.concat(F.lit("作者：x 浏览专业版 "), F.col("text"), F.lit(" 版权所有。")).alias("answer"), F.lit("s").alias("source"), F.lit("d").alias("doc_name"))
    return cleaning.clean_faq(d)


@query
def cleaning_statistics(spark, sf):
    d = table(spark, sf, "benchmark").select(F.col("text").alias("question"), F.col("text").alias("answer"), F.lit("s").alias("source"), F.lit("d").alias("doc_name"))
    out = cleaning.cleaning_stats(d, cleaning.clean_faq(d))
    return out.select("total", "kept", "dropped", "changed", r6(F.col("mean_before"), "mean_before"), r6(F.col("mean_after"), "mean_after"))


@query
def filter_source_length(spark, sf):
    d = documents(spark, sf).where(cleaning.all_of(cleaning.source_is(F.col("source"), "src1"), cleaning.source_is(F.col("lang"), "")))
    return cleaning.long_enough(d, "content", 100).select("doc_id", "source")


@query
def score_threshold(spark, sf):
    return cleaning.at_least(score_rows(spark, sf).where("score is not null"), 0.5).select("event_id", r6(F.col("score"), "score"))


@query
def sampled_fragment(spark, sf):
    return cleaning.sample_fragment(documents(spark, sf), "doc_id", "content").select("doc_id", F.length("fragment").alias("n"), "fragment")


@query
def html_article_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_text.html_lines(F.col("html")).alias("text"))


@query
def html_article_markdown(spark, sf):
    p = table(spark, sf, "pages")
    rows = p.select("page_id", "html", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return rows.select("page_id", cleaning.titled(html_text.html_markdown(F.col("html"), F.col("title")), F.col("title")).alias("markdown"))


@query
def markdown_normalized(spark, sf):
    d = documents(spark, sf).select("doc_id", F.concat(F.lit("# [a](http://x/y)\n\n"), "content").alias("content"))
    return d.select("doc_id", html_text.markdown_text(F.col("content")).alias("content"))


# ------------------------------------------------------- chunking (C)

@query
def chunk_parents(spark, sf):
    return chunking.parents(documents(spark, sf), "doc_id", "content").select("doc_id", "id", "chunk_index", "total_chunks", "content")


@query
def chunk_children(spark, sf):
    c = chunking.children(chunking.parents(documents(spark, sf), "doc_id", "content"))
    return c.select("doc_id", "id", "parent_id", "chunk_index", "content")


@query
def chunk_recursive(spark, sf):
    c = chunking.split_documents(documents(spark, sf), "doc_id", "content", recursive=True)
    return c.select("doc_id", "id", "chunk_type", F.length("content").alias("n"))


@query
def chunk_structure_audit(spark, sf):
    out = chunking.structure_audit(chunking.split_documents(documents(spark, sf), "doc_id", "content"))
    return out.select("total", "parents", "children", "without_text", "dangling", "sound", "ratio")


@query
def dedupe_chunks(spark, sf):
    d = documents(spark, sf).select(F.md5("content").alias("id"), F.col("doc_id").alias("seq"), "source")
    return chunking.first_of_each(d, "id", "seq")


@query
def chunk_type_repair(spark, sf):
    v = vector_rows(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("parent_id")).alias("parent_id"), F.lit("child").alias("chunk_type"))
    return chunking.repaired(v)


@query
def l1_split(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("query"), F.concat(F.lit("h"), F.col("doc_id")).alias("id"), "content", F.lit(0.5).alias("score"), "source", F.lit("").alias("parent_id"), F.lit("").alias("parent_content"), F.lit(1).alias("rank"))
    return chunking.split_hits(d).select("query", "id", "parent_id", "piece", "content")


# -------------------------------------------------------- lexical (F1, F2, G4, H1, K4)

@query
def bm25_idf(spark, sf):
    d = documents(spark, sf)
    out = lexical.idf(lexical.postings(d, "doc_id", "content"), lexical.corpus(d, "content"))
    return out.select("token", "df", r6(F.col("idf"), "idf"))


def _bm25(spark, sf, k=5):
    d, q = documents(spark, sf), questions(spark, sf)
    return lexical.ranked(d, q, "doc_id", "content", "query", "question", k)


@query
def bm25_top5(spark, sf):
    return _bm25(spark, sf).select("query", "doc", "rank", r6(F.col("score"), "score"))


@query
def bm25_best_all_pairs(spark, sf):
    """Every pair of a question and a document that share a token is scored, and summed up by question."""
    pairs = lexical.scores(documents(spark, sf), questions(spark, sf), "doc_id", "content", "query", "question")
    return pairs.groupBy("query").agg(F.count(F.lit(1)).alias("n"), r6(F.max("score"), "best"))


@query
def bm25_softmax(spark, sf):
    d = documents(spark, sf)
    out = lexical.softmax_top(_bm25(spark, sf).drop("rank"), lexical.corpus(d, "content"))
    return out.select("query", "doc", "rank", r6(F.col("probability"), "probability"))


def _faq(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("indexed"), F.concat(F.lit("a: "), F.substring(F.col("text"), 1, 20)).alias("answer"))


@query
def faq_exact_gate(spark, sf):
    q = questions(spark, sf).select("query", F.when(F.col("query") % 2 == 0, F.concat(F.lit("  "), "question", F.lit("\n"))).otherwise(F.concat("question", F.lit(" x"))).alias("question"))
    out = lexical.exact_matches(q, _faq(spark, sf))
    return out.select("query", "faq_id", "answer")


@query
def faq_ranked_gate(spark, sf):
    q, faq = questions(spark, sf), _faq(spark, sf)
    ranked = lexical.ranked(faq, q, "id", "indexed", "query", "question", 5).drop("rank")
    return lexical.faq_answers(q, faq, lexical.softmax_top(ranked), Settings(faq_threshold=0.5)).select("query", "faq_id", "answer", "confidence", "intent", "strategy", "cache_key")


@query
def faq_category_stats(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.col("ts").alias("created_at"))
    last = e.agg(F.max("created_at")).first()[0]
    return lexical.faq_stats(e, F.lit(last))


@query
def faq_upsert(spark, sf):
    faq = _faq(spark, sf).select("id", "question", "answer")
    old = faq.where(F.length("question") < 140).select("id", "question", F.lit("old").alias("answer"), F.lit("put").alias("op"), F.lit(1).alias("seq"))
    new = faq.where(F.length("question") < 120).select("id", "question", F.lit("new").alias("answer"), F.when(F.length("question") < 80, "put").otherwise("delete").alias("op"), F.lit(2).alias("seq"))
    return lexical.upsert(faq, new.unionByName(old))


# -------------------------------------------------------- vectors (D)

def _dense(spark, sf, where=None):
    out = vectors.dense_top(vector_rows(spark, sf), vector_queries(spark, sf), "id", "embedding", "query", "embedding", where=where)
    return out.withColumn("score", F.round("score", 9))


@query
def dense_topk(spark, sf):
    return _dense(spark, sf).select("query", "doc", "rank", r6(F.col("score"), "score"))


@query
def dense_topk_filtered(spark, sf):
    return _dense(spark, sf, F.col("label") == 3).select("query", "doc", "rank", r6(F.col("score"), "score"))


def _weights(df, key, text_col, name):
    out = df.select(F.col(key).alias(name), F.explode(lexical.tokens_of(F.col(text_col))).alias("token")).groupBy(name, "token").agg(F.count(F.lit(1)).alias("n"))
    return out.select(name, "token", F.log1p("n").alias("weight"))


@query
def sparse_topk(spark, sf):
    d = documents(spark, sf).select(F.col("doc_id").alias("doc"), lexical.tokens_of(F.col("content")).alias("tokens"))
    asked = written(_weights(questions(spark, sf), "query", "question", "query"), "asked")
    blocks = written(inverted.build(d, asked, np.log1p), "blocks")
    return lexical.top(inverted.search(blocks, asked, 16), 16).select("query", "doc", "rank", r6(F.col("score"), "score"))


@query
def sparse_map_topk(spark, sf):
    """Maps of a token's hash to its weight, as a sparse model gives them; a fifth of a query's lightest tokens is dropped."""
    weights = lambda c: models.model("sparse")(F.col(c))
    d = documents(spark, sf).select("doc_id", weights("content").alias("w"))
    q = questions(spark, sf).select("query", weights("question").alias("w"))
    out = vectors.sparse_top(d, q, "doc_id", "w", "query", "w", k=16, drop=0.2)
    return out.select("query", "doc", "rank", r6(F.col("score"), "score"))


@query
def hybrid_fusion_topk(spark, sf):
    """Dense scores of vectors, and as the sparse branch BM25 of the documents of the same number."""
    dense = _dense(spark, sf)
    q = table(spark, sf, "benchmark").select((F.col("item_id") * 100).alias("query"), F.col("text").alias("question"))
    q = q.join(vector_queries(spark, sf).select("query"), "query", "left_semi")
    sparse = lexical.ranked(documents(spark, sf), q, "doc_id", "content", "query", "question", 16).drop("rank")
    both = vectors.fuse(dense.drop("rank"), sparse)
    return both.withColumn("score", F.round("score", 6)).select("query", "doc", "score")


@query
def title_anchor_match(spark, sf):
    d = documents(spark, sf).select(F.substring_index(F.substring_index("content", " ", 3), " ", -2).alias("title"))
    return vectors.title_anchors(questions(spark, sf), d).select("query", "title", "rank")


@query
def multi_query_merge(spark, sf):
    hits = _dense(spark, sf).select((F.col("query") % 300).alias("group"), "query", F.col("doc").alias("id"), "score")
    return vectors.merge_queries(hits).select("group", "id", "rank", r6(F.col("score"), "score"))


# -------------------------------------------------------- merging (F3-F7, H, K9)

def _child_hits(spark, sf):
    v = vector_rows(spark, sf)
    hits = _dense(spark, sf).withColumnRenamed("doc", "id").join(v.select("id", "parent_id", F.col("label").cast("string").alias("source")), "id")
    return hits.select("query", "id", F.concat(F.lit("c"), F.col("id")).alias("content"), "score", "source", "parent_id", F.concat(F.lit("text of "), "parent_id").alias("parent_content"), "rank")


@query
def small_to_big_parents(spark, sf):
    return merging.to_parents(_child_hits(spark, sf)).select("query", "id", "content", "rerank_content", "source", F.array_join(F.transform("children_ids", lambda x: x.cast("string")), ",").alias("children_ids"), "rank", r6(F.col("score"), "score"))


@query
def small_to_big_lexical(spark, sf):
    out = retrieve.lexical_small_to_big(table(spark, sf, "documents"), questions(spark, sf), "doc_id", "text", "query", "question")
    return out.select("query", "id", "rank", r6(F.col("score"), "score"))


@query
def subquery_merge(spark, sf):
    p = merging.to_parents(_child_hits(spark, sf)).select((F.col("query") % 300).alias("group"), F.expr("query div 300").alias("branch"), "id", "content", "rerank_content", "source", "score", "topic_anchor", "children_ids", "rank")
    out = merging.merge_branches(p)
    return out.select("group", "id", "rank", "rerank_content", F.array_join(F.transform("children_ids", lambda x: x.cast("string")), ",").alias("children_ids"), r6(F.col("score"), "score"))


@query
def tiered_levels(spark, sf):
    hits = _child_hits(spark, sf)
    q = vector_queries(spark, sf).select("query")
    child = hits.where("query % 300 = 0").withColumn("parent_id", F.when(F.col("rank") % 4 == 0, "").otherwise(F.col("parent_id")))
    wide = hits.where("query % 300 = 100").withColumn("parent_id", F.lit("")).withColumn("id", F.col("id").cast("string"))
    errors = q.where("query % 900 = 0")
    status, _ = merging.tiered(q, child.withColumn("id", F.col("id").cast("string")), wide, errors)
    return status


@query
def merged_levels(spark, sf):
    s = vector_queries(spark, sf).select((F.col("query") % 700).alias("group"), F.expr("query div 700").cast("int").alias("branch"), (F.expr("query div 100") % 3).cast("int").alias("level"), F.concat(F.lit("r"), F.expr("query div 100") % 3).alias("reason"), (F.expr("query div 100") % 2).alias("n_docs"), F.lit(1).alias("orphans"), F.lit(False).alias("failed"))
    return merging.merge_levels(s)


@query
def recovered_parents(spark, sf):
    return merging.recovered_parents(_child_hits(spark, sf)).select("query", "id", "content", "children_count", "rank", r6(F.col("score"), "score"))


@query
def rerank_group_scores(spark, sf):
    hits = _child_hits(spark, sf).withColumn("score", F.col("score") - 0.9)
    parents = vector_rows(spark, sf).select(F.col("parent_id").alias("id"), F.concat(F.lit("text of "), "parent_id").alias("content")).distinct()
    return merging.rerank_groups(hits, parents).select("query", "parent_id", "children_count", r6(F.col("max_score"), "max_score"))


@query
def rerank_top2(spark, sf):
    p = merging.to_parents(_child_hits(spark, sf)).withColumn("topic_anchor", F.col("rank") == 3)
    return merging.rerank(p, F.length("content") - F.col("rank") / 100.0).select("query", "id", "rank")


@query
def context_blocks(spark, sf):
    return merging.contexts(merging.to_parents(_child_hits(spark, sf)))


@query
def degrade_metrics(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 3).cast("int").alias("degrade_level"))
    return merging.degrade_metrics(e)


# -------------------------------------------------------- evaluation (E, F9-F25, G6-G9, I)

@query
def valid_score_mean(spark, sf):
    s = score_rows(spark, sf)
    return s.groupBy("event_type").agg(sc.mean_valid(F.col("score"), 6).alias("mean_score"), F.count_if(sc.valid(F.col("score"))).alias("n_valid"), F.count_if(sc.valid(F.col("score")) & (F.col("score") == 0)).alias("n_zero"))


def _pairs(spark, sf):
    s = score_rows(spark, sf)
    f, ar = F.when(F.col("event_id") % 5 > 0, F.col("score")), F.col("score") / 2
    side = lambda d: s.where((F.expr("event_id div 1") % 2 == d)).select(F.concat(F.lit("q"), F.expr("event_id div 2")).alias("question"), f.alias("faithfulness"), ar.alias("answer_relevancy"))
    asked = s.select(F.concat(F.lit("q"), F.expr("event_id div 2")).alias("question")).distinct()
    return evaluation.pair_rows(asked, side(0), side(1))


@query
def complete_pair_rows(spark, sf):
    return _pairs(spark, sf).select("q", *[r6(F.col(c), c) for c in ("oF", "oAR", "gF", "gAR")])


def _metric_rows(spark, sf):
    s = score_rows(spark, sf)
    k = lambda n: F.when(F.col("event_id") % n > 0, F.col("score"))
    return s.select(
        F.concat(F.lit("q"), F.col("event_id") % 997).alias("question"), F.col("event_type").alias("judge"), (F.col("event_id") % 7).alias("chunk"), F.col("event_id").alias("position"),
        k(11).alias("faithfulness"), F.col("score").alias("answer_relevancy"), k(13).alias("context_precision"), (F.col("score") / 4).alias("context_recall"),
    )


@query
def metric_summary(spark, sf):
    out = evaluation.summary(_metric_rows(spark, sf))
    return out.select("total", "complete_count", *[f"n_{m}" for m in evaluation.METRICS])


@query
def merge_reports_dedupe(spark, sf):
    kept, _ = evaluation.merge_chunks(_metric_rows(spark, sf))
    return kept.select("question", "judge", "chunk", "position")


@query
def merge_reports_counts(spark, sf):
    return evaluation.merge_chunks(_metric_rows(spark, sf))[1]


@query
def judge_means(spark, sf):
    kept, _ = evaluation.merge_chunks(_metric_rows(spark, sf))
    return kept.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("faithfulness"), "faithfulness"), r6(F.avg("context_recall"), "context_recall"))


@query
def retry_fill(spark, sf):
    rows = _metric_rows(spark, sf)
    first = chunking.first_of_each(rows, "question", "position")
    again = evaluation.last_of_each(rows, "question", "position").withColumn("faithfulness", F.col("answer_relevancy"))
    out = evaluation.fill_from_retry(first, again)
    return out.select("question", "position", sc.valid(F.col("faithfulness")).alias("has_faithfulness"), sc.valid(F.col("context_precision")).alias("has_precision"))


@query
def composite_score(spark, sf):
    return _metric_rows(spark, sf).select("position", sc.composite(*[F.col(m) for m in evaluation.METRICS], digits=9).alias("composite"))


@query
def judge_cell_counts(spark, sf):
    return evaluation.judge_counts(_metric_rows(spark, sf))


@query
def score_histogram(spark, sf):
    return evaluation.histogram(score_rows(spark, sf), "score")


@query
def quartile_strata(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return sampling.quartiles(e, "value", "event_id", by=("event_type",)).select("event_id", "event_type", "stratum")


@query
def stratum_sample(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    rows = sampling.quartiles(e, "value", "event_id", by=("event_type",))
    return sampling.sample_strata(rows, "event_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query
def round_robin_slices(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return sampling.round_robin(c, "turn", 3, by=("conv_id",))


@query
def contiguous_chunks(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return sampling.chunks_by_size(c, "turn", 2, by=("conv_id",))


@query
def equal_chunks(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return sampling.chunks_by_count(c, "turn", 2, by=("conv_id",))


@query
def todo_anti_join(spark, sf):
    d, done = documents(spark, sf).select("doc_id"), table(spark, sf, "labels")
    return evaluation.without_done(d, done, "doc_id")


@query
def asked_semi_join(spark, sf):
    d = documents(spark, sf).select("doc_id", "source")
    return evaluation.among(d, table(spark, sf, "labels"), "doc_id")


@query
def resume_union(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", F.lit("cached").alias("origin"))
    fresh = documents(spark, sf).select("doc_id", F.lit("fresh").alias("origin"))
    return evaluation.resumed(done, fresh, "doc_id")


@query
def ground_truth_join(spark, sf):
    answers = documents(spark, sf).select(F.col("content").alias("question"), "doc_id")
    truth = documents(spark, sf).where("lang = 'en'").select(F.col("content").alias("question"), F.col("doc_id").alias("seq"), F.concat(F.lit("t"), F.col("doc_id")).alias("ground_truth"))
    return evaluation.with_ground_truth(answers, truth).select("doc_id", "ground_truth")


@query
def frozen_context_check(spark, sf):
    d = documents(spark, sf).select(F.concat(F.lit("q"), "doc_id").alias("question"), F.array("source", "lang").alias("contexts"))
    out = evaluation.frozen_contexts(d, d.where("contexts[1] = 'en'"))
    return out.select("question", F.array_join("contexts", ",").alias("contexts"))


@query
def template_cross_join(spark, sf):
    t = table(spark, sf, "region").select(F.concat("r_name", F.lit(" has {entity}")).alias("template"))
    return evaluation.template_texts(t, table(spark, sf, "nation").select(F.col("n_name").alias("entity")))


@query
def arm_coverage(spark, sf):
    n = table(spark, sf, "nation")
    rows = n.where("n_nationkey < 20").select(F.col("n_nationkey").cast("int").alias("index"), F.explode(F.array(F.lit("control"), F.lit("treatment"))).alias("arm"))
    return evaluation.arms_complete(rows.where("not (index = 7 and arm = 'control')"))


@query
def stratified_split_counts(spark, sf):
    rows = table(spark, sf, "labels").select(F.concat(F.lit("t"), "doc_id").alias("text"), F.col("quality").alias("label"))
    return sampling.stratified_split(rows).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def balanced_counts(spark, sf):
    rows = table(spark, sf, "labels").select(F.concat(F.lit("t"), "doc_id").alias("text"), F.col("toxic").alias("label"))
    return sampling.balanced(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def intent_distinct_samples(spark, sf):
    """A text's label is of its stripped form, so that copies with other white space around them agree."""
    text = tx.ustrip(F.col("content"))
    d = documents(spark, sf).select(text.alias("text"), (F.length(text) % 2).cast("int").alias("label"))
    return sampling.intent_samples(d, keep_blank=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def probe_substitution(spark, sf):
    d = documents(spark, sf)
    out = sampling.probe(F.col("content"), (("the", "THE"), ("de", "DE"), ("en", "EN")))
    return d.select("doc_id", F.md5(F.coalesce(out, F.lit(""))).alias("probe_md5"), out.isNull().alias("none"))


@query
def confusion_counts(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return evaluation.confusion(rows)


@query
def accuracy_report(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))
    return evaluation.accuracy(rows)


@query
def strategy_timing(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("strategy"), (F.col("event_id") % 4 > 0).alias("success"), F.col("value").alias("seconds"))
    out = evaluation.strategy_times(e)
    return out.select("strategy", "success_count", r6(F.col("avg_time"), "avg_time"))


@query
def run_statistics(spark, sf):
    d = documents(spark, sf).select(F.when(F.col("doc_id") % 5 > 0, F.col("content")).alias("answer"), F.when(F.col("doc_id") % 3 > 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("contexts"), (F.col("doc_id") % 7 == 0).alias("degraded"))
    return evaluation.run_stats(d)


@query
def provenance_flags(spark, sf):
    d = documents(spark, sf).select(F.col("lang").alias("_gen_model"))
    return evaluation.provenance(d, "en").select(F.array_join("generator_models", ",").alias("models"), "self_judge")


@query
def report_with_average(spark, sf):
    rows = table(spark, sf, "labels").select(F.concat(F.lit("q"), "doc_id").alias("question"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return reports.with_average(rows, ("quality", "toxic"))


# -------------------------------------------------------- functions (J)

@query
def cache_key_md5(spark, sf):
    q = questions(spark, sf).select("query", F.concat(F.lit("  "), "question", F.lit(" \n")).alias("question"))
    return q.select("query", cache.faq_key(F.col("question")).alias("key"))


@query
def cache_key_sha256(spark, sf):
    q = questions(spark, sf)
    return q.select("query", cache.query_key(F.col("question"), F.lit(None).cast("string"), F.lit("direct"), F.lit("[]")).alias("key"))


@query
def text_helpers(spark, sf):
    d = documents(spark, sf)
    c = F.col("content")
    return d.select("doc_id", F.md5(tx.clean_text(c)).alias("clean_md5"), tx.truncate(c, 20).alias("short"), tx.is_chinese(c).alias("zh"), tx.is_english(c).alias("en"), tx.token_estimate(c).alias("tokens"), r6(tx.safe_divide(F.col("doc_id").cast("double"), F.col("doc_id") % 3), "ratio"))


@query
def strategy_names(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("direct", "`HyDE`", "Sub-Query", '{"strategy": "backtracking"}', "回溯检索", "?"))), (F.col("query") % 6 + 1).cast("int"))
    return questions(spark, sf).select("query", parsing.strategy(raw).alias("strategy"))


@query
def sub_question_lines(spark, sf):
    raw = F.when(F.col("query") % 2 == 0, F.concat(F.lit("子问题1："), F.substring(F.replace(F.col("question"), F.lit("\n"), F.lit(" ")), 1, 10), F.lit("\n 子问题2：b\nx"))).otherwise(F.lit("none"))
    return questions(spark, sf).select("query", F.posexplode(parsing.sub_questions(raw, F.substring(F.col("question"), 1, 10))).alias("pos", "part"))


@query
def judge_json_scores(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ('{"score": 0.5}', '```json\n{"score": 0}\n```', '{"score": true}', '{"score": "0.5"}', '{"score": 1.2}', '{"score":'))), (F.col("query") % 6 + 1).cast("int"))
    return questions(spark, sf).select("query", parsing.judge_score(raw).alias("score"))


@query
def qa_pair_parse(spark, sf):
    raw = F.concat(F.lit('text ```json\n[{"question": "q'), F.col("query").cast("string"), F.lit('", "answer": "a"},]\n```'))
    return questions(spark, sf).select("query", F.explode(parsing.qa_pairs(raw)).alias("p")).select("query", "p.question", "p.reference_answer")


@query
def review_validation(spark, sf):
    raw = F.concat(F.lit('{"final_answer": "ok", "checks": [{"claim": "c", "supported": true, "evidence_ids": ['), (F.col("query") % 3).cast("string"), F.lit("]}]}"))
    return questions(spark, sf).select("query", parsing.reviewed_answer(raw, F.lit("one\n\ntwo")).alias("answer"))


@query
def evidence_numbering(spark, sf):
    d = documents(spark, sf).select("doc_id", F.replace(F.col("content"), F.lit("\n"), F.lit("\n\n")).alias("c"))
    return d.select("doc_id", F.size(tx.evidence_paragraphs(F.col("c"))).alias("n"), F.md5(tx.numbered_evidence(F.col("c"))).alias("md5"))


@query
def source_answers(spark, sf):
    out = documents(spark, sf).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "content"))).alias("d"))
    return out.select("source", tx.source_only_answer(F.array_repeat("source", 2), F.transform("d", lambda x: x["content"])).alias("answer"))


# -------------------------------------------------------- sessions, cache, routing (G1-G3, K)

@query
def session_last5(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    return sessions.recent_turns(e).select("session_id", "id", "position")


@query
def prompt_last3(spark, sf):
    c = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return sessions.last_messages(c)


@query
def prior_messages(spark, sf):
    return sessions.prior_messages(table(spark, sf, "conversations")).select("conv_id", "turn")


def _cache(spark, sf, now):
    e = table(spark, sf, "events")
    return e.where("value >= 40").select(F.concat(F.lit("k"), F.col("event_id")).alias("key"), F.col("event_type").alias("value"), F.when(F.col("value") < 90, F.col("ts")).alias("expires_at"))


@query
def cache_alive(spark, sf):
    now = F.lit(table(spark, sf, "events").where("event_type = 'error'").agg(F.min("ts")).first()[0])
    return cache.alive(_cache(spark, sf, now), now).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expires_at").isNull()).alias("forever"))


@query
def cache_put_get(spark, sf):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    rows = table(spark, sf, "events").where("value < 20").select(F.concat(F.lit("k"), F.col("event_id")).alias("key"), F.lit("new").alias("value"))
    twice = rows.withColumn("seq", F.lit(2)).unionByName(rows.select("key", F.lit("older").alias("value"), F.lit(1).alias("seq")))  # the last write wins
    after = cache.put(cache.delete_prefix(_cache(spark, sf, now), "k9"), twice, now)
    keys = table(spark, sf, "events").select(F.concat(F.lit("k"), F.col("event_id")).alias("key"))
    return cache.get(after, keys, now)


@query
def cache_counters(spark, sf):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    have = table(spark, sf, "region").select(F.col("r_name").alias("key"), F.lit("10").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    amounts = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise("other").alias("key"), F.col("n_nationkey").alias("amount"))
    return cache.increment(have, amounts, now).select("key", "value")


@query
def routed_answers(spark, sf):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    requests = questions(spark, sf).select("query", "question", F.concat(F.lit("k"), F.col("query")).alias("cache_key"), F.lit(True).alias("use_cache"), F.lit("").alias("source"), F.lit("").alias("strategy"), F.array().cast("array<string>").alias("history"))
    entry = F.to_json(F.struct(F.lit("cached").alias("answer"), F.lit(0).alias("degrade_level")))
    stored = requests.where(F.length("question") < 80).select(F.col("cache_key").alias("key"), entry.alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    faq = _faq(spark, sf).where(F.length("question") < 120)
    extra = lambda d, s: d.select("query", "answer", F.lit(s).alias("stage"), F.lit("faq").alias("intent"), F.lit("faq_fast_channel").alias("strategy"), F.lit(0.95).alias("confidence"), F.lit(0).alias("degrade_level"), F.lit("").alias("degrade_reason"))
    stages = [
        lambda r: route.from_cache(r, stored, now),
        lambda r: extra(lexical.exact_matches(route.wants_faq(r), faq), "faq"),
        lambda r: extra(r.select("query", F.lit("deep").alias("answer")), "deep"),
    ]
    return route.route(requests, stages).select("query", "answer", "stage", "degrade_level")


@query
def strategy_branches(spark, sf):
    r = questions(spark, sf).select("query", F.substring(F.col("question"), 1, 8).alias("question"), F.element_at(F.array(*map(F.lit, ("direct", "hyde", "subquery", "backtracking"))), (F.col("query") % 4 + 1).cast("int")).alias("strategy"))
    return route.by_strategy(r, F.lit("h"), F.lit(""), F.array(F.lit("a"), F.lit("b")))


# -------------------------------------------------------- sources, models (A, M)

@query
def store_prepared(spark, sf):
    v = vector_rows(spark, sf).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 > 0, F.col("parent_id")).alias("parent_id"), F.lit(None).cast("string").alias("parent_content"), F.when(F.col("id") % 2 > 0, "s").alias("source"), F.lit(7).cast("bigint").alias("timestamp"))
    return stores.prepared(v, F.lit("2020-01-01 00:00:00").cast("timestamp"))


@query
def store_info(spark, sf):
    return stores.info(chunking.split_documents(documents(spark, sf), "doc_id", "content")).select("n_rows", "n_parent", "n_child")


@query
def safe_file_names(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit(":x")).alias("title"), F.col("page_id").cast("string").alias("topic_id"), F.lpad(F.col("page_id").cast("string"), 9, "0").alias("path"))
    return corpus.safe_names(p).select("topic_id", "file_name")


@query
def source_labels(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/data/raw/"), F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("/"))).otherwise(""), F.lit("a_b.txt")).alias("path"))
    return p.select("page_id", tx.source_label(F.col("path"), "/data/raw").alias("source"))


@query
def ingest_rows(spark, sf):
    out = ingest.ingest(documents(spark, sf), F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return out.select("id", "chunk_type", "source", "hash_id", F.size("dense").alias("n_dense"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
