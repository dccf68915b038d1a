"""From child hits to parents, levels of fallback, merging of branches and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from .chunking import split_hits


def to_parents(hits: DataFrame, most_children: int = DEFAULT.top_children) -> DataFrame:
    """One row per query and parent of child hits (query, id, content, score, source, parent_id, parent_content, rank[, topic_anchor]).

    The first hit gives source and text, the best one (the first among equals) the text to
    rerank; ``children_ids`` are in order; an anchor among the first children marks the parent.
    Rank: anchors first, then by score, ties by first appearance. Orphans must be gone.
    """
    if "topic_anchor" not in hits.columns:
        hits = hits.withColumn("topic_anchor", F.lit(False))
    hits = hits.withColumn("_k", F.row_number().over(Window.partitionBy("query", "parent_id").orderBy("rank")))
    out = hits.groupBy("query", F.col("parent_id").alias("id")).agg(
        F.min_by(F.struct("source", "parent_content"), "rank").alias("_first"),
        F.max("score").alias("score"),
        F.min_by("content", F.struct(-F.col("score"), F.col("rank"))).alias("rerank_content"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") <= most_children, F.struct("rank", "id")))), lambda x: x["id"]).alias("children_ids"),
        F.bool_or(F.col("topic_anchor") & (F.col("_k") <= most_children)).alias("topic_anchor"),
        F.min("rank").alias("_place"),
    )
    w = Window.partitionBy("query").orderBy(F.desc("topic_anchor"), F.desc("score"), "_place")
    return out.select("query", "id", F.col("_first.parent_content").alias("content"), "rerank_content", "score", F.col("_first.source").alias("source"), "children_ids", "topic_anchor", F.row_number().over(w).alias("rank"))


def tiered(queries: DataFrame, children: DataFrame, relaxed: DataFrame, errors: DataFrame | None = None, rule: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Retrieval results by level, as (one row a query, one row a parent).

    ``children``: child hits by query; those without a parent are orphans, dropped and
    counted. ``relaxed``: hits of any kind, used only by queries without a child hit: the first
    five are cut into child-sized pieces, 16 at most. ``errors``: queries whose search failed.
    Levels: 0 children, 1 pieces of parents, 2 nothing, with a reason.
    """
    orphan = F.coalesce(F.col("parent_id"), F.lit("")) == ""
    found = children.groupBy("query").agg(F.count_if(orphan).alias("orphan_count"), F.count_if(~orphan).alias("n_children"))
    level0 = to_parents(children.where(~orphan), rule.top_children)

    rest = queries.select("query").join(found.where("n_children > 0").select("query"), "query", "left_anti")
    wide = relaxed.join(rest, "query", "left_semi").where(F.col("rank") <= rule.top_children)
    pieces = split_hits(wide, rule)
    pieces = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "piece"))).where(F.col("rank") <= rule.top_retrieve)
    level1 = to_parents(pieces.drop("piece"), rule.top_retrieve) if rule.child_fallback else to_parents(pieces.drop("piece").where(F.lit(False)))

    failed = errors.select("query", F.lit(True).alias("_failed")) if errors is not None else queries.select("query", F.lit(False).alias("_failed")).where(F.lit(False))
    n1 = level1.groupBy("query").agg(F.count(F.lit(1)).alias("n_relaxed"))
    status = queries.select("query").join(found, "query", "left").join(n1, "query", "left").join(failed.distinct(), "query", "left")
    has0, has1, bad = (F.coalesce(c, F.lit(False)) for c in (F.col("n_children") > 0, F.col("n_relaxed") > 0, F.col("_failed")))
    level = F.when(bad, 2).when(has0, 0).when(has1, 1).otherwise(2)
    reason = F.when(bad, "retrieval_error").when(has0, "").when(has1, "child_recall_empty").otherwise("no_recall" if rule.child_fallback else "child_recall_empty")
    status = status.select("query", level.alias("degrade_level"), (level > 0).alias("degraded"), reason.alias("degrade_reason"), F.coalesce("orphan_count", F.lit(0)).alias("orphan_count"))
    parents = level0.unionByName(level1).join(status.where("degrade_level < 2").select("query"), "query", "left_semi")
    return status, parents


def merge_branches(parents: DataFrame) -> DataFrame:
    """Parents of several branches of a query (group, branch, id, ..., rank) to one row per id.

    The higher score wins, earlier branches among equals; anchors are or-ed; children are
    united in order. The order is by score alone, ties by first appearance.
    """
    place = F.struct("branch", "rank")
    best = F.min_by(F.struct("content", "rerank_content", "source"), F.struct((-F.col("score")).alias("s"), F.col("branch"), F.col("rank")))
    ids = F.array_sort(F.collect_list(F.struct("branch", "rank", "children_ids")))
    out = parents.groupBy("group", "id").agg(
        best.alias("_b"), F.max("score").alias("score"), F.bool_or("topic_anchor").alias("topic_anchor"),
        F.array_distinct(F.flatten(F.transform(ids, lambda x: x["children_ids"]))).alias("children_ids"), F.min(place).alias("_place"),
    )
    w = Window.partitionBy("group").orderBy(F.desc("score"), "_place")
    return out.select("group", "id", "_b.*", "score", "topic_anchor", "children_ids", F.row_number().over(w).alias("rank"))


def merge_levels(status: DataFrame) -> DataFrame:
    """(group, degrade_level, degrade_reason, orphan_count) of branches (group, branch, level, reason, n_docs, orphans, failed).

    A failed branch makes level 2; else the highest level of branches with documents; else
    the highest of all, 2 if there are none.
    """
    failed = F.coalesce(F.col("failed"), F.lit(False))
    out = status.withColumn("failed", failed).groupBy("group").agg(
        F.bool_or("failed").alias("_failed"), F.max(F.when(F.col("n_docs") > 0, F.col("level"))).alias("_with"), F.max("level").alias("_any"),
        F.sum("orphans").alias("orphan_count"), F.array_sort(F.collect_list(F.struct("branch", "level", "reason", "failed"))).alias("_all"),
    )
    level = F.when(F.col("_failed"), F.lit(2)).otherwise(F.coalesce("_with", "_any", F.lit(2)))
    out = out.withColumn("degrade_level", level)
    first = F.get(F.filter("_all", lambda x: F.when(F.col("_failed"), x["failed"]).otherwise(x["level"] == F.col("degrade_level"))), F.lit(0))
    return out.select("group", "degrade_level", first["reason"].alias("degrade_reason"), "orphan_count")


def recovered_parents(hits: DataFrame) -> DataFrame:
    """Parents of hits by the older rule: best score, first child's parent text, number of children; by score, then id."""
    out = hits.groupBy("query", F.col("parent_id").alias("id")).agg(F.max("score").alias("score"), F.min_by("parent_content", "rank").alias("content"), F.count(F.lit(1)).alias("children_count"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))


def rerank_groups(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """Reranked children by parent, where the parent is there: best score (not below 0) and how many."""
    out = hits.groupBy("query", "parent_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("max_score"), F.count(F.lit(1)).alias("children_count"))
    return out.join(parents.select(F.col("id").alias("parent_id"), F.col("content").alias("parent_content")), "parent_id")


def checked_score(score: Column) -> Column:
    """A model's score, or an error: a missing or non-finite one must not be ranked."""
    fine = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return F.when(fine, score).otherwise(F.raise_error(F.lit("the reranker returned no finite score")).cast("double"))


def rerank(parents: DataFrame, score: Column, k: int = DEFAULT.top_rerank, anchors: bool = True, strict: bool = True) -> DataFrame:
    """The best ``k`` of each query by a model's ``score``; anchors first, unless told otherwise.

    Not strict: a query with a bad score keeps its first ``k`` as they were.
    """
    rows = parents.withColumn("rerank_score", checked_score(score) if strict else score)
    if not strict:
        bad = F.bool_or(F.col("rerank_score").isNull() | F.isnan("rerank_score") | (F.abs("rerank_score") == float("inf"))).over(Window.partitionBy("query"))
        rows = rows.withColumn("_bad", bad)
    keys = ([F.desc("topic_anchor")] if anchors else []) + [F.desc("rerank_score"), F.asc("rank")]
    if not strict:
        keys = [F.when(F.col("_bad"), F.col("rank")), *keys]
    limit = F.col("k") if "k" in parents.columns else F.lit(k)
    out = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(*keys))).where(F.col("_n") <= limit)
    return out.withColumn("rank", F.col("_n")).drop("_n", "_bad")


def contexts(parents: DataFrame, k: int = DEFAULT.top_rerank) -> DataFrame:
    """(query, context): numbered blocks of the first ``k`` documents, each under its title."""
    from ..functions.text import knowledge_text

    block = F.concat(F.lit("【知识来源"), F.col("rank").cast("string"), F.lit("】\n"), knowledge_text(F.col("source"), F.col("content")))
    rows = parents.where(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_b"))
    return rows.select("query", F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("context"))


def degrade_metrics(log: DataFrame) -> DataFrame:
    """One row: number of results and the shares of levels 1 and 2; 0.0 for none."""
    rate = lambda k: F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.round(F.count_if(F.col("degrade_level") == k) / F.count(F.lit(1)), 4))
    return log.agg(F.count(F.lit(1)).alias("total"), rate(1).alias("l1_rate"), rate(2).alias("l2_rate"))
