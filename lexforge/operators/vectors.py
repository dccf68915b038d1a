"""Exact vector search, sparse search and their fusion, many queries at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..shared import bound_batches, written
from . import inverted
from .lexical import top

#: Most bytes of query vectors that are sent to every task; more queries go in several such blocks.
QUERY_BYTES = 64 << 20
#: Queries and vectors whose scores a task holds at a time.
TILE_QUERIES, TILE_ROWS = 128, 8192


def inner(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_top(docs: DataFrame, queries: DataFrame, doc_id: str, doc_vector: str, query_id: str, query_vector: str, k: int = DEFAULT.top_retrieve, where: Column | None = None) -> DataFrame:
    """(query, doc, score, rank): the ``k`` largest inner products of each query, ties to the smallest doc.

    The filter comes before the search, so rows it drops take no place. Queries are read in
    blocks of bounded size, one at a time: the table is read once for each full block, whose
    hits are written before the next one is sent. Each task multiplies its rows with a block
    tile by tile and keeps ``k`` a query, so what is shuffled is tasks x queries x k rows, and a
    task's memory does not grow with queries x rows. A score that is no number counts as the greatest, as it sorts.
    """
    bound_batches(docs.sparkSession)
    rows = docs if where is None else docs.where(where)
    rows = rows.select(F.col(doc_id).alias("doc"), F.col(doc_vector).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(query_id).alias("query"), F.col(query_vector).cast("array<double>").alias("q")).where("q is not null")
    asked_type = to_arrow_type(asked.schema["query"].dataType)
    doc_kind, query_kind = (rows.schema["doc"].dataType.simpleString(), asked.schema["query"].dataType.simpleString())
    parts: list[DataFrame] = []
    for block in _blocks(asked):
        ids, matrix = block
        sent = docs.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of the queries from a place on: query, doc, score
            kind = None
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_ROWS):
                    part = batch.slice(at, TILE_ROWS)
                    v = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                    doc, kind = np.array(part.column(0).to_pylist()), part.column(0).type
                    for q in range(0, len(ids), TILE_QUERIES):
                        best[q] = _best(matrix[q : q + TILE_QUERIES] @ v.T, doc, k, best.get(q))
            for q, (row, doc, score) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array([ids[q + i] for i in row.tolist()], asked_type), pa.array(doc.tolist(), kind), pa.array(score)], names=["query", "doc", "score"])

        parts.append(rows.mapInArrow(run, f"query {query_kind}, doc {doc_kind}, score double"))
        if len(matrix) * matrix.itemsize * matrix.shape[1] >= QUERY_BYTES:  # there may be more: this block's hits are written, and its vectors go
            parts[-1] = written(parts[-1], "hits")
            sent.destroy()
    if not parts:
        return top(asked.join(rows, F.lit(False)).select("query", "doc", F.lit(0.0).alias("score")), k)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top(out, k)


def _best(scores: np.ndarray, doc: np.ndarray, k: int, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, doc, score), sorted: the ``k`` best of each row of ``scores`` and of those held, ties to the smallest doc."""
    if scores.shape[1] > k:
        bar = np.partition(scores, -k, axis=1)[:, -k]
        row, at = np.nonzero(~(scores < bar[:, None]))
    else:
        row, at = (x.reshape(-1) for x in np.indices(scores.shape))
    doc, score = doc[at], scores[row, at]
    if held is not None:
        row, doc, score = (np.concatenate(x) for x in zip(held, (row, doc, score)))
    order = np.lexsort((doc, -score, ~np.isnan(score), row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], doc[order][keep], score[order][keep]


def _blocks(asked: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Query vectors in blocks of at most QUERY_BYTES; the driver holds one at a time."""
    ids: list = []
    held: list[list[float]] = []
    size = 0
    for row in asked.orderBy("query").toLocalIterator():
        ids.append(row[0])
        held.append(row[1])
        size += 8 * len(row[1])
        if size >= QUERY_BYTES:
            yield ids, np.array(held)
            ids, held, size = [], [], 0
    if ids:
        yield ids, np.array(held)


def sparse_scores(docs: DataFrame, queries: DataFrame, drop: float = 0.0) -> DataFrame:
    """(query, doc, score) from (doc, token, weight) and (query, token, weight): inner products over shared tokens.

    ``drop``: this part of each query's tokens, those of the least weight (ties by token), is not searched for.
    """
    q = kept_weights(queries, drop).select("query", "token", F.col("weight").alias("query_weight"))
    return docs.join(q, "token").groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("query_weight")).alias("score"))


def sparse_top(docs: DataFrame, queries: DataFrame, doc_id: str, doc_weights: str, query_id: str, query_weights: str, k: int = DEFAULT.top_retrieve, drop: float = 0.0) -> DataFrame:
    """(query, doc, score, rank): the ``k`` largest inner products of maps (token to weight); weights that are not above 0 don't count.

    Rows become blocks of postings of the queries' tokens, written once; a task keeps ``k`` hits a
    query and skips blocks that cannot reach them. ``drop`` as in ``sparse_scores``.
    """
    asked = written(kept_weights(exploded_weights(queries, query_id, query_weights, "query"), drop).select("query", F.col("token").cast("string").alias("token"), "weight"), "asked")
    rows = docs.select(F.col(doc_id).alias("doc"), F.map_keys(doc_weights).cast("array<string>").alias("tokens"), F.map_values(doc_weights).cast("array<double>").alias("weights"))
    return top(inverted.search(written(inverted.build(rows, asked), "blocks"), asked, k), k)


def kept_weights(queries: DataFrame, drop: float = 0.0) -> DataFrame:
    """(query, token, weight) without the ``drop`` part of each query's tokens, those of the least weight (ties by token)."""
    if not drop:
        return queries
    w = Window.partitionBy("query")
    numbered = queries.withColumn("_k", F.row_number().over(w.orderBy("weight", "token"))).withColumn("_n", F.count(F.lit(1)).over(w))
    return numbered.where(F.col("_k") > F.floor(F.lit(drop) * F.col("_n"))).drop("_k", "_n")


def exploded_weights(df: DataFrame, id_col: str, weights_col: str, name: str = "doc") -> DataFrame:
    """(id, token, weight) of a map column; only positive weights count."""
    return df.select(F.col(id_col).alias(name), F.explode(weights_col).alias("token", "weight")).where("weight > 0")


def mapped(score: Column) -> Column:
    """An inner product mapped to 0..1: 0.5 + atan(x) / pi."""
    return 0.5 + F.atan(score) / math.pi


def fuse(dense: DataFrame, sparse: DataFrame, k: int = DEFAULT.top_retrieve, rule: Settings = DEFAULT, dense_weight: float | None = None, sparse_weight: float | None = None) -> DataFrame:
    """(query, doc, score, rank): weighted sum of the branches' mapped scores.

    Each branch is cut to its ``k`` best first; a hit that only one has gets nothing from the other.
    """
    a = top(dense, k).select("query", "doc", F.col("score").alias("d"))
    b = top(sparse, k).select("query", "doc", F.col("score").alias("s"))
    wd, ws = rule.dense_weight if dense_weight is None else dense_weight, rule.sparse_weight if sparse_weight is None else sparse_weight
    both = a.join(b, ["query", "doc"], "full_outer")
    score = wd * F.coalesce(mapped(F.col("d")), F.lit(0.0)) + ws * F.coalesce(mapped(F.col("s")), F.lit(0.0))
    return top(both.select("query", "doc", score.alias("score")), k)


def title_anchors(queries: DataFrame, titles: DataFrame, most: int = 2) -> DataFrame:
    """(query, title, rank): titles of two characters or more that a query contains, the longest first.

    Titles meet queries by substrings: a query's parts of each length that titles have
    are generated and joined on equality, so no pair without a match is ever formed.
    """
    names = titles.select(F.col("title")).where(F.length("title") >= 2).distinct()
    lengths = names.agg(F.sort_array(F.collect_set(F.length("title"))).alias("lengths"))  # one row; as many as lengths differ
    text = queries.select("query", F.col("question").alias("t")).join(F.broadcast(lengths))
    parts = F.flatten(F.transform("lengths", lambda n: F.when(F.length("t") >= n, F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring("t", i, n))).otherwise(F.array().cast("array<string>"))))
    found = text.select("query", F.explode(F.array_distinct(parts)).alias("title")).join(names, "title")
    return top(found.select("query", "title"), most, order=(F.desc(F.length("title")), F.asc("title")))


def anchored(hits: DataFrame, by_title: DataFrame) -> DataFrame:
    """Hits with the anchors' best children in front, each id once, the first place kept.

    ``hits``: query, id, rank, ...; ``by_title``: the same columns, the best child of each anchored
    title, with the title's rank. Adds ``topic_anchor``.
    """
    front = by_title.withColumn("topic_anchor", F.lit(True)).withColumn("_place", F.col("rank") - 1_000_000)
    rest = hits.withColumn("topic_anchor", F.lit(False)).withColumn("_place", F.col("rank"))
    both = front.unionByName(rest).withColumn("_n", F.row_number().over(Window.partitionBy("query", "id").orderBy("_place"))).where("_n = 1")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("_place", "id"))).drop("_n", "_place")


def merge_queries(hits: DataFrame, limit: int = DEFAULT.top_retrieve) -> DataFrame:
    """Hits of several rewritten queries (group, id, score, ...) to the best per id, the best ``limit`` of a group."""
    one = hits.withColumn("_n", F.row_number().over(Window.partitionBy("group", "id").orderBy(F.desc("score"), "query"))).where("_n = 1").drop("_n")
    return top(one, limit, by=("group",), order=(F.desc("score"), F.asc("id")))
