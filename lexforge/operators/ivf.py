"""Approximate vector search over an inverted file: vectors lie by their nearest centroid, and a query reads a few lists.

``build`` finds centroids by k-means (rounds of sums in tasks, over a sample of stated size) and
writes every row below a folder, partitioned by list. ``search`` names each query's
``nprobe`` lists, reads those partitions alone, and multiplies blocks of rows with blocks of the
queries that probe the same list. How many lists a wished recall takes is measured (``probes_for``). Rows and queries meet by a join on the list, so either side
may be large: the planner broadcasts the queries' blocks where they are small, and splits long lists
where they are not. A task keeps ``k`` hits a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT
from ..shared import Workspace, written
from .inverted import spread
from .lexical import top

#: Most bytes of all centroids, which every task holds, and of a block of rows or of queries.
CENTROID_BYTES = 64 << 20
BLOCK_BYTES = 1 << 19
#: Rows of a sample that name the lists are told apart by this many hash values.
GRAIN = 1 << 24
#: Hits that a task holds before it drops those beyond ``k`` a query.
HELD = 1 << 19


@dataclass(frozen=True)
class Lists:
    """``count`` lists at most (fewer if the sample has fewer different vectors), of which ``probes`` are read for a query;
    centroids come from ``rounds`` rounds over about ``sample`` rows, chosen by hash."""

    count: int = DEFAULT.nlist
    probes: int = DEFAULT.nprobe
    sample: int = 131_072
    rounds: int = 10


@dataclass(frozen=True)
class Index:
    """A folder of rows by ``_list``, and the lists' centroids."""

    path: str
    id: str
    vector: str
    centroids: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        shape = spark.read.parquet(f"{self.path}/shape").schema
        return spark.read.schema(shape.add("_list", "integer")).parquet(f"{self.path}/rows")


def usable(vector: Column) -> Column:
    """Not null, and all components finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))) & (F.size(vector) > 0), F.lit(False))


def build(docs: DataFrame, doc_id: str, doc_vector: str, path: str | None = None, rule: Lists = Lists()) -> Index:
    """An index below ``path`` (a new one; by default in the shared folder) with all columns of ``docs``.

    Rows without an id, or whose vector is null, empty or has null or non-finite components, are
    not indexed; vectors of unlike lengths are an error. Repeated rows stay repeated. A table without
    vectors gives an index without lists. A column named ``_list`` is an error.
    """
    if "_list" in docs.columns:
        raise ValueError("a column is named _list")
    spark, path = docs.sparkSession, path or Workspace(docs.sparkSession, "ivf").path("index")
    rows = docs.where(usable(F.col(f"`{doc_vector}`")) & F.col(f"`{doc_id}`").isNotNull())
    centroids = _centroids(rows.select(F.col(f"`{doc_vector}`").cast("array<double>").alias("v")), rule)
    _assigned(rows, doc_vector, centroids).hint("rebalance", "_list").write.partitionBy("_list").parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/shape")
    kept = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(kept, "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    return Index(path, doc_id, doc_vector, centroids)


def load(spark: SparkSession, path: str, doc_id: str, doc_vector: str) -> Index:
    kept = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()  # as many as lists, of bounded size
    return Index(path, doc_id, doc_vector, _matrix(kept.column("centroid").combine_chunks()) if kept.num_rows else np.empty((0, 0)))


def search(index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int = DEFAULT.top_retrieve, probes: int = Lists.probes, where: Column | None = None) -> DataFrame:
    """(query, doc, score, rank): the ``k`` largest inner products among each query's ``probes`` lists, ties to the smallest doc.

    A query's lists are those whose centroids have the largest inner products with it; with as many
    probes as lists the search is exact. ``where`` speaks of the indexed columns and comes before the
    search. Scores are rounded to nine places. Queries without an id or a usable vector have no rows.
    """
    return top(_hits(index, queries, query_id, query_vector, k, probes, where).drop("list"), k)


def probes_for(index: Index, spark: SparkSession, k: int = DEFAULT.top_retrieve, recall: float = 0.95, asked: int = 256) -> int:
    """The fewest probes that find ``recall`` of the true ``k`` best of ``asked`` indexed rows, chosen by hash, each row itself left out.

    Reads the index once, since the truth is an exact search; what comes to the driver is ``asked`` vectors and
    ``asked`` x (k + 1) list numbers, whatever the index's size. At least one; 1 for an index without lists.
    """
    chosen = index.rows(spark).select(F.col(f"`{index.id}`").alias("query"), F.col(f"`{index.vector}`").cast("array<double>").alias("v"))
    chosen = written(chosen.orderBy(F.xxhash64(F.lit(2), "query"), "query", "v").limit(asked).dropDuplicates(["query"]), "asked")
    hits = top(_hits(index, chosen, "query", "v", k + 1, len(index.centroids), None), k + 1).where("doc <> query").select("query", "list")
    found, vectors = hits.toArrow(), chosen.toArrow()
    if not found.num_rows:
        return 1
    order = np.argsort(-(_matrix(vectors.column("v").combine_chunks()) @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of a list among those that a query reads
    of = {q: i for i, q in enumerate(vectors.column("query").to_pylist())}
    at = np.sort(place[[of[q] for q in found.column("query").to_pylist()], found.column("list").to_numpy()])
    return int(at[int(np.ceil(recall * len(at))) - 1]) + 1


def _hits(index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int, where: Column | None) -> DataFrame:
    """(query, doc, list, score): the ``k`` best that each task has found, or more."""
    spark = queries.sparkSession
    asked = queries.where(usable(F.col(f"`{query_vector}`")) & F.col(f"`{query_id}`").isNotNull()).select(F.col(f"`{query_id}`").alias("query"), F.col(f"`{query_vector}`").cast("array<double>").alias("v"))
    probed = _probes(asked, index.centroids, max(1, probes))
    asked = written(_packed(probed.hint("rebalance", "_list").sortWithinPartitions("_list"), "query"), "probes")
    lists = [r[0] for r in asked.select("_list").distinct().collect()]  # at most as many as centroids
    rows = index.rows(spark).where(F.col("_list").isin(lists))
    rows = (rows if where is None else rows.where(where)).select("_list", F.col(f"`{index.id}`").alias("doc"), F.col(f"`{index.vector}`").cast("array<double>").alias("v"))
    pairs = _packed(rows, "doc").join(asked, "_list").select("docs", "doc_v", "queries", "query_v", "_list")
    query_kind, doc_kind = asked.schema["queries"].dataType.elementType, rows.schema["doc"].dataType
    return pairs.mapInArrow(_scorer(k, to_arrow_type(query_kind), to_arrow_type(doc_kind)), f"query {query_kind.simpleString()}, doc {doc_kind.simpleString()}, list int, score double")


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors have unlike lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid at the least distance, ties to the first."""
    if v.shape[1] != centroids.shape[1]:
        raise ValueError(f"a vector has {v.shape[1]} components, the index {centroids.shape[1]}")
    return np.argmax(v @ centroids.T - (centroids * centroids).sum(1) / 2, axis=1)


def _centroids(rows: DataFrame, rule: Lists) -> np.ndarray:
    """k-means over a sample; a list that no row is nearest to keeps its centroid."""
    n = rows.count()
    chance = F.pmod(F.xxhash64("v"), F.lit(GRAIN)) < (GRAIN * rule.sample) // max(n, 1)
    sample = written(spread(rows.where(chance) if n > rule.sample else rows), "sample")
    first = sample.distinct().orderBy(F.xxhash64(F.lit(1), "v"), "v").limit(rule.count).toArrow().column(0).combine_chunks()
    if not len(first):
        return np.empty((0, 0))
    centroids = _matrix(first)
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError(f"{len(centroids)} centroids take {centroids.nbytes} bytes, over {CENTROID_BYTES}: ask for fewer lists")
    for _ in range(rule.rounds):
        moved = sample.mapInArrow(_partial_sums(rows.sparkSession.sparkContext.broadcast(centroids)), "list int, total array<double>, n long")
        moved = moved.groupBy("list").applyInArrow(_means, "list int, centroid array<double>").toArrow()  # a row a list
        after = centroids.copy()
        if moved.num_rows:
            after[moved.column("list").to_numpy()] = _matrix(moved.column("centroid").combine_chunks())
        if np.array_equal(after, centroids):
            break
        centroids = after
    return centroids


def _partial_sums(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                of = _nearest(v, centroids)
                order = np.argsort(of, kind="stable")
                used, start = np.unique(of[order], return_index=True)
                total[used] += np.add.reduceat(v[order], start, axis=0)
                n += np.bincount(of, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), _lists(total[used]), pa.array(n[used])], names=["list", "total", "n"])

    return run


def _means(part: pa.Table) -> pa.Table:
    """One list's mean from the tasks' sums, added in order of size so that it does not hang on theirs."""
    total = np.sort(_matrix(part.column("total").combine_chunks()), axis=0).sum(0)
    return pa.table({"list": part.column("list").slice(0, 1).combine_chunks(), "centroid": _lists((total / sum(part.column("n").to_pylist()))[None])})


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] if len(matrix) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _assigned(rows: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """Adds ``_list``."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    at = rows.columns.index(vector)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", `_list` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = _nearest(_matrix(batch.column(at)), sent.value).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of)], names=[*batch.schema.names, "_list"])

    return spread(rows).mapInArrow(run, shape)


def _probes(asked: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(_list, query, v): a row for each list that a query reads."""
    sent = asked.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if not batch.num_rows or not len(c):
                continue
            v = _matrix(batch.column(1))
            if v.shape[1] != c.shape[1]:
                raise ValueError(f"a query has {v.shape[1]} components, the index {c.shape[1]}")
            near = np.argsort(-(v @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            for j in range(near.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(near[:, j]), batch.column(0), batch.column(1)], names=["_list", "query", "v"])

    return asked.mapInArrow(run, f"_list int, query {asked.schema['query'].dataType.simpleString()}, v array<double>")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Rows (_list, id, v) as blocks of one list each: ids, and vectors as the bytes of a matrix."""
    plural = {"doc": "docs", "query": "queries"}[name]
    kind = rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, of = _matrix(batch.column(2)), batch.column(0).to_numpy()
            most = max(1, BLOCK_BYTES // (8 * v.shape[1]))
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for begin, end in zip(edges, edges[1:]):
                for at in range(begin, end, most):
                    stop = min(at + most, end)
                    ids = batch.column(1).slice(at, stop - at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(of[at])], pa.int32()), pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), pa.concat_arrays([ids])), pa.array([v[at:stop].tobytes()], pa.binary())], names=["_list", plural, f"{name}_v"]
                    )

    return rows.mapInArrow(run, f"_list int, {plural} array<{kind}>, {name}_v binary")


def _scorer(k: int, query_type: pa.DataType, doc_type: pa.DataType):
    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True).sort_values(["query", "score", "doc"], ascending=[True, False, True])
        return rows.groupby("query", sort=False).head(k)

    def out(rows: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows["query"].tolist(), query_type), pa.array(rows["doc"].tolist(), doc_type), pa.array(rows["list"].to_numpy(), pa.int32()), pa.array(rows["score"].to_numpy())], names=["query", "doc", "list", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            for b in range(batch.num_rows):
                docs, doc_v, queries, query_v, part = (c[b] for c in batch.columns)
                v, q = (np.frombuffer(x.as_buffer()).reshape(len(ids), -1) for x, ids in ((doc_v, docs), (query_v, queries)))
                s = np.round(q @ v.T, 9)
                bar = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else -np.inf
                i, j = np.nonzero(s >= bar)  # ties with the k-th stay
                held.append(pd.DataFrame({"query": queries.values.to_pandas().to_numpy()[i], "doc": docs.values.to_pandas().to_numpy()[j], "list": np.full(len(i), part.as_py(), np.int32), "score": s[i, j]}))
                size += len(i)
                if size > HELD:
                    held = [best(held)]
                    size = len(held[0])
                    if size > HELD // 2:  # very many queries: their hits so far go on
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(best(held))

    return run
