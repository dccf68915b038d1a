"""Top-k search over an inverted table in blocks of documents, pruned by each block's greatest impacts.

``build`` turns documents into rows of a few thousand each: the block's tokens, and for each token
its postings (place of the document in the block, weight), its greatest weight and the
length of its shortest document. ``search`` sends queries to the blocks, many at a time. A task bounds what
a query can reach in a block by the tokens' greatest impacts; a block that cannot reach
the query's ``k``-th score so far is skipped, any other is scored, and only ``k`` rows a query
leave the task. So what is shuffled is tasks x queries x k rows, however many documents share a token.

A table written once serves any number of searches (``written`` or a path of one's own).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Settings
from ..shared import bound_batches

#: Documents, and tokens, of a block at most.
BLOCK_DOCS = 2048
BLOCK_TOKENS = 1 << 20
#: Weights of queries that are sent to every task at a time, about 40 bytes each; the rest go in further passes.
SENT_WEIGHTS = 1 << 20

SHAPE = "docs array<{doc}>, lengths array<int>, tokens array<string>, starts array<int>, places array<int>, weights array<double>, most array<double>, shortest array<int>"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is read in fewer parts than there are: a small table in one file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build(rows: DataFrame, vocabulary: DataFrame | None = None, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of (doc, tokens) or (doc, tokens, weights): a token's weight is the sum over its places, 1 each if not given.

    ``vocabulary`` (token): other tokens are not indexed, though they count for a document's
    length; it is used where it has at most SENT_WEIGHTS tokens. ``weigh`` is applied to the sums. Weights
    that are not above 0 are left out. A null list of tokens is an empty one; a document without tokens
    is in a block all the same. Documents are told apart by row, so ids may repeat and may be null.
    """
    bound_batches(rows.sparkSession)
    weighted = "weights" in rows.columns
    body = rows.select("doc", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), *([F.coalesce(F.col("weights").cast("array<double>"), F.array().cast("array<double>")).alias("weights")] if weighted else []))
    known = None
    if vocabulary is not None:
        few = vocabulary.select("token").where("token is not null").distinct().limit(SENT_WEIGHTS + 1).toArrow().column(0).combine_chunks()
        known = few if len(few) <= SENT_WEIGHTS else None
    sent = rows.sparkSession.sparkContext.broadcast(known)
    doc_kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = sent.value
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_TOKENS, side="right"))
                stop = min(max(stop, at + 1), at + BLOCK_DOCS, batch.num_rows)
                yield _block(batch.slice(at, stop - at), sizes[at:stop], only, weighted, weigh)
                at = stop

    return spread(body).mapInArrow(run, SHAPE.format(doc=doc_kind))


def _block(part: pa.RecordBatch, sizes: np.ndarray, only, weighted: bool, weigh) -> pa.RecordBatch:
    flat = part.column(1).flatten()
    place = np.repeat(np.arange(len(sizes)), sizes)
    value = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float) if weighted else np.ones(len(flat))
    if len(value) != len(flat):
        raise ValueError("a document has more or fewer weights than tokens")
    keep = pc.is_valid(flat) if only is None else pc.is_in(flat, value_set=only)
    held = keep.to_numpy(zero_copy_only=False).astype(bool)
    coded = flat.filter(keep).dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + place[held]
    key, back = np.unique(key, return_inverse=True)
    weight = np.bincount(back, weights=value[held], minlength=len(key)) if len(key) else np.empty(0)
    weight = weigh(weight) if weigh else weight
    key, weight = key[weight > 0], weight[weight > 0]
    token, place = key // len(sizes), key % len(sizes)
    used, start = np.unique(token, return_index=True)
    starts = np.append(start, len(key)).astype(np.int32)
    most = np.maximum.reduceat(weight, start) if len(used) else weight
    shortest = np.minimum.reduceat(sizes[place], start) if len(used) else sizes[:0]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [one(part.column(0)), one(pa.array(sizes.astype(np.int32))), one(coded.dictionary.take(pa.array(used))), one(pa.array(starts)), one(pa.array(place.astype(np.int32))), one(pa.array(weight)), one(pa.array(most)), one(pa.array(shortest.astype(np.int32)))],
        names=["docs", "lengths", "tokens", "starts", "places", "weights", "most", "shortest"],
    )


def size(blocks: DataFrame) -> DataFrame:
    """One row: n_docs and mean_length of a table of blocks."""
    total = F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))
    return blocks.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("n_docs"), total.alias("_t")).select("n_docs", (F.col("_t") / F.nullif("n_docs", F.lit(0))).alias("mean_length"))


def frequencies(blocks: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(token, df): documents that have the token; of ``wanted`` (token) alone, if given."""
    rows = blocks.select(F.explode(F.transform("tokens", lambda t, i: F.struct(t.alias("token"), (F.get("starts", i + 1) - F.get("starts", i)).alias("n")))).alias("t")).select("t.token", "t.n")
    counts = rows.groupBy("token").agg(F.sum("n").alias("df"))
    return counts if wanted is None else counts.join(wanted.select("token").distinct(), "token", "left_semi")


def search(blocks: DataFrame, weights: DataFrame, k: int, saturation: tuple[float, float, float] | None = None, skipped=None) -> DataFrame:
    """(query, doc, score): at least the ``k`` best documents of each query, some more than once from several tasks.

    ``weights``: (query, token, weight), weights above 0. A posting's impact is its weight, or with ``saturation``
    (k1, b, mean length) the BM25 part tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)). Scores are
    rounded to nine places, and ties go to the smallest doc, so no order of sums changes a rank.
    Documents that share no token with a query are no hits. ``skipped``: an accumulator for blocks that bounds ruled out.
    """
    spark = blocks.sparkSession
    bound_batches(spark)
    asked = weights.select("query", "token", F.col("weight").cast("double").alias("weight")).where("weight > 0 and token is not null and query is not null")
    doc_type = blocks.schema["docs"].dataType.elementType
    query_type = to_arrow_type(asked.schema["query"].dataType)
    shape = f"query {asked.schema['query'].dataType.simpleString()}, doc {doc_type.simpleString()}, score double"
    passes = max(1, -(-asked.count() // SENT_WEIGHTS))
    out = None
    for i in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i)
        found = blocks.mapInArrow(_searcher(spark.sparkContext.broadcast(_matrix(part.toArrow())), k, saturation, to_arrow_type(doc_type), query_type, skipped), shape)
        out = found if out is None else out.unionByName(found)
    return out


def _matrix(rows: pa.Table):
    """Queries, the row each begins at, and of each row the token's number and the weight; and the tokens by number."""
    rows = rows.sort_by([("query", "ascending"), ("token", "ascending")])
    queries = rows.column("query").combine_chunks().dictionary_encode()
    tokens = rows.column("token").combine_chunks().dictionary_encode()
    of = queries.indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    names = {t: i for i, t in enumerate(tokens.dictionary.to_pylist())}
    return queries.dictionary.to_pylist(), starts, tokens.indices.to_numpy(zero_copy_only=False), rows.column("weight").to_numpy(), names


def _searcher(sent, k: int, saturation, doc_type: pa.DataType, query_type: pa.DataType, skipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, starts, token, weight, names = sent.value
        ends = np.append(starts[1:], len(token))
        bar = np.full(len(queries), -np.inf)  # each query's k-th score so far
        best: list = [None] * len(queries)
        impact = lambda w, n: w if saturation is None else w * (saturation[0] + 1) / (w + saturation[0] * (1 - saturation[1] + saturation[1] * n / saturation[2]))
        for batch in batches:
            for b in range(batch.num_rows if len(queries) else 0):
                docs, lengths, tokens, first, places, weights, most, shortest = (c[b].values for c in batch.columns)
                here = np.full(len(names), -1)
                for i, t in enumerate(tokens.to_pylist()):
                    at = names.get(t)
                    if at is not None:
                        here[at] = i
                local = here[token]
                top = np.append(impact(most.to_numpy(), shortest.to_numpy().astype(float)), 0.0)  # an impact grows with the weight and falls with the length
                reach = np.add.reduceat(weight * top[local], starts)
                open_ = np.flatnonzero((reach > 0) & (reach * (1 + 1e-9) + 1e-9 >= bar))
                if skipped is not None:
                    skipped.add(int((reach > 0).sum()) - len(open_))
                if not len(open_):
                    continue
                place, first = places.to_numpy(), first.to_numpy()
                part = impact(weights.to_numpy(), lengths.to_numpy().astype(float)[place])
                names_of = None
                for q in open_:
                    rows = np.arange(starts[q], ends[q])
                    rows = rows[local[rows] >= 0]
                    score = np.zeros(len(docs))
                    for j, w in zip(local[rows], weight[rows]):
                        s, e = first[j], first[j + 1]
                        score[place[s:e]] += w * part[s:e]
                    score = np.round(score, 9)
                    hit = np.flatnonzero((score > 0) & (score >= bar[q]))
                    if not len(hit):
                        continue
                    if names_of is None:
                        names_of = docs.to_pylist()
                    new = [(-s, names_of[h]) for s, h in zip(score[hit].tolist(), hit.tolist())]
                    best[q] = sorted([*(best[q] or ()), *new], key=_order)[:k]
                    if len(best[q]) == k:
                        bar[q] = -best[q][-1][0]
        rows = [(queries[q], d, -s) for q, hits in enumerate(best) for s, d in hits or ()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], query_type), pa.array([r[1] for r in rows], doc_type), pa.array([r[2] for r in rows], pa.float64())], names=["query", "doc", "score"])

    return run


def _order(hit: tuple) -> tuple:
    """By score, then doc; a null doc goes first, as in an ascending sort."""
    return hit[0], hit[1] is not None, hit[1] if hit[1] is not None else 0


def bm25_weights(blocks: DataFrame, asked: DataFrame, stats: DataFrame) -> DataFrame:
    """(query, token, weight) of (query, token, weight): the count of the token in the query times its idf, ln(1 + (N - df + 0.5) / (df + 0.5)).

    ``stats``: one row, n_docs and mean_length.
    """
    counts = frequencies(blocks, asked).join(F.broadcast(stats.select("n_docs")))  # one row
    idf = counts.select("token", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return asked.join(idf, "token").select("query", "token", (F.col("weight") * F.col("idf")).alias("weight"))


def bm25(blocks: DataFrame, asked: DataFrame, k: int, rule: Settings = DEFAULT, skipped=None) -> DataFrame:
    """(query, doc, score) as ``search`` gives them, by BM25 over a written table of blocks."""
    stats = size(blocks).first()
    mean = stats.mean_length or 1.0
    one = blocks.sparkSession.createDataFrame([(stats.n_docs,)], "n_docs long")
    return search(blocks, bm25_weights(blocks, asked, one), k, (rule.k1, rule.b, mean), skipped)
