"""BM25 by an inverted table: statistics and scores are joins and sums on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT, Settings
from ..functions.text import normalize_query, same_question, utokens
from ..shared import written
from . import inverted


def tokens_of(text: Column) -> Column:
    """The tokeniser without a dictionary: lower case, cut at white space."""
    return utokens(F.lower(F.coalesce(text, F.lit(""))))


def postings(df: DataFrame, id_col: str, text_col: str, tokens=tokens_of) -> DataFrame:
    """(doc, token, tf, length), one row per distinct token of a document."""
    rows = df.select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("w"))
    rows = rows.select("doc", F.size("w").alias("length"), F.explode("w").alias("token"))
    return rows.groupBy("doc", "token", "length").agg(F.count(F.lit(1)).alias("tf")).select("doc", "token", "tf", "length")


def corpus(df: DataFrame, text_col: str, tokens=tokens_of) -> DataFrame:
    """One row: number of documents and mean length."""
    return df.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(F.col(text_col)))).alias("mean_length"))


def idf(table: DataFrame, size: DataFrame) -> DataFrame:
    """(token, df, idf): ln(1 + (N - df + 0.5) / (df + 0.5))."""
    n = table.groupBy("token").agg(F.count(F.lit(1)).alias("df"))  # a token has one row a document
    return n.join(F.broadcast(size)).select("token", "df", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # size is one row


def query_tokens(queries: DataFrame, id_col: str, text_col: str, tokens=tokens_of) -> DataFrame:
    """(query, token, weight): how often the query has the token; each occurrence counts."""
    rows = queries.select(F.col(id_col).alias("query"), F.explode(tokens(F.col(text_col))).alias("token"))
    return rows.groupBy("query", "token").agg(F.count(F.lit(1)).alias("weight"))


def scores(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, rule: Settings = DEFAULT, tokens=tokens_of) -> DataFrame:
    """(query, doc, score) of every pair that shares a token.

    Documents are read and cut into tokens once: what is written to the shared folder is a
    row of each document with its length, and its counts of the tokens that some query has,
    so the table is as large as the queries' vocabulary makes it, not the corpus. Size, mean
    length and idf come from that table. It lies by document, so sums over a document's
    tokens are made before they are shuffled, whatever the frequency of a token.
    """
    asked = query_tokens(queries, query_id, query_text, tokens)
    wanted = asked.select("token").distinct().withColumn("wanted", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(doc_text)).alias("w"))
    rows = rows.select("doc", F.size("w").alias("length"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "w")).alias("token"))
    rows = rows.join(wanted, "token", "left").where("wanted or token is null").drop("wanted")
    table = written(rows.repartition("doc").groupBy("doc", "length", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
    size = table.where("token is null").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean_length"))  # one row
    table = table.where("token is not null")
    weights = written(asked.join(idf(table, size), "token").select("token", "query", (F.col("weight") * F.col("idf") * (rule.k1 + 1)).alias("weight")), "weights")
    part = F.col("weight") * F.col("tf") / (F.col("tf") + rule.k1 * (1 - rule.b + rule.b * F.col("length") / F.col("mean_length")))
    joined = table.join(F.broadcast(size.select("mean_length"))).join(weights, "token")
    return joined.groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))  # ties must not hang on the order of a sum


def ranked(docs: DataFrame, queries: DataFrame, doc_id: str, doc_text: str, query_id: str, query_text: str, k: int, rule: Settings = DEFAULT, tokens=tokens_of) -> DataFrame:
    """(query, doc, score, rank): the ``k`` best documents of each query by BM25, as the best of ``scores``.

    Documents become blocks of postings of the queries' tokens, written once; a task keeps ``k`` hits a query.
    """
    asked = written(query_tokens(queries, query_id, query_text, tokens), "asked")
    rows = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(doc_text)).alias("tokens"))
    blocks = written(inverted.build(rows, asked), "blocks")
    return top(inverted.bm25(blocks, asked, k, rule), k)


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query",), order: tuple[Column, ...] | None = None) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1; ties go to the smallest doc."""
    order = order or (F.desc("score"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def softmax_top(scored: DataFrame, n_docs: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(query, doc, score, rank, probability) over each query's ``k`` best raw scores.

    With ``n_docs`` (one row: n_docs), a query with fewer matches than ``k`` is padded by zero scores, as a
    search over all documents would be. Queries whose best score isn't above 0 have no rows.
    """
    best = top(scored.where("score > 0"), k)
    w = Window.partitionBy("query")
    rows = best.withColumn("_e", F.exp(F.col("score") - F.max("score").over(w))).withColumn("_found", F.count(F.lit(1)).over(w)).withColumn("_top", F.max("score").over(w))
    total = F.sum("_e").over(w)
    if n_docs is not None:
        rows = rows.join(F.broadcast(n_docs.select("n_docs")))  # one row
        total = total + F.greatest(F.least(F.col("n_docs"), F.lit(k)) - F.col("_found"), F.lit(0)) * F.exp(-F.col("_top"))
    return rows.select("query", "doc", "score", "rank", (F.col("_e") / total).alias("probability"))


def faq_answers(questions: DataFrame, faq: DataFrame, ranked: DataFrame, rule: Settings = DEFAULT) -> DataFrame:
    """Questions that the FAQ answers: (query, faq_id, answer, confidence, intent, strategy, cache_key).

    ``questions``: query, question. ``faq``: id, question, answer, as the rows are now, and
    ``indexed``, the question as the index has it. ``ranked``: ``softmax_top`` over the index.
    The best entry must reach the threshold, and the question must equal both the indexed one
    and the row's present one; blank answers don't count.
    """
    best = ranked.where((F.col("rank") == 1) & (F.col("probability") >= rule.faq_threshold)).select("query", F.col("doc").alias("id"))
    rows = questions.join(best, "query").join(faq.withColumnRenamed("question", "stored"), "id")
    exact = same_question(F.col("question"), F.col("indexed")) & same_question(F.col("question"), F.col("stored"))
    rows = rows.where(exact & (normalize_query(F.col("answer")) != ""))
    return rows.select("query", F.col("id").alias("faq_id"), "answer", F.lit(0.95).alias("confidence"), F.lit("faq").alias("intent"), F.lit("faq_fast_channel").alias("strategy"), F.concat(F.lit("faq:v3:"), F.md5(normalize_query(F.col("question")))).alias("cache_key"))


def exact_matches(questions: DataFrame, faq: DataFrame) -> DataFrame:
    """(query, faq_id, answer) where a question equals a stored one but for outer white space."""
    left = questions.withColumn("_k", normalize_query(F.col("question"))).where("_k <> ''")
    right = faq.select(F.col("id").alias("faq_id"), "answer", normalize_query(F.col("question")).alias("_k")).where(normalize_query(F.col("answer")) != "")
    return left.join(right, "_k").select("query", "faq_id", "answer")


def last_by_key(rows: DataFrame, key: str | tuple[str, ...], *ties: Column) -> DataFrame:
    """One row of each key, the last by the column ``seq`` if there is one, then by ``ties``; one row a key on each side of the shuffle."""
    keys = (key,) if isinstance(key, str) else key
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    order = F.struct(*([F.col("seq").alias("s")] if "seq" in rows.columns else []), *[c.alias(f"t{i}") for i, c in enumerate(ties)])
    last = rows.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, order).alias("_row"))
    return last.select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def faq_stats(faq: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(category, n, recent): entries a category and those of the last days, the largest first."""
    recent = F.count_if(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))
    return faq.groupBy("category").agg(F.count(F.lit(1)).alias("n"), recent.alias("recent")).orderBy(F.desc("n"), "category")


def upsert(faq: DataFrame, changes: DataFrame) -> DataFrame:
    """``faq`` with rows of ``changes`` (same columns and ``op``: put or delete) applied by id.

    Of several changes of one id the last by ``seq`` counts; without that column, or where it ties,
    a delete goes before a put and the puts in order of their values. Changes without an id are ignored.
    """
    last = last_by_key(changes.where("id is not null"), "id", F.col("op") == "put", *[F.col(f"`{c}`") for c in faq.columns if c != "id"])
    kept = faq.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.where("op = 'put'").select(*faq.columns))
