"""Routing of questions: cache, then exact answers, then retrieval; what a stage answers leaves the rest to the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import acceptable, alive, cacheable

ANSWER = "query long, answer string, stage string, intent string, strategy string, confidence double, degrade_level int, degrade_reason string"
COLUMNS = [x.split()[0] for x in ANSWER.split(", ")]


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests whose question isn't blank."""
    return requests.where(F.trim(F.coalesce("question", F.lit(""))) != "")


def from_cache(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (query, cache_key, use_cache) that an acceptable entry answers."""
    kind = "answer string, intent string, strategy string, confidence double, degrade_level int, degrade_reason string"
    rows = requests.where(F.coalesce("use_cache", F.lit(True))).join(alive(cache, now).withColumnRenamed("key", "cache_key"), "cache_key")
    rows = rows.select("query", F.from_json("value", kind).alias("v")).where(acceptable(F.col("v.answer"), F.col("v.degrade_level")))
    level = F.coalesce("v.degrade_level", F.lit(0))
    return rows.select("query", "v.answer", F.lit("cache").alias("stage"), "v.intent", "v.strategy", "v.confidence", level.alias("degrade_level"), "v.degrade_reason")


def wants_faq(requests: DataFrame) -> DataFrame:
    """Only plain questions, without history, source or strategy, may be answered from the FAQ."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return requests.where(blank("source") & blank("strategy") & (F.coalesce(F.size("history"), F.lit(0)) <= 0))


def deep_outcome(general: Column, classified: Column, level: Column, reason: Column, reranked: Column, context: Column, generated: Column, excerpt: Column, allow_empty: bool = False) -> Column:
    """(answer, degrade_level, degrade_reason, stage) of the deep channel, the first rule that applies.

    Classifier failed; general question answered directly; nothing retrieved; reranker failed;
    no context; generation failed (an excerpt stands in); answered.
    """
    out = lambda a, n, r, s: F.struct(a.alias("answer"), n.cast("int").alias("degrade_level"), r.alias("degrade_reason"), F.lit(s).alias("stage"))
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    empty = F.coalesce(context, F.lit("")) == ""
    return (
        F.when(~F.coalesce(classified, F.lit(False)), out(none, F.lit(2), text("intent_error"), "deep"))
        .when(F.coalesce(general, F.lit(False)), F.when(generated.isNull(), out(none, F.lit(2), text("generation_error"), "general")).otherwise(out(generated, F.lit(0), text(""), "general")))
        .when((level >= 2) & F.lit(not allow_empty), out(none, level, reason, "deep"))
        .when(~F.coalesce(reranked, F.lit(False)), out(none, F.lit(2), text("rerank_error"), "deep"))
        .when(empty & F.lit(not allow_empty), out(none, F.lit(2), text("empty_context"), "deep"))
        .when(generated.isNull(), out(excerpt, F.greatest(level, F.lit(1)), text("generation_error"), "deep"))
        .otherwise(out(generated, level, reason, "deep"))
    )


def route(requests: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Answers (as in COLUMNS) of all stages; each stage sees the requests that those before have not answered.

    A stage that runs a model should write its answers before the next reads them, or the model runs twice.
    """
    rest, out = valid_requests(requests), None
    for stage in stages:
        answers = stage(rest).select(*COLUMNS)
        out = answers if out is None else out.unionByName(answers)
        rest = rest.join(answers.select("query"), "query", "left_anti")
    if out is None:
        raise ValueError("no stages")
    return out


def to_cache(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """(key, value) of answers worth keeping: new ones of a level below 2."""
    rows = answers.where((F.col("stage") != "cache") & cacheable(F.col("degrade_level")) & F.col("answer").isNotNull())
    value = F.to_json(F.struct("answer", "intent", "strategy", "confidence", "degrade_level", "degrade_reason"))
    return rows.withColumn("value", value).join(requests.select("query", "cache_key"), "query").select(F.col("cache_key").alias("key"), "value")


def by_strategy(requests: DataFrame, hyde: Column, simpler: Column, parts: Column) -> DataFrame:
    """(query, branch, text): what is searched: the question, a supposed answer, a simpler question, or each part.

    A missing rewrite, or an unknown strategy, searches the question itself.
    """
    q = F.col("question")
    texts = F.when(F.col("strategy") == "hyde", F.array(F.coalesce(F.nullif(hyde, F.lit("")), q))).when(F.col("strategy") == "backtracking", F.array(F.coalesce(F.nullif(simpler, F.lit("")), q)))
    texts = texts.when(F.col("strategy") == "subquery", F.when(F.size(parts) > 0, parts).otherwise(F.array(q))).otherwise(F.array(q))
    return requests.select("query", F.posexplode(texts).alias("branch", "text"))


def health(spark: SparkSession, checks: dict[str, Callable[[], bool]]) -> DataFrame:
    """(service, up) of each check, and ``all``; one that fails by an exception is down."""

    def up(check: Callable[[], bool]) -> bool:
        try:
            return bool(check())
        except Exception:  # a service that can't be asked is not up
            return False

    rows = [(name, up(check)) for name, check in checks.items()]
    return spark.createDataFrame([*rows, ("all", all(x for _, x in rows))], "service string, up boolean")
