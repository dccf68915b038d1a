"""Evaluation flows: judges over answers, relays of judges, answers from several generators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import model
from ..functions.scores import valid, valid_or_null
from ..operators.evaluation import METRICS, normalized_items, summary
from ..operators.sampling import chunks_by_size


def judged(items: DataFrame, judge: str = "stand-in") -> tuple[DataFrame, DataFrame]:
    """(scores, one row of means) of items by a judge's overlap of question, answer, contexts and truth.

    Metrics that need a ground truth are null where there is none; an invalid score is null, never 0.
    """
    rows = normalized_items(items)
    ask = model("judge", judge)
    seen = F.array_join("contexts", " ")
    has_truth = F.col("ground_truth") != ""
    scores = rows.select(
        "question", valid_or_null(ask(F.col("answer"), seen)).alias("faithfulness"), valid_or_null(ask(F.col("question"), F.col("answer"))).alias("answer_relevancy"),
        F.when(has_truth, valid_or_null(ask(F.col("ground_truth"), F.element_at("contexts", 1)))).alias("context_precision"),
        F.when(has_truth, valid_or_null(ask(F.col("ground_truth"), seen))).alias("context_recall"),
    )
    return scores, summary(scores)


def first_answer(*answers: Column) -> Column:
    """The first answer of a chain of generators that isn't blank."""
    return F.coalesce(*[F.when(F.trim(a) != "", a) for a in answers])


def relay(items: DataFrame, judges: dict[str, Callable[[DataFrame], DataFrame]], order: str, keep: Callable[[DataFrame], DataFrame], size: int = 25, least: float = 0.5, metric: str = METRICS[0]) -> DataFrame:
    """Items scored chunk by chunk; a judge whose share of valid scores in a chunk is below ``least`` is dropped for the next one.

    ``keep`` writes a chunk's scores and reads them back, so no judge runs twice. A chunk that
    no judge can score keeps its null scores. Judges answer over the network: chunks are few and in turn.
    """
    left, done = dict(judges), None
    chunked = chunks_by_size(items, order, size)
    for k in [r[0] for r in chunked.select("chunk").distinct().orderBy("chunk").collect()]:
        todo = chunked.where(F.col("chunk") == k).drop("chunk")
        rows = None
        while left:
            name = next(iter(left))
            rows = keep(left[name](todo).withColumn("judge", F.lit(name)))
            counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid(F.col(metric))).alias("ok")).first()
            if counts.ok >= least * counts.n:
                break
            left.pop(name)
        rows = todo.withColumn(metric, F.lit(None).cast("double")).withColumn("judge", F.lit(None).cast("string")) if rows is None else rows
        done = rows if done is None else done.unionByName(rows, allowMissingColumns=True)
    return items.limit(0) if done is None else done


def captured(hits: DataFrame, status: Column) -> DataFrame:
    """Hits with an error as a column: a failed search is told apart from an empty one."""
    return hits.withColumn("status", F.coalesce(status, F.lit("ok")))
