"""Reports: rows of scores and a last row of averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import mean_valid


def with_average(scores: DataFrame, metrics: tuple[str, ...], key: str = "question") -> DataFrame:
    """The rows, then ``__average__``: each metric's mean over valid cells. ``is_average`` orders them."""
    average = scores.agg(*[mean_valid(F.col(m)).alias(m) for m in metrics]).select(F.lit("__average__").alias(key), *metrics, F.lit(1).alias("is_average"))
    return scores.select(key, *metrics, F.lit(0).alias("is_average")).unionByName(average)


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls are blank, so a missing score is never read as 0."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_report(scores: DataFrame, summary: DataFrame, folder: str, metrics: tuple[str, ...]) -> None:
    scores.write.mode("overwrite").json(f"{folder}/scores")
    summary.write.mode("overwrite").json(f"{folder}/summary")
    rows = with_average(scores, metrics)
    write_csv(rows.repartitionByRange("is_average").sortWithinPartitions("is_average").drop("is_average"), f"{folder}/csv")
