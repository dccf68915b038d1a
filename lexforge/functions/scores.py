"""Scores: null is not scored, 0.0 is a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(score: Column) -> Column:
    """A number from 0 to 1. NaN sorts above all numbers, so the range rejects it too."""
    return F.coalesce((score >= 0.0) & (score <= 1.0), F.lit(False))


def valid_or_null(score: Column) -> Column:
    return F.when(valid(score), score)


def mean_valid(score: Column, digits: int = 4) -> Column:
    """Mean of the valid ones; null if there are none."""
    return F.round(F.avg(valid_or_null(score)), digits)


def any_positive(*scores: Column) -> Column:
    """The other rule of validity: one metric above zero."""
    out = F.lit(False)
    for s in scores:
        out = out | F.coalesce(s > 0, F.lit(False))
    return out


def composite(*scores: Column, digits: int = 4) -> Column:
    """Mean of all; null if one is missing."""
    total = F.lit(0.0)
    for s in scores:
        total = total + s
    return F.round(total / len(scores), digits)


def bucket(score: Column) -> Column:
    """Histogram bucket of a score."""
    return (
        F.when(score.isNull(), "none").when(score == 0, "=0").when(score < 0.2, "<0.2").when(score < 0.4, "<0.4")
        .when(score < 0.6, "<0.6").when(score < 0.8, "<0.8").otherwise(">=0.8")
    )
