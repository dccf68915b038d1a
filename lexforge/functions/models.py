"""Models are plugged in: a registry of named scorers, and stand-ins that need no weights.

A scorer is a function from columns to a column, usually a pandas UDF over batches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import bound_batches
from .text import utokens

KINDS = ("embedder", "sparse", "reranker", "classifier", "generator", "judge", "tokenizer", "rewriter")
_registry: dict[tuple[str, str], Callable[..., Column]] = {}


def register(kind: str, name: str, make: Callable[..., Column]) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}")
    _registry[kind, name] = make


def model(kind: str, name: str = "stand-in") -> Callable[..., Column]:
    if (kind, name) not in _registry:
        raise LookupError(f"no {kind} named {name} is registered")
    return _registry[kind, name]


def _per_text(kind: str, make):
    """A pandas UDF over texts, as a model would be: each batch is read once."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: make((t or "").lower().split()))

    bound_batches()
    return run


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Counts of tokens by hash, scaled to length 1; all zero for an empty text."""

    def make(tokens: list[str]) -> np.ndarray:
        v = np.bincount([crc32(t.encode()) % size for t in tokens], minlength=size).astype(float) if tokens else np.zeros(size)
        return v / max(np.sqrt(v @ v), 1e-12)

    return _per_text("array<double>", make)(text)


def hashed_weights(text: Column, size: int = 1 << 20) -> Column:
    """Sparse weights: ln(1 + count) by a token's hash; only positive ones."""

    def make(tokens: list[str]) -> dict[int, float]:
        return {k: math.log1p(n) for k, n in Counter(crc32(t.encode()) % size for t in tokens).items()}

    return _per_text("map<int,double>", make)(text)


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    q = F.array_distinct(utokens(F.lower(query)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, utokens(F.lower(text)))) / F.size(q)).otherwise(0.0)


def extract(question: Column, context: Column) -> Column:
    """The context's first paragraph."""
    return F.nullif(F.element_at(F.split(context, "\n\n"), 1), F.lit(""))


register("embedder", "stand-in", hashed_vector)
register("sparse", "stand-in", hashed_weights)
register("reranker", "stand-in", overlap)
register("judge", "stand-in", overlap)
register("generator", "stand-in", extract)
register("tokenizer", "stand-in", lambda text: utokens(F.lower(text)))
register("rewriter", "stand-in", lambda text: text)


def published(text: Column, finish_reason: Column) -> Column:
    """A generation is used only if it ended by itself and isn't blank."""
    return F.when((finish_reason == "stop") & (F.trim(text) != ""), text)


def embed(df: DataFrame, text_col: str = "content", name: str = "stand-in") -> DataFrame:
    """Dense and sparse vectors and the text's hash. A failing model fails the job."""
    return df.select("*", model("embedder", name)(F.col(text_col)).alias("dense"), model("sparse", name)(F.col(text_col)).alias("sparse"), F.md5(text_col).alias("hash_id"))


def train_intent(df: DataFrame, text_col: str = "text", label_col: str = "label", size: int = 1 << 14):
    """A logistic regression over hashed tokens, in place of a tuned transformer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    rows = df.withColumn("_tokens", utokens(F.lower(F.col(text_col)))).withColumn("_label", F.col(label_col).cast("double"))
    return Pipeline(stages=[HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=size), LogisticRegression(featuresCol="_features", labelCol="_label", regParam=0.01, maxIter=50)]).fit(rows)


def predict_intent(fitted, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Label and probability; an unfitted model refuses."""
    from pyspark.ml.functions import vector_to_array

    if fitted is None:
        raise RuntimeError("the classifier has not been trained")
    out = fitted.transform(df.withColumn("_tokens", utokens(F.lower(F.col(text_col)))))
    p = vector_to_array("probability")
    return out.withColumn("intent", F.col("prediction").cast("int")).withColumn("intent_probability", F.array_max(p)).drop("_tokens", "_features", "rawPrediction", "probability", "prediction")
