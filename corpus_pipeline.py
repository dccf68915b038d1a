"""A corpus pipeline of five stages over ``documents``; each reads what the one before has written.

In every stage null and empty texts have a defined result, repeated rows are treated one like
the other, an empty table gives an empty one, and columns beyond those of ``documents``
go along whatever their names (but for the last stage, which returns places of pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import mixing, near_text, packing, quality_rules, secret_scan
from lexforge.llm.common import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that lose too much or fail the base rules.

    Null and empty texts fail the base rules (too few words) and go. Ties cannot occur.
    """
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Null and empty texts and null ids are in no group and stay; rows that repeat an id stay or go together.
    """
    return near_text.thin(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays. Null and empty texts stay as they are."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: all documents stay, those of smaller sources repeat.

    The rows come in the order of the mixture, block by block. A null source is a source of
    its own; null and empty texts count one token. Rows alike in id and text tie and repeat alike.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = mixing.mix(docs.select("doc_id", "text", "source", row)).select("row", "mix_block", "mix_order")
    return mixing.in_order(mixed).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the texts' pieces in bins of the permitted lengths; copies of a document are numbered.

    Null and empty texts are one token, their end. Pieces of equal length go in order of id, copy and piece.
    """
    return packing.best_fit(docs)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packed)]

#: SQL has no tokeniser, bisection or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; a table between two of them goes once the next is written."""
    space = Workspace(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = space.stow(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            space.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
