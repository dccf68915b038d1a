"""Ingest: documents to chunks with vectors, one lazy plan from reading to the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.models import embed
from ..operators.chunking import split_documents
from ..operators.cleaning import clean_documents, with_metadata
from ..operators.html_text import clean_markdown
from ..sources.stores import prepared


def clean(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Markdown rows (by ``file_type``) keep their structure; others are cleaned line by line.

    Markdown that can't be normalised fails the job: raw markup must not be taken for clean
    text. The line rules of the others are expressions that cannot fail on any text, so the
    raw text never has to stand in.
    """
    if "file_type" not in df.columns:
        return clean_documents(df, text_col)
    is_markdown = F.coalesce(F.col("file_type") == "markdown", F.lit(False))
    marked = df.where(is_markdown).withColumn(text_col, clean_markdown(F.col(text_col)))
    return clean_documents(df.where(~is_markdown), text_col).unionByName(marked)


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "content", rule: Settings = DEFAULT, recursive: bool = False) -> DataFrame:
    return split_documents(with_metadata(clean(df, text_col), text_col), id_col, text_col, rule, recursive)


def ingest(df: DataFrame, now: Column, id_col: str = "doc_id", text_col: str = "content", rule: Settings = DEFAULT, embedder: str = "stand-in") -> DataFrame:
    """Rows for the store, with dense and sparse vectors and each text's hash."""
    return prepared(embed(chunks(df, id_col, text_col, rule), "content", embedder), now)
