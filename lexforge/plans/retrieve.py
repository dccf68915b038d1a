"""Small to big: search children, answer with parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..operators.chunking import children, parents
from ..operators.cleaning import clean_documents
from ..operators.lexical import ranked
from ..operators.merging import rerank, to_parents
from ..shared import written


def lexical_small_to_big(docs: DataFrame, questions: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, rule: Settings = DEFAULT) -> DataFrame:
    """The best parents of each question by BM25 over cleaned children.

    Documents are cleaned and cut once; the parents are written to the shared folder, and
    children are cut from them where they are read: once for the search, and again of those
    parents alone that have a hit. Texts stay out of the search: a task keeps the best hits of a
    question, and only those meet their texts. The hits are written too, so the planner knows whether they are
    few enough to be sent to every task.
    """
    cleaned = clean_documents(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), "source"), "_text")
    whole = written(parents(cleaned, "_doc", "_text", rule), "parents")
    hits = ranked(children(whole, rule), questions, "id", "content", query_id, query_text, rule.top_retrieve, rule).withColumnRenamed("doc", "id")
    hits = written(hits, "hits")
    met = hits.select(F.regexp_replace("id", "_[0-9]+_child$", "").alias("id")).distinct()
    small = children(whole.join(met, "id", "left_semi"), rule)
    found = small.select("id", "content", "source", "parent_id", "parent_content").join(hits, "id")
    return rerank(to_parents(found, rule.top_children), F.col("score"), rule.top_rerank)
