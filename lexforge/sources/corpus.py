"""HTML topics with their titles, and Markdown files under safe names."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WS, ustrip


def _titles(node) -> Iterator[tuple[str, str]]:
    """(id, title) of all nodes that have both, in the order in which they are written."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if "TopicId" in x and "Title" in x:
                yield str(x["TopicId"]).strip("{}").lower(), str(x["Title"]).strip()
            stack += reversed(x.values())
        elif isinstance(x, list):
            stack += reversed(x)


def titles(chapters: DataFrame, json_col: str = "value", order_col: str | None = None) -> DataFrame:
    """(topic_id, title) of all nodes, however deep, of chapters' JSON; unreadable chapters give none.

    Nesting without a fixed depth has no schema to read it by, hence Python. An id has one
    title: the last in order of ``order_col`` (by default the chapter's text) and within a chapter.
    """
    order = F.col(order_col or json_col)
    kind = chapters.select(order).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for place, text in zip(batch["order"], batch["text"]):
                try:
                    out += [(place, k, *pair) for k, pair in enumerate(_titles(json.loads((text or "").lstrip("\ufeff"))))]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["order", "k", "topic_id", "title"])

    rows = chapters.select(order.alias("order"), F.col(json_col).alias("text")).mapInPandas(run, f"order {kind}, k long, topic_id string, title string")
    return rows.groupBy("topic_id").agg(F.max_by("title", F.struct("order", "k")).alias("title"))


def topic_id(path: Column) -> Column:
    """A file's name without folders, ending and braces, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), r"[{}]|%7[BbDd]", ""))


def topics(pages: DataFrame, names: DataFrame, path_col: str = "path") -> DataFrame:
    """Pages (path, html) that have a title."""
    return pages.withColumn("topic_id", topic_id(F.col(path_col))).join(names, "topic_id")


def safe_names(df: DataFrame, title_col: str = "title", id_col: str = "topic_id", order: str = "path") -> DataFrame:
    """Adds ``file_name``: the title with forbidden characters replaced; a later one that differs at most by case gets its id."""
    stem = ustrip(F.regexp_replace(F.regexp_replace(F.col(title_col), r'[\\/:*?"<>|]', "_"), f"{WS}+", " "))
    rows = df.withColumn("_stem", stem)
    w = Window.partitionBy(F.lower("_stem")).orderBy(order, id_col)
    name = F.when(F.row_number().over(w) == 1, F.col("_stem")).otherwise(F.concat_ws("_", "_stem", F.col(id_col)))
    return rows.withColumn("file_name", F.concat(name, F.lit(".md"))).drop("_stem")


def manifest(df: DataFrame, parser: str) -> tuple[DataFrame, DataFrame]:
    """(extracted, failed): what was written for each topic, and why others were not."""
    good = df.where("error is null").select("topic_id", "title", F.col("path").alias("source_html"), F.col("file_name").alias("markdown_file"), F.lit(parser).alias("parser"), F.length("markdown").alias("characters"))
    return good, df.where("error is not null").select("topic_id", "title", "error")


def write_markdown(df: DataFrame, folder: str) -> None:
    """A table of (file_name, markdown), written whole: a file a topic is for small corpora, a table for large ones."""
    df.select("file_name", "markdown").write.mode("overwrite").parquet(folder)
