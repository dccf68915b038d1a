"""Splitting of documents into parents and children, by generators over the row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..shared import bound_batches


def check_sizes(parent: int, child: int, overlap: int) -> None:
    if not 0 <= overlap < min(parent, child):
        raise ValueError("the overlap must be at least 0 and less than both sizes")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters, ``size - overlap`` apart, up to the text's end.

    A last window that the one before covers is kept; an empty text has none.
    """
    step = size - overlap
    starts = F.sequence(F.lit(1), F.length(text), F.lit(step))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


#: Where to split, the coarsest first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "：", ",", " ", "")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, in order, cut at the coarsest separator that serves.

    Each piece after the first repeats up to ``overlap`` characters of whole parts before it.
    Separators stay at the end of what they end, so that nothing is lost.
    """

    def parts(value: str, level: int) -> list[str]:
        if len(value) <= size:
            return [value] if value else []
        separator = separators[level] if level < len(separators) else ""
        if separator == "":
            step = max(1, size - overlap)
            return [value[i : i + step] for i in range(0, len(value), step)]
        cut = [x + separator for x in value.split(separator)]
        cut[-1] = cut[-1][: -len(separator)]
        return [p for x in cut if x for p in parts(x, level + 1)]

    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts(text, 0):
        if held and length + len(part) > size:
            out.append("".join(held))
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    return [*out, "".join(held)] if held else out


def recursive_pieces(size: int, overlap: int):
    """A pandas UDF: text to its recursive pieces."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: recursive_split(t or "", size, overlap))

    bound_batches()
    return split


def parents(df: DataFrame, id_col: str, text_col: str, rule: Settings = DEFAULT, recursive: bool = False) -> DataFrame:
    """One row per parent: all columns of ``df`` but the text, then ``id, content, chunk_index, total_chunks, chunk_type``."""
    check_sizes(rule.parent_size, rule.child_size, rule.overlap)
    text = F.coalesce(F.col(text_col), F.lit(""))
    pieces = recursive_pieces(rule.parent_size, rule.overlap)(text) if recursive else windows(text, rule.parent_size, rule.overlap)
    rest = [c for c in df.columns if c != text_col]
    rows = df.withColumn("_pieces", pieces).select(*rest, F.size("_pieces").alias("total_chunks"), F.posexplode_outer("_pieces").alias("chunk_index", "content"))
    rows = rows.where("chunk_index is not null")  # not outer, the planner would cut each text twice to see whether it has pieces
    name = F.concat_ws("_", F.col(id_col).cast("string"), F.col("chunk_index").cast("string"), F.lit("parent"))
    return rows.select(*rest, name.alias("id"), "content", "chunk_index", "total_chunks", F.lit("parent").alias("chunk_type"))


#: Columns of a chunk that are its own; others are its document's.
OWN = frozenset("id content chunk_index total_chunks chunk_type parent_id parent_content".split())


def _child_pieces(rule: Settings, recursive: bool) -> Column:
    text = F.col("content")
    return recursive_pieces(rule.child_size, rule.overlap)(text) if recursive else windows(text, rule.child_size, rule.overlap)


def child_name(parent: Column, at: Column) -> Column:
    return F.concat_ws("_", parent, at.cast("string"), F.lit("child"))


def children(parent_rows: DataFrame, rule: Settings = DEFAULT, recursive: bool = False) -> DataFrame:
    """One row per child of each parent; the parent's columns are inherited, its id and text kept."""
    check_sizes(rule.parent_size, rule.child_size, rule.overlap)
    rest = [c for c in parent_rows.columns if c not in OWN]
    rows = parent_rows.withColumn("_pieces", _child_pieces(rule, recursive)).select(*rest, F.col("id").alias("parent_id"), F.col("content").alias("parent_content"), F.size("_pieces").alias("total_chunks"), F.posexplode("_pieces").alias("chunk_index", "content"))
    return rows.select(*rest, child_name(F.col("parent_id"), F.col("chunk_index")).alias("id"), "content", "chunk_index", "total_chunks", F.lit("child").alias("chunk_type"), "parent_id", "parent_content")


def split_documents(df: DataFrame, id_col: str, text_col: str, rule: Settings = DEFAULT, recursive: bool = False) -> DataFrame:
    """Parents and children in one table."""
    up = parents(df, id_col, text_col, rule, recursive)
    # a parent and its children come from one generator, so documents are read and cut once
    first = lambda whole, piece: F.when(F.col("_k") == 0, whole).otherwise(piece)
    rest = [c for c in up.columns if c not in OWN]
    rows = up.withColumn("_pieces", _child_pieces(rule, recursive)).select(
        *rest, F.col("id").alias("_id"), F.col("chunk_index").alias("_at"), F.col("total_chunks").alias("_of"), F.size("_pieces").alias("_n"), F.col("content").alias("_whole"),
        F.posexplode(F.concat(F.array("content"), "_pieces")).alias("_k", "content"),
    )
    at = F.col("_k") - 1
    made = {
        "id": first(F.col("_id"), child_name(F.col("_id"), at)), "content": F.col("content"), "chunk_index": first(F.col("_at"), at), "total_chunks": first(F.col("_of"), F.col("_n")),
        "chunk_type": first(F.lit("parent"), F.lit("child")), "parent_id": first(F.lit(""), F.col("_id")), "parent_content": first(F.lit(""), F.col("_whole")),
    }
    return rows.select(*[made[c].alias(c) if c in OWN else c for c in dict.fromkeys([*up.columns, "parent_id", "parent_content"])])


def repaired(df: DataFrame) -> DataFrame:
    """What a stored chunk is follows from its parent id, whatever was stored."""
    kind = F.when(F.coalesce(F.col("parent_id"), F.lit("")) != "", "child").otherwise("parent")
    out = df.withColumn("chunk_type", kind)
    if "metadata" in df.columns:
        rest = F.map_filter("metadata", lambda k, v: k != "chunk_type")
        out = out.withColumn("metadata", F.map_concat(F.coalesce(rest, F.create_map().cast("map<string,string>")), F.create_map(F.lit("chunk_type"), kind)))
    return out


def first_of_each(df: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The first row of each key. ``min_by`` keeps one row a key on each side of the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def structure_audit(chunks: DataFrame) -> DataFrame:
    """One row: totals, whether kinds add up, children per parent, and children whose parent is missing."""
    kinds = chunks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("chunk_type") == "parent").alias("parents"), F.count_if(F.col("chunk_type") == "child").alias("children"),
        F.count_if((F.col("chunk_type") == "child") & (F.coalesce("parent_content", F.lit("")) == "")).alias("without_text"),
    )
    down = chunks.where("chunk_type = 'child'").select("parent_id")
    up = chunks.where("chunk_type = 'parent'").select(F.col("id").alias("parent_id"))
    dangling = down.join(up, "parent_id", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    out = kinds.join(dangling)  # one row each
    return out.select("*", ((F.col("parents") + F.col("children") == F.col("total")) & (F.col("children") > 0)).alias("sound"), F.round(F.col("children") / F.nullif("parents", F.lit(0)), 4).alias("ratio"))


def split_hits(hits: DataFrame, rule: Settings = DEFAULT) -> DataFrame:
    """Parent hits cut into children in place: they inherit score and source, and name their parent.

    A hit without text keeps it as its one piece.
    """
    pieces = windows(F.coalesce("content", F.lit("")), rule.child_size, rule.overlap)
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.col("content")))
    rest = [c for c in hits.columns if c not in ("id", "content", "parent_id", "parent_content")]
    rows = hits.withColumn("_pieces", pieces).select(*rest, F.col("id").alias("parent_id"), F.col("content").alias("parent_content"), F.posexplode("_pieces").alias("piece", "content"))
    name = F.concat_ws("_", "parent_id", F.col("piece").cast("string"), F.lit("l1child"))
    return rows.select(*rest, name.alias("id"), "content", "parent_id", "parent_content", "piece")
