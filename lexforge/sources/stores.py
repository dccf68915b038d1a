"""Tables of chunks and of questions with answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..operators.chunking import repaired

CHUNKS = (
    "id string, text string, dense_vector array<float>, sparse_vector map<int,float>, parent_id string, parent_content string, "
    "chunk_type string, source string, timestamp bigint, metadata map<string,string>"
)
FAQ = "id int, question string, answer string, category string, keywords string, confidence_score float, created_at timestamp, updated_at timestamp"
TURNS = "id int, session_id string, question string, answer string, timestamp timestamp"


def prepared(df: DataFrame, now: Column) -> DataFrame:
    """Chunks as the store keeps them: what a row is follows from its parent, missing sources are ``unknown``, times whole seconds."""
    parent = F.coalesce("parent_id", F.lit(""))
    time = F.coalesce(F.col("timestamp").cast("bigint"), F.unix_timestamp(now)) if "timestamp" in df.columns else F.unix_timestamp(now)
    source = F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")) if "source" in df.columns else F.lit("unknown")
    return df.withColumns({
        "parent_id": parent, "parent_content": F.coalesce("parent_content", F.lit("")), "chunk_type": F.when(parent != "", "child").otherwise("parent"),
        "source": source, "timestamp": time,
    })


def write_chunks(df: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by kind, so that a search over children never opens parents."""
    df.write.mode(mode).partitionBy("chunk_type").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """Chunks saved as JSON, their kinds repaired."""
    return repaired(spark.read.schema(schema).json(path))


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table cut by ``key``: later joins and sums on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def info(df: DataFrame) -> DataFrame:
    """One row: number of rows, by kind, and the columns."""
    kinds = [F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in ("parent", "child")] if "chunk_type" in df.columns else []
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *kinds, F.lit(",".join(df.columns)).alias("fields"))


def jdbc_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; give ``partitionColumn`` and bounds so that it is read in parts."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def faq_csv(spark: SparkSession, path: str) -> DataFrame:
    """Questions and answers of a CSV file with a header (a byte order mark and blanks in it are ignored).

    ``source`` names the category, ``doc_name`` the keywords. Rows without either part go.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    named = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    text = lambda c: ustrip(F.coalesce(F.col(c), F.lit(""))) if c in named.columns else F.lit("")
    rows = named.select(text("question").alias("question"), text("answer").alias("answer"), text("source").alias("category"), text("doc_name").alias("keywords"))
    return rows.where("question <> '' and answer <> ''")
