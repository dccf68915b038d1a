"""A cache as a keyed table with expiry, and keys for questions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import normalize_query
from .lexical import last_by_key

#: Key, value as JSON, and when it expires; null: never.
SCHEMA = "key string, value string, expires_at timestamp"


def faq_key(question: Column) -> Column:
    return F.concat(F.lit("faq:v3:"), F.md5(normalize_query(question)))


def query_key(question: Column, source: Column, strategy: Column, history: Column) -> Column:
    """SHA-256 over the JSON list of the four; ``history`` is JSON. Python's spacing of JSON is part of the key."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, s, t, h in batches:
            rows = zip(q, s.where(s.notna(), None), t.where(t.notna(), None), h.where(h.notna(), None))
            yield pd.Series(["query:v3:" + hashlib.sha256(json.dumps([a, b, c, json.loads(d) if d else []], ensure_ascii=False, sort_keys=True).encode()).hexdigest() for a, b, c, d in rows], dtype=object)

    return run(normalize_query(question), source, strategy, history)


def alive(table: DataFrame, now: Column) -> DataFrame:
    return table.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def put(table: DataFrame, rows: DataFrame, now: Column, ttl: int = DEFAULT.cache_ttl) -> DataFrame:
    """``table`` with (key, value) rows in place of what their keys had; a ttl of 0 or less never expires.

    Of several rows of a key the last by ``seq`` counts; without that column, or where it ties, the
    greatest value. Rows without a key are ignored.
    """
    expires = F.lit(None).cast("timestamp") if ttl <= 0 else now + F.make_interval(secs=F.lit(ttl))
    fresh = last_by_key(rows.where("key is not null"), "key", F.col("value")).select("key", "value", expires.alias("expires_at"))
    return table.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def get(table: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """(key, value) of many keys; a missing or expired one has a null value."""
    return keys.select("key").join(alive(table, now).select("key", "value"), "key", "left")


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key"), "key", "left_anti")


def delete_prefix(table: DataFrame, prefix: str) -> DataFrame:
    return table.where(~F.startswith("key", F.lit(prefix)))


def increment(table: DataFrame, amounts: DataFrame, now: Column) -> DataFrame:
    """Counters: (key, amount) added to integer values; several amounts of a key add up; missing ones start at 0."""
    have = alive(table, now).select("key", F.col("value").cast("long").alias("v"), "expires_at")
    total = amounts.groupBy("key").agg(F.sum("amount").alias("a"))
    new = total.join(have, "key", "left").select("key", (F.coalesce("v", F.lit(0)) + F.col("a")).cast("string").alias("value"), "expires_at")
    return table.join(total.select("key"), "key", "left_anti").unionByName(new)


def hash_set(table: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields (key, field, value) merged into JSON objects, one object a key.

    Of several values of a field the last by ``seq`` counts; without that column, or where it ties, the
    greatest. Fields without a key or a name are ignored. An object is one value, so its fields are in one row.
    """
    kind = "map<string,string>"
    fields = last_by_key(fields.where("key is not null and field is not null"), ("key", "field"), F.col("value"))
    new = fields.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("value").alias("v")))).alias("n"))
    both = new.join(table, "key", "left")
    kept = F.map_filter(F.coalesce(F.from_json("value", kind), F.create_map().cast(kind)), lambda k, v: ~F.map_contains_key("n", k))
    out = both.select("key", F.to_json(F.map_concat(kept, "n")).alias("value"), "expires_at")
    return table.join(new.select("key"), "key", "left_anti").unionByName(out)


def list_push(table: DataFrame, items: DataFrame) -> DataFrame:
    """Items (key, seq, item) appended in order to JSON lists, one list a key; where seq ties, in order of the items.

    A list is one value, so its items are in one row. Items without a key are ignored.
    """
    new = items.where("key is not null").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"]).alias("n"))
    out = new.join(table, "key", "left").select("key", F.to_json(F.concat(F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>")), "n")).alias("value"), "expires_at")
    return table.join(new.select("key"), "key", "left_anti").unionByName(out)


def acceptable(answer: Column, level: Column) -> Column:
    """A cached answer serves if it isn't blank and its level is below 2."""
    return (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(level, F.lit(0)) < 2)


def cacheable(level: Column) -> Column:
    return F.coalesce(level, F.lit(0)) < 2
