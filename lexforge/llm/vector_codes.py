"""Compression of vectors into codes of parts, exact to the last integer.

Vectors become integers and are cut into parts; each part position has a codebook, trained by
rounds of nearest entry and floored mean. The nearest entry is found by a float32 matrix
product: for a part x and an entry c the product differs from the true one by at most
gamma(k + 2) * |x| * |c| (k components, conversions included, in any order of summation), which gives
every entry an interval that holds its distance. Entries whose interval overlaps the
best one's are measured again in int64, and ties go to the lowest index; where no other
overlaps, the best is proven and needs no more. So results are those of integers
throughout, at the speed of a matrix product.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_by_share, sums

#: Rows that a task holds as matrices at a time.
ROWS = 4096


def packed(whole: np.ndarray) -> bytes:
    """Integers as bytes whose order is that of the integers."""
    return (whole + (1 << 31)).astype(">u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, ">u4").astype(np.int64) - (1 << 31)


@dataclass(frozen=True)
class Coding:
    """``scale`` x a component, floored, is an integer; ``entries`` of each codebook are 256 at most."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096

    def __post_init__(self):
        if not (0 < self.entries <= 256 and self.parts > 0 and self.rounds >= 0):
            raise ValueError(f"no such coding: {self}")


@dataclass(frozen=True)
class Codebooks:
    """``values``: parts x entries x components of a part, int64. Its size hangs on the coding alone."""

    rule: Coding
    values: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.values.reshape(-1).tolist())).encode()).hexdigest()


def limit(size: int) -> int:
    """Integers below this have squared distances over ``size`` components that fit int64, and fit int32 themselves."""
    return min(1 << 30, math.isqrt((1 << 61) // max(size, 1)))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, the squared distance, and how many rows needed int64 for their choice."""
    k, unit = x.shape[1], 2.0**-24
    gamma = (k + 2) * unit / (1 - (k + 2) * unit)
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    long = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12 * (k + 4))  # noqa: E731  # no less than the true length
    own = (c * c).sum(1).astype(np.float64)
    score = own - 2 * dot  # the squared distance, less the row's own part
    slack = 2 * gamma * long(x)[:, None] * long(c)[None]
    slack = slack * (1 + 1e-9) + 2.0**-50 * (own + 2 * np.abs(dot))  # rounding of the steps in float64
    overlaps = score - slack <= (score + slack).min(1, keepdims=True)
    best = overlaps.argmax(1)
    open_ = np.flatnonzero(overlaps.sum(1) > 1)
    if len(open_):
        row, entry = np.nonzero(overlaps[open_])
        step = x[open_[row]] - c[entry]
        exact = np.full((len(open_), len(c)), np.iinfo(np.int64).max)
        exact[row, entry] = (step * step).sum(1)
        best[open_] = exact.argmin(1)  # the first of equal ones
    step = x - c[best]
    return best, (step * step).sum(1), len(open_)


def _integers(df: DataFrame, rule: Coding) -> DataFrame:
    """(id, label, v) of rows whose vectors can be coded; ``v`` holds the integers, four bytes each."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            good = (size > 0) & (size % rule.parts == 0) & (sums((~np.isfinite(values)).astype(np.int64), first) == 0)
            whole = np.zeros(len(values))
            used = np.repeat(good, size)
            whole[used] = np.floor(values[used] * rule.scale)
            if len(whole) and np.abs(whole).max() >= limit(int(size.max())):
                raise ValueError(f"components of {rule.scale} x {limit(int(size.max()))} and more leave no room for exact distances in int64")
            data = memoryview(packed(whole.astype(np.int64)))
            blobs = [bytes(data[4 * first[i] : 4 * first[i + 1]]) for i in np.flatnonzero(good)]
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(blobs, pa.binary())], names=["id", "label", "v"])

    return df.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, v binary")


def _matrices(batch: pa.RecordBatch, column: int, rule: Coding) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their integers: rows x parts x components."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, unpacked(b"".join(part.column(column).to_pylist())).reshape(part.num_rows, rule.parts, -1)


def _round(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """The next values: each entry the floored mean of its parts. A task sends a sum an entry; the driver gets one an entry."""
    rule, values = books.rule, books.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(values), np.zeros(values.shape[:2], np.int64)
        for batch in batches:
            for _, x in _matrices(batch, 0, rule):
                for p in range(rule.parts):
                    best, _, _ = nearest(x[:, p], values[p])
                    order = np.argsort(best, kind="stable")
                    first = np.searchsorted(best[order], np.arange(values.shape[1] + 1))
                    total[p] += sums(x[order, p], first)
                    n[p] += np.diff(first)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sent = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    sent = sent.select("part", "entry", "n", F.posexplode("total").alias("at", "total")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = values.copy()
    for r in sent.collect():  # parts x entries x components of a part
        out[r.part, r.entry, r.at] = int(r.total) // r.n
    return out


def _seeded(rows: DataFrame, rule: Coding) -> Codebooks | None:
    """Codebooks of the first rows in order of id (equal ids: of their integers); none for no rows."""
    first = rows.where("id is not null").orderBy("id", "v").limit(rule.entries).select("v").collect() or rows.orderBy("v").limit(1).select("v").collect()
    if not first:
        return None
    size = len(first[0].v)
    values = unpacked(b"".join(bytes(r.v) for r in first if len(r.v) == size))
    return Codebooks(rule, values.reshape(-1, rule.parts, size // 4 // rule.parts).transpose(1, 0, 2).copy())


def fit(rows: DataFrame, rule: Coding = Coding()) -> Codebooks | None:
    """Codebooks trained on all of ``rows`` (id, label, v as ``prepared`` gives them)."""
    books = _seeded(rows, rule)
    for _ in range(rule.rounds if books else 0):
        books = Codebooks(rule, _round(_fitting(rows, books), books))
    return books


def _fitting(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Rows whose vectors are as long as the codebooks'."""
    return rows.where(F.octet_length("v") == 4 * books.values.shape[0] * books.values.shape[2])


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of each row: two hex digits a part, and the squared distances summed."""
    rule, values = books.rule, books.values
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _matrices(batch, 2, rule):
                code, error = np.empty((len(x), rule.parts), np.uint8), np.zeros(len(x), np.int64)
                for p in range(rule.parts):
                    best, far, _ = nearest(x[:, p], values[p])
                    code[:, p] = best
                    error += far
                text, wide = code.tobytes().hex(), 2 * rule.parts
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([text[i : i + wide] for i in range(0, len(text), wide)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return _fitting(rows, books).select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str, rule: Coding, space: Workspace) -> DataFrame:
    """(id, label, v): the integers of all vectors that can be coded, written once; the rounds read this table."""
    return space.stow(_integers(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")), rule), "integers")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rule: Coding = Coding()) -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` of every row with a codable vector.

    Null vectors, null and non-finite components drop the row, and so does a length that cannot
    be cut into equal parts (zero included) or differs from that of the smallest id's vector.
    Rows with a null id are coded, but seed no codebook unless there is no other. Rows that repeat an
    id are coded each, and seed entries each; ties between entries go to the lower index. With
    fewer rows than ``entries`` the codebooks are shorter; entries without parts stay as
    they are. An empty table gives an empty one. Other columns are dropped, so names
    cannot clash. Components so large that int64 cannot hold a distance are an error.
    ``label_error`` sums over equal labels, nulls together; a hot label's sum is made before the
    shuffle, and goes to its rows by a broadcast of bounded size.
    """
    space = Workspace(df.sparkSession, "vector-codes")
    rows = prepared(df, id_col, vector_col, label_col, rule, space)
    books = fit(rows, rule)
    if books is None:
        return rows.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = space.stow(coded(rows, books), "codes")
    space.drop(rows)
    totals = space.stow(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")), "totals")
    out = join_by_share(codes, totals, "label", "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
