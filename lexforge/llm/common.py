"""Shared parts: NumPy kernels over Arrow text buffers, and tables in the shared folder.

The kernels work on whole texts in slices of a few MB, so memory is bounded by the
slice (or by one text, if it alone is longer), never by a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import BATCH_BYTES, Workspace, bound_batches  # noqa: F401

SLICE_BYTES = 1 << 20
HASH_BYTES = 1 << 19


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- Arrow text

def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, beside a large JVM."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def text_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array's texts end to end, and where each starts (n + 1); null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    arr = arr.fill_null("")
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = arr.buffers()
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(where, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have ``size`` bytes at most, or one row."""
    _, offs = text_parts(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end
    trim()


GAP = np.zeros(256, bool)
GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and each text's first word (n + 1)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    gap = GAP[data]
    start, end = ~gap, ~gap
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first], end[last] = ~gap[first], ~gap[last]
    begin = np.flatnonzero(start)
    return begin, np.flatnonzero(end) + 1, np.searchsorted(begin, offs)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        have = _powers[name] = out
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[begin:end]: a polynomial over bytes, then mixed."""
    out = np.empty(len(begin), np.uint64)
    inverse = pow(int(_BASE), -1, 1 << 64)
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(end, begin[at] + HASH_BYTES, side="right")))
        lo, hi = begin[at], end[stop - 1]
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        value = data[lo:hi].astype(np.uint64)
        value += np.uint64(1)
        value *= _power(int(_BASE), hi - lo, "up")[: hi - lo]
        np.cumsum(value, out=total[1:])
        b, e = begin[at:stop] - lo, end[at:stop] - lo
        h = total[e] - total[b]
        h *= _power(inverse, hi - lo, "down")[b]
        out[at:stop] = mix64(h)
        at = stop
    return out


def text_words(arr: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and each text's first word (n + 1)."""
    data, offs = text_parts(arr)
    if lower:
        data = LOWER[data]
    begin, end, first = word_spans(data, offs)
    return word_hashes(data, begin, end), first


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and each text's first (n + 1).

    A text with fewer words than ``size`` has its whole sequence as the one shingle; a text
    without words has none.
    """
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(starts[-1]) - starts[doc] + first[doc]
    length = np.minimum(n_words[doc], size)
    h = length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for k in range(size):
        here = k < length
        step = h * np.uint64(0x9E3779B97F4A7C15) + words[np.where(here, at + k, 0)]
        step ^= step >> np.uint64(31)
        h = np.where(here, step, h)
    h = mix64(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run values[first[i]:first[i + 1]], exact per run (no running total)."""
    out = np.zeros((len(first) - 1,) + values.shape[1:], values.dtype)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from batches that come sorted by them; a run may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        new = np.zeros(table.num_rows, bool)
        for key in keys:
            v = table.column(key).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None:
        yield rest
    trim()


def join_by_share(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each value of ``key`` (null is a value) and in
    ``count`` how many of the rows have it.

    Values that more than one row in ``share`` has are fewer than ``share``, so they are sent to every task;
    all others meet their rows by a shuffle in which no value is hot. ``table`` is read three times: have it written.
    """
    total = table.agg(F.sum(count).alias("_total"))  # one row
    body = F.struct(*[F.col(c) for c in table.columns if c not in (key, count)]).alias("_body")
    parts = table.join(F.broadcast(total)).select(F.col(key).alias("_key"), body, (F.col(count) * share > F.col("_total")).alias("_hot"))
    hot = parts.where("_hot").select(F.col("_key").alias("_hot_key"), F.col("_body").alias("_hot_body"), F.lit(True).alias("_met"))
    cold = parts.where("not _hot").select("_key", "_body", F.lit(0).cast("long").alias("_cold"))
    met = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    # rows that have met theirs look for nothing, and are spread over all tasks
    met = met.withColumn("_spread", F.when(F.col("_met"), 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(1 << 20))).otherwise(F.lit(0)).cast("long"))
    out = met.join(cold, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_spread") == F.col("_cold")), "left")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col("_hot_body")[c], F.col("_body")[c]).alias(c) for c in table.columns if c not in (key, count)])
