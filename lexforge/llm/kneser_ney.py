"""An interpolated modified Kneser-Ney model of word pairs or triples.

Counting runs in Spark. A first round counts words. Then word pairs (order 2) or triples
(order 3) are counted, a part of the shards at a time (``passes``), so that the shuffle of one
part is gone before the next is made; each task sums what it has read before it is shuffled,
packed as sorted runs of hashes. Pairs are dealt by the hash of their first word, those of very
frequent first words by the pair, so no word's pairs land in one task.

The tables are sorted arrays of hashes in the shared folder, a file for each table and shard:
the leading bits of a hash name its shard, the next ones its bucket, and 32 more are stored.
Scoring tasks map the files into memory and look up a slice's queries shard by shard. Files are
listed in a manifest, and one that is absent or too short is an error, never a zero. Frequent
words and their statistics are a file as well; the driver gets sums alone.

p(w) = (N(.w) - D) / N(..) + spare / (V + 1);  p(w|v) = (c(vw) - D) / c(v.) + spare(v) p(w),
with N: distinct pairs, D: the modified discounts of one, two, and three or more.

With order 3 triples are dealt by their middle word, so that what a pair is followed by and
what it follows meet in one place. Those of a frequent middle word are dealt by their first two
words, or by the triple if both are frequent; what their pairs sum to is then dealt again.
p(w|uv) = (c(uvw) - D) / c(uv.) + spare(uv) p(w|v), and the pairs below count distinct words
before them: p(w|v) = (N(.vw) - D) / N(.v.) + spare(v) p(w). A text's first word has nothing
before it; its pair keeps its count, and no triple is made.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bound_batches, mix64, slices, sorted_groups, sums, text_words

END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x8F14E45FCEEA167A)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hashed context; the lowest says whether both of its words are frequent.
CONTEXT = 40
#: Keys of a bucket, about.
BUCKET = 16
#: Bytes of texts that are scored at once.
SCORED = 2 << 20
#: Tokens that a task holds before it sums them up.
HELD = 1_500_000
#: Tables of a model: words, words that pairs end in, and what first words, pairs and contexts sum to.
TABLES = ("words", "ends", "firsts", "pairs", "hot-pairs", "triples", "contexts", "hot-contexts")
#: Every task's rows: what a shard's arrays are made from, totals, files, statistics of frequent words.
NOTES = "part string, shard int, blob binary, numbers array<long>, frequent array<array<long>>"
_KINDS = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the totals."""

    folder: str
    bits: int
    order: int = 2
    tokens: int = 0
    types: int = 0
    pairs: int = 0
    triple_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_spread: tuple[int, int, int] = (0, 0, 0)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts one, two, three or more, from how many counts are 1, 2, 3, 4.

    Each lies between 0 and its count; without counts of one or two there is nothing to
    estimate from, and the usual 0.5, 1, 1.5 serve.
    """
    if not n[0] or not n[1]:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = (k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3))
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))


# ------------------------------------------------------------- packed runs

def _packed(*columns: np.ndarray, widths: str) -> bytes:
    """Columns of one length as one compressed blob: the first as steps, then hashes of so many bytes, or counts (c)."""
    n = len(columns[0])
    first = columns[0].copy()
    first[1:] -= columns[0][:-1]
    parts = [np.uint64(n).tobytes(), first.tobytes()]
    for x, width in zip(columns[1:], widths):
        if width == "c":
            parts.append(x.astype(np.uint32).view(np.uint8).reshape(n, 4).T.tobytes())
        else:
            parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(n, 8)[:, : int(width)]).tobytes())
    raw = b"".join(parts)
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, widths: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob[:8], np.uint64)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:8], np.uint64)[0])
    out, at = [np.cumsum(np.frombuffer(raw, np.uint64, n, 8), dtype=np.uint64)], 8 + 8 * n
    for width in widths:
        if width == "c":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).reshape(n).astype(np.int64))
            at += 4 * n
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, : int(width)] = np.frombuffer(raw, np.uint8, int(width) * n, at).reshape(n, int(width))
            out.append(wide.view(np.uint64).reshape(n))
            at += int(width) * n
    return out


def _merged(group: pa.Table, widths: str) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(_unpacked(b.as_py(), widths) for b in group.column("blob")))]


def _note(part: str, shard: list | None = None, blob: list | None = None, numbers: list[int] | None = None, frequent: list | None = None) -> pa.RecordBatch:
    n = len(shard) if shard is not None else 1
    columns = ([part] * n, shard or [None] * n, blob or [None] * n, [numbers] * n, [frequent] * n)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS)], names=["part", "shard", "blob", "numbers", "frequent"])


def _dealt(part: str, shard_of: np.ndarray, order: np.ndarray, *columns: np.ndarray, widths: str) -> pa.RecordBatch:
    """Columns in ``order``, dealt to shards."""
    shard = shard_of[order]
    if len(shard):
        small = int(shard.max()) < 1 << 16
        by = np.argsort(shard.astype(np.uint16) if small else shard, kind="stable")
        order, shard = order[by], shard[by]
    cut = _cuts(shard)
    blobs = [_packed(*(x[order[a:b]] for x in columns), widths=widths) for a, b in zip(cut, cut[1:])]
    return _note(part, shard[cut[:-1]].astype(np.int32).tolist(), blobs)


# ----------------------------------------------------------------- numbers

def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their sums (or how often they occur), and where one of each stands."""
    order = np.argsort(key)
    key = key[order]
    cut = _cuts(key)
    at = cut[:-1]
    return key[at], np.diff(cut) if n is None else np.add.reduceat(n[order], at) if len(at) else n[:0], order[at]


def _cuts(sorted_key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1, [len(sorted_key)]])


def _stats(n: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.stack([sums(x.astype(np.int64), cut) for x in (n, n == 1, n == 2, n >= 3)])


def _spread(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4; how many there are; and how many are 3 or more."""
    few = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)
    return [*few[1:5].tolist(), len(n), int((n >= 3).sum())]


def _low(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 48) - 1)


def _top(h: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    return (h >> np.uint64(width - bits)).astype(np.int64)


def _in_shard(shard: np.ndarray | int, key: np.ndarray, bits: int) -> np.ndarray:
    """The key with the shard's number as its leading bits."""
    return (np.asarray(shard).astype(np.uint64) << np.uint64(64 - bits)) | (key & np.uint64((1 << (64 - bits)) - 1))


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and each text's first (n + 1)."""
    words, first = text_words(part.column(part.schema.get_field_index("text")))
    docs = len(first) - 1
    starts = first + np.arange(docs + 1)
    out = np.empty(len(words) + docs, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(first))] = words
    out[starts[1:] - 1] = END
    return out, starts


def _before(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    v = np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[starts[:-1]] = BEGIN
    return v


class Routes:
    """Which shard a pair, context or triple belongs to, and its key there."""

    def __init__(self, hot: np.ndarray, bits: int):
        self.hot, self.bits = hot, bits

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)] == v

    def pairs(self, v: np.ndarray, w: np.ndarray, is_hot: np.ndarray) -> np.ndarray:
        """Keys of pairs: in the shard of the first word, or of the pair if that is frequent."""
        key = mix64(v * STEP + _low(w))
        return np.where(is_hot, key, _in_shard(v >> np.uint64(64 - self.bits), key, self.bits))

    def contexts(self, u: np.ndarray, v: np.ndarray, hot_u: np.ndarray, hot_v: np.ndarray) -> np.ndarray:
        c = mix64(u * STEP + v) >> np.uint64(64 - CONTEXT)
        return (c & ~np.uint64(1)) | (hot_u & hot_v).astype(np.uint64)

    def of_context(self, c: np.ndarray, v: np.ndarray, hot_v: np.ndarray) -> np.ndarray:
        """The shard of a context's sums: by its second word, or by itself if that is frequent."""
        return np.where(hot_v, _top(c, self.bits, CONTEXT), _top(v, self.bits))

    def triples(self, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        return mix64(c * STEP + _low(w))

    def of_triple(self, c: np.ndarray, v: np.ndarray, key: np.ndarray, hot_v: np.ndarray) -> np.ndarray:
        return np.where((c & np.uint64(1)).astype(bool), _top(key, self.bits), self.of_context(c, v, hot_v))


# ------------------------------------------------------------------- files

def _write(folder: str, name: str, parts: list[bytes]) -> None:
    """Write whole or not at all: a task that runs twice writes the same file twice."""
    if not os.path.exists(f"{folder}/shared"):
        raise RuntimeError(f"{folder} is not mounted here: spark.checkpoint.dir must be the same folder on all machines")
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.writelines(parts)
    os.replace(part, f"{folder}/{name}")


def _store(folder: str, table: str, shard: int, key: np.ndarray, bits: int, counts: np.ndarray | None = None, stats: np.ndarray | None = None) -> pa.RecordBatch:
    """A shard's file: sizes, where each bucket begins, 32 bits of each key, a value of each, and what values refer to.

    Counts are a byte each; those of 255 or more are listed apart by place. Rows of statistics
    are few distinct ones: values are places in a list of them.
    """
    if stats is not None:
        row = reduce(lambda h, x: mix64(h * STEP + x.astype(np.uint64)), stats, np.zeros(len(key), np.uint64))
        _, _, at = _summed(row)
        _, value = np.unique(row, return_inverse=True)
        value = value.astype(np.uint16 if len(at) < 1 << 16 else np.uint32)
        side = np.ascontiguousarray(stats.T[at], np.int64)
    else:
        value = np.minimum(counts, 255).astype(np.uint8)
        large = np.flatnonzero(counts >= 255)
        side = np.stack([large, counts[large]]).astype(np.int64)
    depth = max(0, (len(key) // BUCKET).bit_length())
    rest = key << np.uint64(bits)
    bucket = _top(rest, depth) if depth else np.zeros(len(key), np.int64)
    begin = np.searchsorted(bucket, np.arange((1 << depth) + 1)).astype(np.uint32)
    low = ((rest << np.uint64(depth)) >> np.uint64(32)).astype(np.uint32)
    steps = int(np.diff(begin).max(initial=0)).bit_length()
    sizes = np.array([len(key), depth, steps, value.itemsize, side.size], np.int64)
    _write(folder, f"{table}-{shard}", [sizes.tobytes(), side.tobytes(), begin.tobytes(), low.tobytes(), value.tobytes()])
    return _note("stored", [shard], None, [TABLES.index(table), len(key)])


class Shard:
    """A file of ``_store``, mapped into memory."""

    def __init__(self, path: str, want: int, rows: bool):
        data = np.memmap(path, np.uint8, "r")
        if len(data) < 40 or int(data[:8].view(np.int64)[0]) != want:
            raise ValueError(f"{path} is not the file that the model was made with")
        n, self.depth, self.steps, width, m = data[:40].view(np.int64).tolist()
        ends = np.cumsum([40, 8 * m, 4 * ((1 << self.depth) + 1), 4 * n, width * n]).tolist()
        if len(data) != ends[-1]:
            raise ValueError(f"{path} is cut short")
        side, begin, low, value = (data[a:b] for a, b in zip(ends, ends[1:]))
        self.side = side.view(np.int64).reshape((-1, 4) if rows else (2, -1))
        self.begin, self.low, self.value = begin.view(np.uint32), low.view(np.uint32), value.view(f"u{width}")

    def find(self, key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are there: a bisection within buckets, all keys at once."""
        rest = key << np.uint64(bits)
        bucket = _top(rest, self.depth) if self.depth else np.zeros(len(key), np.int64)
        low = ((rest << np.uint64(self.depth)) >> np.uint64(32)).astype(np.uint32)
        at, stop = self.begin[bucket].astype(np.int64), self.begin[bucket + 1].astype(np.int64)
        end, last = stop.copy(), len(self.low) - 1
        for _ in range(self.steps):
            mid = (at + stop) >> 1
            less = (self.low[np.minimum(mid, last)] < low) & (at < stop)
            at = np.where(less, mid + 1, at)
            stop = np.where(less, stop, mid)
        return at, (at < end) & (self.low[np.minimum(at, last)] == low)


# ---------------------------------------------------------------- training

def train(df: DataFrame, text_col: str = "text", shard_bytes: int = 64 << 20, label: str = "kneser-ney", order: int = 2, passes: int = 2) -> Model:
    """A model of all rows of ``df``. Null texts are empty ones: their end is their one token.

    ``order``: 2 for word pairs, 3 for triples above pairs. ``passes``: in how many parts
    the shards are counted; each reads all texts, and the shuffle of one is on disk at a time.
    Repeated rows count each; an empty table gives a model without counts.
    """
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    spark = df.sparkSession
    space = Workspace(spark, label)
    bound_batches(spark)
    folder = space.local("arrays")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/shared", "w"):
        pass
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = max(6, (n_bytes // (shard_bytes >> (order - 2))).bit_length())
    shards = 1 << bits
    often = max(64, n_bytes // (96 * shards))  # about 15 tokens in 1000 of a shard: at most 16 x shards words reach it

    def by_shard(notes: DataFrame, part: str) -> DataFrame:
        return notes.where(F.col("part") == part).select("shard", "blob").repartition(shards, "shard").sortWithinPartitions("shard")

    def routes() -> Routes:
        return Routes(_hot(folder)[0], bits)

    # ---- words

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, n, _ = _summed(*(np.concatenate(x) for x in zip(*held)))
            return _dealt("words", _top(key, bits), np.arange(len(key)), key, n, widths="c")

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(np.unique(_tokens(part)[0], return_counts=True))
                if sum(len(x[0]) for x in held) > HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            key, n, _ = _summed(*_merged(group, "c"))
            yield _store(folder, "words", group.column("shard")[0].as_py(), key, bits, n)
            yield _note("totals", None, None, [int(n.sum()), len(key)], [[int(x)] for x in key[n >= often].view(np.int64)])

    words = space.stow(by_shard(docs.mapInArrow(count_words, NOTES), "words").mapInArrow(merge_words, NOTES), "words")
    total = words.where("part = 'totals'").agg(F.sum(F.col("numbers")[0]), F.sum(F.col("numbers")[1])).first()
    _save_hot(words.select(F.explode("frequent").alias("f")).select(F.col("f")[0].alias("v")), folder, "hot")

    # ---- pairs

    def settle(shard: int, key: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, at: Routes, table: str) -> Iterator[pa.RecordBatch]:
        """Write the distinct pairs of a shard and what their first words sum to; then the words they end in."""
        yield _store(folder, table, shard, key, bits, n)
        order = np.argsort(v)
        cut = _cuts(v[order])
        stats, firsts = _stats(n[order], cut), v[order][cut[:-1]]
        is_hot = at.is_hot(firsts)
        if table == "pairs":
            yield _store(folder, "firsts", shard, firsts[~is_hot], bits, stats=stats[:, ~is_hot])
        yield _note("pairs-spread", None, None, _spread(n), np.concatenate([firsts[is_hot].view(np.int64)[:, None], stats[:, is_hot].T], 1).tolist())
        u, c = np.unique(_low(w), return_counts=True)
        yield _dealt("ends", _top(u, bits, 48), np.arange(len(u)), u, c, widths="c")

    def count_pairs(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], routes()

            def flush() -> pa.RecordBatch:
                v, w, key = (np.concatenate(x) for x in zip(*held))
                key, n, one = _summed(key)
                v, w = v[one], _low(w[one])
                return _dealt("pairs", _top(key, bits), np.argsort(v), v, w, n, widths="6c")

            for batch in batches:
                for part in slices(batch, "text"):
                    w, starts = _tokens(part)
                    v = _before(w, starts)
                    key = at.pairs(v, w, at.is_hot(v))
                    mine = np.flatnonzero(_top(key, bits) % passes == turn)
                    held.append(tuple(x.take(mine) for x in (v, w, key)))
                    if sum(len(x[0]) for x in held) > HELD:
                        yield flush()
                        held.clear()
            if held:
                yield flush()

        return run

    def merge_pairs(table: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = routes()
            for group in sorted_groups(batches, ["shard"]):
                v, w, n = _merged(group, "6c")
                key, n, one = _summed(at.pairs(v, w, at.is_hot(v)), n)
                yield from settle(group.column("shard")[0].as_py(), key, v[one], w[one], n, at, table)

        return run

    # ---- triples

    def count_triples(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, at = [], routes()

            def flush() -> pa.RecordBatch:
                v, c, w, key, shard = (np.concatenate(x) for x in zip(*held))
                _, n, one = _summed(key)
                v, c, w, shard = v[one], c[one], _low(w[one]), shard[one]
                # by the first half of v's bits, then of w's: equal pairs stand together and compress
                order = np.argsort(v & np.uint64(0xFFFFFFFF00000000) | w >> np.uint64(16))
                return _dealt("triples", shard, order, v, c, w, n, widths=f"{CONTEXT // 8}6c")

            for batch in batches:
                for part in slices(batch, "text"):
                    w, starts = _tokens(part)
                    v = _before(w, starts)
                    hot_v = at.is_hot(v)
                    hot_u = np.empty_like(hot_v)
                    hot_u[1:] = hot_v[:-1]
                    hot_u[starts[:-1]] = True  # nothing is before a text, as often as there are texts
                    c = at.contexts(_before(v, starts), v, hot_u, hot_v)
                    key = at.triples(c, w)
                    shard = at.of_triple(c, v, key, hot_v)
                    mine = np.flatnonzero(shard % passes == turn)
                    held.append(tuple(x.take(mine) for x in (v, c, w, key, shard)))
                    if sum(len(x[0]) for x in held) > HELD:
                        yield flush()
                        held.clear()
            if held:
                yield flush()

        return run

    def merge_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = routes()
        for group in sorted_groups(batches, ["shard"]):
            shard = group.column("shard")[0].as_py()
            v, c, w, n = _merged(group, f"{CONTEXT // 8}6c")
            key, n, one = _summed(_in_shard(shard, at.triples(c, w), bits), n)
            v, c, w = v[one], c[one], w[one]
            whole = v != BEGIN
            yield _store(folder, "triples", shard, key[whole], bits, n[whole])
            yield _note("triples-spread", None, None, _spread(n[whole]))
            # what follows a context
            place = np.flatnonzero(whole)
            place = place[np.argsort(c[place])]
            cut = _cuts(c[place])
            stats, cs = _stats(n[place], cut), c[place][cut[:-1]]
            both = (cs & np.uint64(1)).astype(bool)
            yield from contexts(shard, cs[~both], stats[:, ~both], "contexts")
            if both.any():
                yield _dealt("contexts", _top(cs[both], bits, CONTEXT), np.arange(int(both.sum())), cs[both], *stats[:, both], widths="cccc")
            # distinct words before a pair; a text's first word keeps its count
            before = np.where(whole, 1, n)
            is_hot = at.is_hot(v)
            key = at.pairs(v, w, is_hot)
            if is_hot.any():
                k, m, one = _summed(key[is_hot], before[is_hot])
                first, second = v[is_hot][one], w[is_hot][one]
                yield _dealt("hot-pairs", _top(k, bits), np.argsort(first), first, second, m, widths="6c")
            k, m, one = _summed(key[~is_hot], before[~is_hot])
            yield from settle(shard, k, v[~is_hot][one], w[~is_hot][one], m, at, "pairs")

    def contexts(shard: int, c: np.ndarray, stats: np.ndarray, table: str) -> Iterator[pa.RecordBatch]:
        key = _in_shard(shard, mix64(c), bits)
        order = np.argsort(key)
        yield _store(folder, table, shard, key[order], bits, stats=stats[:, order])

    def merge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            c, *stats = _merged(group, "cccc")
            order = np.argsort(c)
            cut = _cuts(c[order])
            yield from contexts(group.column("shard")[0].as_py(), c[order][cut[:-1]], np.stack([sums(x[order], cut) for x in stats]), "hot-contexts")

    def merge_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            key, n, _ = _summed(*_merged(group, "c"))
            yield _store(folder, "ends", group.column("shard")[0].as_py(), key << np.uint64(16), bits, n)
            yield _note("ends-spread", None, None, _spread(n))

    count, merge, part = (count_pairs, merge_pairs("pairs"), "pairs") if order == 2 else (count_triples, merge_triples, "triples")
    notes = [space.stow(by_shard(docs.mapInArrow(count(turn), NOTES), part).mapInArrow(merge, NOTES), part) for turn in range(passes)]
    every = reduce(DataFrame.unionByName, notes)
    if order == 3:
        notes.append(space.stow(by_shard(every, "contexts").mapInArrow(merge_contexts, NOTES), "contexts"))
        notes.append(space.stow(by_shard(every, "hot-pairs").mapInArrow(merge_pairs("hot-pairs"), NOTES), "hot-pairs"))
        every = reduce(DataFrame.unionByName, notes)
    notes.append(space.stow(by_shard(every, "ends").mapInArrow(merge_ends, NOTES), "ends"))
    every = reduce(DataFrame.unionByName, [*notes, words])

    def spread(part: str) -> list[int]:
        row = every.where(F.col("part") == f"{part}-spread").agg(*[F.sum(F.col("numbers")[k]) for k in range(6)]).first()
        return [int(x or 0) for x in row]

    hot = every.where("part = 'pairs-spread'").select(F.explode("frequent").alias("f")).groupBy(F.col("f")[0].alias("v")).agg(*[F.sum(F.col("f")[k]).alias(f"s{k}") for k in (1, 2, 3, 4)])
    _save_hot(hot, folder, "hot-stats")
    _save_manifest(every.where("part = 'stored'").select(F.col("numbers")[0].alias("table"), F.col("shard").cast("long").alias("shard"), F.col("numbers")[1].alias("n")), folder, shards)
    three, two, one = spread("triples"), spread("pairs"), spread("ends")
    for note in [*notes, words]:
        space.drop(note)
    return Model(folder, bits, order, int(total[0] or 0), int(total[1] or 0), two[4], discounts(three[:4]), discounts(two[:4]), discounts(one[:4]), (one[0], one[1], one[5]))


def _one_file(df: DataFrame, folder: str, name: str, make) -> None:
    """Rows of whole numbers in one file; there are a few of them a shard."""
    width = len(df.columns)

    def save(rows: list[np.ndarray]) -> int:
        array = make(np.concatenate([np.zeros((width, 0), np.int64), *rows], 1))
        _write(folder, name, [np.array(array.shape, np.int64).tobytes(), np.ascontiguousarray(array, np.int64).tobytes()])
        return array.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = save([np.stack([x.to_numpy(zero_copy_only=False) for x in b.columns]) for b in batches if b.num_rows])
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    if df.repartition(1).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] is None:  # a plan without rows runs no function
        save([])


def _read_file(folder: str, name: str) -> np.ndarray:
    data = np.fromfile(f"{folder}/{name}", np.int64)
    return data[2:].reshape(data[:2])


def _save_hot(df: DataFrame, folder: str, name: str) -> None:
    """Frequent words, and the row of statistics of each if there is one, in order; a text's beginning is frequent."""

    def make(rows: np.ndarray) -> np.ndarray:
        if not (rows[0] == BEGIN.view(np.int64)).any():
            rows = np.concatenate([rows, np.array([[BEGIN.view(np.int64)]] + [[0]] * (len(rows) - 1))], 1)
        return rows[:, np.argsort(rows[0].view(np.uint64))]

    _one_file(df, folder, name, make)


def _hot(folder: str, name: str = "hot") -> tuple[np.ndarray, np.ndarray]:
    rows = _read_file(folder, name)
    return np.ascontiguousarray(rows[0]).view(np.uint64), rows[1:]


def _save_manifest(df: DataFrame, folder: str, shards: int) -> None:
    """How many keys each table has in each shard."""

    def make(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(TABLES), shards), np.int64)
        out[rows[0], rows[1]] = rows[2]
        return out

    _one_file(df, folder, "manifest", make)


# ----------------------------------------------------------------- scoring

class Reader:
    """Memory-mapped arrays of a model."""

    def __init__(self, model: Model):
        self.m, self.open = model, {}
        self.at = Routes(_hot(model.folder)[0], model.bits)
        self.hot, self.hot_stats = _hot(model.folder, "hot-stats")
        self.sizes = dict(zip(TABLES, _read_file(model.folder, "manifest")))

    def shard(self, table: str, k: int) -> Shard | None:
        """A shard's file; none if the manifest has it without a key, an error if the file is not there."""
        if (table, k) not in self.open:
            n = int(self.sizes[table][k])
            self.open[table, k] = Shard(f"{self.m.folder}/{table}-{k}", n, table in ("firsts", "contexts", "hot-contexts")) if n else None
        return self.open[table, k]

    def _each(self, key: np.ndarray, table: str) -> Iterator[tuple[Shard, np.ndarray, np.ndarray]]:
        """Shards, places in them of the keys that are there, and which keys these are."""
        order = np.argsort(key)
        asked = key[order]
        top = _top(asked, self.m.bits)
        cut = _cuts(top)
        for a, b in zip(cut, cut[1:]):
            have = self.shard(table, int(top[a]))
            if have is not None:
                place, there = have.find(asked[a:b], self.m.bits)
                yield have, place[there], order[a:b][there]

    def counts(self, key: np.ndarray, table: str) -> np.ndarray:
        """Counts of keys in any order; 0 where unknown."""
        out = np.zeros(len(key), np.int64)
        for have, place, which in self._each(key, table):
            n = have.value[place].astype(np.int64)
            large = np.flatnonzero(n == 255)
            if len(large):
                n[large] = have.side[1][np.searchsorted(have.side[0], place[large])]
            out[which] = n
        return out

    def stats(self, key: np.ndarray, table: str) -> np.ndarray:
        """Four statistics of each key, in any order; 0 where unknown."""
        out = np.zeros((len(key), 4), np.int64)
        for have, place, which in self._each(key, table):
            out[which] = have.side[have.value[place]]
        return out.T

    @staticmethod
    def mixed(n: np.ndarray, stats: np.ndarray, discount: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
        total, one, two, more = stats
        d = np.array([0.0, *discount])
        spare = d[1] * one + d[2] * two + d[3] * more
        return np.where(total > 0, (n - d[np.minimum(n, 3)] + spare * lower) / np.maximum(total, 1), lower)

    def words(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, their base scores and their share of distinct pairs."""
        m = self.m
        count = self.counts(u, "words")
        base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
        if not m.pairs:
            return count, base, np.full(len(u), 1.0 / (m.types + 1))
        ends = self.counts(_low(u) << np.uint64(16), "ends")
        d = np.array([0.0, *m.word_discounts])
        spare = sum(x * y for x, y in zip(m.word_discounts, m.word_spread)) / m.pairs
        return count, base, np.maximum(ends - d[np.minimum(ends, 3)], 0) / m.pairs + spare / (m.types + 1)

    def score(self, w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: known tokens, base score and log10 probability."""
        m, at = self.m, self.at
        u, inv = np.unique(w, return_inverse=True)
        count, base, p = self.words(u)
        p = p[inv]
        # what first words sum to: one row of each word, and of the beginning
        heads = np.append(u, BEGIN)
        stats = self.stats(heads, "firsts")
        k = np.minimum(np.searchsorted(self.hot, heads), len(self.hot) - 1)
        stats = np.where(self.hot[k] == heads, self.hot_stats[:, k], stats)
        head = np.empty(len(w), np.int64)
        head[1:] = inv[:-1]
        head[starts[:-1]] = len(u)
        v, hot_v = heads[head], at.is_hot(heads)[head]
        key = at.pairs(v, w, hot_v)
        n = np.empty(len(key), np.int64)
        for some, table in ((hot_v, "hot-pairs"), (~hot_v, "pairs")) if m.order == 3 else ((slice(None), "pairs"),):
            n[some] = self.counts(key[some], table)
        p = self.mixed(n, stats[:, head], m.pair_discounts, p)
        if m.order == 3:
            hot_u = np.empty_like(hot_v)
            hot_u[1:] = hot_v[:-1]
            hot_u[starts[:-1]] = True
            c = at.contexts(_before(v, starts), v, hot_u, hot_v)
            key = at.triples(c, w)
            key = _in_shard(at.of_triple(c, v, key, hot_v), key, m.bits)
            own = _in_shard(at.of_context(c, v, hot_v), mix64(c), m.bits)
            both = (c & np.uint64(1)).astype(bool)
            after = np.empty((4, len(c)), np.int64)
            for some, table in ((both, "hot-contexts"), (~both, "contexts")):
                after[:, some] = self.stats(own[some], table)
            p = self.mixed(self.counts(key, "triples"), after, m.triple_discounts, p)
        return sums((count > 0).astype(np.int64)[inv], starts), sums(base[inv], starts), sums(np.log10(p), starts)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of each row.

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` that of
    the smoothed word counts. Null texts are empty ones. Repeated rows are scored each; an
    empty table gives an empty one; there are no ties to break. Other columns are dropped, so
    names cannot clash. A model of no rows gives every token the same share. A worker holds
    the tokens of a slice of texts, or of the longest one: about 300 bytes a token.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part in slices(batch, "text", SCORED):
                w, starts = _tokens(part)
                known, base, value = reader.score(w, starts)
                n = np.diff(starts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(value), pa.array(10 ** (-value / n))], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return out.withColumnRenamed("id", id_col)
