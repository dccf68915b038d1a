"""Best-fit packing into bins of several permitted lengths.

Texts become runs of tokens (words and one end); a run longer than the longest permitted
length is cut into pieces of that length. Pieces are packed by decreasing length: each goes
into the open bin with the least room that still holds it; if none does, a bin opens, of
the length whose cost per token of expected content is least. At the end each bin shrinks
to the shortest permitted length that holds its contents.

Pieces are dealt by hash into shards of about ``shard_rows`` rows, whatever their source,
so no key lands in one task; only ids and lengths are shuffled, never text. A shard leaves
a few bins part-filled, which the last step shrinks.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, sorted_groups


#: Most copies of a text that one row stands for when copies become rows again.
COPIES = 1 << 14


@dataclass(frozen=True)
class Bins:
    """Permitted lengths, and the cost of a bin: ``fixed`` tokens, its length, and
    ``square`` x length^2 for attention."""

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    fixed: float = 16.0
    square: float = 1 / 65536
    shard_rows: int = 20_000

    def cost(self, length: int) -> float:
        return self.fixed + length + self.square * length * length


def pack(sizes: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin and bin length of each piece; sizes are 1 to the longest length.

    Opening a bin looks at what is still to come: a length is expected to fill up with later
    (shorter) pieces as far as these reach, and the bin with the least cost per token wins;
    ties go to the shorter one.
    """
    order = np.argsort(-sizes, kind="stable")
    still = int(sizes.sum())
    bin_of, at, room, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), [], []
    by_room: list[list[int]] = [[] for _ in range(max(bins.lengths) + 1)]  # stacks of bins
    open_rooms: list[int] = []  # sorted rooms that have a bin
    free = 0  # room in open bins
    for i in order.tolist():
        n = int(sizes[i])
        k = bisect.bisect_left(open_rooms, n)
        if k < len(open_rooms):
            r = open_rooms[k]
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms.pop(k)
            free -= n
        else:
            fill = max(n, still - free)  # what can still come into a new bin
            length = min((x for x in bins.lengths if x >= n), key=lambda x: (bins.cost(x) / min(x, fill), x))
            b, r = len(room), length
            room.append(length)
            used.append(0)
            free += length - n
        bin_of[i], at[i] = b, used[b]
        used[b] += n
        still -= n
        left = r - n
        if left:
            if not by_room[left]:
                bisect.insort(open_rooms, left)
            by_room[left].append(b)
    shrunk = np.array([min(x for x in bins.lengths if x >= u) for u in used], np.int64)
    return bin_of, at, shrunk[bin_of] if len(shrunk) else at


def _numbered(rows: DataFrame) -> DataFrame:
    """(_id, copy, _n): ``copy`` numbers the rows of an id from 0, the longest first.

    Rows alike are counted before they meet, so an id has a row a length however often it repeats. A
    length's copies are a range of numbers that begins after the longer ones'; ranges are
    dealt to all tasks in parts of ``COPIES`` and only there become rows again.
    """
    alike = rows.groupBy("_id", "_n").agg(F.count(F.lit(1)).alias("k"))
    longer = Window.partitionBy("_id").orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = alike.withColumn("first", F.coalesce(F.sum("k").over(longer), F.lit(0)))
    zero = F.lit(0).cast("long")
    parts = ranges.select("_id", "_n", "k", "first", F.explode(F.sequence(zero, F.expr(f"(k - 1) div {COPIES}"))).alias("part"))
    begin, end = F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, F.col("k"))
    return parts.repartition("_id", "_n", "part").select("_id", F.explode(F.sequence(F.col("first") + begin, F.col("first") + end - 1)).alias("copy"), "_n")


def best_fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None, bins: Bins = Bins()) -> DataFrame:
    """One row per piece: the id, ``copy``, ``piece``, its ``start`` and ``length`` in tokens of its text, and
    ``shard, bin, at, capacity``.

    ``copy`` is ``copy_col``, or numbers rows of one id from 0 (the longest text first, equal
    ones by chance: they are packed alike), so (id, copy, piece) is unique. A bin is named by
    (shard, bin); ``at`` is the piece's place in it. Null and empty texts have one token, their
    end. Null ids are one id. Repeated rows are packed each. Pieces of equal length go in order
    of id, copy and piece (ties). An empty table gives no rows. Other columns are dropped, so
    their names cannot clash. Lengths are written to the shared folder once; a task holds one
    shard of ``shard_rows`` pieces or so, whatever the texts' lengths.
    """
    longest = max(bins.lengths)
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    copy = F.col(f"`{copy_col}`").cast("long") if copy_col else F.lit(0)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), copy.alias("copy"), tokens.cast("long").alias("_n"))
    if copy_col is None:
        rows = _numbered(rows.select("_id", "_n"))
    rows = Workspace(df.sparkSession, "packing").stow(rows, "lengths")
    count = rows.agg(F.sum(F.expr(f"(_n - 1) div {longest} + 1"))).first()[0] or 0
    shards = -(-count // bins.shard_rows) or 1
    pieces = rows.select("_id", "copy", F.col("_n"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((_n - 1) div {longest} as int)"))).alias("piece"))
    length = F.least(F.lit(longest), F.col("_n") - F.col("piece") * longest).cast("int")
    pieces = pieces.select("_id", "copy", "piece", (F.col("piece") * F.lit(longest).cast("long")).alias("start"), length.alias("length"))
    shard = F.pmod(F.xxhash64("_id", "copy", "piece"), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("shard", shard).repartitionById(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "_id", "copy", "piece")
    fields = dealt.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", `bin` long, `at` long, capacity long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["shard"]):
            packed = pack(table.column("length").to_numpy().astype(np.int64), bins)
            for name, values in zip(("bin", "at", "capacity"), packed):
                table = table.append_column(name, pa.array(values, pa.int64()))
            yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    packed = dealt.mapInArrow(run, schema)
    return packed.select(F.col("_id").alias(id_col), "copy", "piece", "start", "length", "shard", "bin", "at", "capacity")
