"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Equal vectors with equal labels form a class, counted once with its size. Unit vectors are
projected on random directions. The difference of two vectors on a direction is a normal
variable whose spread is their distance, so all windows are set in spreads of a pair at
the least cosine, and all chances of a miss are known.

1. Directions are taken in tables of a few. On each direction but the last a table cuts the
   sorted values into ranges; a vector whose value lies near the lower end of its range
   visits the range below as well. So two vectors within ``reach`` of each other on all these
   directions meet in one list of the table, and in one alone: where their lower ranges meet.
   As vectors become more, tables take more directions, so that lists stay short.
2. A list is sorted by the last direction. A window centred on each vector runs along it; the
   vectors inside are its candidates in this table.
3. For each candidate pair, in the first table where it meets, collisions are counted: the
   directions on which one lies in the ``window`` centred on the other. The count that a pair
   at the least cosine reaches but for one in ``1 / miss`` is the bar (calibrated recall).
4. Pairs at the bar are verified in double precision.

Lists are made of ids; vectors travel once, to lists that hold two or more. Long lists are
read in blocks, and a block gives sums per vector and a spanning forest of its links, never
the pairs, so a large group of near vectors gives as many rows as it has members in each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, sorted_groups
from .graph import components


@dataclass(frozen=True)
class Collisions:
    """``near`` and ``far``: half-widths of ``window`` and ``reach`` in spreads. ``width``: of
    the ranges, in reaches. ``rows``: the length that lists of unlike vectors should have."""

    cosine: float = 0.98
    projections: int = 64
    near: float = 1.5
    far: float = 3.5
    width: float = 4.0
    rows: int = 32
    miss: float = 1e-6
    block: int = 1024
    seed: int = 5

    @property
    def distance(self) -> float:
        """Of two unit vectors at the least cosine, and the spread of their difference on a direction."""
        return math.sqrt(max(0.0, 2 - 2 * self.cosine)) or 1e-6

    @property
    def window(self) -> float:
        return self.near * self.distance

    @property
    def reach(self) -> float:
        return self.far * self.distance

    @property
    def bar(self) -> int:
        """The greatest count that a pair at the least cosine misses with a chance below half of ``miss``."""
        p, n, below, k = math.erf(self.near / math.sqrt(2)), self.projections, 0.0, 0
        while k < n:
            below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if below > self.miss / 2:
                break
            k += 1
        return k

    def tables(self, most: int) -> list[np.ndarray]:
        """Directions of each table, the sorted one last, for ``most`` vectors of a label.

        Ranges of a standard normal value hold a vector and another at random together with
        a chance of about 0.4. There are as many tables as make the chance that a pair meets
        in none at most half of ``miss``, if there are directions enough; else the tables
        have fewer directions and the lists are longer.
        """
        joint = max(1, math.ceil(math.log(max(most, 2) / self.rows) / math.log(2.5)))
        while True:
            apart = 1 - math.erf(self.far / math.sqrt(2)) ** (joint + 1)
            n = max(1, math.ceil(math.log(self.miss / 2) / math.log(apart)))
            if n * (joint + 1) <= self.projections or joint == 1:
                break
            joint -= 1
        deal = np.random.default_rng(self.seed + 1).permutation(self.projections)
        return [np.resize(np.roll(deal, -t * (joint + 1)), joint + 1) for t in range(n)]


_drawn: dict[tuple, np.ndarray] = {}


def directions(rule: Collisions, size: int) -> np.ndarray:
    key = rule.seed, rule.projections, size
    if key not in _drawn:
        _drawn[key] = np.random.default_rng(rule.seed).standard_normal((size, rule.projections))
    return _drawn[key]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def posts(projected: np.ndarray, use: np.ndarray, table: int, rule: Collisions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, lists (hashed) and visits (a bit for each direction) of one table."""
    width = rule.width * rule.reach
    start = np.random.default_rng(rule.seed + 2 + table).random(len(use))
    x = projected[:, use[:-1]] / width + start[:-1]
    cell = np.floor(x)
    low = (x - cell) * width <= rule.reach * (1 + 1e-9)
    row, visit = np.arange(len(projected)), np.zeros(len(projected), np.int64)
    for j in range(len(use) - 1):
        more = low[row, j]
        row, visit = np.concatenate([row, row[more]]), np.concatenate([visit, visit[more] | 1 << j])
    where = cell.astype(np.int64)[row] - (visit[:, None] >> np.arange(len(use) - 1) & 1)
    h = np.full(len(row), table, np.uint64)
    for c in where.T:
        h = (h ^ (np.ascontiguousarray(c).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)) + (h >> np.uint64(2)))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return row, h.view(np.int64), visit


def linked(v: np.ndarray, part: np.ndarray, visit: np.ndarray, table: int, tables: list[np.ndarray], rule: Collisions, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that link and are first met in this table; of unlike parts if ``cross``.

    The block is sorted by the table's last direction, and windows run along it.
    """
    p = v @ directions(rule, v.shape[1])
    reach, window = rule.reach, rule.window
    order = np.argsort(p[:, tables[table][-1]], kind="stable")
    value = p[order, tables[table][-1]]
    ahead = np.searchsorted(value, value + reach, side="right") - np.arange(len(value)) - 1
    upto = np.concatenate([[0], np.cumsum(ahead)])
    xs, ys, at = [], [], 0
    while at < len(value):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + 16_384, side="right")) - 1)
        n = ahead[at:stop]
        x = np.repeat(np.arange(at, stop), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[at:stop] - upto[at], n)
        x, y = order[x], order[y]
        own = (visit[x] & visit[y]) == 0
        if cross:
            own &= part[x] != part[y]
        x, y = x[own], y[own]
        near = np.abs(p[x] - p[y])
        met = (near[:, tables[table]] <= reach).all(1) & ((near <= window).sum(1) >= rule.bar)
        for earlier in tables[:table]:
            met &= ~(near[:, earlier] <= reach).all(1)
        x, y = x[met], y[met]
        good = (v[x] * v[y]).sum(1) >= rule.cosine
        xs.append(x[good])
        ys.append(y[good])
        at = stop
    return np.concatenate(xs or [order[:0]]), np.concatenate(ys or [order[:0]])


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(rows, -1)


def _posted(classes: DataFrame, tables: list[np.ndarray], rule: Collisions) -> DataFrame:
    """(label, dim, table, cell, visit, rep, key): the lists of each class of (label, rep, key, v), by ids alone."""
    label = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(3).offsets))
            for size in np.unique(lengths):
                some = batch.filter(pa.array(lengths == size))
                for at in range(0, some.num_rows, 1024):
                    part = some.slice(at, 1024)
                    p = unit(_matrix(part.column(3), part.num_rows)) @ directions(rule, int(size))
                    for t, use in enumerate(tables):
                        row, cell, visit = posts(p, use, t, rule)
                        n = len(row)
                        ids = part.take(pa.array(row))
                        columns = [ids.column(0), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cell), pa.array(visit), ids.column(1), ids.column(2)]
                        yield pa.RecordBatch.from_arrays(columns, names=["label", "dim", "table", "cell", "visit", "rep", "key"])

    return classes.mapInArrow(run, f"label {label}, dim int, table int, cell long, visit long, rep long, key long")


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first member of each of ``n`` members' components."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _counted(classes: DataFrame, rule: Collisions) -> DataFrame:
    """(rep, links, with): per block and vector, the linked vectors and one of the block's component."""
    # one row: the vectors of the largest label
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    tables = rule.tables(most)
    where = ["label", "dim", "table", "cell"]
    rows = _posted(classes.select("label", "rep", "key", "v"), tables, rule)
    full = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(full.select(*where, F.ceil(F.col("n") / rule.block).cast("int").alias("parts")), where)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep", "key"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(*where, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "visit", "rep", "key")
    rows = rows.join(classes, ["label", "rep", "key"])
    keys = [*where, "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            n = group.num_rows
            if n < 2:
                continue
            table, i, j = (group.column(c)[0].as_py() for c in ("table", "i", "j"))
            part, visit, rep, size = (group.column(c).to_numpy() for c in ("part", "visit", "rep", "size"))
            x, y = linked(unit(_matrix(group.column("v"), n)), part, visit, table, tables, rule, i != j)
            if len(x):
                near = np.zeros(n, np.int64)
                np.add.at(near, x, size[y])
                np.add.at(near, y, size[x])
                joined = _forest(n, x, y)
                at = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(near[at]), pa.array(rep[joined[at]])], names=["rep", "links", "with"])

    return dealt.mapInArrow(run, "rep long, links long, `with` long")


def classify(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rule: Collisions = Collisions()) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row.

    Rows link if their labels are equal and their cosine in double precision is at least
    ``rule.cosine``. Null labels, null, empty and zero vectors, and vectors with null or
    non-finite components, link with nothing, and so does a null id (its component is null,
    it is kept). Vectors of unlike lengths never link. Rows that repeat an id count as
    vectors of their own. Other columns are dropped, so names cannot clash.
    """
    space = Workspace(df.sparkSession, "near-vectors")
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False)))
    # -0.0 and 0.0 are equal numbers: adding 0.0 makes them equal bits
    key = F.when(F.col("fit"), F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0))))
    key2 = F.when(F.col("fit"), F.hash(F.transform("v", lambda x: x + F.lit(0.0)), F.size("v")))
    rows = space.stow(rows.withColumn("key", key).withColumn("key2", key2), "rows")

    by = ["label", "key", "key2"]
    classes = space.stow(rows.where("fit").groupBy(*by).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v")), "classes")
    counted = space.stow(_counted(classes.select("label", "rep", "key", "size", "v"), rule), "counted")
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(counted.select(F.col("rep").alias("a"), F.col("with").alias("b")).distinct(), space).withColumnRenamed("node", "rep")
    named = classes.select(*by, "rep", "size").join(links, "rep", "left").join(groups, "rep", "left")
    named = named.select(*by, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "fit", *by).join(named, by, "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
