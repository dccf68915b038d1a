"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and normalised. The exponent is
bisected: the largest one (closest to the natural shares) whose weights reach a target
entropy, unless a lower spread is forced by the limit on repetitions. The weights become
token budgets, and each source is realised as permutations of its documents, whole ones
first, then the part of one that the budget still holds. Documents fall into blocks that
each have the mixture of the whole.

Sources are rows of a table throughout: a round of the search is one aggregate over it, for
many exponents at once, with exact decimal sums, so no order of rows changes a budget. What
reaches the driver are sums. No source is sorted as one group: a permutation is the order of
a hash, the place where a budget ends is sought by its leading bits, twice, and only the rows
of that one part in 16 million are compared singly, by hashes and lengths alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

#: Bits of a row's place in its source's permutation by which the end of a budget is sought, twice.
BITS = 12
#: Most sources whose budgets are broadcast: a few MB.
BROADCAST_ROWS = 50_000
#: Exponents that are tried at once, and how often: each round narrows the range so many times.
TRIED, ROUNDS = 32, 8
#: Columns that are added.
ADDED = ("mix_epoch", "mix_block", "mix_order", "mix_tokens")


@dataclass(frozen=True)
class Target:
    """``entropy``: of the weights, as a part of ln(number of sources). ``repeats``: most
    times that a source's tokens may occur. ``tokens``: the budget; None: the least that
    holds each source once whole."""

    entropy: float = 0.9
    repeats: float = 4.0
    tokens: int | None = None
    blocks: int = 64
    seed: int = 17


def spread(shares: list[float], exponent: float) -> list[float]:
    top = max(shares)
    raised = [(s / top) ** exponent for s in shares]
    total = sum(raised)
    return [x / total for x in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def plan(tokens: dict, target: Target) -> dict:
    """Source to (weight, budget) of its tokens; sources without tokens have none: the rule for totals at hand.

    An exponent of 1 keeps the natural shares; 0 makes all equal. Entropy falls and
    repetition falls as the exponent rises, so both bounds are monotone: the exponent is the
    greatest that meets the entropy, or a greater one if that would repeat too much.
    """
    names = sorted((s for s in tokens if tokens[s] > 0), key=lambda s: (s is None, str(s)))
    if not names:
        return {}
    total = sum(tokens[s] for s in names)
    shares = [tokens[s] / total for s in names]

    def budget(weights: list[float]) -> float:
        return target.tokens if target.tokens is not None else max(tokens[s] / w for s, w in zip(names, weights))

    def repeated(weights: list[float]) -> float:
        return max(w * budget(weights) / tokens[s] for s, w in zip(names, weights))

    def bisect(holds) -> float:
        """The greatest exponent in 0..1 that holds, where all below hold too."""
        if holds(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    wanted = target.entropy * math.log(len(names))
    exponent = bisect(lambda a: entropy(spread(shares, a)) >= wanted)
    if repeated(spread(shares, exponent)) > target.repeats:
        exponent = 1 - bisect(lambda b: repeated(spread(shares, 1 - b)) <= target.repeats)
    weights = spread(shares, exponent)
    return {s: (w, int(math.floor(w * budget(weights) + 1e-6))) for s, w in zip(names, weights)}


def _exponent(totals: DataFrame, target: Target) -> tuple[float, float, float]:
    """Exponent, sum of the raised shares and whole budget for (s, total), a row a source; ``plan`` states the rule."""
    most, least, sources = totals.agg(F.max("total"), F.min("total"), F.count(F.lit(1))).first()
    if not sources:
        return 1.0, 1.0, 0.0
    log = F.log(F.col("total") / F.lit(float(most)))

    def exact(x: Column) -> Column:
        return F.sum((x * 1e15).cast("decimal(20,0)"))

    def measured(exponents: list[float]) -> list[tuple[float, float]]:
        """Of each exponent the entropy and the most repetitions."""
        row = totals.agg(*[f(F.exp(log * a)) for a in exponents for f in (exact, lambda x: exact(x * log))]).first()
        out = []
        for a, z, e in zip(exponents, row[::2], row[1::2]):
            z, e = float(z) / 1e15, float(e) / 1e15
            budget = target.tokens if target.tokens is not None else most * z
            out.append((math.log(z) - a * e / z, budget * (least / most) ** a / z / least))
        return out

    def search(holds, grid: list[float]) -> float:
        """The last of a falling or rising range of exponents that holds, where all before it do."""
        first, last = grid
        if holds(measured([last])[0]):
            return last
        for _ in range(ROUNDS):
            tried = [first + (last - first) * k / TRIED for k in range(1, TRIED)]
            good = [holds(x) for x in measured(tried)]
            k = good.index(False) if False in good else len(good)
            first, last = ([first, *tried][k], [*tried, last][k])
        return first

    wanted = target.entropy * math.log(sources)
    a = search(lambda x: x[0] >= wanted, [0.0, 1.0])
    if measured([a])[0][1] > target.repeats:
        a = search(lambda x: x[1] <= target.repeats, [1.0, 0.0])
    z = float(totals.agg(exact(F.exp(log * a))).first()[0]) / 1e15
    return a, z, float(target.tokens if target.tokens is not None else most * z)


def _budgets(places: DataFrame, target: Target, space: Workspace) -> DataFrame:
    """(s, total, budget, whole, last) of (s, chance, n): whole passes, and the last place of the partial one (-1 of none)."""
    totals = space.stow(places.groupBy("s").agg(F.sum("n").alias("total")), "totals")
    a, z, whole = _exponent(totals, target)
    most = totals.agg(F.max("total")).first()[0] or 1
    share = F.exp(F.log(F.col("total") / F.lit(float(most))) * a) / z
    budgets = totals.withColumn("budget", F.floor(share * whole + 1e-6).cast("long"))
    budgets = budgets.withColumn("whole", F.expr("budget div total")).withColumn("left", F.expr("budget % total"))

    def end(rows: DataFrame, shift: int) -> DataFrame:
        """(s, part, left): the part in which each source's tokens run out, and the tokens left for it."""
        parts = rows.groupBy("s", "left", F.shiftright("chance", shift).alias("part")).agg(F.sum("n").alias("n"))
        parts = parts.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("part")))  # a source has 2^BITS parts at most
        parts = parts.where("upto - n < left and left <= upto")
        return parts.select(F.col("s").alias("s2"), "part", F.expr("left - upto + n").alias("left2"))

    first, second = 63 - BITS, 63 - 2 * BITS
    here = places.join(budgets.select(F.col("s").alias("s1"), "left").where("left > 0"), F.col("s").eqNullSafe(F.col("s1"))).drop("s1")
    for shift in (first, second):
        ends = space.stow(end(here, shift), "ends")
        here = places.join(ends, F.col("s").eqNullSafe(F.col("s2")) & (F.shiftright("chance", shift) == F.col("part")))
        here = here.select("s", "chance", "n", F.col("left2").alias("left"))
    # rows with equal places (alike in id and text) stand together
    before = F.sum("n").over(Window.partitionBy("s").orderBy("chance").rangeBetween(Window.unboundedPreceding, -1))
    last = here.withColumn("before", F.coalesce(before, F.lit(0))).where("before < left").groupBy(F.col("s").alias("s3")).agg(F.max("chance").alias("last"))
    out = budgets.join(last, F.col("s").eqNullSafe(F.col("s3")), "left")
    return space.stow(out.select("s", "total", "budget", "whole", F.coalesce("last", F.lit(-1)).alias("last")), "budgets")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target: Target = Target()) -> DataFrame:
    """Rows of ``df`` as often as the mixture has them.

    Columns: all of ``df``, then ``mix_epoch`` (0 is the first pass), ``mix_block`` and
    ``mix_order`` (a hash: order within the block), ``mix_tokens``; columns of ``df`` with
    these four names are replaced, any other stays. A null source is a source of its own.
    Null and empty texts have one token (a document's end), so no row is lost while its
    source's budget is whole. Null ids are ids like any other. Repeated rows, alike in id and
    text, tie: where a budget ends among them all come in. An empty table gives an empty one.
    """
    keep = [c for c in df.columns if c not in ADDED]
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1
    key = [F.col(f"`{c}`") for c in (id_col, text_col)]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("s"),
        tokens.cast("long").alias("n"), F.shiftrightunsigned(F.xxhash64(F.lit(target.seed), *key), 1).alias("chance"),
    )
    space = Workspace(df.sparkSession, "mix")
    places = space.stow(rows.select("s", "chance", "n"), "places")
    budgets = _budgets(places, target, space).withColumnRenamed("s", "s2")
    # one row a source: sent to every task while they are few, joined by shuffle beyond that
    budgets = F.broadcast(budgets) if budgets.count() <= BROADCAST_ROWS else budgets
    joined = rows.join(budgets, F.col("s").eqNullSafe(F.col("s2")))
    passes = F.col("whole") + (F.col("chance") <= F.col("last")).cast("long")
    taken = joined.where(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (passes - 1).cast("int"))))

    order = F.xxhash64(F.lit(target.seed + 1), "epoch", "id", "text")
    place = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
    # the passes of a source follow each other through the blocks in proportion to its budget
    start = F.col("epoch") * F.col("total")
    along = (start + place * F.least(F.col("total"), F.col("budget") - start)) / F.col("budget")
    block = F.least((along * target.blocks).cast("int"), F.lit(target.blocks - 1))
    return taken.select(*[F.col("row")[c].alias(c) for c in keep], F.col("epoch").alias("mix_epoch"), block.alias("mix_block"), order.alias("mix_order"), F.col("n").alias("mix_tokens"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` in the order of the mixture: partitions are runs of blocks, sorted within; columns stay."""
    return mixed.repartitionByRange("mix_block", "mix_order").sortWithinPartitions("mix_block", "mix_order")
