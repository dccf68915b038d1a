"""Strata, slices and splits; what was random is a hash, so that runs repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Substitutions that turn a question's meaning round, in order of preference.
OPPOSITES = (
    ("升高", "降低"), ("增加", "减少"), ("成人", "儿童"), ("男性", "女性"), ("可以", "不可以"), ("能", "不能"), ("需要", "不需要"), ("会", "不会"),
    ("有", "没有"), ("是", "不是"), ("高", "低"), ("急性", "慢性"), ("原发", "继发"), ("良性", "恶性"), ("治疗", "预防"), ("症状", "病因"),
)


def numbered(df: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``row`` from 0 in ``order`` within ``by``.

    Without ``by`` the whole table is sorted by ranges and written once; a row's number is its
    place in its range and the rows of the ranges before, so no task sees more than a range.
    """
    if by:
        return df.withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    name = "_place"
    while name in df.columns:
        name += "_"
    placed = written(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = F.broadcast(sizes.select(F.struct("_part", before.alias("_before")).alias("_start")))
    rows = placed.join(starts, part == F.col("_start._part"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start._before") + F.col(name).bitwiseAND((1 << 33) - 1)).alias("row"))


def _counted(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds ``_n``, the rows within ``by``."""
    if by:
        return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))  # one row


def quartiles(df: DataFrame, score: str, index: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``stratum`` 0 to 3: row i of n in order of (score, index) lies in slice [b n // 4, (b + 1) n // 4)."""
    rows = _counted(numbered(df, F.col(score), F.col(index), by=by), by)
    return rows.withColumn("stratum", (F.ceil(4 * (F.col("row") + 1) / F.col("_n")) - 1).cast("int")).drop("row", "_n")


def sample_strata(df: DataFrame, index: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``k`` rows of each stratum, by hash."""
    w = Window.partitionBy("stratum").orderBy(F.xxhash64(F.col(index), F.lit(seed)), index)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def round_robin(df: DataFrame, order: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``slice``: rows i, i + n, i + 2n ... in order."""
    return numbered(df, F.col(order), by=by).withColumn("slice", (F.col("row") % n).cast("int")).drop("row")


def chunks_by_size(df: DataFrame, order: str, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    return numbered(df, F.col(order), by=by).withColumn("chunk", F.floor(F.col("row") / size).cast("int")).drop("row")


def chunks_by_count(df: DataFrame, order: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``chunk``: n runs of nearly equal length, the longer ones first."""
    if by:
        return df.withColumn("chunk", F.ntile(n).over(Window.partitionBy(*by).orderBy(order)) - 1)
    rows = _counted(numbered(df, F.col(order)), ())
    short, longer = F.expr(f"_n div {n}"), F.col("_n") % n
    chunk = F.when(F.col("row") < longer * (short + 1), F.floor(F.col("row") / (short + 1))).otherwise(longer + F.floor((F.col("row") - longer * (short + 1)) / F.greatest(short, F.lit(1))))
    return rows.withColumn("chunk", chunk.cast("int")).drop("row", "_n")


def at_indices(df: DataFrame, order: str, indices: list[int]) -> DataFrame:
    """Rows at 1-based places; a place beyond the rows is an error."""
    asked = df.sparkSession.createDataFrame([(i,) for i in indices], "place long")
    rows = numbered(df, F.col(order)).withColumn("place", F.col("row") + 1)
    out = asked.join(rows.withColumn("_found", F.lit(True)), "place", "left")
    return out.withColumn("place", F.when(F.col("_found"), F.col("place")).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))).drop("_found", "row")


def intent_samples(df: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Distinct stripped texts with their label 0 or 1; blank texts and texts with two labels are errors.

    With ``keep_blank`` an empty and a null text are texts as others are, and a null one may lack a label.
    """
    from ..functions.text import ustrip

    rows = df.select(ustrip(F.col("text")).alias("text"), F.col("label").cast("int").alias("label"))
    out = rows.groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("_hi"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("_bad"))
    fail = lambda why: F.raise_error(F.lit(why)).cast("int")
    blank = F.when(F.col("text").isNull(), F.col("label")) if keep_blank else F.when(F.coalesce("text", F.lit("")) == "", fail("blank text"))
    label = blank.when(F.col("_bad") > 0, fail("label is not 0 or 1")).when(F.col("label") != F.col("_hi"), fail("a text has two labels")).otherwise(F.col("label"))
    return out.select("text", label.alias("label"))


def balanced(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has, by hash."""
    w = Window.partitionBy(label).orderBy(F.xxhash64("text", F.lit(seed)), "text")
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_least"))  # one row
    return df.withColumn("_k", F.row_number().over(w)).join(F.broadcast(least)).where("_k <= _least").drop("_k", "_least")


def stratified_split(df: DataFrame, label: str = "label", share: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds ``part``, train or validation: in each label min(max(int(n share), 1), n - 1) rows train.

    Fewer than two rows of a label are an error. Texts must be distinct, so none is in both parts.
    """
    w = Window.partitionBy(label)
    n = F.count(F.lit(1)).over(w)
    train = F.least(F.greatest(F.floor(n * share), F.lit(1)), n - 1)
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(F.xxhash64("text", F.lit(seed)), "text"))).withColumn("_train", train).withColumn("_n", n)
    part = F.when(F.col("_n") < 2, F.raise_error(F.lit("a label needs two rows"))).when(F.col("_k") <= F.col("_train"), F.lit("train")).otherwise(F.lit("validation"))
    return rows.withColumn("part", part).drop("_k", "_train", "_n")


def augmented(df: DataFrame, synonyms: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """Texts with one synonym put in, chosen by hash; texts without a known word stay."""
    text = F.col("text")
    for word, others in synonyms.items():
        pick = F.get(F.array(*map(F.lit, others)), F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(len(others))).cast("int"))
        text = F.when(F.contains(F.col("text"), F.lit(word)) & (text == F.col("text")), F.replace(F.col("text"), F.lit(word), pick)).otherwise(text)
    return df.withColumn("text", text)


def probe(question: Column, pairs: tuple[tuple[str, str], ...] = OPPOSITES) -> Column:
    """The question with the first pair that applies put in at its first place; null if none applies."""
    out = F.when(F.lit(False), question)
    for old, new in pairs:
        at = F.instr(question, old)
        out = out.when(at > 0, F.overlay(question, F.lit(new), at, F.lit(len(old))))
    return out
