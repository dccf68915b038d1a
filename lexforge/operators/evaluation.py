"""Evaluation: joins of answers and scores, aggregates that keep null and zero apart, merges of reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import bucket, composite, mean_valid, valid, valid_or_null
from ..functions.text import ustrip

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


# ------------------------------------------------------------------- joins

def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, order).alias("_r")).select("_r.*")


def with_ground_truth(answers: DataFrame, truth: DataFrame, order: str = "seq") -> DataFrame:
    """Answers with ``ground_truth`` by question; '' if there is none; of several the last."""
    right = last_of_each(truth, "question", order).select("question", F.col("ground_truth").alias("_t"))
    return answers.join(right, "question", "left").withColumn("ground_truth", F.coalesce("_t", F.lit(""))).drop("_t")


def with_contexts(answers: DataFrame, scored: DataFrame) -> DataFrame:
    """Answers with contexts: their own if not empty, else those of the scored rows."""
    right = scored.select("question", F.col("contexts").alias("_c"))
    own = F.when(F.size("contexts") > 0, F.col("contexts"))
    return answers.join(right, "question", "left").withColumn("contexts", F.coalesce(own, "_c", F.array().cast("array<string>"))).drop("_c")


def pair_rows(questions: DataFrame, original: DataFrame, grounded: DataFrame) -> DataFrame:
    """(q, oF, oAR, gF, gAR, dF, dAR): both sides' scores by question; a missing or invalid one is null."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("question").alias("q"), valid_or_null(F.col("faithfulness")).alias(f"{p}F"), valid_or_null(F.col("answer_relevancy")).alias(f"{p}AR"))

    rows = questions.select(F.col("question").alias("q")).join(side(original, "o"), "q", "left").join(side(grounded, "g"), "q", "left")
    return rows.withColumn("dF", F.round(F.col("gF") - F.col("oF"), 4)).withColumn("dAR", F.round(F.col("gAR") - F.col("oAR"), 4))


def pair_summary(rows: DataFrame) -> DataFrame:
    """Means and mean differences over pairs with all four scores, rounded once."""
    full = rows.where("oF is not null and oAR is not null and gF is not null and gAR is not null")
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return full.agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("oF"), "original_F"), mean(F.col("oAR"), "original_AR"), mean(F.col("gF"), "grounded_F"), mean(F.col("gAR"), "grounded_AR"),
        mean(F.col("gF") - F.col("oF"), "delta_F"), mean(F.col("gAR") - F.col("oAR"), "delta_AR"),
    )


def fill_from_retry(base: DataFrame, retry: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Base rows whose invalid cells take the retry's valid ones (rounded); questions that only the retry has are ignored."""
    right = retry.select("question", *[F.col(m).alias(f"_{m}") for m in metrics])
    out = base.join(right, "question", "left")
    for m in metrics:
        b, r = F.col(m), F.col(f"_{m}")
        out = out.withColumn(m, F.when(valid(b), b).when(valid(r), F.round(r, 4))).drop(f"_{m}")
    return out.withColumn("composite", composite(*[F.col(m) for m in metrics]))


def without_done(items: DataFrame, done: DataFrame, key: str = "question") -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def among(items: DataFrame, asked: DataFrame, key: str = "question") -> DataFrame:
    return items.join(asked.select(key), key, "left_semi")


def resumed(cached: DataFrame, fresh: DataFrame, key: str = "question") -> DataFrame:
    """Cached rows, and fresh ones for what is not cached."""
    return cached.unionByName(without_done(fresh, cached, key))


def frozen_contexts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a``, or an error if a question that both have differs in its contexts."""
    other = b.select("question", F.col("contexts").alias("_c"))
    same = F.col("_c").isNull() | F.col("contexts").eqNullSafe(F.col("_c"))
    out = a.join(other, "question", "left")
    checked = F.when(same, F.col("contexts")).otherwise(F.raise_error(F.concat(F.lit("contexts differ: "), F.col("question"))).cast("array<string>"))
    return out.withColumn("contexts", checked).drop("_c")


def template_texts(templates: DataFrame, entities: DataFrame) -> DataFrame:
    """Every template with every entity in place of ``{entity}``; both are small by hand."""
    return templates.crossJoin(entities).select(F.replace(F.col("template"), F.lit("{entity}"), F.col("entity")).alias("text"), *[c for c in templates.columns if c != "template"])


# -------------------------------------------------------------- aggregates

def summary(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: total, per metric mean and number of valid cells, and how many rows are complete."""
    full = F.lit(True)
    for m in metrics:
        full = full & valid(F.col(m))
    return scores.agg(F.count(F.lit(1)).alias("total"), *[mean_valid(F.col(m)).alias(m) for m in metrics], *[F.count_if(valid(F.col(m))).alias(f"n_{m}") for m in metrics], F.count_if(full).alias("complete_count"))


def metrics_for(items: DataFrame) -> DataFrame:
    """One row: all four metrics if every item has a ground truth, else the first two."""
    every = F.coalesce(F.bool_and(F.length(F.coalesce("ground_truth", F.lit(""))) > 0), F.lit(False))
    return items.agg(F.when(every, F.array(*map(F.lit, METRICS))).otherwise(F.array(*map(F.lit, METRICS[:2]))).alias("metrics"))


def complete(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> Column:
    out = F.lit(True)
    for m in metrics:
        out = out & valid(F.col(m))
    return out


def merge_chunks(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> tuple[DataFrame, DataFrame]:
    """Score rows of chunk reports (chunk, position, judge, question, ...) to (kept rows, one row of counts).

    Invalid rows are set aside before duplicates are looked for; of a question's complete rows the first stays.
    """
    marked = rows.withColumn("_ok", complete(rows, metrics))
    n = F.row_number().over(Window.partitionBy("question", "_ok").orderBy("chunk", "position"))
    marked = marked.withColumn("_n", n)
    kept = marked.where("_ok and _n = 1").drop("_ok", "_n")
    counts = marked.agg(F.count_if(F.col("_ok") & (F.col("_n") == 1)).alias("total"), F.count_if(~F.col("_ok")).alias("invalid"), F.count_if(F.col("_ok") & (F.col("_n") > 1)).alias("duplicate"))
    return kept.withColumn("composite", composite(*[F.col(m) for m in metrics])), counts


def by_judge(kept: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return kept.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in metrics], F.round(F.avg("composite"), 4).alias("composite"))


def spread(judges: DataFrame, column: str = "composite") -> DataFrame:
    """Least, greatest, range and sample deviation (0.0 for one) of judges' means."""
    c = F.col(column)
    return judges.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.max(c) - F.min(c), 4).alias("range"), F.round(F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.stddev_samp(c)), 4).alias("stdev"))


def merge_retries(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: per metric mean and count of valid cells, and the mean over all cells of complete rows."""
    pooled = F.lit(0.0)
    for m in metrics:
        pooled = pooled + F.col(m)
    return rows.agg(*[mean_valid(F.col(m)).alias(m) for m in metrics], *[F.count_if(valid(F.col(m))).alias(f"n_{m}") for m in metrics], F.round(F.avg(F.when(complete(rows, metrics), pooled / len(metrics))), 4).alias("composite"))


def judge_counts(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(judge, metric, n): valid cells by judge."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    return rows.select("judge", F.explode(cells).alias("c")).where(valid(F.col("c.v"))).groupBy("judge", "c.metric").agg(F.count(F.lit(1)).alias("n"))


def merge_relay(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: mean of each metric over valid cells; the composite is the mean of the unrounded means, null if one is."""
    means = rows.agg(*[F.avg(valid_or_null(F.col(m))).alias(m) for m in metrics])
    total = sum((F.col(m) for m in metrics), F.lit(0.0))
    return means.select(*[F.round(m, 4).alias(m) for m in metrics], F.round(total / len(metrics), 4).alias("composite"))


def merge_plain(reports: list[DataFrame], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Score rows one after the other, invalid cells null; reports of unlike engines are an error."""
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    engines = F.count_distinct("engine")
    one = out.agg(F.when(engines > 1, F.raise_error(F.lit("reports of several engines"))).otherwise(F.lit(0)).cast("int").alias("_z"))
    for m in metrics:
        out = out.withColumn(m, valid_or_null(F.col(m)))
    return out.join(F.broadcast(one)).where("_z = 0 or _z is null").drop("_z")  # one row


#: A prime below 2^31: products of two numbers below it are exact in 64 bits.
PRIME = 2147483647


def _below_prime(x: np.ndarray) -> np.ndarray:
    """``x`` modulo PRIME in place, for 0 <= x < 2^63: 2^31 is 1 there, so the bits above the 31st are added to those below."""
    for _ in range(2):
        high = x >> 31
        x &= PRIME
        x += high
    x[x >= PRIME] -= PRIME
    return x


def draw(round_: int, k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places in 0..n-1 that draws ``k`` of a round take: two squarings modulo a prime, which any engine computes alike."""
    x = _below_prime(k * 69621 + (round_ * 48271 + seed))
    x = _below_prime(x * x + x * 16807 + k)
    x = _below_prime(x * x + x * 48271 + round_)
    return x - x // n * n


#: Draws of a round that are computed at a time.
DRAWS = 1 << 16


def paired_bootstrap(diffs: DataFrame, column: str = "diff", rounds: int = 5000, seed: int = 42) -> DataFrame:
    """One row: mean difference, and elements 2.5 % from either end of the sorted means of resamples.

    ``diffs`` is one row a pair; null differences are left out, and without any there is no
    row. A draw takes the pair at a place that its round and number give, so rounds are
    dealt to tasks and nothing is shuffled but their means. Every task holds the distinct differences
    with how many pairs have each (differences of four decimals have 20001 at most), and of each
    place in their order the number of its difference, in as few bytes as that takes: two for up to 65536.
    """
    runs = diffs.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").toArrow()
    values, counts = runs.column("d").to_numpy(), runs.column("n").to_numpy()
    n = int(counts.sum())
    mean = float(values @ counts) / n if n else 0.0
    spark = diffs.sparkSession
    sent = spark.sparkContext.broadcast((values, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = sent.value
        at = np.repeat(np.arange(len(values), dtype=np.min_scalar_type(len(values))), counts)
        for batch in batches:
            means = []
            for b in batch.column(0).to_pylist() if n else []:
                total = sum(float(values[at[draw(b, np.arange(k, min(k + DRAWS, n)), n, seed)]].sum()) for k in range(0, n, DRAWS))
                means.append(total / n)
            yield pa.RecordBatch.from_arrays([pa.array(means, pa.float64())], names=["m"])

    means = spark.range(0, rounds, 1, spark.sparkContext.defaultParallelism * 4).mapInArrow(run, "m double")
    low, high = int(rounds * 0.025), int(rounds * 0.975) - 1
    ranked = means.agg(F.array_sort(F.collect_list("m")).alias("all")).where(F.size("all") > 0)  # ``rounds`` numbers
    return ranked.select(F.lit(n).cast("long").alias("n"), F.lit(mean).alias("mean_diff"), F.get("all", F.lit(low)).alias("low"), F.get("all", F.lit(high)).alias("high"))


def run_stats(results: DataFrame) -> DataFrame:
    """One row: totals, empty answers and contexts, degraded results, mean number of contexts."""
    return results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("answer", F.lit("")) == "").alias("empty_answers"), F.count_if(F.coalesce(F.size("contexts"), F.lit(0)) <= 0).alias("empty_contexts"),
        F.count_if(F.coalesce("degraded", F.lit(False))).alias("degraded"), F.round(F.avg(F.greatest(F.coalesce(F.size("contexts"), F.lit(0)), F.lit(0))), 2).alias("mean_contexts"),
    )


def provenance(answers: DataFrame, judge: str) -> DataFrame:
    """One row: generator models, and whether the judge is one: null if that can't be told."""
    names = F.array_sort(F.collect_set("_gen_model"))
    known = F.count_if(F.col("_gen_model").isNull()) == 0
    self_judge = F.when(known & (F.count(F.lit(1)) > 0), F.array_contains(names, judge))
    return answers.agg(names.alias("generator_models"), self_judge.alias("self_judge"))


def independent(generator: Column, judge: Column) -> Column:
    """The judge, or an error where it judges itself."""
    return F.when(generator == judge, F.raise_error(F.lit("a model must not judge its own answers"))).otherwise(judge)


def histogram(scores: DataFrame, metric: str) -> DataFrame:
    return scores.groupBy(bucket(F.col(metric)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def split_means(scores: DataFrame, order: str, first: int = 44, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means over the first rows and over the rest, among rows with one metric above zero."""
    from ..functions.scores import any_positive

    part = F.when(F.col(order) < first, "first").otherwise("rest").alias("part")
    return scores.where(any_positive(*[F.col(m) for m in metrics])).groupBy(part).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def legacy_judge_means(rows: DataFrame, metrics: tuple[str, ...] = METRICS[:2]) -> DataFrame:
    """Per judge means with missing scores as 0, the older rule."""
    return rows.groupBy("judge").agg(*[F.round(F.avg(F.coalesce(F.col(m), F.lit(0.0))), 4).alias(m) for m in metrics])


def probe_counts(probes: DataFrame) -> DataFrame:
    """One row: probes, how many the old and the new rule accept, and how many they share."""
    return probes.agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted_before").alias("before"), F.count_if("accepted_after").alias("after"), F.count_if(F.col("accepted_before") & F.col("accepted_after")).alias("both"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 of label 1."""
    hit, said, true = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)), F.count_if(F.col("prediction") == 1), F.count_if(F.col("label") == 1)
    return predictions.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4).alias("accuracy"),
        F.round(hit / F.nullif(said, F.lit(0)), 4).alias("precision"), F.round(hit / F.nullif(true, F.lit(0)), 4).alias("recall"), F.round(2 * hit / F.nullif(said + true, F.lit(0)), 4).alias("f1"),
    )


def strategy_times(log: DataFrame) -> DataFrame:
    """Per strategy: successes, total and mean time."""
    return log.groupBy("strategy").agg(F.count_if("success").alias("success_count"), F.sum("seconds").alias("total_time"), F.avg("seconds").alias("avg_time"))


def normalized_items(items: DataFrame) -> DataFrame:
    """Items with one name for the truth, contexts as a list, and stripped texts."""
    cols = items.columns
    truth = F.coalesce(*[F.nullif(ustrip(F.col(c)), F.lit("")) for c in ("ground_truth", "reference_answer", "reference") if c in cols], F.lit(""))
    kind = items.schema["contexts"].dataType.simpleString() if "contexts" in cols else None
    listed = F.array().cast("array<string>") if kind is None else F.when(F.col("contexts").isNotNull(), F.array("contexts")).otherwise(F.array().cast("array<string>")) if kind == "string" else F.coalesce("contexts", F.array().cast("array<string>"))
    return items.select(ustrip(F.coalesce("question", F.lit(""))).alias("question"), ustrip(F.coalesce("answer", F.lit(""))).alias("answer"), listed.alias("contexts"), truth.alias("ground_truth"))


def arms_complete(rows: DataFrame, n: int = 20, arms: tuple[str, ...] = ("control", "treatment")) -> DataFrame:
    """One row: whether each (index, arm) of n x arms is there exactly once."""
    spark = rows.sparkSession
    wanted = spark.range(n).select(F.col("id").cast("int").alias("index"), F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    have = rows.select(F.col("index").cast("int"), "arm")
    missing, extra = wanted.exceptAll(have), have.exceptAll(wanted)
    return missing.agg(F.count(F.lit(1)).alias("missing")).join(extra.agg(F.count(F.lit(1)).alias("extra"))).withColumn("complete", (F.col("missing") == 0) & (F.col("extra") == 0))
