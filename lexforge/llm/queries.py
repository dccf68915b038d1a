"""Queries of this subpackage's operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factor_quality, fill_middle, kneser_ney, language_spans, mixing, near_text, near_vectors, packing, quality_rules, secret_scan, site_style, url_filter, vector_codes
from .common import bucket_of
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them, and their place in it."""
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_epoch", "mix_block", "mix_order", "mix_tokens")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and spans. Null and empty texts have none; an empty table gives an empty one."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document. Null and empty texts fail the base rules; repeated rows are judged each."""
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("cleaned_text")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in bins. Null and empty texts are one token; copies of an id are numbered."""
    return packing.best_fit(_table(spark, sf_dir, "documents"))


def op5_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fold. Null and empty texts are scored too."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = factor_quality.train(docs, labels.where(bucket_of("doc_id", 5) != 0), "doc_id", "text", "quality")
    out = factor_quality.score(docs, machine)
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold; ``und`` for texts without a letter."""
    docs = _table(spark, sf_dir, "documents")
    languages = language_spans.learn(docs.where(bucket_of("doc_id", 4) != 2))
    out = language_spans.label(docs, languages)
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of the others; null texts are empty ones, an end alone."""
    docs = _table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(bucket_of("doc_id", 10) != 0), order=3)
    out = kneser_ney.score(docs, model)
    return out.select("doc_id", (bucket_of("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; empty for null and empty pages."""
    return site_style.extract(_table(spark, sf_dir, "pages"))


def op9_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies over all documents; texts without a word are in no group."""
    return near_text.classify(_table(spark, sf_dir, "documents"), rule=near_text.Near(percent=85))


def op10_vector_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near vectors over all rows; vectors without a direction or a label are in no group."""
    return near_vectors.classify(_table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, those of their labels, and the codebooks' digest."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every document is cut, and digests of its output and of the text rebuilt from that."""
    out = fill_middle.transform(_table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


#: The rules that op13 is to follow.
URL_RULES = [url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/")]


def op13_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by the rules or by its host's reputation among labelled pages."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.page_outcomes(pages, _table(spark, sf_dir, "labels")), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_temperature_mix, op2_secret_scan, op3_quality_rules, op4_best_fit_packing, op5_factor_quality, op6_language_spans, op7_kneser_ney, op8_site_style, op9_minhash_near, op10_vector_near, op11_vector_codes, op12_fill_middle, op13_url_reputation, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
