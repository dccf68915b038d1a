"""Rows that SQL compares must be there, and numbering must hold over ranges."""

import time

import numpy as np
from pyspark.sql import functions as F

from lexforge.catalog import flows, oracles, queries
from lexforge.operators import evaluation, sampling


def test_every_sql_has_its_query():
    names = {**queries.queries(), **flows.queries()}
    assert len(names) == len(queries.queries()) + len(flows.queries())
    assert set(oracles.oracle_sql()) | set(flows.oracle_sql()) <= set(names)
    assert not set(oracles.oracle_sql()) & set(flows.oracle_sql())


def test_numbers_over_ranges(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("x"), F.lit("y").alias("_place"))
    rows = sampling.numbered(df, F.col("x"))
    got = {r.x: r.row for r in rows.collect()}
    assert got == {x: i for i, x in enumerate(sorted(got))} and rows.columns == ["x", "_place", "row"]
    assert sampling.numbered(df.limit(0), F.col("x")).count() == 0
    sizes = [r["count"] for r in sampling.chunks_by_count(df, "x", 7).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [715] * 2 + [714] * 5
    few = sampling.chunks_by_count(df.limit(3), "x", 5)
    assert sorted(r.chunk for r in few.collect()) == [0, 1, 2]


def test_bootstrap_equals_brute_force(spark):
    values = [((i * 37) % 101 - 50) / 100 for i in range(60)]
    row = evaluation.paired_bootstrap(spark.createDataFrame([(v,) for v in values] + [(None,)], "diff double"), rounds=400).first()
    d, n, means = sorted(values), len(values), []
    for b in range(400):
        total = 0.0
        for k in range(n):
            x = (b * 48271 + k * 69621 + 42) % 2147483647
            x = (x * x + x * 16807 + k) % 2147483647
            total += d[(x * x + x * 48271 + b) % 2147483647 % n]
        means.append(total / n)
    means.sort()
    assert row.n == n and abs(row.mean_diff - sum(values) / n) < 1e-12 and abs(row.low - means[10]) < 1e-12 and abs(row.high - means[389]) < 1e-12
    assert len({round(m, 6) for m in means}) > 100
    assert evaluation.paired_bootstrap(spark.createDataFrame([], "diff double")).count() == 0


def test_bootstrap_draws_many_pairs_of_few_values(spark):
    """A round over many pairs is some vectors' work, and tasks hold the distinct values alone: a million pairs within half a minute."""
    n = 1_000_000
    diffs = spark.range(n).select(F.when(F.col("id") % 4 == 0, None).otherwise((F.col("id") % 7 - 3) / 100).alias("diff"))
    began = time.monotonic()
    row = evaluation.paired_bootstrap(diffs, rounds=200).first()
    assert time.monotonic() - began < 30
    d = np.sort(np.array([(i % 7 - 3) / 100 for i in range(n) if i % 4]))
    k = np.arange(len(d))
    means = []
    for b in range(200):
        x = (b * 48271 + k * 69621 + 42) % 2147483647
        x = (x * x + x * 16807 + k) % 2147483647
        means.append(d[(x * x + x * 48271 + b) % 2147483647 % len(d)].sum() / len(d))
    means.sort()
    assert row.n == len(d) and abs(row.mean_diff - d.sum() / len(d)) < 1e-12 and abs(row.low - means[5]) < 1e-12 and abs(row.high - means[194]) < 1e-12


def test_intent_samples_of_odd_texts(spark, tmp_path):
    """Copies that differ in outer white space are one sample with one label; blank and null texts are counted as SQL does."""
    import duckdb

    texts = ["one two", "one two ", "\n one two", "even", " even", "odd", " odd\n\n", "", "  ", "\n", None, None]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = set(db.sql(oracles.oracle_sql()["intent_distinct_samples"]).fetchall())
    got = {tuple(r) for r in queries.queries()["intent_distinct_samples"](spark, str(tmp_path)).collect()}
    assert got == want == {(0, 2), (1, 2), (None, 1)}


def test_articles_with_cut_references(spark, tmp_path):
    """Headings and titles are cut at a length, and so within references: all three extractions equal their SQL at each place."""
    import duckdb

    whole = "q &quot;a&quot; &lt;b&gt; &amp; &#x27;c&#39; &amp;quot; d"
    pages = [f"<html><head><title>{whole[:n]}</title></head><body><nav>m</nav><article><h1>{whole[:n]}</h1><p><b>Th {whole[:n]}</b><br>{whole} e</p></article></body></html>" for n in range(1, len(whole) + 1)]
    spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names, sql = {**queries.queries(), **flows.queries()}, {**oracles.oracle_sql(), **flows.oracle_sql()}
    for name in ("html_article_text", "html_article_markdown", "page_chapters"):
        want = dict(db.sql(sql[name]).fetchall())
        got = {r[0]: r[1] for r in names[name](spark, str(tmp_path)).collect()}
        assert got == want, name
