import pytest
from pyspark.sql import functions as F

from lexforge.operators import evaluation as ev, sampling

M = "question string, faithfulness double, answer_relevancy double, context_precision double, context_recall double"


def test_pairs(spark):
    rows = [("a", 0.0, 0.0, 0.0, 0.0), ("b", 0.123456, 0.5, 0.876543, 0.75), ("c", 1.0, 1.0, None, 1.0)]
    q = spark.createDataFrame([(r[0],) for r in rows], "question string")
    side = lambda i: spark.createDataFrame([(r[0], r[i], r[i + 1]) for r in rows], "question string, faithfulness double, answer_relevancy double")
    pairs = ev.pair_rows(q, side(1), side(3))
    out = ev.pair_summary(pairs).first()
    assert (out.n, out.original_F, out.delta_F) == (2, 0.0617, 0.3765)
    assert {r.q: r.dF for r in pairs.collect()}["c"] is None


def test_merge_counts(spark):
    zero, good, half = ("z", 0.0, 0.0, 0.0, 0.0), ("g", 1.0, 1.0, 1.0, 1.0), ("m", 1.0, None, 1.0, 1.0)
    rows = [(*r, i, "j") for i, r in enumerate([zero, good, zero, half])]
    df = spark.createDataFrame(rows, M + ", position int, judge string").withColumn("chunk", F.lit(0))
    kept, counts = ev.merge_chunks(df)
    c = counts.first()
    assert (c.total, c.invalid, c.duplicate) == (2, 1, 1)
    j = ev.by_judge(kept).first()
    assert j.composite == 0.5 and ev.spread(ev.by_judge(kept)).first().stdev == 0.0


def test_retry_and_summary(spark):
    base = spark.createDataFrame([("a", None, 0.5, None, 1.0), ("b", 1.0, 1.0, 1.0, 1.0)], M)
    retry = spark.createDataFrame([("a", 0.0, 0.9, 7.0, 1.0), ("zz", 1.0, 1.0, 1.0, 1.0)], M)
    got = {r.question: r for r in ev.fill_from_retry(base, retry).collect()}
    assert set(got) == {"a", "b"} and got["a"].faithfulness == 0.0 and got["a"].answer_relevancy == 0.5 and got["a"].composite is None and got["b"].composite == 1.0
    s = ev.summary(base).first()
    assert (s.total, s.n_faithfulness, s.complete_count, s.faithfulness) == (2, 1, 1, 1.0)
    assert ev.summary(base.where("question = 'zz'")).first().faithfulness is None
    assert ev.merge_relay(base).first().composite == 0.9375
    assert ev.merge_relay(base.where("question = 'a'")).first().composite is None


def test_frozen_contexts(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", [])], "question string, contexts array<string>")
    assert ev.frozen_contexts(df, df.where("question = 'a'")).count() == 2
    with pytest.raises(Exception, match="contexts differ"):
        ev.frozen_contexts(df, spark.createDataFrame([("a", ["y"])], df.schema)).collect()


def test_provenance(spark):
    tri = lambda *names: ev.provenance(spark.createDataFrame([(n,) for n in names], "_gen_model string"), "judge").first().self_judge
    assert [tri(None), tri("other", None), tri("judge", None), tri("judge"), tri("other")] == [None, None, None, True, False]
    with pytest.raises(Exception, match="own answers"):
        spark.range(1).select(ev.independent(F.lit("a"), F.lit("a"))).collect()


def test_joins_and_items(spark):
    a = spark.createDataFrame([("q", "x", ["c"]), ("r", "y", [])], "question string, answer string, contexts array<string>")
    t = spark.createDataFrame([("q", "old", 1), ("q", "new", 2)], "question string, ground_truth string, seq int")
    assert {r.question: r.ground_truth for r in ev.with_ground_truth(a, t).collect()} == {"q": "new", "r": ""}
    s = spark.createDataFrame([("r", ["d"]), ("q", ["e"])], "question string, contexts array<string>")
    assert {r.question: r.contexts for r in ev.with_contexts(a, s).collect()} == {"q": ["c"], "r": ["d"]}
    raw = spark.createDataFrame([(" q ", None, "one", " t ")], "question string, answer string, contexts string, reference_answer string")
    r = ev.normalized_items(raw).first()
    assert (r.question, r.answer, r.contexts, r.ground_truth) == ("q", "", ["one"], "t")
    assert len(ev.metrics_for(spark.createDataFrame([("t",), ("",)], "ground_truth string")).first().metrics) == 2
    assert ev.arms_complete(spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "a")], "index int, arm string"), 2, ("a", "b")).first().complete is False


def test_bootstrap(spark):
    d = spark.createDataFrame([(0.1 * i,) for i in range(20)], "diff double")
    r = ev.paired_bootstrap(d, rounds=400).first()
    assert r.n == 20 and r.low < r.mean_diff < r.high and abs(r.mean_diff - 0.95) < 1e-9
    assert tuple(r) == tuple(ev.paired_bootstrap(d, rounds=400).first())


def test_strata_and_slices(spark):
    for n in (1, 3, 7, 20, 41):
        df = spark.createDataFrame([(i, float(i % 5)) for i in range(n)], "i int, s double")
        order = sorted(range(n), key=lambda i: (i % 5, i))
        want = {i: b for b in range(4) for i in order[b * n // 4 : (b + 1) * n // 4]}
        assert {r.i: r.stratum for r in sampling.quartiles(df, "s", "i").collect()} == want
    df = spark.createDataFrame([(i,) for i in range(7)], "i int")
    assert [r.slice for r in sampling.round_robin(df, "i", 3).orderBy("i").collect()] == [0, 1, 2, 0, 1, 2, 0]
    assert [r.chunk for r in sampling.chunks_by_count(df, "i", 3).orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2]
    assert [r.i for r in sampling.at_indices(df, "i", [2, 7]).orderBy("i").collect()] == [1, 6]
    with pytest.raises(Exception, match="out of range"):
        sampling.at_indices(df, "i", [8]).collect()


def test_intent_data(spark):
    rows = [(f"a{i}", 0) for i in range(20)] + [(f"b{i}", 1) for i in range(20)] + [("a0", 0)] * 19 + [(" a0 ", 0)]
    df = spark.createDataFrame(rows, "text string, label int")
    out = sampling.intent_samples(df)
    assert out.count() == 40
    parts = {(r.label, r.part): r["count"] for r in sampling.stratified_split(out).groupBy("label", "part").count().collect()}
    assert parts == {(0, "train"): 18, (0, "validation"): 2, (1, "train"): 18, (1, "validation"): 2}
    for bad, why in ((("a0", 1), "two labels"), (("  ", 0), "blank"), (("x", 2), "not 0 or 1")):
        with pytest.raises(Exception, match=why):
            sampling.intent_samples(df.unionByName(spark.createDataFrame([bad], df.schema))).collect()
    with pytest.raises(Exception, match="two rows"):
        sampling.stratified_split(spark.createDataFrame([("x", 0)], df.schema)).collect()


def test_probes(column):
    assert column(sampling.probe, "血压升高怎么办", "成人成人", "无关") == ["血压降低怎么办", "儿童成人", None]
