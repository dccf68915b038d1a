import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import ivf, vectors

SHAPE = "id int, v array<double>, kind int"


@pytest.fixture(scope="module")
def cloud():
    """Vectors around 40 centres of unequal weight, a third of all in one."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    of = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(0, 40, 3000))
    v = centres[of] + rng.normal(scale=0.3, size=(3000, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, x.tolist(), i % 3) for i, x in enumerate(v)]


@pytest.fixture(scope="module")
def stored(spark, cloud):
    docs = spark.createDataFrame(cloud, SHAPE)
    return docs, ivf.build(docs, "id", "v", rule=ivf.Lists(count=40, rounds=6))


def answers(df):
    out = {}
    for r in df.withColumn("score", F.round("score", 9)).orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r.doc, r.score))
    return out


def exact(docs, asked, k, where=lambda r: True):
    """Brute force: all inner products, the largest first, ties to the smallest doc."""
    rows = [r for r in docs if where(r)]
    m = np.array([r[1] for r in rows])
    out = {}
    for q, v in asked:
        s = np.round(m @ np.array(v), 9)
        out[q] = sorted(((r[0], x) for r, x in zip(rows, s.tolist())), key=lambda t: (-t[1], t[0]))[:k]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [d for d, _ in got[q]] == [d for d, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-8)


def test_all_lists_are_exact(spark, cloud, stored):
    docs, index = stored
    asked = [(r[0], r[1]) for r in cloud[::50]]
    queries = spark.createDataFrame(asked, "query int, v array<double>")
    same(answers(ivf.search(index, queries, "query", "v", 16, probes=40)), exact(cloud, asked, 16))
    same(answers(ivf.search(index, queries, "query", "v", 5, 40, F.col("kind") == 1)), exact(cloud, asked, 5, lambda r: r[2] == 1))
    same(answers(ivf.search(index, queries, "query", "v", 16, probes=40)), answers(vectors.dense_top(docs, queries, "id", "v", "query", "v", 16)))


def test_recall_of_few_lists(spark, cloud, stored):
    _, index = stored
    asked = [(r[0], r[1]) for r in cloud[::20]]
    probes = ivf.probes_for(index, spark)
    assert 1 <= probes < 40
    got = answers(ivf.search(index, spark.createDataFrame(asked, "query int, v array<double>"), "query", "v", 16, probes))
    want = exact(cloud, asked, 16)
    found = sum(len({d for d, _ in got[q]} & {d for d, _ in want[q]}) for q in want)
    assert found / (16 * len(want)) >= 0.9


def test_an_index_is_a_table(spark, stored):
    docs, index = stored
    again = ivf.load(spark, index.path, "id", "v")
    assert np.array_equal(again.centroids, index.centroids)
    rows = again.rows(spark)
    assert sorted(r.id for r in rows.select("id").collect()) == sorted(r.id for r in docs.select("id").collect())
    centroids = index.centroids
    for r in rows.limit(200).collect():
        assert r["_list"] == int(np.argmin(((centroids - np.array(r.v)) ** 2).sum(1)))
    plan = rows.where(F.col("_list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_list" in plan  # lists that no query names are not read
    assert len(index.centroids) == 40


def test_lists_do_not_hang_on_partitions(spark, cloud):
    rows = spark.createDataFrame(cloud[:400], SHAPE)
    one, two = (ivf.build(rows.repartition(n), "id", "v", rule=ivf.Lists(count=8, rounds=3)).centroids for n in (1, 7))
    assert np.allclose(one, two, atol=1e-9)


def test_edges(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, None, 0), (4, [None, 1.0], 0), (5, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (6, [0.0, 1.0], None), (7, [], 0), (8, [float("nan"), 1.0], 0)]
    docs = spark.createDataFrame(rows, SHAPE)
    index = ivf.build(docs, "id", "v", rule=ivf.Lists(count=8))
    assert len(index.centroids) == 2
    queries = spark.createDataFrame([(1, [2.0, 1.0]), (2, None), (None, [1.0, 1.0])], "query int, v array<double>")
    got = ivf.search(index, queries, "query", "v", 3).orderBy("rank").collect()
    assert [(r["query"], r.doc, r.score) for r in got] == [(1, 1, 2.0), (1, 1, 2.0), (1, 2, 2.0)]
    assert ivf.search(index, queries.where("query = 2"), "query", "v").count() == 0
    empty = ivf.build(docs.where("id > 99"), "id", "v")
    assert ivf.search(empty, queries, "query", "v").count() == 0 and ivf.probes_for(empty, spark) == 1
    assert ivf.search(ivf.load(spark, empty.path, "id", "v"), queries, "query", "v").count() == 0
    with pytest.raises(ValueError, match="_list"):
        ivf.build(docs.withColumn("_list", F.lit(1)), "id", "v")
    with pytest.raises(Exception, match="unlike lengths|components"):
        ivf.build(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SHAPE), "id", "v")


def test_many_ties_keep_the_smallest(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(500)] + [(1000, [0.0, 1.0], 0)], SHAPE)
    index = ivf.build(docs.repartition(3), "id", "v", rule=ivf.Lists(count=4))
    got = ivf.search(index, spark.createDataFrame([(1, [1.0, 0.0])], "query int, v array<double>"), "query", "v", 4).orderBy("rank").collect()
    assert [r.doc for r in got] == [0, 1, 2, 3]
