"""Near-duplicates against brute force over all pairs."""

import math
import random

import numpy as np
import pytest

from lexforge.llm import graph, near_text, near_vectors
from lexforge.llm.common import Workspace

CLASH = "id long, text string, a long, b long, rep long, n int, token long, component long, kept boolean, label string"


def closed(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_text(rows, percent):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, closed(ids, links)


def test_components(spark):
    random.seed(1)
    ids = list(range(200))
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(random.choice(ids[150:]), random.choice(ids[150:])) for _ in range(20)]
    random.shuffle(links)
    df = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    want = closed(ids, links)
    got = {r.node: r.component for r in graph.components(df, Workspace(spark, "t")).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert graph.components(df.limit(0), Workspace(spark, "t")).count() == 0


def words(n, vocabulary=4000):
    return [f"w{random.randint(0, vocabulary)}" for _ in range(n)]


def family(base, n, edits):
    """Near copies of a text, each with its own edits."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(random.randint(0, edits)):
            k = random.randrange(len(w))
            w[k : k + random.randint(0, 2)] = words(random.randint(0, 2))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [85, 80])
def test_texts(spark, percent):
    random.seed(percent)
    passage = words(60)
    texts = [" ".join(words(random.randint(1, 300))) for _ in range(80)]
    texts += family(words(150), 60, 4) + family(words(400), 30, 8) + family(words(40), 30, 2)
    texts += [" ".join(words(random.randint(0, 80)) + passage + words(random.randint(0, 80))) for _ in range(60)]
    texts += ["one", "ONE", "one two", "a b c d", "a b c d", "a b c d e", "", " \n", None, None] + [texts[3]] * 20 + [texts[3].upper()]
    random.shuffle(texts)
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, texts[0]), (None, None)], "doc_id long, text string")
    sizes, want = brute_text(rows, percent)
    got = near_text.classify(df, rule=near_text.Near(percent=percent, block=16)).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {i: (sizes[i], want[i], want[i] == i) for i, _ in rows}
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    kept = near_text.thin(df, rule=near_text.Near(percent=percent))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if want[i] == i)


def test_text_edges(spark):
    rows = [(1, "same text here now ok", 1, 2, 3, 4, 5, 6, True, "x"), (1, "same text here now ok", 1, 2, 3, 4, 5, 6, True, "x"), (2, "SAME text here now ok", 1, 2, 3, 4, 5, 6, True, "x"), (3, "x" * 50_000, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, CLASH)
    got = sorted((r.id, r.component_id, r.kept) for r in near_text.classify(df, "id").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_text.thin(df, "id").columns == df.columns and near_text.thin(df, "id").count() == 3
    assert near_text.classify(df.limit(0), "id").count() == 0


def test_repeated_rows_make_one_set(spark, monkeypatch):
    """Rows that repeat an id add nothing to the lists: k rows of two near texts post what one row of each does."""
    random.seed(11)
    base = words(200)
    near = [*base[:190], "x", *base[191:]]
    sizes, stow = {}, Workspace.stow

    def counted(self, df, name):
        out = stow(self, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "stow", counted)
    seen = []
    for k in (1, 10, 1000):
        rows = [(1, " ".join(base)), (2, " ".join(near))] * k
        got = near_text.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == 2 * k and {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False)}
        seen.append((sizes["posted"], sizes["classes"], sizes["found"]))
    assert len(set(seen)) == 1


def test_an_id_with_several_texts(spark):
    """Each row goes by its own text; another text under the same id adds no link to it."""
    random.seed(12)
    a, b = words(120), words(120)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (7, " ".join([*a, "end"])), (3, " ".join([*b, "end"])), (9, " ".join(words(80)))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_text.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 117, 3), (5, 116, 3), (5, 116, 3), (5, 116, 5), (7, 117, 5), (9, 76, 9)]


def test_thin_with_any_names(spark):
    rows = [(1, "a b c d e f", "x", "y", 3), (2, "A b c d e f", "x", "y", 3), (3, None, "x", "y", 3), (None, "a b c d e f", "x", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string, gone string, gone_ int")
    out = near_text.thin(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]
    assert near_text.thin(df.limit(0)).count() == 0


def test_bars_are_exact_tails():
    for percent in (80, 85):
        rule = near_text.Near(percent=percent)
        for n, p, bar in ((rule.coordinates, percent / 100, rule.matches), (rule.sketch, percent / 100 + (1 - percent / 100) / 256, rule.sketch_matches)):
            tail = lambda k: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k))  # noqa: B023, E731
            assert tail(bar) <= rule.miss / 2 < tail(bar + 1)


def brute_vectors(rows, cosine=0.98):
    unit = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32).astype(np.float64)
        unit[i] = (x / np.sqrt(x @ x), label)
    ids = sorted(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= cosine]
    degree = dict.fromkeys([r[0] for r in rows], 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, closed([r[0] for r in rows if r[0] is not None], links)


@pytest.mark.parametrize("block", [7, 256])
def test_vectors(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for label in (0, 1):
        for _ in range(6):
            centre = rng.normal(size=24)
            for s in rng.uniform(0, 0.06, 15):
                rows.append((centre + s * rng.normal(size=24)).tolist() + [label])
        rows += [rng.normal(size=24).tolist() + [label] for _ in range(60)]
    rows = [(r[:-1], r[-1]) for r in rows]
    rows += [rows[0]] * 12 + [(rows[0][0], 1), ([2.0 * x for x in rows[1][0]], 0), ([-x for x in rows[1][0]], 0)]
    rows += [(None, 0), ([0.0] * 24, 0), ([float("nan")] * 24, 0), ([float("inf")] + [0.0] * 23, 0), (rows[0][0], None), ([], 0), ([1.0, 2.0], 0), ([1.0, 2.0], 0), ([None] * 24, 0)]
    order = rng.permutation(len(rows))
    table = [(int(k), *rows[i]) for k, i in enumerate(order)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    degree, want = brute_vectors(table)
    got = near_vectors.classify(df, rule=near_vectors.Collisions(block=block)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (degree[i], want[i], want[i] == i) for i in want}


def test_vector_edges(spark):
    schema = "id long, v array<double>, label string, rep long, size int, p float, cells string, key long, fit boolean"
    rows = [(None, [1.0, 0.0], "a", 1, 1, 1.0, "", 1, True), (1, [1.0, 0.0], "a", 1, 1, 1.0, "", 1, True), (1, [1.0, 0.0], "a", 1, 1, 1.0, "", 1, True), (2, [-0.0, 1.0], "a", 1, 1, 1.0, "", 1, True), (3, [0.0, 1.0], "a", 1, 1, 1.0, "", 1, True)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r.id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_vectors.classify(df, "id", "v", "label").collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 1, 2, False)]
    assert near_vectors.classify(df.limit(0), "id", "v", "label").count() == 0


def test_calibration():
    rule = near_vectors.Collisions()
    rng = np.random.default_rng(0)
    hit = np.abs(rng.normal(0, rule.distance, (20_000, rule.projections))) <= rule.window
    assert (hit.sum(1) >= rule.bar).mean() > 0.9999 and rule.bar > rule.projections / 2


@pytest.mark.parametrize("most", [50, 6_000, 5_000_000])
def test_pairs_at_the_threshold_meet_once(most):
    """Recall over 4000 pairs just above the least cosine, among vectors at random; no pair is found twice."""
    rule = near_vectors.Collisions()
    tables = rule.tables(most)
    assert len(tables) * len(tables[0]) <= rule.projections and len({int(d) for t in tables for d in t}) == len(tables) * len(tables[0])
    rng = np.random.default_rng(most)
    a = near_vectors.unit(rng.normal(size=(4000, 64)))
    turn = rng.normal(size=a.shape)
    turn = near_vectors.unit(turn - (turn * a).sum(1, keepdims=True) * a)
    cosine = 0.98 + 1e-9
    v = np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * turn])
    p = v @ near_vectors.directions(rule, 64)
    found = []
    for t, use in enumerate(tables):
        row, cell, visit = near_vectors.posts(p, use, t, rule)
        order = np.argsort(cell, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            x, y = near_vectors.linked(v[row[some]], np.zeros(len(some), int), visit[some], t, tables, rule, False)
            found += [tuple(sorted(q)) for q in zip(row[some][x].tolist(), row[some][y].tolist())]
    assert len(found) == len(set(found))
    assert {(i, i + 4000) for i in range(4000)} == set(found)
