"""Vector codes, fill-in-the-middle and URL filters against brute force, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import fill_middle, url_filter, vector_codes
from lexforge.llm.common import Workspace, join_by_share
from lexforge.llm.queries import URL_RULES

VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, code int, n int, error string"


# ------------------------------------------------------------------ vector codes

def brute_codes(rows, rule):
    """(vec_id, code, error, label) of rows in Python's integers, and the entries' digest."""
    kept = [(i, [math.floor(rule.scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % rule.parts == 0]
    first = sorted(r[:2] for r in kept if r[0] is not None) or sorted((r[1],) * 2 for r in kept)[:1]
    size = len(first[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    k = size // rule.parts
    cut = lambda v: [tuple(v[p * k : p * k + k]) for p in range(rule.parts)]
    seeds = [v for _, v in first[: rule.entries] if len(v) == size]
    books = [[cut(v)[p] for v in seeds] for p in range(rule.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, c), j) for j, c in enumerate(books[p]))
    for _ in range(rule.rounds):
        for p in range(rule.parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            for j, g in groups.items():
                books[p][j] = tuple(sum(c) // len(g) for c in zip(*g))
    out = []
    for i, v, lab in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), lab))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def checked(spark, rows, rule=vector_codes.Coding()):
    df = spark.createDataFrame([(i, v, lab, 1, "x", 2, 3, "y") for i, v, lab in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in vector_codes.compress(df, rule=rule).collect()]
    want, digest = brute_codes(rows, rule)
    totals = {}
    for _, _, error, lab in want:
        totals[lab] = totals.get(lab, 0) + error
    assert sorted(got, key=repr) == sorted(((i, c, e, totals[lab], digest) for i, c, e, lab in want), key=repr)
    return got


def test_codes_equal_brute_force(spark):
    random.seed(3)
    vector = lambda n=16: [random.choice([random.gauss(0, 0.3), 0.0, 0.25, -0.25]) for _ in range(n)]
    vector32 = lambda n=16: [float(np.float32(x)) for x in vector(n)]
    rows = [(i * 7 % 211, vector32(), random.choice([0, 0, 0, 1, None])) for i in range(150)]
    rows += [(500, None, 1), (501, vector32()[:15] + [None], 1), (502, vector32()[:15] + [math.nan], 1), (503, vector32()[:15] + [math.inf], 0), (504, [], 1), (505, vector32(24), 1), (506, vector32(15), 1)]
    rows += [rows[3], rows[3], (3, rows[9][1], 1), (None, vector32(), None)]  # repeated rows and ids, a null id
    assert len(checked(spark, rows)) == 154


def test_codes_of_few_rows_and_ties(spark):
    same = [1.0, -1.0] * 8
    got = checked(spark, [(i, same, 0) for i in range(5)])
    assert {r[1] for r in got} == {"00" * 8} and {r[2] for r in got} == {0}  # equal entries: the lowest index
    checked(spark, [(None, same, None)])
    checked(spark, [(i, [float(x)] * 8, i % 2) for i, x in enumerate([0, 2, 1, 1, 3])], vector_codes.Coding(entries=2, rounds=3))
    empty = spark.createDataFrame([], VECTORS)
    out = vector_codes.compress(empty)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(spark.createDataFrame([(1, None, 0, 1, "x", 2, 3, "y")], VECTORS)).count() == 0
    with pytest.raises(Exception, match="leave no room"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0, 1, "x", 2, 3, "y")], VECTORS)).count()


def test_nearest_is_exact_where_float32_is_not():
    rng = np.random.default_rng(5)
    for k, size in ((8, 4096), (8, 1 << 26), (3, 1 << 20), (40, 1 << 24)):
        x = rng.integers(-size, size, (300, k))
        c = np.repeat(x[:4] + rng.integers(-1, 2, (4, k)), 4, 0) + rng.integers(-2, 3, (16, k))  # entries a few units apart
        x[50:] = c[rng.integers(0, 16, 250)] + rng.integers(-3, 4, (250, k))
        best, far, looked = vector_codes.nearest(x, c)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in c] for r in x]
        assert best.tolist() == [row.index(min(row)) for row in exact] and far.tolist() == [min(row) for row in exact]
        assert looked > 0
    apart = rng.integers(-4096, 4096, (16, 8))
    _, _, looked = vector_codes.nearest(rng.integers(-4096, 4096, (5000, 8)), apart)
    assert looked < 50  # the interval is narrow: few rows need more than the product


def test_join_by_share(spark):
    space = Workspace(spark, "t")
    keys = [None] * 400 + ["hot"] * 300 + [f"k{i}" for i in range(200)] + ["alone"]
    rows = spark.createDataFrame([(k, i % 50) for i, k in enumerate(keys)], "key string, x int")
    table = space.stow(rows.where("key is null or key <> 'alone'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")), "table")
    want = {}
    for i, k in enumerate(keys):
        want[k] = want.get(k, 0) + i % 50
    want["alone"] = None
    for share in (3, 1000, 10**6):
        got = join_by_share(rows, table, "key", "n", share).collect()
        assert len(got) == len(keys) and all(r.total == want[r.key] for r in got)


# ------------------------------------------------------------------ fill in the middle

def brute_middle(doc_id, text, rule=fill_middle.Middle()):
    units = re.findall(rule.unit, text)
    h = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rule.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < rule.spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_brute_force(spark):
    random.seed(8)
    pieces = ["a", "word", " ", "\n", "\t\x0b", "\x85", "　", "é😀", "<", "<P", ">", "S>", "M>", "<S"]
    texts = [None, "", " ", " \n", "x", " x", "x ", "<P>", "a<S>b", "a <M", "日本語 テキスト😀 ende", "x" * 70_000, "w " * 30_000, "\n" * 5000]
    texts += ["".join(random.choice(pieces) for _ in range(random.randint(1, 40))) for _ in range(300)]
    rows = [(i, t, "spm", "clash", 1) for i, t in enumerate(texts)] + [(None, "a b c", "", "", 1), (None, None, "", "", 1), (9, "again another row", "", "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, n int")
    for rule in (fill_middle.Middle(), fill_middle.Middle(rate=100, spm=50)):
        out = fill_middle.transform(df, rule=rule)
        got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), rule)).collect()
        assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr((i, *brute_middle(i, t or "", rule))) for i, t, *_ in rows)
        plain = {i: t or "" for i, t, *_ in rows if i not in (None, 9)}
        assert all(r.back == plain[r.doc_id] for r in got if r.doc_id in plain)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(df.limit(0)).count() == 0


def test_two_passes_hold_no_list():
    import tracemalloc

    unit, text = re.compile(fill_middle.UNIT), "ab " * 1_000_000
    tracemalloc.start()
    n = fill_middle.count_units(unit, text)
    at = fill_middle.ends(unit, text, 10, n - 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_001 and at == (29, 2_999_999) and most < 50_000


def test_marks_must_not_overlap():
    fill_middle.Middle(prefix="[pre]", suffix="[suf]", middle="[mid]")
    for bad in (dict(prefix="<S>"), dict(prefix=""), dict(prefix="aba"), dict(prefix="x<", suffix="<y"), dict(prefix="a<S>b")):
        with pytest.raises(ValueError):
            fill_middle.Middle(**bad)


# ------------------------------------------------------------------ URL filters

def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def tail(a, b, x, n=400_000):
    """The part above x by the midpoint rule, in a variable that flattens both ends."""
    t = (np.arange(n) + 0.5) / n * math.pi / 2
    v = np.sin(t) ** 2
    w = (2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t))
    w = np.exp(w - w.max())
    return float(w[v > x].sum() / w.sum())


def test_share_above(spark):
    rows = [(1.0, 1.0), (0.3, 0.9), (2.5, 7.0), (7.0, 2.5), (40.0, 60.0), (60.0, 40.0), (500.0, 480.0), (3.0, 300.0)]
    for x in (0.5, 0.1):
        got = url_filter.share_above(spark.createDataFrame(rows, "a double, b double"), "a", "b", x, "z").collect()
        for r in got:
            assert abs(r.z - tail(r.a, r.b, x)) < 2e-4, r
    big = url_filter.share_above(spark.createDataFrame([(5.001e8, 4.999e8), (4.999e8, 5.001e8), (5e8, 5e8)], "a double, b double"), "a", "b", 0.5, "z").collect()
    assert big[0].z > 0.999 and big[1].z < 0.001 and abs(big[2].z - 0.5) < 1e-3


def posterior(pages, outcomes, rule=url_filter.Reputation()):
    """host -> (n, bad, chance) by the same levels, in Python."""
    hosts = {h: [0, 0] for h in pages}
    for h, n, bad in outcomes:
        have = hosts.setdefault(h or "", [0, 0])
        have[0] += n or 0
        have[1] += bad or 0
    def names(h):
        name = re.sub(r"\.+\Z", "", re.sub(r":[0-9]*\Z", "", re.sub(r"\A.*@", "", h, flags=re.S)))
        if re.match(r"[0-9]+(\.[0-9]+)*\Z|\[", name):
            return name, ""
        labels = name.split(".")
        k = 2 if ".".join(labels[-2:]) in url_filter.SUFFIXES else 1
        return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])

    def level(nodes, centres):
        over = sum((b - n * centres[k]) ** 2 - n * centres[k] * (1 - centres[k]) for k, (n, b) in nodes.items())
        room = sum(n * (n - 1) * centres[k] * (1 - centres[k]) for k, (n, b) in nodes.items())
        alike = max(min(over / room, 1 / (1 + rule.least)), 1 / (1 + rule.most)) if room > 0 else 1 / (1 + rule.most)
        return 1 / alike - 1

    domains, tops = {}, {}
    for h, (n, b) in hosts.items():
        for table, key in ((domains, names(h)), (tops, names(h)[1])):
            have = table.setdefault(key, [0, 0])
            have[0] += n
            have[1] += b
    n, b = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    centre = {k: (b + 0.5) / (n + 1) for k in tops}
    s = level(tops, centre)
    centre = {d: (tops[d[1]][1] + s * centre[d[1]]) / (tops[d[1]][0] + s) for d in domains}
    s = level(domains, centre)
    centre = {h: (domains[names(h)][1] + s * centre[names(h)]) / (domains[names(h)][0] + s) for h in hosts}
    s = level(hosts, centre)
    return {h: (n, b, tail(b + s * centre[h], n - b + s * (1 - centre[h]), rule.limit, 20_000)) for h, (n, b) in hosts.items()}


def test_judged_urls_equal_brute_force(spark):
    random.seed(21)
    sites = [f"{sub}{name}.{suffix}" for sub in ("", "www.", "a.b.") for name in ("good", "bad", "mixed", "rare") for suffix in ("net", "co.uk", "example.org", "com")]
    urls = [f"{random.choice(['http', 'HTTPS'])}://{random.choice(sites)}/{random.choice(['en', 'de', 'fr', 'es', 'EN'])}/{random.randint(1, 2999)}{random.choice(['', '?a=/x', '#t', '/', '.html'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "://", "x:///p", "http://Example.ORG", "http://EXAMPLE.org/en/1", "http://notexample.org/es/", "ftp://user@A.Com:80/fr/x", "http://10.0.0.1/en/5", "http://com/de/", "http://com?x", "a://b.net://c/d", "http://org./x\ny", "http://É.net/ü#"]
    rows = [(i, u, "h", "r", 1) for i, u in enumerate(urls)] + [(None, urls[0], "h", "r", 1), (3, urls[3], "h", "r", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, n int")
    judged = [(h, 1, int(random.random() < (0.95 if "bad" in h else 0.5 if "mixed" in h else 0.05))) for h in (parts(u)[0] for u in urls[:1200]) if "rare" not in h]
    judged += [(None, 2, 1), ("nowhere.net", 3, None), ("bad.net", None, None)]
    outcomes = spark.createDataFrame(judged, "host string, n int, bad int")
    got = url_filter.judge(pages, outcomes, URL_RULES).collect()
    want = posterior({parts(u)[0] for u in urls}, judged)
    assert len(got) == len(rows)
    url = dict(enumerate(urls))
    for r in got:
        host, path = parts(url[r.page_id] if r.page_id is not None else urls[0])
        assert (r.host, r.path) == (host, path)
        fit = [x for x in URL_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name)) if fit else None
        n, bad, above = want[host]
        assert (r.host_judged, r.host_bad) == (n, bad)
        assert abs(above - 0.95) > 1e-3, "the fixture must not lie on the bar"
        assert r.rule == (best.name if best else None) and r.verdict == (best.verdict if best else "block" if above >= 0.95 else "allow"), r
    by_method = {r.verdict for r in got if r.rule is None}
    assert by_method == {"allow", "block"}
    assert any(r.verdict == "block" for r in got if r.rule is None and "bad" in r.host) and all(r.verdict == "allow" for r in got if r.rule is None and "good" in r.host)
    assert url_filter.judge(pages.limit(0), outcomes.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, outcomes.limit(0), []).collect()} == {"allow"}


def test_page_outcomes(spark):
    pages = spark.createDataFrame([("http://a.net/en/7",), ("http://a.net/en/7?x",), ("http://a.net/en/8.html",), ("http://b.net/en/x9",), ("http://b.net/9/10",), (None,), ("http://b.net/12",)], "url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (8, 1, None), (9, 1, 1), (10, 0, 0), (None, 0, 0), (12, None, None)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in url_filter.page_outcomes(pages, labels).collect())
    assert got == [("a.net", 3, 2), ("b.net", 1, 1)]


def test_parts_of_hosts(column):
    hosts = ["a.b.example.co.uk", "example.com", "com", "", "10.0.0.1:80", "u@x.y.net:8080", "[::1]:80", "x.y.", "co.uk"]
    assert column(lambda h: url_filter.suffix_of(h), *hosts) == ["co.uk", "com", "com", "", "", "net", "", "y", "co.uk"]
    assert column(lambda h: url_filter.domain_of(h), *hosts) == ["example.co.uk", "example.com", "com", "", "10.0.0.1", "y.net", "[::1]", "x.y", "co.uk"]
