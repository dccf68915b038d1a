import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.config import Settings
from lexforge.operators import chunking, cleaning, lexical, merging, vectors


def test_windows_cover_and_repair(spark):
    rule = Settings(parent_size=20, child_size=8, overlap=2)
    text = "ab。" + "".join(chr(0x4E00 + i) for i in range(80))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, content string")
    rows = chunking.split_documents(df, "doc_id", "content", rule).collect()
    assert len({r.id for r in rows}) == len(rows)
    down = [r for r in rows if r.chunk_type == "child"]
    assert all(len(r.content) <= 8 and r.parent_content for r in down)
    assert set("".join(r.content for r in down)) == set(text)
    ups = sorted((r for r in rows if r.chunk_type == "parent"), key=lambda r: r.chunk_index)
    assert [r.content for r in ups] == [text[i : i + 20] for i in range(0, len(text), 18)]
    with pytest.raises(ValueError):
        chunking.check_sizes(20, 8, 8)
    stored = spark.createDataFrame([("a", None, "child", {"chunk_type": "child"}), ("b", "a", "parent", None)], "id string, parent_id string, chunk_type string, metadata map<string,string>")
    got = {r.id: r for r in chunking.repaired(stored).collect()}
    assert got["a"].chunk_type == got["a"].metadata["chunk_type"] == "parent" and got["b"].chunk_type == "child"


def test_recursive_pieces():
    text = "第一段。第二句！\n\n" + "x" * 50 + "\n尾。"
    pieces = chunking.recursive_split(text, 20, 5)
    assert all(0 < len(p) <= 20 for p in pieces)
    assert set("".join(pieces)) == set(text)
    assert chunking.recursive_split("", 20, 5) == [] and chunking.recursive_split("ab", 20, 5) == ["ab"]


def test_first_of_each_and_audit(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "id string, seq int, v string")
    assert sorted((r.id, r.v) for r in chunking.first_of_each(df).collect()) == [("a", "x"), ("b", "z")]
    chunks = spark.createDataFrame([("p", "parent", "", ""), ("c", "child", "p", "t"), ("d", "child", "q", "t")], "id string, chunk_type string, parent_id string, parent_content string")
    out = chunking.structure_audit(chunks).first()
    assert (out.total, out.parents, out.children, out.dangling, out.sound) == (3, 1, 2, 1, True)


def bm25(docs, query, k1=1.2, b=0.75):
    toks = {d: t.lower().split() for d, t in docs.items()}
    mean = sum(map(len, toks.values())) / len(toks)
    out = {}
    for d, words in toks.items():
        tf, s = Counter(words), 0.0
        for w in query.lower().split():
            n = sum(w in x for x in toks.values())
            if tf[w]:
                s += math.log(1 + (len(toks) - n + 0.5) / (n + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(words) / mean))
        if s:
            out[d] = s
    return out


def test_bm25(spark):
    docs = {1: "apple pie apple", 2: "Banana split", 3: "apple banana", 4: ""}
    d = spark.createDataFrame(list(docs.items()), "id int, text string")
    q = spark.createDataFrame([(1, "apple apple"), (2, "cherry"), (3, "!!!"), (4, "banana pie")], "query int, question string")
    got = {(r.query, r.doc): r.score for r in lexical.scores(d, q, "id", "text", "query", "question").collect()}
    want = {(k, doc): s for k, t in ((1, "apple apple"), (2, "cherry"), (4, "banana pie")) for doc, s in bm25(docs, t).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_softmax_pads_and_gate(spark):
    scored = spark.createDataFrame([(1, 7, 2.0), (2, 8, 0.0)], "query int, doc int, score double")
    size = spark.createDataFrame([(3,)], "n_docs long")
    rows = lexical.softmax_top(scored, size).collect()
    assert len(rows) == 1 and abs(rows[0].probability - 1 / (1 + 2 * math.exp(-2))) < 1e-12
    faq = spark.createDataFrame([(7, "how much", "how much", "5 mg"), (8, "when", "when", " ")], "id int, question string, indexed string, answer string")
    asked = spark.createDataFrame([(1, " how much\n"), (2, "when"), (3, "how many")], "query int, question string")
    ranked = spark.createDataFrame([(1, 7, 1, 1.0), (2, 8, 1, 1.0), (3, 7, 1, 1.0)], "query int, doc int, rank int, probability double")
    got = lexical.faq_answers(asked, faq, ranked).collect()
    assert [(r.query, r.faq_id, r.confidence, r.strategy) for r in got] == [(1, 7, 0.95, "faq_fast_channel")]
    moved = faq.withColumn("question", F.lit("other"))
    assert lexical.faq_answers(asked, moved, ranked).count() == 0


def test_opposite_questions_are_not_answered(spark):
    pairs = [("血压 升高", "血压 降低"), ("成人 剂量", "儿童 剂量"), ("用 1.5mg", "用 15mg"), ("x -5", "x 5"), ("5 mL", "5 ML"), ("头痛 怎么办", "头痛 怎么办 呢")]
    for stored, asked in pairs:
        faq = spark.createDataFrame([(0, stored, stored, "a")], "id int, question string, indexed string, answer string")
        q = spark.createDataFrame([(1, asked), (2, stored)], "query int, question string")
        ranked = lexical.softmax_top(lexical.scores(faq, q, "id", "indexed", "query", "question"))
        assert [r.query for r in lexical.faq_answers(q, faq, ranked).collect()] == [2]


def test_dense_and_fusion(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(30)] + [(99, None, 0)], "id int, v array<float>, kind int")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query int, v array<float>")
    got = [(r.query, r.doc) for r in vectors.dense_top(docs, asked, "id", "v", "query", "v", k=2).orderBy("query", "rank").collect()]
    assert got == [(1, 29), (1, 28), (2, 0), (2, 1)]
    got = [(r.query, r.doc) for r in vectors.dense_top(docs, asked, "id", "v", "query", "v", 2, F.col("kind") == 0).orderBy("query", "rank").collect()]
    assert got == [(1, 28), (1, 26), (2, 0), (2, 2)]
    assert vectors.dense_top(docs, asked.where("query > 9"), "id", "v", "query", "v").count() == 0
    dense = spark.createDataFrame([(1, 5, 1.0), (1, 6, 0.0)], "query int, doc int, score double")
    sparse = spark.createDataFrame([(1, 6, 3.0)], "query int, doc int, score double")
    out = {r.doc: r.score for r in vectors.fuse(dense, sparse).collect()}
    half = lambda x: 0.5 + math.atan(x) / math.pi
    assert abs(out[5] - half(1)) < 1e-12 and abs(out[6] - (half(0) + 0.7 * half(3))) < 1e-12


def test_sparse(spark):
    d = spark.createDataFrame([(1, {1: 0.5, 2: -1.0}), (2, {2: 1.0})], "id int, w map<int,double>")
    q = spark.createDataFrame([(9, {1: 2.0, 2: 3.0})], "id int, w map<int,double>")
    got = {r.doc: r.score for r in vectors.sparse_scores(vectors.exploded_weights(d, "id", "w"), vectors.exploded_weights(q, "id", "w", "query")).collect()}
    assert got == {1: 1.0, 2: 3.0}


def test_anchors(spark):
    q = spark.createDataFrame([(1, "1型糖尿病如何处理？")], "query int, question string")
    t = spark.createDataFrame([(x,) for x in ("1型糖尿病", "2型糖尿病", "糖尿病", "病")], "title string")
    assert [r.title for r in vectors.title_anchors(q, t).orderBy("rank").collect()] == ["1型糖尿病", "糖尿病"]
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.8)], "query int, id string, rank int, score double")
    front = spark.createDataFrame([(1, "b", 1, 0.8)], "query int, id string, rank int, score double")
    got = [(r.id, r.topic_anchor) for r in vectors.anchored(hits, front).orderBy("rank").collect()]
    assert got == [("b", True), ("a", False)]


HIT = "query int, id string, content string, score double, source string, parent_id string, parent_content string, rank int"


def hit(spark, *rows, schema=HIT):
    return spark.createDataFrame(list(rows), schema)


def test_parents(spark):
    rows = hit(spark, (1, "c1", "weak", 0.2, "s", "p", "parent text", 1), (1, "c2", "strong", 0.8, "s", "p", "parent text", 2), (1, "c3", "tie", 0.8, "s", "p", "parent text", 3))
    got = merging.to_parents(rows).collect()
    assert len(got) == 1 and got[0].rerank_content == "strong" and got[0].content == "parent text" and got[0].children_ids == ["c1", "c2", "c3"] and got[0].score == 0.8
    anchored = hit(spark, (1, "c1", "a", 0.1, "s", "p", "t", 1, True), (1, "c2", "b", 0.9, "s", "p", "t", 2, False), (1, "c3", "c", 0.95, "s", "q", "u", 3, False), schema=HIT + ", topic_anchor boolean")
    got = merging.to_parents(anchored).orderBy("rank").collect()
    assert [(r.id, r.topic_anchor) for r in got] == [("p", True), ("q", False)] and got[0].rerank_content == "b" and got[0].children_ids == ["c1", "c2"]


def test_levels(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 6)], "query int")
    child = hit(spark, (1, "a", "x", 0.5, "s", "p", "t", 1), (1, "b", "x", 0.4, "s", "", "", 2), (1, "c", "x", 0.4, "s", None, None, 3), (4, "d", "x", 0.5, "s", "p", "t", 1))
    wide = hit(spark, (2, "h", "y" * 900, 0.6, "s", "", "", 1), (2, "i", "z" * 9000, 0.5, "s", "", "", 2))
    errors = spark.createDataFrame([(4,)], "query int")
    status, parents = merging.tiered(q, child, wide, errors)
    got = {r["query"]: (r.degrade_level, r.degrade_reason, r.orphan_count) for r in status.collect()}
    assert got == {1: (0, "", 2), 2: (1, "child_recall_empty", 0), 3: (2, "no_recall", 0), 4: (2, "retrieval_error", 0), 5: (2, "no_recall", 0)}
    rows = parents.collect()
    assert {r["query"] for r in rows} == {1, 2} and sum(len(r.children_ids) for r in rows if r["query"] == 2) == 16
    status, _ = merging.tiered(q, child, wide, None, Settings(child_fallback=False))
    assert {r["query"]: r.degrade_reason for r in status.collect()}[2] == "child_recall_empty"


def test_branches_do_not_depend_on_order(spark):
    schema = "group int, branch int, id string, content string, rerank_content string, source string, score double, topic_anchor boolean, children_ids array<string>, rank int"
    for flip in (0, 1):
        rows = [(1, flip, "p", "t", "weak", "s", 0.2, False, ["c1"], 1), (1, 1 - flip, "p", "t", "strong", "s", 0.8, True, ["c2", "c1"], 1)]
        got = merging.merge_branches(spark.createDataFrame(rows, schema)).collect()
        assert len(got) == 1 and got[0].rerank_content == "strong" and got[0].score == 0.8 and got[0].topic_anchor and set(got[0].children_ids) == {"c1", "c2"}
    levels = spark.createDataFrame([(1, 0, 0, "", 1, 0, False), (1, 1, 2, "retrieval_error", 0, 1, True), (2, 0, 1, "r", 2, 0, False), (2, 1, 2, "x", 0, 0, False)], "group int, branch int, level int, reason string, n_docs int, orphans int, failed boolean")
    got = {r["group"]: (r.degrade_level, r.degrade_reason) for r in merging.merge_levels(levels).collect()}
    assert got == {1: (2, "retrieval_error"), 2: (1, "r")}


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "named", True, 1, 1.0), (1, "other", False, 2, 5.0), (1, "third", False, 3, 3.0)], "query int, id string, topic_anchor boolean, rank int, s double")
    assert [r.id for r in merging.rerank(rows, F.col("s")).orderBy("rank").collect()] == ["named", "other"]
    assert [r.id for r in merging.rerank(rows, F.col("s"), anchors=False).orderBy("rank").collect()] == ["other", "third"]
    with pytest.raises(Exception, match="finite"):
        merging.rerank(rows, F.lit(float("nan"))).collect()
    assert [r.id for r in merging.rerank(rows, F.lit(None).cast("double"), strict=False).orderBy("rank").collect()] == ["named", "other"]


def test_contexts_and_metrics(spark):
    rows = spark.createDataFrame([(1, 1, "t", "a"), (1, 2, "unknown", "b"), (1, 3, "x", "c")], "query int, rank int, source string, content string")
    assert merging.contexts(rows).first().context == "【知识来源1】\n【文档标题：t】\na\n\n【知识来源2】\nb"
    log = spark.createDataFrame([(0,), (1,), (2,)], "degrade_level int")
    got = merging.degrade_metrics(log).first()
    assert (got.total, got.l1_rate, got.l2_rate) == (3, 0.3333, 0.3333)
    assert merging.degrade_metrics(log.where("degrade_level > 9")).first().l1_rate == 0.0


def test_best_of_tiles_equal_brute_force(spark):
    """Scores are held by the tile; ties across tiles go to the smallest doc, and a score that is no number is the greatest."""
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 6, (5, 4000)).astype(float)
    doc = rng.permutation(4000)
    held = None
    for at in range(0, 4000, 700):
        held = vectors._best(scores[:, at : at + 700], doc[at : at + 700], 16, held)
        assert len(held[0]) == 5 * 16
    row, docs, score = held
    for i in range(5):
        want = np.lexsort((doc, -scores[i]))[:16]
        assert docs[row == i].tolist() == doc[want].tolist() and score[row == i].tolist() == scores[i][want].tolist()
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [float("nan"), 0.0]), (3, [1.0, 0.0])], "d int, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "q int, v array<double>")
    assert [r.doc for r in vectors.dense_top(rows, asked, "d", "v", "q", "v", k=2).orderBy("rank").collect()] == [2, 1]


def test_documents_are_cut_once_in_small_batches(spark):
    df = spark.createDataFrame([(1, "ab cd " * 900, "s"), (2, "", "s"), (3, None, "t")], "doc_id int, content string, source string")
    rows = chunking.split_documents(df, "doc_id", "content", recursive=True)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Union" not in plan
    up = chunking.parents(df, "doc_id", "content", recursive=True)
    both = up.withColumn("parent_id", F.lit("")).withColumn("parent_content", F.lit("")).unionByName(chunking.children(up, recursive=True))
    assert rows.columns == both.columns and rows.exceptAll(both).count() == 0 == both.exceptAll(rows).count()


def test_letters_of_a_page_are_told_once(spark):
    """Each of many headings is looked for in letters that were told once: time does not grow with headings x text."""
    text = "\n".join(f"line {i} of some words and 1{i}" for i in range(6000))
    df = spark.createDataFrame([(text, "x\n" + text.replace("line 7 of", "line of"))], "t string, m string")
    began = time.monotonic()
    row = df.select(cleaning.missing_parts(F.col("t"), F.split("t", "\n"), F.col("m")).alias("p")).first()
    assert row.p == ["line 7 of some words and 17"] and time.monotonic() - began < 30
