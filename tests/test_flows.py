import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexforge.operators import cache, sessions
from lexforge.plans import ingest, retrieve, route
from lexforge.sources import corpus, files, reports, stores
from lexforge.streaming import history

def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")



def test_cache_table(spark):
    t = spark.createDataFrame([("a", "1", None), ("b", "2", datetime(2023, 1, 1)), ("c", "3", datetime(2025, 1, 1))], cache.SCHEMA)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    assert {r.key: r.value for r in cache.get(t, keys, now()).collect()} == {"a": "1", "b": None, "c": "3", "d": None}
    new = spark.createDataFrame([("a", "9")], "key string, value string")
    t2 = cache.put(t, new, now())
    row = t2.where("key = 'a'").first()
    assert row.value == "9" and str(row.expires_at) == "2024-01-01 01:00:00"
    assert cache.put(t, new, now(), 0).where("key = 'a'").first().expires_at is None
    assert cache.delete_prefix(t, "a").count() == 2 and cache.delete(t, keys.limit(2)).count() == 1
    up = cache.increment(t, spark.createDataFrame([("a", 2), ("z", 1), ("a", 1)], "key string, amount long"), now())
    assert {r.key: r.value for r in up.collect()} == {"a": "4", "b": "2", "c": "3", "z": "1"}
    h = cache.hash_set(t.where("key = 'x'"), spark.createDataFrame([("h", "f", "1"), ("h", "g", "2")], "key string, field string, value string"))
    h = cache.hash_set(h, spark.createDataFrame([("h", "f", "3")], "key string, field string, value string"))
    assert h.select(F.from_json("value", "map<string,string>").alias("m")).first().m == {"f": "3", "g": "2"}
    pushed = cache.list_push(cache.list_push(t.where("key = 'x'"), spark.createDataFrame([("l", 1, "a")], "key string, seq int, item string")), spark.createDataFrame([("l", 2, "c"), ("l", 1, "b")], "key string, seq int, item string"))
    assert pushed.first().value == '["a","b","c"]'


def test_cache_repeated_keys(spark):
    """The last write of a key or a field wins, by seq, then by value; rows without a key are ignored."""
    empty = spark.createDataFrame([], cache.SCHEMA)
    rows = spark.createDataFrame([("a", "9", 1), ("a", "1", 2), ("a", "0", 2), ("b", None, 1), (None, "x", 1)], "key string, value string, seq int")
    assert sorted((r.key, r.value) for r in cache.put(empty, rows, now()).collect()) == [("a", "1"), ("b", None)]
    assert [r.value for r in cache.put(empty, rows.where("key = 'a'").drop("seq"), now()).collect()] == ["9"]
    fields = spark.createDataFrame([("h", "f", "z", 1), ("h", "f", "y", 3), ("h", "f", "x", 3), ("h", "g", "1", 1), ("h", None, "1", 1), (None, "f", "1", 1)], "key string, field string, value string, seq int")
    h = cache.hash_set(empty, fields)
    assert [r.m for r in h.select(F.from_json("value", "map<string,string>").alias("m")).collect()] == [{"f": "y", "g": "1"}]
    assert cache.hash_set(h, fields.limit(0)).collect() == h.collect()


def test_sessions(spark):
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(minutes=i // 2), f"q{i}", "a") for i in range(8)] + [("t", 1, datetime(2024, 1, 1), "q", "a")]
    df = spark.createDataFrame(rows, "session_id string, id int, timestamp timestamp, question string, answer string")
    got = [(r.id, r.position) for r in sessions.recent_turns(df).where("session_id = 's'").orderBy("position").collect()]
    assert got == [(3, 1), (4, 2), (5, 3), (6, 4), (7, 5)]
    assert sessions.appended(df, df.limit(0)).count() == 6
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(4)], "conv_id int, turn int, role string, content string")
    assert sessions.last_messages(m).first().history == "助手: m1\n用户: m2\n助手: m3"
    assert sessions.prior_messages(m).count() == 3


def test_router(spark):
    r = spark.createDataFrame([(1, "cached?", "k1", True, None, None, []), (2, "faq?", "k2", True, None, None, []), (3, "deep?", "k3", True, "s", None, []), (4, "  ", "k4", True, None, None, []), (5, "bad cache", "k5", True, None, None, ["m"])], "query long, question string, cache_key string, use_cache boolean, source string, strategy string, history array<string>")
    stored = spark.createDataFrame([("k1", '{"answer": "A", "degrade_level": 0}', None), ("k5", '{"answer": "B", "degrade_level": 2}', None)], cache.SCHEMA)
    made = lambda d, s: d.select("query", F.lit("x").alias("answer"), F.lit(s).alias("stage"), F.lit("i").alias("intent"), F.lit("s").alias("strategy"), F.lit(1.0).alias("confidence"), F.lit(0).alias("degrade_level"), F.lit("").alias("degrade_reason"))
    out = route.route(r, [lambda d: route.from_cache(d, stored, now()), lambda d: made(route.wants_faq(d), "faq"), lambda d: made(d, "deep")])
    assert {x["query"]: x.stage for x in out.collect()} == {1: "cache", 2: "faq", 3: "deep", 5: "deep"}
    assert {x.key for x in route.to_cache(out, r).collect()} == {"k2", "k3", "k5"}
    b = route.by_strategy(r.withColumn("strategy", F.element_at(F.array(*map(F.lit, ("hyde", "subquery", "backtracking", "direct", "odd"))), F.col("query").cast("int"))), F.lit("h"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")))
    got = [(x["query"], x.text) for x in b.orderBy("query", "branch").collect()]
    assert got == [(1, "h"), (2, "a"), (2, "b"), (3, "deep?"), (4, "  "), (5, "bad cache")]


def test_deep_outcome(spark):
    rows = [(False, None, 0, "", True, "c", "g"), (True, True, 0, "", True, "", "g"), (True, False, 2, "no_recall", True, "c", "g"), (True, False, 0, "", False, "c", "g"), (True, False, 0, "", True, "", "g"), (True, False, 0, "", True, "c", None), (True, False, 1, "r", True, "c", "g")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, ok boolean, general boolean, level int, reason string, reranked boolean, context string, generated string")
    c = F.col
    out = df.select("n", route.deep_outcome(c("general"), c("ok"), c("level"), c("reason"), c("reranked"), c("context"), c("generated"), F.lit("excerpt")).alias("o")).orderBy("n").collect()
    assert [(r.o.answer, r.o.degrade_level, r.o.degrade_reason) for r in out] == [(None, 2, "intent_error"), ("g", 0, ""), (None, 2, "no_recall"), (None, 2, "rerank_error"), (None, 2, "empty_context"), ("excerpt", 1, "generation_error"), ("g", 1, "r")]


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pptx(*slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, text in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:p="x" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sld>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"sub/a.TXT": "中文".encode("gbk"), "s_b.md": "# x".encode(), "c.docx": docx("p1", " ", "p2"), "d.pptx": pptx("one", "two"), "e.docx": b"junk", "f.pdf": b"%PDF", "g.html": b"no", "h.md": b"\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    docs, bad = files.read_documents(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in docs.collect()}
    assert {k: v.content for k, v in got.items()} == {"a.TXT": "中文", "s_b.md": "# x", "c.docx": "p1\np2", "d.pptx": "one\ntwo"}
    assert (got["a.TXT"].source, got["s_b.md"].source, got["c.docx"].paragraph_count, got["d.pptx"].slide_count) == ("sub", "s", 2, 2)
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"e.docx", "f.pdf", "h.md"}
    docs, bad = files.read_documents(spark, str(tmp_path / "absent"))
    assert docs.count() == bad.count() == 0
    files.use_pdf_reader(lambda data: ["page one", "", "page three"])
    docs, _ = files.read_documents(spark, str(tmp_path))
    files.use_pdf_reader(None)
    assert [(r.page_number, r.total_pages) for r in docs.where("file_type = 'pdf'").orderBy("page_number").collect()] == [(1, 3), (3, 3)]


def test_faq_csv_and_reports(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('﻿question , answer,source,doc_name\n"a ""q""\nline",x,s,d\n,y,s,d\nz,,s,d\n', encoding="utf-8")
    rows = stores.faq_csv(spark, str(path)).collect()
    assert [(r.question, r.answer, r.category, r.keywords) for r in rows] == [('a "q"\nline', "x", "s", "d")]
    df = spark.createDataFrame([("q", 0.5), ("r", None)], "question string, m double")
    out = {r.question: r.m for r in reports.with_average(df, ("m",)).collect()}
    assert out == {"q": 0.5, "r": None, "__average__": 0.5}
    reports.write_report(df, df.agg(F.avg("m").alias("m")), str(tmp_path / "rep"), ("m",))
    assert spark.read.csv(str(tmp_path / "rep/csv"), header=True).count() == 3


def test_corpus_names(spark):
    t = corpus.titles(spark.createDataFrame([('{"x": [{"TopicId": "{AAA}", "Title": " 疾病/说明 ", "Kids": [{"TopicId": "bbb", "Title": "疾病:说明"}]}]}',), ("junk",)], "value string"))
    assert {r.topic_id: r.title for r in t.collect()} == {"aaa": "疾病/说明", "bbb": "疾病:说明"}
    pages = spark.createDataFrame([("/x/{AAA}.html", "a"), ("/x/bbb.htm", "b"), ("/x/zzz.html", "c")], "path string, html string")
    got = {r.topic_id: r.file_name for r in corpus.safe_names(corpus.topics(pages, t), order="topic_id").collect()}
    assert got == {"aaa": "疾病_说明.md", "bbb": "疾病_说明_bbb.md"}


def test_ingest_and_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# T\n[link](u) text\n\nPage 2 stays", "markdown", "a"), (2, "apple pie\nPage 2\napple", "txt", "b"), (3, "banana", None, "c")], "doc_id int, content string, file_type string, source string")
    out = ingest.ingest(docs, now())
    texts = {r.doc_id: r.content for r in out.where("chunk_type = 'parent'").collect()}
    assert texts == {1: "# T\nlink text\n\nPage 2 stays", 2: "apple pie\n\napple", 3: "banana"}
    stores.write_chunks(out, str(tmp_path / "store"))
    assert stores.info(stores.read_chunks(spark, str(tmp_path / "store"))).first().n_child == 3
    q = spark.createDataFrame([(1, "apple")], "query int, question string")
    got = retrieve.lexical_small_to_big(docs, q, "doc_id", "content", "query", "question").collect()
    assert [(r.id, r.content) for r in got] == [("2_0_parent", "apple pie\n\napple")]


def test_stream(spark, tmp_path):
    rows = [("s", i, datetime(2024, 1, 1) + timedelta(minutes=i), f"q{i}", "a") for i in range(7)]
    schema = "session_id string, id long, timestamp timestamp, question string, answer string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = history.recent_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("update").format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.sql("select * from turns").collect()[-1]
    assert last.turns == 7 and last.history.startswith("q2\na") and last.history.endswith("q6\na")


def test_health(spark):
    def broken():
        raise OSError

    assert {(r.service, r.up) for r in route.health(spark, {"a": lambda: True, "b": broken}).collect()} == {("a", True), ("b", False), ("all", False)}
    assert [r.up for r in route.health(spark, {}).collect()] == [True]


def test_scanned_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x|" + b"|z")
    files.use_pdf_reader(lambda data: data.decode().split("|"))
    files.use_page_reader(lambda data, k: f"read from page {k}")
    try:
        good, bad = files.read_documents(spark, str(tmp_path))
        assert [(r.page_number, r.content) for r in good.orderBy("page_number").collect()] == [(1, "x"), (2, "read from page 2"), (3, "z")] and bad.count() == 0
    finally:
        files.use_pdf_reader(None)
        files.use_page_reader(None)
