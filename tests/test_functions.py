import hashlib
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from lexforge.functions import models, parsing, scores, text
from lexforge.operators import cache, cleaning


def test_strip_and_tokens_follow_unicode(column):
    samples = ["  a b ", " x　", "\x1ca\x85", "", "a\t\n b", " \n "]
    assert column(text.ustrip, *samples) == [s.strip() for s in samples]
    assert column(text.utokens, *samples) == [s.split() for s in samples]


def test_cache_keys_keep_what_matters(column):
    pairs = [("1.5mg", "15mg"), ("120/80", "12080"), ("-5", "5"), ("1 2", "12"), ("mL", "ML")]
    for a, b in pairs:
        x, y = column(cache.faq_key, a, b)
        assert x != y
    assert len(set(column(cache.faq_key, " test ", "test"))) == 1
    assert column(cache.faq_key, " q\n") == ["faq:v3:" + hashlib.md5(b"q").hexdigest()]


def test_query_key_depends_on_all_parts(column):
    rows = [("q", None, "direct", "[]"), ("q", "s", "direct", "[]"), ("q", None, "hyde", "[]"), ("q", None, "direct", '[{"role": "user", "content": "x"}]'), ("p", None, "direct", "[]")]
    keys = column(cache.query_key, *rows)
    assert len(set(keys)) == 5
    assert keys[0] == "query:v3:" + hashlib.sha256(json.dumps(["q", None, "direct", []], ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_valid_scores(column):
    got = column(scores.valid, None, float("nan"), float("inf"), -0.1, 1.1, 0.0, 1.0, types="double")
    assert got == [False, False, False, False, False, True, True]


def test_composite_and_bucket(column):
    row = (0.8163338095238095, 0.5006771428571428, 0.8404761904761905, 0.7619047619047619)
    assert column(lambda *c: scores.composite(*c), row, types=["double"] * 4) == [0.7298]
    assert column(lambda *c: scores.composite(*c), (1.0, None), types=["double"] * 2) == [None]
    assert column(scores.bucket, 0.0, 0.1, 0.2, 0.9, None, types="double") == ["=0", "<0.2", "<0.4", ">=0.8", "none"]


def test_strategy_names(column):
    raw = [None, "direct", "`HyDE`", "回溯检索", "子查询检索", '{"s": "backtracking"}', "sub-query", "nonsense"]
    assert column(parsing.strategy, *raw) == ["direct", "direct", "hyde", "backtracking", "subquery", "backtracking", "subquery", "direct"]


def test_sub_questions(column):
    assert column(parsing.sub_questions, ("子问题1： a \n子问题2：b：c\nother", "q"), ("none", "q"), (None, "q"), ("子问题1：", "q")) == [["a", "b：c"], ["q"], ["q"], ["q"]]


def test_judge_scores(column):
    raw = ['{"score": true}', '{"score": "0.5"}', '{"score": NaN}', '{"score": 1.2}', '{"score":', "[]", '```json\n{"score": 0}\n```', '{"score": 0.25}']
    assert column(parsing.judge_score, *raw) == [None] * 6 + [0.0, 0.25]
    lenient = ['so: {"faithfulness": "0.5"} ok', '{"faithfulness": true}', "nothing", '{"faithfulness": 0.0}']
    assert column(lambda c: parsing.judge_scores_lenient(c, "faithfulness"), *lenient) == [0.5, None, None, 0.0]


def test_qa_pairs(column):
    got = column(parsing.qa_pairs, 'x ```json\n[{"question": "q", "answer": "a"}, {"question": "", "answer": "b"},]\n```', "junk")
    assert [(r.question, r.reference_answer) for r in got[0]] == [("q", "a")] and got[1] == []


def test_reviews(column):
    def review(**check):
        return json.dumps({"final_answer": " ok ", "checks": [{"claim": "c", **check}]})

    context = "one two\n\nthree"
    good = [review(supported=True, evidence_ids=[2]), review(supported=False, evidence_ids=[]), review(supported=True, evidence="onetwo")]
    bad = [review(supported=True, evidence_ids=[]), review(supported=True, evidence_ids=[3]), review(supported=1, evidence_ids=[1]), review(supported=True, evidence_ids=[True]), review(supported=True, evidence="four"), "[]", "{", None]
    got = column(parsing.reviewed_answer, *[(r, context) for r in good + bad])
    assert got == ["ok"] * 3 + [None] * len(bad)


def test_evidence_and_formats(column):
    assert column(text.numbered_evidence, "a\n\n \n\nb") == ["【证据1】\na\n\n【证据2】\nb"]
    assert column(text.knowledge_text, ("t", "c"), ("unknown", "c"), (None, None)) == ["【文档标题：t】\nc", "c", ""]
    assert column(lambda c: text.truncate(c, 5), "abcdef", "abc") == ["ab...", "abc"]
    assert column(text.clean_entity, "糖尿病（型）.md", "a (b) c.md") == ["糖尿病", "a  c"]
    assert column(lambda c: text.source_label(c, "/raw"), "file:/x/raw/s/a.txt", "file:/x/raw/p_q.txt", "file:/x/raw/z.md") == ["s", "p", "z"]
    assert column(text.token_estimate, "高血压", "a b c d") == [2, 3]


def test_models(spark, column):
    v = column(models.hashed_vector, "a b a", "")
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and sum(v[1]) == 0
    assert all(w > 0 for w in column(models.hashed_weights, "a b")[0].values())
    assert column(models.published, ("x", "stop"), ("x", "length"), (" ", "stop")) == ["x", None, None]
    with pytest.raises(LookupError):
        models.model("judge", "absent")
    rows = spark.createDataFrame([(f"good text {i}" if i % 2 else f"bad words {i}", i % 2) for i in range(40)], "text string, label int")
    out = models.predict_intent(models.train_intent(rows), rows)
    assert out.where(F.col("intent") != F.col("label")).count() == 0
    with pytest.raises(RuntimeError):
        models.predict_intent(None, rows)


def test_white_space_is_pythons_and_runs_within_a_text_cost_little(column):
    """Every character by itself, then a run between letters: stripping looks at the edges only, and cleaning goes on from there."""
    every = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    ends = [c + "a" + c + "b" + c for c in every]
    assert column(text.ustrip, *ends) == [x.strip() for x in ends]
    assert column(text.utokens, *ends) == [x.split() for x in ends]
    assert column(lambda x: F.regexp_replace(x, "(?U)" + text.WS, ""), *ends) == ["".join(x.split()) for x in ends]
    unseen = [c for c in every if re.fullmatch("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufeff\u200b-\u200d\xad]", c)]
    assert column(cleaning.clean_characters, "".join(unseen) + "a" + "".join(unseen)) == ["a"]
    kept = "".join(c for c in every if c not in unseen and c != "\r")
    assert column(cleaning.clean_characters, kept) == [kept]
    wide = "a" + " " * 300_000 + "b"
    began = time.monotonic()
    assert column(text.ustrip, " " + wide) == [wide] and column(lambda x: cleaning.joined(F.array(x)), wide) == ["a b"]
    assert time.monotonic() - began < 10
    assert column(text.ustrip, None, "", " \u3000") == [None, "", ""] and column(text.utokens, None, "", " \u3000") == [None, [], []]
