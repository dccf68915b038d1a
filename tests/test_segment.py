import itertools
import math

import pytest
from hypothesis import given, settings, strategies as st

from lexforge.operators import inverted
from lexforge.functions import segment
from lexforge.operators import lexical

COUNTS = {"ab": 5, "abc": 2, "c": 3, "cd": 4, "d": 1, "abcd": 1, "x": 2, "xyz": 1, "bd": 2}
KNOWN = segment.Dictionary.of(COUNTS)
TOTAL = sum(COUNTS.values())


def cuts(run):
    for ends in itertools.product((0, 1), repeat=max(len(run) - 1, 0)):
        out = [run[0]]
        for c, new in zip(run[1:], ends):
            if new:
                out.append(c)
            else:
                out[-1] += c
        yield out


def weight(pieces):
    s = 0.0
    for p in pieces:
        if p not in COUNTS and len(p) > 1:
            return -math.inf
        s += math.log(COUNTS[p] / TOTAL) if p in COUNTS else math.log(1 / (TOTAL + 1))
    return s


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdxyz", min_size=1, max_size=9))
def test_path_against_all_paths(run):
    got = KNOWN.path(run)
    assert "".join(got) == run and weight(got) == max(weight(p) for p in cuts(run))


def tagged(run, pieces):
    """The tag model's logarithm of a cut, from counts alone."""
    tags = "".join("S" if len(p) == 1 else "B" + "M" * (len(p) - 2) + "E" for p in pieces)
    seen = {t: {} for t in "BMES"}
    pairs = {}
    for w, n in COUNTS.items():
        of = "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E"
        for t, c in zip(of, w):
            seen[t][c] = seen[t].get(c, 0) + n
        for i in range(len(of) - 1):
            pairs[of[i : i + 2]] = pairs.get(of[i : i + 2], 0) + n
    for t in "ES":
        pairs[t + "B"], pairs[t + "S"] = sum(seen["B"].values()), sum(seen["S"].values())
    letters = len(set("".join(COUNTS))) + 1
    follow = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}
    s, before = 0.0, "E"
    for t, c in zip(tags, run):
        s += math.log((pairs.get(before + t, 0) + 1) / (sum(pairs.get(before + x, 0) for x in follow[before]) + 2))
        s += math.log((seen[t].get(c, 0) + 1) / (sum(seen[t].values()) + letters))
        before = t
    return s


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abxyzq", min_size=2, max_size=8))
def test_unknown_runs_against_all_tags(run):
    got = KNOWN.guess(run)
    assert "".join(got) == run
    assert abs(tagged(run, got) - max(tagged(run, p) for p in cuts(run))) < 1e-9


def test_words_and_runs():
    zh = segment.Dictionary.of({"糖尿病": 20, "糖": 3, "尿病": 1, "的": 50, "治疗": 10, "血糖": 8})
    assert zh.tokens("糖尿病的治疗，HbA1c 6.5% 以上_!") == ["糖尿病", "的", "治疗", "hba1c", "6.5%", *zh.guess("以上")]
    assert zh.tokens(None) == zh.tokens("") == zh.tokens(" ,。_") == []
    assert "".join(zh.tokens("甲乙丙丁")) == "甲乙丙丁"
    long = "糖尿病的" * 30_000
    assert zh.tokens(long) == ["糖尿病", "的"] * 30_000


def test_search_with_a_dictionary(spark):
    words = spark.createDataFrame([("糖尿病", 5), ("治疗", 3), ("症状", 3), ("症状", 1), ("的", 9), (None, 1), ("", 1), ("坏", 0), ("a b", 4)], "word string, n int")
    known = segment.dictionary(words)
    assert {w for w, s in known.share.items() if s > -math.inf} == {"糖尿病", "治疗", "症状", "的"}
    cut = segment.segmenter(words)
    docs = spark.createDataFrame([(1, "糖尿病的治疗"), (2, "糖尿病的症状"), (3, None), (4, "")], "id int, text string")
    asked = spark.createDataFrame([(1, "症状")], "query int, question string")
    assert [r.doc for r in lexical.ranked(docs, asked, "id", "text", "query", "question", 5, tokens=cut).collect()] == [2]
    assert {r.id: r.w for r in docs.select("id", cut(docs.text).alias("w")).collect()} == {1: ["糖尿病", "的", "治疗"], 2: ["糖尿病", "的", "症状"], 3: [], 4: []}
    with pytest.raises(ValueError, match="empty"):
        segment.dictionary(words.where("n > 99"))


def test_text_that_lost_its_spaces(spark):
    words = spark.createDataFrame([("the", 9), ("cat", 2), ("sat", 2), ("on", 3), ("mat", 1), ("them", 1), ("at", 1)], "word string, n int")
    cut = segment.segmenter(words, segment.ANY)
    docs = spark.createDataFrame([(1, "TheCatSatOnTheMat")], "id int, text string")
    assert docs.select(cut(docs.text).alias("w")).first().w == ["the", "cat", "sat", "on", "the", "mat"]


def test_texts_and_blocks_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name, None)
    words = spark.createDataFrame([("ab", 1)], "word string, n long")
    rows = spark.createDataFrame([(1, ["ab"])], "doc int, tokens array<string>")
    for use in (lambda: segment.segmenter(words), lambda: inverted.build(rows)):
        spark.conf.set(name, "64m")
        use()
        assert int(spark.conf.get(name)) == 4 << 20
    spark.conf.unset(name) if had is None else spark.conf.set(name, had)
