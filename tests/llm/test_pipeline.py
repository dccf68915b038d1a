"""The pipeline's stages on a small table, each against what its operator must do."""

import math
import random
from collections import Counter

import corpus_pipeline

from .test_near import brute_text, words
from .test_texts import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows():
    random.seed(11)
    prose = lambda n: "\n".join(" ".join(words(14)) + "." for _ in range(n))
    out = [prose(6) for _ in range(60)]
    out += [out[0], out[1] + " extra end.", out[2].upper(), "too short.", None, "", " | ".join(words(80))]
    out += [out[5] + f'\ntoken = "{"ab12" * 10}" is here.', out[6] + "\nAll rights reserved.", prose(700)]
    return [(i, t, "en", "big" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(out)]


def test_stages(spark, tmp_path):
    table = rows()
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == COLUMNS

    kept = {r.doc_id: r.text for r in seen["quality rules"]}
    n = len(table)
    assert set(kept) == {i for i, *_ in table} - {63, 64, 65, 66}
    assert kept[n - 2] == table[6][1] and kept[0] == table[0][1]

    _, component = brute_text(list(kept.items()), 80)
    left = {r.doc_id: r.text for r in seen["near duplicates"]}
    assert left == {i: kept[i] for i in kept if component[i] == i} and {60, 61, 62} & set(left) == set()

    clean = {r.doc_id: r.text for r in seen["secrets"]}
    assert clean.keys() == left.keys()
    for i, text in left.items():
        spans = base(text)
        assert (clean[i] == text) if not spans else ("[SECRET]" in clean[i] and not base(clean[i]))

    tokens = lambda t: len(t.split()) + 1
    mixed = Counter((r.doc_id, r.text) for r in seen["mixture"])
    assert set(mixed) == set(clean.items())
    have, first = Counter(), Counter()
    for r in seen["mixture"]:
        have[r.source] += tokens(r.text)
    for r in seen["secrets"]:
        first[r.source] += tokens(r.text)
    share = [x / sum(have.values()) for x in have.values()]
    assert all(have[s] >= first[s] for s in first)
    spread = lambda w: -sum(x * math.log(x) for x in w)
    assert spread(share) > spread([x / sum(first.values()) for x in first.values()]) - 1e-9

    placed = Counter()
    for r in seen["packing"]:
        placed[r.doc_id] += r.length
    assert placed == Counter({i: k * tokens(t) for (i, t), k in [((d, t), n) for (d, t), n in mixed.items()]})
    assert all(r["at"] + r.length <= r.capacity for r in seen["packing"])

    assert len({(r.doc_id, r["copy"], r.piece) for r in seen["packing"]}) == len(seen["packing"])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted((r.doc_id, r.piece, r.length) for r in seen["packing"])


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns(spark):
    """Every stage but the last returns all columns, whatever their names."""
    extra = ["_gone", "gone", "mix_block", "mix_order", "mix_tokens", "row", "id", "n", "s", "chance", "rep", "component", "kept", "n_words", "_row", "_body", "cleaned_text", "spans", "copy", "piece", "shard", "length", "epoch"]
    table = [(*r, *range(len(extra))) for r in rows()]
    now = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` int" for x in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == COLUMNS + extra
        now = spark.createDataFrame(now.collect(), now.schema)
        assert now.count() and all(tuple(r)[len(COLUMNS) :] == tuple(range(len(extra))) for r in now.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count()
