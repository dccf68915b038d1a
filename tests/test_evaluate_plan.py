from pyspark.sql import functions as F

from lexforge.plans import evaluate


def test_judged(spark):
    items = spark.createDataFrame([("a b", "a b c", ["a b c d"], "a"), ("x", "y", [], "")], "question string, answer string, contexts array<string>, ground_truth string")
    scores, one = evaluate.judged(items)
    got = {r.question: tuple(r)[1:] for r in scores.collect()}
    assert got == {"a b": (1.0, 1.0, 1.0, 1.0), "x": (0.0, 0.0, None, None)}
    assert one.first().complete_count == 1 and one.first().context_recall == 1.0


def test_relay(spark):
    items = spark.createDataFrame([(i,) for i in range(7)], "i int")
    calls = []

    def judge(name, good):
        def run(df):
            calls.append(name)
            return df.withColumn("faithfulness", F.when(F.lit(good), 0.5))

        return run

    keep = lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema)
    out = evaluate.relay(items, {"bad": judge("bad", False), "fine": judge("fine", True)}, "i", keep, size=3)
    assert {(r.judge, r.faithfulness) for r in out.collect()} == {("fine", 0.5)} and out.count() == 7
    assert calls == ["bad", "fine", "fine", "fine"]
    assert evaluate.relay(items, {"bad": judge("bad", False)}, "i", keep, size=10).where("faithfulness is null").count() == 7


def test_first_answer(column):
    assert column(evaluate.first_answer, (None, " ", "x"), ("a", "b", "c"), ("", None, " ")) == ["x", "a", None]
