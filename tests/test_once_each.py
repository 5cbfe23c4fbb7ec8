"""Work that is done once for each text or word, not once for each use of it."""

import time

import numpy as np
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.functions.rules import RuleTable
from brindle.operators import boundaries, sentences, topics, vectors


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_a_long_text_take_linear_time(spark):
    docs = spark.range(2).select(F.lit("a").alias("topic"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(150_000)), lambda i: F.concat(F.lit("w"), F.translate(i.cast("string"), "0123456789", "abcdefghij")))).alias("text")).repartition(2)
    began = time.perf_counter()
    assert topics.ngram_counts(docs, lengths=(2, 2)).where("n = 2").count() == 149_999
    assert time.perf_counter() - began < 25


def test_words_are_told_once_a_pair(spark):
    docs = spark.createDataFrame([(1, "One. Two (three) -- four. Five")], "doc_id int, text string")
    found = plan(boundaries.word_counts(docs))
    assert found.count("split(") == 1
    aggregate = found.index("Aggregate [")
    assert "regexp_replace" not in found[aggregate:] and "regexp_replace" in found[:aggregate]


def test_topics_lower_a_text_once(spark):
    df = spark.createDataFrame([("Processor SALES, fertile Plastic cash",), ("Process",), (None,), ("",)], "sentence string")
    found = sentences.keyword_topics(df, blacklist=("disclosure", "processor"), exclusions={4: ("fertil",)})
    assert [r["topics"] for r in found.collect()] == [[0, 11], [3], None, []]
    assert plan(found).count("regexp_replace") == 1 and plan(found).count("lower(sentence") == 1


def test_cleaning_is_the_same_by_faster_patterns(spark):
    odd = ["a1b2 c 33 x_9_ é5e ٣x", "w" * 30 + " " + "w" * 31 + " " + "é" * 40, " \t a b  c\n\n d\r\ne  f ", "!!?? a--b ** .", "", None, "x́ 9́ ́", "a‍b1 ‍"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string")
    for rule in text.GENERAL_RULES:
        both = df.select(text.replace_rules(F.col("text"), (rule,)).alias("got"), text.squeeze(F.regexp_replace(F.lower("text"), f"(?U){rule[0]}", rule[1])).alias("want")).collect()
        assert [r["got"] for r in both] == [r["want"] for r in both], rule
    assert plan(df.select(text.replace_rules(F.col("text")))).count("\\s+,  ,") == 0


def test_few_texts_are_strings_at_a_time(spark):
    """A batch's texts are changed step by step, in order, whatever its size."""
    texts = spark.range(1, 1000, numPartitions=1).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("T "), F.col("id"))).alias("t"))
    made = [r[0] for r in texts.select(text.each_text(lambda t: t.lower())(F.col("t"))).collect()]
    assert made == [f"t {i}" if i % 7 else None for i in range(1, 1000)]
    assert RuleTable((("a", "b"),)).apply("aa") == "bb"


def test_distances_by_products_keep_their_digits():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(400, 64)) + 50
    x = np.concatenate([y[:50], y[50:100] + 1e-9, y[100:150] * (1 + 1e-5), rng.normal(size=(50, 64)) * 1e3])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert np.allclose(vectors.euclidean(x, y), want, rtol=1e-9, atol=1e-13)
