"""Hand-computed cases, and what the tables at hand don't have: nulls, ties, empty inputs."""

import datetime as dt
import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.functions import stats, text
from brindle.operators import filings, fundamentals, joins, portfolio, prep, routing, sentences, sentiment, topics, vectors
from brindle.sources import files
from brindle.streaming.sentiment import windowed_sentiment

D = dt.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_centroids_distances_silhouettes(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.8, 0.6], 0), (2, [0.0, 1.0], 1), (3, [0.6, 0.8], 1)], "vec_id long, embedding array<float>, label int")
    c = vectors.centroids(v)
    assert [[round(x, 6) for x in r["centroid"]] for r in c.orderBy("topic").collect()] == [[0.9, 0.3], [0.3, 0.9]]
    assert round(vectors.intertopic_cosine(c).first()["cosine"], 6) == 0.6
    far = {(r["vec_id"], r["topic"]): round(r["distance"], 5) for r in vectors.topic_distances(v, c).collect()}
    assert far[(0, 0)] == 0.05132 and far[(0, 1)] == 0.68377
    got = [round(r["silhouette"], 5) for r in vectors.silhouettes(v, 1).orderBy("vec_id").collect()]
    assert got == [0.4521, -0.06929, 0.4521, -0.06929]


def test_entropy_of_three_distances(spark):
    c = spark.createDataFrame([(i, [1 - d, math.sqrt(1 - (1 - d) ** 2)]) for i, d in enumerate((0.1, 0.5, 0.9))], "topic int, centroid array<double>")
    got = vectors.assign_topics(spark.createDataFrame([(0, [1.0, 0.0])], "vec_id long, embedding array<double>"), c).first()
    assert got["topic"] == 0 and abs(got["entropy"] - 0.093035) < 1e-5


def test_class_tfidf(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "y", 1), ("b", "z", 3)], "topic string, token string, n long")
    got = {(r["topic"], r["token"]): round(r["score"], 5) for r in topics.class_tfidf(counts).collect()}
    assert got == {("a", "x"): 0.38376, ("a", "y"): 0.27136, ("b", "y"): 0.235, ("b", "z"): 0.11564}


def test_sentiment_of_a_document(spark):
    s = spark.createDataFrame([(1, 0, 2, 0.9), (1, 0, 0, 0.8), (1, 3, 1, 0.6), (1, 3, 2, 0.7), (1, -1, 0, 0.5), (2, 0, 1, 0.4), (2, 1, 1, 0.4)], "doc_id long, topic int, sentiment_class int, sentiment_prob double")
    got = {r["doc_id"]: r.asDict() for r in sentiment.document_sentiment(s).collect()}
    want = {"basic": 1.0, "azimi": 0.999975, "huang": 0, "zhang": 0.499999, "gupta_a": 0, "gupta_b": 0.399999, "gupta_c": 0, "renault": 0.06, "vamossy": 0.066667}
    assert all(abs(got[1][k] - v) < 2e-6 for k, v in want.items())
    assert got[2]["basic"] == 1.0 and all(got[2][k] == 0 for k in want if k != "basic")
    assert not sentiment.document_sentiment(s, neutral=False).where("doc_id = 2").collect()
    wide = sentiment.sentiment_features(s, "huang").where("doc_id = 1").first()
    assert abs(wide["mean_sentiment_topic_3"] - 0.5) < 1e-4 and abs(wide["mean_sentiment_topic_-1"] + 1) < 1e-4 and wide["mean_sentiment_topic_5"] is None


def test_section(spark):
    t = "PART II Item 7. body Item 8. fs PART III see Item 7. and Item 8. in Part III end"
    df = spark.createDataFrame([(t,), ("",), (None,), ("Part II item 8. item 7.",)], "text string")
    assert [r["section"] for r in filings.section(df).collect()] == ["Item 7. body ", None, None, None]
    assert filings.section(df, strict=False).first()["section"] == "Item 7. and "
    cases = {
        "Part II see Part III below. Item 7. x Item 8. y Part III": "Item 7. x ",
        "Part II Item 7. x Item 8. y": None,
        "Part II Items 7 and 7A. x Item 8. y Part III": "Items 7 and 7A. x ",
        "Part II Item 7: x Item 8: y Part III": "Item 7: x ",
        "\u0130\u0130 Part II Item 7. MDA text Item 8. y Part III": "Item 7. MDA text ",
        "Part\u00a0II Item\n7. x Item\t8. y part iii": "Item\n7. x ",
        "Part IIII Item 7. x Item 8. y Part III": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r["text"]: r["section"] for r in filings.section(df).collect()} == cases


def test_first_of_accession_keeps_nulls(spark):
    df = spark.createDataFrame([("A", 1, 1), (None, 1, 2), ("A", 2, 1), (None, 2, 2)], "accession_number string, archive int, entry int")
    assert [r["accession_number"] for r in filings.first_of_accession(df).orderBy("archive", "entry").collect()] == ["A", None, None]


def test_lengths_and_quantile(spark):
    df = spark.createDataFrame([(n,) for n in (300, 310, 290, 305, 900)], "n_words int")
    assert [round(r["zscore"], 4) for r in filings.within_zscore(df, 9).orderBy("n_words").collect()] == [0.489, 0.4517, 0.433, 0.4144, 1.7882]
    assert filings.within_quantile(df, 0.99).count() == 4
    with pytest.raises(ValueError, match="between 0 and 1"):
        filings.within_quantile(df, 2.0)


def test_sentence_lengths_and_numbers(spark):
    said = " ".join(["word"] * 5) + ". " + " ".join(["Word"] * 6) + ". " + " ".join(["Word"] * 49) + ". " + " ".join(["Word"] * 50) + "."
    got = sentences.number_sentences(sentences.clean_sentences(sentences.split_sentences(spark.createDataFrame([(1, said), (2, ""), (3, None)], "doc_id int, text string")), rules=()))
    assert rows(got, "doc_id", "pos", "sentence_id", "n_words") == [(1, 1, 0, 6), (1, 2, 1, 49)]


def test_rules_batches_agree(spark):
    df = spark.createDataFrame([("Ünï \n a@b.c co, 3 words; x-y",), (None,), ("",), ("plain Text.",)], "text string")
    both = df.select(text.replace_rules(F.col("text")).alias("a"), text.replace_rules_in_batches(F.col("text"), text.GENERAL_RULES).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_header(spark):
    t = "ACCESSION NUMBER:\t\t0001-23\nCONFORMED PERIOD OF REPORT:\t20231201\nCOMPANY CONFORMED NAME:\t\tADOBE INC.\r\n"
    got = filings.with_header(spark.createDataFrame([(t,), ("none",)], "text string")).collect()
    assert (got[0]["accession_number"], got[0]["year_of_report"], got[0]["company_name"]) == ("0001-23", "2023", "ADOBE INC.")
    assert got[1]["cik"] is None and got[1]["year_of_report"] is None


def test_asof(spark):
    left = spark.createDataFrame([(1, 10), (2, 25), (3, 5), (4, None)], "id int, t int")
    right = spark.createDataFrame([(10, "old", 1), (10, "a", 2), (20, "b", 1), (None, "n", 1)], "t2 int, v string, o int")
    for got in (joins.asof(left, right, "t", "t2", ["v"], order="o"), joins.asof_small(left, right, "t", "t2", ["v"], order="o")):
        assert [r["v"] for r in got.orderBy("id").collect()] == ["a", "b", None, None]


def test_event_window_and_range(spark):
    days = [D(2024, 1, d) for d in (1, 2, 3, 4, 5, 8)]
    prices = spark.createDataFrame([("T", d, float(p), 1.0) for d, p in zip(days, (10, 12, 11, 13, 14, 15))], "ticker string, date date, price double, volume double")
    filed = spark.createDataFrame([("T", D(2024, 1, 5), 2024), ("T", D(2024, 1, 6), 2025)], "ticker string, filing_date date, year int")
    assert [r[1] for r in rows(fundamentals.event_windows(prices, filed, 3, 0), "offset", "price")] == [12, 11, 13, 14]
    assert [r[1] for r in rows(fundamentals.event_windows(prices, filed, 3, -1), "offset", "price")] == [12, 11, 13]
    got = joins.within_interval(filed, prices, F.date_sub("filing_date", 2), F.col("filing_date"), "date", ["ticker"], 2)
    assert rows(got, "year", "price") == [(2024, 11.0), (2024, 13.0), (2024, 14.0), (2025, 13.0), (2025, 14.0)]


def test_targets(spark):
    t = spark.createDataFrame([("T", y, float(v)) for y, v in zip(range(2015, 2021), (1, 3, 2, 4, 10, 0))], "ticker string, year int, target double")
    assert rows(fundamentals.above_recent_mean(t), "year", "target") == [(2018, 2.0), (2019, 7.5), (2020, -4.75)]


def test_growth_fills_gaps(spark):
    t = spark.createDataFrame([("T", i, v) for i, v in enumerate((1.0, None, 2.0, 0.0, 3.0))], "ticker string, year int, v double")
    assert [r[1] for r in rows(fundamentals.growth(t, ["v"], factor=1.0), "year", "v_change")] == [None, 0.0, 1.0, -1.0, None]


def test_macro_mean_of_empty_window(spark):
    f = spark.createDataFrame([("T", D(2024, 1, 1), D(2024, 1, 10)), ("U", D(2023, 1, 1), D(2023, 1, 2))], "ticker string, previous_period date, period_of_report date")
    m = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2024, 1, 10), 3.0), (D(2024, 1, 11), 99.0)], "date date, x double")
    assert rows(fundamentals.macro_mean(f, m, ["x"]), "ticker", "x_mean") == [("T", 2.0), ("U", None)]


def test_sanity(spark):
    f = spark.createDataFrame([(D(2023, 12, 31), D(2024, 2, 1), 2023), (D(2023, 12, 31), D(2023, 12, 31), 2023), (D(2023, 12, 31), None, 2023), (D(2020, 1, 1), D(2020, 2, 1), 2023)], "period_of_report date, filing_date date, year int")
    good, bad = fundamentals.sane_filings(f, F.lit(D(2025, 1, 1)))
    assert good.count() == 1 and bad.count() == 3


def test_returns_and_dates(spark):
    p = spark.createDataFrame([("T", D(2024, 1, d), v) for d, v in enumerate((100.0, 110.0, 99.0, 108.9), 1)], "ticker string, date date, price double")
    daily = portfolio.daily_returns(p)
    assert [None if r[1] is None else round(r[1], 6) for r in rows(daily, "date", "daily_return")] == [None, 0.1, -0.1, 0.1]
    held = spark.createDataFrame([("T", 2024, D(2024, 1, 1), D(2024, 1, 9))], "ticker string, year int, start_date date, end_date date")
    market = spark.createDataFrame([(D(2024, 1, d), 0.0) for d in range(1, 5)], "date date, market_return double")
    assert round(portfolio.cumulative_returns(held, daily, market, 4).first()["stock_return"], 6) == 0.089
    assert not portfolio.cumulative_returns(held, daily, market, 5).collect()
    f = spark.createDataFrame([("T", 2024, D(2024, 11, 30))], "ticker string, year int, period_of_report date")
    assert portfolio.holding_periods(spark.createDataFrame([("T", 2025)], "ticker string, year int"), f).first()["start_date"] == D(2025, 2, 28)


def test_hedge(spark):
    data = [(f"L{i}", 2020, 1, x, float(i + 1)) for i, x in enumerate((0.1, 0.2, 0.05, 0.15))] + [(f"S{i}", 2020, 0, x, 1.0) for i, x in enumerate((-0.05, 0.02, 0.0))] + [("N", 2020, -1, 9.0, 1.0)]
    df = spark.createDataFrame(data, "ticker string, year int, position int, excess_return double, market_cap double")
    got = stats.with_welch_p(portfolio.hedge_summary(df)).first()
    assert round(got["hedge_return"], 6) == 0.135 and round(got["t"], 6) == 3.515101 and round(got["df"], 6) == 4.77552 and 0.01 < got["p"] < 0.03
    assert round(portfolio.hedge_summary(df, weighted=True).first()["long_mean"], 6) == 0.125
    one = portfolio.permutation_hedge(df, 300).first()
    assert one["p_one_sided"] < 0.2 and portfolio.bootstrap_hedge(df, 200).first()["low"] > 0
    assert portfolio.with_positions(spark.createDataFrame([(0.5,)], "prob double")).first()["position"] == 0


def test_student(spark):
    assert abs(stats.t_two_sided(2.0, 10) - 0.07338803) < 1e-7 and stats.t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.4), (1, 0.4), (0, 0.2), (1, 0.3)], "label int, prob double")
    assert stats.roc_auc(df).first()["auc"] == 0.75 and round(stats.log_loss(df).first()["log_loss"], 6) == 0.591919
    got = stats.confusion(df, F.when(F.col("prob") >= 0.4, 1).otherwise(0), F.col("label")).first()
    assert (got["tn"], got["fp"], got["fn"], got["tp"]) == (1, 1, 1, 2)
    assert stats.roc_auc(df.where("label = 1")).first()["auc"] is None
    flipped = df.withColumn("prob", 1 - F.col("prob"))
    assert stats.roc_auc(flipped).first()["auc"] == pytest.approx(0.25)


def test_preparation(spark):
    df = spark.createDataFrame([(i, 2000 + i, v) for i, v in enumerate((1.0, 2.0, 3.0, 4.0, 100.0))], "id int, year int, a double")
    assert [r[1] for r in rows(prep.outliers_to_null(df, ["a"]), "id", "a")] == [1, 2, 3, 4, None]
    scaled = prep.scale(df.where("a < 5 and a <> 3"), ["a"])
    assert [round(r[1], 5) for r in rows(scaled, "id", "a")] == [-1.06904, -0.26726, 1.33631]
    constant = prep.scale(df.withColumn("a", F.lit(2.0)), ["a"])
    assert {r["a"] for r in constant.collect()} == {0.0}
    bad = spark.createDataFrame([(1, float("nan"), 0.0), (2, 1.0, float("inf")), (3, 1.0, 1.0)], "id int, a double, b double")
    assert rows(prep.drop_problem_rows(prep.without_infinities(bad), ["a", "b"]), "id") == [(2,), (3,)]


def test_oversample_and_smote(spark):
    df = spark.createDataFrame([(i, int(i < 3), float(i)) for i in range(20)], "id long, target int, x double")
    sizes = dict(prep.oversample(df, "target", "id").groupBy("target").count().collect())
    assert sizes == {0: 17, 1: 17}
    made = prep.smote(df, "target", 1, ["x"], "id", 10)
    assert made.count() == 10 and all(0 <= r["x"] <= 2 for r in made.collect())
    assert made.orderBy("x").collect() == prep.smote(df.repartition(3), "target", 1, ["x"], "id", 10).orderBy("x").collect()


def test_routing(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.4, 0.5), (0.4, 0.6)], "s double, e double")
    assert [r[0] for r in df.select(routing.ambiguous(F.col("s"), F.col("e"))).collect()] == [False, False, True]
    near = spark.createDataFrame([(i, 4) for i in range(4)], "sentence_index int, topic int")
    said = spark.createDataFrame([(0, "hr", 90), (1, "hr", 84), (2, "weather", 99)], "sentence_index int, topic string, probability int")
    assert rows(routing.override(near, said), "sentence_index", "final_topic") == [(0, 8), (1, -1), (2, -1), (3, 4)]
    raw = spark.createDataFrame([('{"topic": "hr", "explanation": "e", "probability": 90}',), ("no json",), (None,), ('{"topic": "hr", "explanation": "e", "probability": 900}',)], "answer string")
    assert [r["probability"] for r in routing.read_answers(raw).collect()] == [90, 0, 0, 0]
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "sentence_index int, position int, topic string")
    assert routing.latest(twice).first()["topic"] == "b"


def test_archives_and_answers(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("2020_10-K_a.txt", "ACCESSION NUMBER: 1\né")
        z.writestr("2020_10-Q_a.txt", "no")
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    (tmp_path / "empty.zip").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    got = files.read_archives(spark, str(tmp_path)).collect()
    assert [(r["entry"], r["text"][-1]) for r in got] == [("2020_10-K_a.txt", "é")]
    out = str(tmp_path / "answers")
    for p in (10, 20):
        files.append_answers(spark.createDataFrame([(1, "s", "p", "hr", "e", p)], files.ANSWERS), out)
    assert files.read_answers(spark, out).count() == 2
    assert files.Experiment.load(json.dumps({"sample": "cik_symbol"})).partition("lr")["sample"] == "cik_symbol"
    with pytest.raises(ValueError, match="no settings"):
        files.Experiment.load('{"sampel": 1}')


def test_stream_equals_batch(spark, tmp_path):
    data = [(1, dt.datetime(2024, 1, 1, h), h % 3, 0.5) for h in range(24)] + [(2, dt.datetime(2024, 1, 2, 1), 2, 0.9), (3, dt.datetime(2024, 1, 9), 0, 0.1)]
    spark.createDataFrame(data, "doc_id long, ts timestamp, sentiment_class int, sentiment_prob double").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    query = windowed_sentiment(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, windowed_sentiment(batch).collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, topic int, sentiment_class int, sentiment_prob double")
    assert not sentiment.sentiment_features(none, "basic").collect()
    assert not filings.within_zscore(spark.createDataFrame([], "n_words int")).collect()
    assert not vectors.centroids(spark.createDataFrame([], "embedding array<float>, label int")).collect()
