"""Ranks, quantiles, neighbours and as-of lookups against plain versions, and what their plans may not hold."""

import datetime as dt
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import stats, text
from brindle.operators import joins, prep, ranks, routing, sentences, vectors
from brindle.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    cases = {
        "few": [1.0, 2.0], "one": [3.5], "ties": [1.0] * 50 + [2.0] * 30, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 300) for _ in range(3000)],
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "hot": [0.0] * 2000 + [rng.random() for _ in range(1000)],
    }
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    for name, values in cases.items():
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(3)
        got = ranks.quantiles(df, ["x"], shares).first()["x"]
        assert got == df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0], name
    two = spark.createDataFrame([(1, None, 5), (3, None, None)], "a int, b double, `c.d` long")
    assert [list(r) if r else r for r in ranks.quantiles(two, ["a", "b", "c.d"], (0.5,)).first()] == [[2.0], None, [5.0]]
    assert ranks.quantiles(two.limit(0), ["a"], (0.5,)).first()["a"] is None
    with pytest.raises(ValueError, match="between"):
        ranks.quantiles(two, ["a"], (2.0,))


def test_ranks_are_those_of_a_whole_sort(spark):
    rows = [(i, random.Random(i).choice("abc")) for i in range(3000)] + [(None, "a"), (7, None), (7, None)]
    got = ranks.ranked(spark.createDataFrame(rows, "id long, s string"), ["s"], "id").collect()
    for s in ("a", "b", "c", None):
        own = sorted((r for r in got if r["s"] == s), key=lambda r: r["__r"])
        assert [r["__r"] for r in own] == list(range(len(own))) and {r["__n"] for r in own} == {len(own)}
        known = [r["id"] for r in own if r["id"] is not None]
        assert known == sorted(known, key=lambda i: (zlib.crc32(f"{i}/42".encode()), i))
    assert not ranks.ranked(spark.createDataFrame([], "id long, s string"), ["s"], "id").collect()


@pytest.mark.parametrize("sent", [8_000_000, 0])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_is_brute_force(spark, monkeypatch, sent, metric):
    monkeypatch.setattr(vectors, "MOST_SENT", sent)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    x = np.random.default_rng(2).integers(-2, 3, (150, 4)).astype(float) + 0.25
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 4), (999, None)], "id long, v array<double>")
    got = {(r["q"], r["rank"]): (r["neighbour"], r["distance"]) for r in vectors.nearest(df.where("id % 5 = 0"), df, 3, metric, others=True).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    far = 1 - u @ u.T if metric == "cosine" else ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for q in range(0, 150, 5):
        best = sorted((i for i in range(150) if i != q), key=lambda i: (round(far[q, i], 12), i))[:3]
        assert [got[q, k + 1][0] for k in range(3)] == best and np.allclose([got[q, k + 1][1] for k in range(3)], far[q, best])
    assert len(got) == 90 and not vectors.nearest(df, df.limit(0), 3, metric).collect()


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_silhouettes_by_blocks(spark, metric):
    x = np.random.default_rng(3).normal(size=(120, 3))
    lab = [i % 4 if i < 119 else 9 for i in range(120)]
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<double>, label int")
    whole = {r["vec_id"]: r for r in vectors.silhouettes(df, 2, metric=metric).collect()}
    parts = {r["vec_id"]: r for r in vectors.silhouettes(df, 2, metric=metric, block_rows=9).collect()}
    assert len(whole) == 120 and whole[119]["silhouette"] == 0
    y = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(120):
        mates = [j for j in range(120) if whole[j]["fold"] == whole[i]["fold"] and j != i]
        d = {j: (1 - y[i] @ y[j] if metric == "cosine" else np.linalg.norm(x[i] - x[j])) for j in mates}
        own = [d[j] for j in mates if lab[j] == lab[i]]
        if own:
            b = min(np.mean([d[j] for j in mates if lab[j] == k]) for k in {lab[j] for j in mates} - {lab[i]})
            assert abs(whole[i]["silhouette"] - (b - np.mean(own)) / max(b, np.mean(own))) < 1e-9
        assert abs(whole[i]["silhouette"] - parts[i]["silhouette"]) < 1e-9


def test_asof_small_is_asof(spark):
    rng = random.Random(4)
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(i)
    ticks = [(day(i), float(i)) for i in sorted(rng.sample(range(100), 12))] + [(day(20_000), 1.0), (None, 2.0)]
    asks = [(k, day(i)) for k, i in enumerate([-5, 0, 50, 99, 101, 19_999, 20_000, 30_000, *range(100)])] + [(900, None)]
    right, left = spark.createDataFrame(ticks, "d date, v double"), spark.createDataFrame(asks, "id int, t date")
    got = joins.asof_small(left, right, "t", "d", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, joins.asof(left, right, "t", "d", ["v"]).collect()), key=str)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    none = joins.asof_small(left, right.limit(0), "t", "d", ["v"]).collect()
    assert len(none) == len(asks) and all(r["v"] is None for r in none)
    stamps = spark.createDataFrame([(dt.datetime(2000, 1, 1, 5), 1), (dt.datetime(2000, 1, 3), 2)], "at timestamp, v int")
    for kind in ("timestamp", "timestamp_ntz"):
        got = joins.asof_small(left.where("id in (1, 2, 9, 10)"), stamps.withColumn("at", F.col("at").cast(kind)), "t", "at", ["v"]).orderBy("id").collect()
        assert [(r["id"], r["v"]) for r in got] == [(1, None), (2, 2), (9, 1), (10, 2)]


def test_smote_lies_between_neighbours(spark):
    rng = random.Random(5)
    data = [(i, int(i % 5 == 0), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "id long, target int, a double, b double")
    made = prep.smote(df, "target", 1, ["a", "b"], "id").collect()
    own = {i: np.array([a, b]) for i, t, a, b in data if t}
    assert len(made) == 240 - 60 and {r["target"] for r in made} == {1}
    for r in made:
        near = sorted((j for j in own if j != r["id"]), key=lambda j: ((own[j] - own[r["id"]]) ** 2).sum())[:5]
        x, p = own[r["id"]], np.array([r["a"], r["b"]])
        assert any(abs(np.linalg.norm(p - x) + np.linalg.norm(own[j] - p) - np.linalg.norm(own[j] - x)) < 1e-9 for j in near)


def test_plans_have_no_whole_sorts(spark):
    """Windows without keys run over buckets alone, and no aggregate holds all values of a column."""
    scored = spark.range(1000).selectExpr("id", "(id * 37 % 101) / 101 as prob", "cast(id % 3 = 0 as int) as label")
    for df in (stats.pr_summary(scored), stats.roc_auc(scored), prep.stratified_split(scored, "label", "id")):
        windows = re.findall(r"Window \[.*windowspecdefinition\((.*?), specifiedwindowframe", plan(df))
        assert windows and all("__b" in w for w in windows)
    wide = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    assert not re.search(r"[^_]percentile\(", plan(prep.iqr_bounds(wide, ["x"])))


def test_rules_by_python(spark):
    rng = random.Random(6)
    parts = ["u.s. ", "e.u.", "the ", "xyz ", "http://a.b/c ", "www.x.org", "a@b.c ", "q3 2020 ", "\n", "Item 1\n", "long" * 9, " (at) ", "I'm ", "they've ", "doesn't ", "x.com/y ", "LTRect1 ", "/n", ";", ". "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 20))) for _ in range(300)] + [None]
    rules = text.contractions() + text.GENERAL_RULES
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", text.replace_rules(F.col("t"), rules).alias("a"), text.replace_rules_in_batches(F.col("t"), rules).alias("b")).collect()
    for r in got:
        t = texts[r["id"]]
        if t is not None:
            t = t.lower()
            for pattern, new in rules:
                t = re.sub(pattern, new, t)
            t = re.sub(r"\s+", " ", t).strip()
        assert r["a"] == r["b"] == t
    assert dict(text.contractions())[r"\bwe've\b"] == "we have" and len(text.GENERAL_RULES) == 22


def test_keywords_with_lists(spark):
    df = spark.createDataFrame([("Wholesale prices",), ("sales and wholesale",), ("sale of stock",), ("M&A",), (None,)], "sentence string")
    got = [r["topics"] for r in sentences.keyword_topics(df, blacklist=("wholesal",), exclusions={0: ("stock",)}).collect()]
    assert got == [[], [0], [], [5], None]
    assert sentences.keyword_topics(df).first()["topics"] == [0]


def test_later_answers_replace_earlier_ones(spark, tmp_path):
    out = str(tmp_path / "a")
    for p, rows in ((1, 400), (2, 1)):
        files.append_answers(spark.createDataFrame([(k, "s", "p" * 50, "hr", "e", p) for k in range(rows)], files.ANSWERS).coalesce(1), out)
        time.sleep(1.1)
    got = {r["sentence_index"]: r["probability"] for r in routing.latest(files.read_answers(spark, out)).collect()}
    assert got[0] == 2 and got[1] == 1 and len(got) == 400


def test_calls_go_side_by_side_and_stay_in_place(spark):
    def load():
        def model(text):
            time.sleep(0.4 if text.endswith("0") else 0.25)
            if text == "p7":
                raise RuntimeError
            return text.upper()

        return model

    df = spark.createDataFrame([(i, f"p{i}") for i in range(64)] + [(99, None)], "id int, prompt string").coalesce(1)
    began = time.monotonic()
    got = {r["id"]: r["answer"] for r in routing.ask(df, load).collect()}
    assert time.monotonic() - began < 12 and got == {i: None if i in (7, 99) else f"P{i}" for i in [*range(64), 99]}
    began = time.monotonic()
    assert routing.ask(df.limit(10), load, per_second=20).where("answer is not null").count() == 9 and time.monotonic() - began > 0.4
    with pytest.raises(ValueError, match="at least"):
        routing.ask(df, load, at_once=0)
    assert routing.instruction_text().count("\n") == len(sentences.TOPIC_NAMES) and "competitors" in routing.instruction_text()


def test_vectors_classes_and_catalogue(spark, tmp_path):
    for k in (2, 1):
        spark.createDataFrame([(k * 10 + i, [float(i)]) for i in range(3)], "id int, v array<double>").coalesce(1).write.parquet(f"{tmp_path}/vectors/batch_{k}")
    of = files.Catalogue(str(tmp_path), vectors="vectors/batch_*")
    assert {r["id"]: r["row"] for r in of.load(spark, "vectors").collect()} == {k * 10 + i: i for k in (1, 2) for i in range(3)}
    with pytest.raises(ValueError, match="no table"):
        of.load(spark, "root")

    def load():
        return lambda texts: np.array([[len(t), 3.0, 0.0] for t in texts])

    df = spark.createDataFrame([("ab",), ("abcde",), (None,)], "t string")
    got = vectors.classified(df, load, "t", ("long", "short", "none"), "fls_").collect()
    assert [(r["fls_class"], r["fls_label"]) for r in got] == [(1, "short"), (0, "long"), (None, None)] and got[2]["fls_prob"] is None


def test_additions_and_importances(spark):
    from brindle.operators import models, sentiment

    known = spark.createDataFrame([(1, "A", 0), (2, "B", 5)], "cik int, ticker string, pos int")
    both = sentiment.with_additions(known, spark.createDataFrame([(2, "BB"), (3, "C")], "cik int, ticker string")).collect()
    last = {}
    for r in sorted(both, key=lambda r: r["pos"]):
        last[r["cik"]] = r["ticker"]
    assert last == {1: "A", 2: "BB", 3: "C"}
    rows = [(int(i % 4 == 0), float(i % 4 == 0) if i % 9 else None, float(i % 7)) for i in range(200)]
    got = {r["column"]: r["importance"] for r in models.importances(spark.createDataFrame(rows, "target int, a double, b double"), ["a", "b"], trees=20).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > 0.8
