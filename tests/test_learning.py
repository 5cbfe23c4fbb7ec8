"""Learnt sentence boundaries, rule tables, the vector index, silhouettes by sums, as-of joins by ranges, boosting and Shapley values."""

import datetime as dt
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import rules, text
from brindle.operators import boosting, boundaries, joins, models, trees, vector_index, vectors

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# sentence boundaries

NAMES = "Smith Jones Miller Brown Garcia Chen Novak Weber".split()
PLACES = "Ohio Texas Berlin Geneva Lyon Austin".split()


def marked_sentences(n, seed):
    """Sentences with abbreviations, initials and numbers, whose bounds are known."""
    rng = random.Random(seed)
    name, place = lambda: rng.choice(NAMES), lambda: rng.choice(PLACES)
    noun = lambda: rng.choice("market plant company office report team plan list year cost".split())
    kinds = [
        lambda: f"The meeting with Dr. {name()} took place near the {noun()}.",
        lambda: f"Sales of {name()} Corp. and {name()} Inc. rose in the U.S. {noun()}.",
        lambda: f"We moved the {noun()} to {place()} in 199{rng.randint(0, 9)}.",
        lambda: f"It follows No. {rng.randint(2, 90)} of the {noun()}, as Mr. {name()} told the {noun()}.",
        lambda: f"The {noun()} of {rng.choice('ABCDEFG')}. {name()} was a late {noun()}!",
        lambda: f"Was the U.S. {name()} {noun()} part of the {noun()}?",
        lambda: f"The {noun()} of the {noun()} was approx. {rng.randint(2, 90)} million for a {noun()}.",
        lambda: f"They meet Prof. {name()} and the {noun()} with every {noun()}.",
        lambda: f"He left the {noun()} and a {noun()}.",
        lambda: f"In {place()} the {noun()} was slow as the {noun()}.",
        lambda: f"We sold the {noun()} to {name()} Inc.",
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def bounds(sentences):
    ends = list(itertools.accumulate(len("".join(s.split())) for s in sentences))
    return set(ends[:-1])


def test_learnt_sentences_on_marked_ones(spark):
    docs = [marked_sentences(40, k) for k in range(40)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    learnt = boundaries.learn(df)
    known = {r["type"] for r in learnt.abbreviations.collect()}
    assert {"dr", "corp", "inc", "u.s", "no", "mr", "prof", "approx"} <= known and not known & set("market plant company office report team plan list year cost".split())
    got = {}
    for r in boundaries.split_learnt(df, learnt).orderBy("doc_id", "pos").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    plain = {r["doc_id"]: r["s"] for r in df.select("doc_id", text.sentences(F.col("text")).alias("s")).collect()}

    def f1(of):
        right = sum(len(bounds(of[i]) & bounds(d)) for i, d in enumerate(docs))
        return 2 * right / sum(len(bounds(of[i])) + len(bounds(d)) for i, d in enumerate(docs))

    assert f1(got) >= 0.97 > 0.9 > f1(plain)
    joined = [s for own in got.values() for s in own]
    assert not any(re.search(r"(U\.S|No|Dr|Mr|Prof|Corp)\.$", s) for s in joined)
    assert all(" ".join(got[i]).split() == " ".join(d).split() for i, d in enumerate(docs))


def plain_counts(texts):
    out = Counter()
    for t in texts:
        words = re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")
        for i, w in enumerate(words):
            if re.sub(r"^[\W_]+|[^\w.]+$", "", w):
                out["" if i == 0 else words[i - 1] if words[i - 1][-1] in ".!?\"')]" else None, w] += 1
    return out


def test_counts_of_words_and_scores_by_hand(spark):
    texts = [" ".join(marked_sentences(30, k)) for k in range(5)] + [None, "", "  ", "one", 'He said "no." Then (it) went. \n\tNew\x0bline']
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = boundaries.word_counts(df)
    got = {(r["ahead"], r["word"]): r["n"] for r in counts.collect()}
    assert got == dict(plain_counts(texts))
    stop, bare = Counter(), Counter()
    for (_, w), n in got.items():
        core = re.sub(r"^[\W_]+|[^\w.]+$", "", w)
        kind = re.sub(r"\.+$", "", core)
        kind = "#" if re.fullmatch(r"[0-9][0-9.,/\-]*", kind) else kind.lower()
        (stop if re.search(r"[^.]\.$", core) else bare)[kind] += n
    p = sum(stop.values()) / (sum(stop.values()) + sum(bare.values()))
    want = {}
    for kind in set(stop):
        a, b, k = stop[kind], bare[kind], len(kind.replace(".", ""))
        score = 2 * (a * math.log(0.99) + b * math.log(0.01) - a * math.log(p) - b * math.log(1 - p)) * math.exp(-k) * (len(kind) - k + 1) * float(k) ** -b
        if kind != "#" and score >= boundaries.ABBREVIATION:
            want[kind] = (a, b, round(score, 9))
    assert {r["type"]: (r["n_stop"], r["n_bare"], round(r["score"], 9)) for r in boundaries.abbreviations(counts).collect()} == want


def test_sentences_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    learnt = boundaries.learn(empty)
    assert not learnt.abbreviations.collect() and not learnt.openers.collect() and not boundaries.split_learnt(empty, learnt).collect()
    rows = [(None, "Ann ran. Two are."), (1, "An owl. Cats do."), (1, "An owl. Cats do."), (2, None), (3, ""), (4, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("x")).withColumn("type", F.lit(1))
    got = sorted((str(r["doc_id"]), r["pos"], r["sentence"], r["piece"]) for r in boundaries.split_learnt(df, learnt).collect())
    assert got == [("1", 0, "An owl.", "x")] * 2 + [("1", 1, "Cats do.", "x")] * 2 + [("None", 0, "Ann ran.", "x"), ("None", 1, "Two are.", "x")]


# rule tables


def random_rules(rng, words, n):
    def one():
        a, b = rng.choice(words), rng.choice(words)
        return [(f"{a} {b}", a + b), (rf"\b{a}\b", b), (f"{a}|{b}{a}", ""), (rf"({a})\s+({b})", r"\2\1"), (f"{a}+", b), (f"(?i){a.upper()}", b), (rf"[{a}]{b}", a), (rf"(?:{a}x?)?{b}", a), (rf"{a}(?= {b})", "")][rng.randint(0, 8)]

    return tuple(one() for _ in range(n))


def test_rule_tables_are_sequential_substitution(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 10, 100]))) + rng.choice(["", "\n", " Don't TextBox", " U.S. 12"]) for _ in range(40)]
    for k in range(12):
        of = random_rules(rng, words, 330)
        if k % 3 == 0:
            of = rules.with_rules(text.GENERAL_RULES, of, text.contractions())
        table = rules.RuleTable(of)
        for t in texts:
            want = t
            for pattern, new in of:
                want = re.sub(pattern, new, want)
            assert table.apply(t) == want
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string")
    got = df.select(rules.rewrite(F.col("t"), of).alias("a"), text.replace_rules_in_batches(F.col("t"), of).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[-1]["a"] is None


def test_literals_of_patterns():
    cases = {"supply chain": {"supply chain"}, r"\b\w{31,}\b": None, "a|bc": {"a", "bc"}, "(?:ab)?c": {"c"}, "(?:ab){2,}": {"ab"}, "(?i)ab": None, r"\S*\.com\S*|x": {".com", "x"}, "a.bcd": {"bcd"}, "[ab]": None, r"x(?=yyy)": {"x"}, "": None}
    assert {p: (None if (found := rules.literals(p)) is None else set(found)) for p in cases} == cases


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([(2, "b", "c"), (1, "a", "b"), (3, None, "x"), (4, "c c", None)], "place int, pattern string, replacement string")
    of = rules.read_rules(table)
    assert of == (("a", "b"), ("b", "c"), ("c c", ""))
    phrases = spark.createDataFrame([("going concern", 1), ("m&a deal", 0)], "phrase string, place int")
    made = rules.read_rules(rules.compounds(phrases))
    assert rules.RuleTable(made).apply("a going concern, m&a deal") == "a goingconcern, m&adeal"


# vectors


def clustered(n, d, k, seed, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d))
    lab = rng.integers(0, k, n)
    return (centres[lab] + rng.normal(size=(n, d)) * spread).astype(float), lab


@pytest.mark.parametrize("rows", [8192, 16])
def test_index_finds_most_neighbours(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(vector_index, "LIST_ROWS", rows)
    x, _ = clustered(3000, 16, 12, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    vector_index.build(df, str(tmp_path))
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = vectors.nearest(asked, df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10, others=True)
    found = vector_index.search(spark, asked, str(tmp_path), 10, others=True).collect()
    table = spark.createDataFrame(found)
    assert len(found) == 600 and vector_index.recall(table, exact) >= 0.9
    held = {(r["q"], r["neighbour"]): r["distance"] for r in exact.collect()}
    assert all(abs(held[r["q"], r["neighbour"]] - r["distance"]) < 1e-9 for r in found if (r["q"], r["neighbour"]) in held)
    lists = spark.read.parquet(f"{tmp_path}/centres").count()
    whole = vector_index.search(spark, asked, str(tmp_path), 10, probes=lists, others=True)
    assert vector_index.recall(whole, exact) == 1.0


def test_index_of_the_tables_rows(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vector_index.build(df, str(tmp_path))
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = vectors.nearest(asked, df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10, others=True)
    assert vector_index.recall(vector_index.search(spark, asked, str(tmp_path), 10, others=True), exact) >= 0.9


ODD = [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [math.nan, 1.0, 1.0], 1), (104, [0.0, 0.0, 0.0], 1), (105, [1.0, 2.0], 1), (106, [math.inf, 0.0, 0.0], 2)]


def test_odd_vectors(spark, tmp_path):
    x, lab = clustered(40, 3, 3, 2)
    schema = "vec_id long, embedding array<double>, label int"
    good = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, lab, strict=True))]
    df, own = spark.createDataFrame(good + ODD + [(107, [1.0, 1.0, 1.0], None)], schema), spark.createDataFrame(good, schema)
    of = vectors.centroids(own)
    assert {r["vec_id"] for r in vectors.topic_distances(df, of).collect()} == {*range(40), 107}
    assigned = {r["vec_id"]: r for r in vectors.assign_topics(df, of).collect()}
    assert len(assigned) == 48 and all(assigned[i]["topic"] is None and assigned[i]["distance"] is None and assigned[i]["entropy"] is None for i, *_ in ODD)
    for made in (vectors.silhouettes, vectors.cosine_silhouettes):
        whole, some = ({r["vec_id"]: r["silhouette"] for r in made(t, 1).collect()} for t in (df.where("vec_id <> 104"), own))
        assert whole.keys() == set(range(40)) and all(abs(whole[i] - some[i]) < 1e-9 for i in whole)
    pairs = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = vectors.nearest(pairs, pairs, 2, others=True).collect()
    assert {r["q"] for r in near} == {*range(40), 104, 107}
    vector_index.build(df, str(tmp_path))
    assert {r["q"] for r in vector_index.search(spark, pairs, str(tmp_path), 2).collect()} == {*range(40), 107}
    vector_index.build(df.limit(0), f"{tmp_path}/none")
    assert not vector_index.search(spark, pairs, f"{tmp_path}/none", 2).collect()


def test_cosine_silhouettes_are_those_of_pairs(spark):
    x, lab = clustered(150, 5, 4, 3)
    lab[0] = 9
    x[5] = x[6]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<double>, label int")
    found = vectors.cosine_silhouettes(df)
    text_of = plan(found)
    assert "Cartesian" not in text_of and "Pandas" not in text_of
    got = {r["vec_id"]: r["silhouette"] for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    far = 1 - u @ u.T
    for i in range(150):
        own = [j for j in range(150) if lab[j] == lab[i] and j != i]
        b = min(far[i, lab == k].mean() for k in set(lab) - {lab[i]})
        want = (b - far[i, own].mean()) / max(b, far[i, own].mean()) if own else 0.0
        assert abs(got[i] - want) < 1e-9
    one = vectors.cosine_silhouettes(df.withColumn("label", F.lit(1))).collect()
    assert {r["silhouette"] for r in one} == {0.0}


# as-of joins


def plain_asof(left, right, by):
    out = []
    for r in left:
        fit = [t for t in right if t[1] is not None and r[2] is not None and t[1] <= r[2] and (not by or t[0] == r[1])]
        best = max(fit, key=lambda t: (t[1], t[2]), default=None)
        out.append((*r, best[3] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("by", [True, False])
def test_asof_over_ranges_is_brute_force(spark, by):
    rng = random.Random(8)
    keys = ["a", "b", None]
    right = [(rng.choice(keys), rng.choice([None, *range(200)]), rng.random(), float(i)) for i in range(150)] + [("a", -(10**6), 0.0, -1.0)]
    left = [(i, rng.choice(keys), rng.choice([None, 77, 77, 77, *range(-10, 260)])) for i in range(300)]
    r, df = spark.createDataFrame(right, "k string, t long, o double, v double"), spark.createDataFrame(left, "id int, k string, at long")
    got = joins.asof(df, r, "at", "t", ["v"], ["k"] if by else None, order="o")
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_asof(left, right, by)
    windows = re.findall(r"Window \[.*windowspecdefinition\((.*?), specifiedwindowframe", plan(got))
    assert windows and all("__b" in w for w in windows)
    if not by:
        small = joins.asof_small(df, r, "at", "t", ["v"], order="o")
        assert sorted((tuple(x) for x in small.collect()), key=str) == plain_asof(left, right, by)
        assert "Window" not in plan(small) and "NestedLoop" not in plan(small)


def test_asof_names_that_clash_and_empty_sides(spark):
    day = dt.date(2001, 2, 3)
    left = spark.createDataFrame([(day, 1, 2, 3, 4.0)], "from date, until int, __slot int, v int, date double")
    right = spark.createDataFrame([(day, 7.0, 1)], "date date, v double, until int")
    for made in (joins.asof, joins.asof_small):
        got = made(left, right, "from", "date", ["v", "until"])
        assert got.columns == [*left.columns, "v_right", "until_right"] and tuple(got.first()) == (day, 1, 2, 3, 4.0, 7.0, 1)
        assert made(left, right.limit(0), "from", "date", ["v"]).first()["v_right"] is None and not made(left.limit(0), right, "from", "date", ["v"]).collect()


def test_one_outlying_tick_costs_nothing(spark):
    ticks = spark.range(20_000).selectExpr("id as t", "cast(id as double) as v").union(spark.createDataFrame([(-(10**15), -1.0)], "t long, v double"))
    asks = spark.range(50_000).selectExpr("id", "id % 30000 as at")
    found = joins.asof_small(asks, ticks, "at", "t", ["v"])
    joined = found.where("v <> least(at, 19999)").count()
    assert joined == 0 and found.count() == 50_000
    # each row meets one tick
    assert found.where("v is null").count() == 0


# trees


def by_subsets(known, x, columns):
    """Shapley values over all subsets of columns, from the trees themselves."""

    def value(tree, node, row, seen):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        a, b = tree.left[node], tree.right[node]
        if f in seen:
            go = tree.missing_left[node] if math.isnan(row[f]) else row[f] <= tree.threshold[node]
            return value(tree, a if go else b, row, seen)
        return sum(value(tree, c, row, seen) * tree.cover[c] / tree.cover[node] for c in (a, b))

    out = np.zeros((len(x), columns))
    for r, row in enumerate(x):
        v = {s: sum(value(t, 0, row, s) for t in known) for k in range(columns + 1) for s in map(frozenset, itertools.combinations(range(columns), k))}
        for j in range(columns):
            for s in v:
                if j not in s:
                    out[r, j] += math.factorial(len(s)) * math.factorial(columns - 1 - len(s)) / math.factorial(columns) * (v[s | {j}] - v[s])
    return out


def rows_with_gaps(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([1.0, 2.0, 3.0])
        gone = rng.random() < 0.3
        p = 1 / (1 + math.exp(-(2 * a * (b > 0) + (3 if gone else -1) + 0.5 * c)))
        out.append((i, int(rng.random() < p), None if gone else a, math.nan if rng.random() < 0.05 else b, c, 5.0, rng.random() < 0.25))
    return out


COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def boosted(spark):
    df = spark.createDataFrame(rows_with_gaps(4000, 9), "id long, target int, a double, b double, c double, d double, held_out boolean").repartition(4).cache()
    return df, boosting.fit(df, COLUMNS, rounds=40, patience=5, rate=0.3, subsample=1.0)


def test_boosting_stops_and_uses_missing_values(spark, boosted):
    df, model = boosted
    assert 3 <= len(model.trees) < 40 and len(model.losses) == min(len(model.trees) + 5, 40)
    assert len(model.trees) == int(np.argmin(model.losses)) + 1 and model.losses[0] > min(model.losses)
    got = boosting.predict(df.where("held_out"), model).select("target", "prob").collect()
    loss = -np.mean([math.log(r["prob"] if r["target"] else 1 - r["prob"]) for r in got])
    assert abs(loss - min(model.losses)) < 1e-5
    assert any(t.feature[k] == 0 and math.isfinite(t.threshold[k]) for t in model.trees for k in range(len(t.feature)))
    # a missing value differs from any filled-in one
    asked = spark.createDataFrame([(None,), (-1.0,), (0.0,), (1.0,)], "a double").withColumns({c: F.lit(1.0) for c in "bcd"})
    probs = [r["prob"] for r in boosting.predict(asked, model).collect()]
    assert probs[0] > 0.85 and probs[1] < 0.5


def test_boosting_is_no_worse_than_the_librarys(spark, boosted):
    from brindle.functions import stats

    df, model = boosted
    test = df.where("held_out")
    mine = stats.roc_auc(boosting.predict(test, model), "prob", "target").first()["auc"]
    theirs = models.classify("gbt", df.where("not held_out"), test, COLUMNS, maxIter=20, balanced=False)
    assert mine >= stats.roc_auc(theirs, "prob", "target").first()["auc"] - 0.005


def test_boosting_of_odd_tables(spark, boosted):
    df, _ = boosted
    assert boosting.fit(df.limit(0), COLUMNS).trees == []
    one = boosting.fit(df.where("target = 1"), COLUMNS, rounds=2)
    assert boosting.predict(df.limit(3), one).where("prob > 0.99").count() == 3
    without = boosting.fit(df.withColumn("held_out", F.lit(None).cast("boolean")).withColumn("a", F.lit(None).cast("double")), COLUMNS, rounds=3)
    assert len(without.trees) == 3 and without.losses == [] and all(f != 0 for t in without.trees for f in t.feature)


def test_shapley_values_are_those_of_all_subsets(spark, boosted):
    df, model = boosted
    rng = np.random.default_rng(10)
    x = rng.normal(size=(12, 4))
    x[0, 0] = x[1, 1] = np.nan
    deep = boosting.fit(df, COLUMNS, rounds=3, depth=4, rate=0.5)
    for made in (model.trees, deep.trees):
        known = [p for t in made for p in trees.paths(t)]
        got = trees.shapley(known, x, 4)
        assert np.allclose(got.sum(axis=1) + trees.expected(made), trees.predicted(made, x)) and np.allclose(got, by_subsets(made, x, 4))


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_shapley_values_of_the_librarys_trees(spark, boosted, kind):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df, _ = boosted
    rows = VectorAssembler(inputCols=["b", "c", "e"], outputCol="features").transform(df.withColumn("e", F.coalesce("a", F.lit(9.0))).where("not isnan(b)"))
    learner = RandomForestClassifier(labelCol="target", maxDepth=4, numTrees=5, seed=1) if kind == "rf" else GBTClassifier(labelCol="target", maxDepth=3, maxIter=4, seed=1)
    model = learner.fit(rows)
    of = trees.spark_trees(model)
    some = rows.limit(30)
    got = trees.contributions(some, of, ["b", "c", "e"]).collect()
    raw = [r["p"] for r in model.transform(some).select(F.col("rawPrediction").alias("p")).collect()]
    for r, p in zip(got, raw, strict=True):
        margin = p[1] / sum(p) if kind == "rf" else p[1]
        assert abs(sum(r["contributions"]) + trees.expected(of) - margin) < 1e-6
    x = np.array([[r["b"], r["c"], r["e"]] for r in got[:6]])
    assert np.allclose([r["contributions"] for r in got[:6]], by_subsets(of, x, 3))
    means = {r["column"]: r["mean_abs"] for r in trees.mean_contributions(some, of, ["b", "c", "e"]).collect()}
    assert abs(means["b"] - np.mean([abs(r["contributions"][0]) for r in got])) < 1e-9


# resampling


def hashes(spark, n, seed, rounds):
    rows = spark.range(n).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    rows = rows.withColumns({"ticker": F.concat(F.lit("t"), (F.col("id") % 37).cast("string")), "year": (F.col("id") / 37).cast("int")})
    return rows.withColumns({"h": F.xxhash64("ticker", "year", "round", F.lit(seed)), "g": F.xxhash64(F.struct("ticker", "year"), "round", F.lit(seed)), "y": F.xxhash64("year", "round", F.lit(seed))}).collect()


def positions(spark, n):
    rng = random.Random(12)
    data = [(f"t{i % 37}", i // 37, rng.choice([0, 1, 1]), rng.gauss(0.1, 1), rng.uniform(1, 5)) for i in range(n)]
    return data, spark.createDataFrame(data, "ticker string, year int, position int, excess_return double, market_cap double").repartition(3)


@pytest.mark.parametrize("weighted", [False, True])
def test_permutations_are_those_of_sorted_hashes(spark, weighted):
    from brindle.operators import portfolio

    n, rounds = 400, 30
    data, df = positions(spark, n)
    order = {}
    for r in hashes(spark, n, 42, rounds):
        order.setdefault(r["round"], []).append((r["h"], r["ticker"], r["year"]))
    value = {(t, y): (x, c if weighted else 1.0) for t, y, _, x, c in data}
    mean = lambda keys: sum(value[k][0] * value[k][1] for k in keys) / sum(value[k][1] for k in keys)
    longs = [(t, y) for t, y, p, *_ in data if p == 1]
    shorts = [(t, y) for t, y, p, *_ in data if p == 0]
    real, two, one = mean(longs) - mean(shorts), 0, 0
    for own in order.values():
        keys = [k[1:] for k in sorted(own)]
        h = mean(keys[: len(longs)]) - mean(keys[len(longs) :])
        two, one = two + (abs(h) >= abs(real)), one + (h >= real)
    got = portfolio.permutation_hedge(df, rounds, weighted=weighted).first()
    assert abs(got["hedge_return"] - real) < 1e-9 and (got["p_two_sided"], got["p_one_sided"]) == (two / rounds, one / rounds)
    assert portfolio.permutation_hedge(df.where("position = 1"), rounds).first()["p_two_sided"] is None


@pytest.mark.parametrize("by_year", [False, True])
def test_bootstrap_of_hedges_by_the_same_hashes(spark, by_year):
    from brindle.functions.stats import poisson_cuts
    from brindle.operators import portfolio

    n, rounds = 300, 25
    data, df = positions(spark, n)
    cuts = poisson_cuts()
    times = {(r["round"], r["ticker"], r["year"]): sum(((r["y"] if by_year else r["g"]) % (1 << 30)) / (1 << 30) >= c for c in cuts) for r in hashes(spark, n, 42, rounds)}
    drawn = []
    for k in range(1, rounds + 1):
        side = {p: (sum(times[k, t, y] * x for t, y, q, x, _ in data if q == p), sum(times[k, t, y] for t, y, q, *_ in data if q == p)) for p in (0, 1)}
        drawn.append(side[1][0] / side[1][1] - side[0][0] / side[0][1])
    got = portfolio.bootstrap_hedge(df, rounds, by_year=by_year).first()
    assert abs(got["mean"] - np.mean(drawn)) < 1e-9 and np.allclose([got["low"], got["high"]], np.percentile(drawn, [2.5, 97.5]))


@pytest.mark.parametrize("ties", [False, True])
def test_bootstrap_of_aucs_by_the_same_hashes(spark, ties):
    from brindle.functions import stats

    rng = random.Random(13)
    data = [(i, (0.5 if rng.random() < 0.4 else round(rng.random(), 1)) if ties else rng.random(), int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(data + [(900, None, 1), (901, 0.5, None), (902, math.nan, 0)], "id long, prob double, label int").repartition(3)
    h = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id", F.lit(42)).alias("h")).collect()}
    rounds = 20
    w = stats.poisson_weights(np.array([h[i] for i, *_ in data]), np.arange(1, rounds + 1))
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    p, y = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    wins = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
    aucs = [(w[:, k] * (y == 1)) @ wins @ (w[:, k] * (y == 0)) / (w[y == 1, k].sum() * w[y == 0, k].sum()) for k in range(rounds)]
    got = stats.bootstrap_auc(df, rounds).first()
    assert abs(got["mean_auc"] - np.mean(aucs)) < 1e-9 and got["p"] == np.mean(np.array(aucs) <= 0.5)
    assert stats.bootstrap_auc(df.where("label = 1"), 3).first()["mean_auc"] is None


def test_scores_of_a_narrow_range(spark):
    """All scores in a thousandth: areas are exact, and no range has them all."""
    from brindle.functions import stats

    df = spark.range(2000).selectExpr("id", "0.5 + id * 37 % 1999 / 4000000.0 as prob", "cast(id % 3 = 0 as int) as label").withColumn("prob", F.col("prob").cast("double"))
    p, y = (np.array([r[c] for r in df.collect()]) for c in ("prob", "label"))
    want = ((p[y == 1][:, None] > p[y == 0][None, :]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :])).mean()
    assert abs(stats.roc_auc(df).first()["auc"] - want) < 1e-12
    dealt = stats._running(stats._by_score(df, "prob", "label"), ["pos"]).groupBy("__b").count().collect()
    assert len(dealt) > 200 and max(r["count"] for r in dealt) < 30


def test_runs_of_words_with_bounds(spark):
    from brindle.operators import topics

    docs = [("a", "red fox red fox"), ("a", "red fox runs"), ("b", "blue sky"), ("b", None), ("b", ""), (None, "red fox"), ("-1", "red fox")]
    df = spark.createDataFrame(docs, "topic string, text string")
    count = lambda **o: sorted(map(tuple, topics.ngram_counts(df, **o).collect()))
    assert count(lengths=(2, 2)) == [("a", "fox red", 1), ("a", "fox runs", 1), ("a", "red fox", 3), ("b", "blue sky", 1)]
    assert count(lengths=(1, 2), least=0.4) == [("a", "fox", 3), ("a", "red", 3), ("a", "red fox", 3)]
    assert count(most=0.2, vocabulary=2) == [("a", "runs", 1), ("b", "blue", 1)]
    assert count(lengths=(1, 1)) == sorted(map(tuple, topics.term_counts(df).collect()))
