"""License templates, whitening and resampling against brute force; places of rows."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import common, license_scan, mixing, resampling, whitening
from brindle.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


# license templates


def plain_scan(text, templates, percent):
    w = plain_words(text)
    starts = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in license_scan.PHRASES}
    base = sorted({label for label, at in starts.items() if at})
    places = sorted(i for at in starts.values() for i in at)
    found, best = set(base), 1.0 if places else 0.0
    for label, t in templates:
        own, span = set(plain_words(t)), license_scan.class_of(len(plain_words(t)))
        for s in range(0, max(1, len(w) - span), span):
            held = len(own & set(w[s : s + 2 * span]))
            if own and 100 * held >= percent * len(own):
                found.add(label)
                best = max(best, held / len(own))
    return (len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), ",".join(sorted(found)), best)


def texts_with_licenses(seed=3):
    rng = random.Random(seed)
    fill = "the of and license software any copy 2 0 permission notice über gate river stone with public free".split()
    out = [None, "", "   \n", "CC-BY", "cc by cc by", "ALL RIGHTS  reserved\nall rights", "Kelvin GNU Lesser General Public License İ"]
    for _ in range(150):
        words = [rng.choice(fill) for _ in range(rng.choice([0, 2, 30, 200]))]
        for _ in range(rng.randint(0, 2)):
            own = re.findall(r"\S+", rng.choice(license_scan.TEMPLATES)[1])
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                own[rng.randrange(len(own))] = rng.choice(fill)
            at = rng.randint(0, len(words))
            words[at:at] = own
        out.append(rng.choice([" ", "\n", ", "]).join(words))
    out.append(" ".join(rng.choice(fill) for _ in range(30_000)) + " released under the MIT License " + "x " * 500)
    return out


@pytest.mark.parametrize("percent", [70, 90, 100])
def test_licenses_are_brute_force(spark, percent):
    texts = texts_with_licenses()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(docs, percent=percent).collect()}
    assert got == {i: plain_scan(t, license_scan.TEMPLATES, percent) for i, t in enumerate(texts)}
    assert sum(len(v[5].split(",")) > len(v[4].split(",")) for v in got.values()) > 20


def test_licenses_of_odd_tables(spark):
    same = "all rights reserved"
    docs = spark.createDataFrame([(None, same, 1), (5, same, 2), (5, same, 3), (5, "other", 4), (None, None, 5)], "doc_id long, text string, w int")
    docs = docs.withColumns({"labels": F.lit(1), "score": F.lit("s"), "word": F.lit("x"), "__place": F.lit(0), "block": F.lit(0)})
    got = sorted((tuple(r) for r in license_scan.scan_licenses(docs).collect()), key=str)
    hit = (3, 1, 0, 0, "reserved", "reserved", 1.0)
    assert got == sorted([(None, *hit), (5, *hit), (5, *hit), (5, 1, 0, None, None, "", "", 0.0), (None, 0, 0, None, None, "", "", 0.0)], key=str)
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []
    assert license_scan.scan_licenses(docs, templates=(), phrases=()).where("labels <> '' or score <> 0").count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(docs, percent=0)


def test_license_scan_stays_in_the_jvm(spark):
    plan = QUERIES["op11_license_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# whitening


def test_limbs_and_products_are_exact():
    rng = random.Random(4)
    for bits in (3, 17, 18, 19, 40, 61, 90):
        rows = [[rng.randint(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(40)] + [[1 << bits, -(1 << bits)] + [0] * 3]
        y = np.array(rows, np.int64 if bits < 62 else object)
        count = whitening.limb_count(1 << bits)
        limbs = whitening.limbs_of(y, count)
        assert all(np.abs(limb).max() <= 1 << whitening.LIMB_BITS for limb in limbs)
        assert all(sum(int(limb[r, c]) << (whitening.LIMB_BITS * k) for k, limb in enumerate(limbs)) == rows[r][c] for r in range(len(rows)) for c in range(5))
        products = whitening.OuterProducts(5, count)
        products.add(y[:20])
        products.add(y[20:])
        got = products.sum()
        assert [[int(v) for v in row] for row in got] == [[sum(r[i] * r[j] for r in rows) for j in range(5)] for i in range(5)]


def whitened_by_hand(rows, components=16, scale=64, offset=1_000_000):
    x = {i: tuple(math.floor(scale * float(c)) + offset for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(f[k] for f in fit) for k in range(d)]
    y = {f: [n * f[k] - sums[k] for k in range(d)] for f in fit}
    v = np.array([[float(Fraction(sum(y[f][i] * y[f][j] for f in fit), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    out = {}
    for i, f in x.items():
        for c in range(min(components, d)):
            e, a = values[d - 1 - c], axes[:, d - 1 - c]
            out[i, c + 1] = (n, sum(k * k for k in y[f]), float(np.dot(np.array(y[f]) / n, a) / math.sqrt(e)), float(e / np.trace(v)))
    return out


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 9)).astype(np.float32) * np.arange(1, 10, dtype=np.float32) * np.float32(3)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:25], base[:1].repeat(30, 0)]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).withColumn("n", F.lit("clash")).withColumn("x", F.lit(1))
    want = whitened_by_hand(rows, 7)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(table, components=7).collect()}
    assert set(got) == set(want)
    for c in range(1, 8):
        sign = np.sign(sum(got[i, c]["whitened"] * want[i, c][2] for i, _ in rows))
        for i, _ in rows:
            n, deviation, w, share = want[i, c]
            r = got[i, c]
            assert (r["n"], r["deviation"]) == (n, deviation) == (60, deviation)
            assert abs(r["whitened"] * sign - w) < 1e-7 and abs(r["explained"] / share - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query_of_whitening(spark):
    got = QUERIES["op12_embedding_whitening"](spark, DATA)
    source = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in source.collect()]
    want, found = whitened_by_hand(rows), {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert set(want) == set(found) and len(found) == 16 * len(rows)
    assert all(found[k]["deviation"] == v[1] and abs(abs(found[k]["whitened"]) - abs(v[2])) < 1e-6 and found[k]["identity_error"] < 1e-4 for k, v in want.items())


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, math.nan]), (5, [math.inf, 0.0]), (6, [1.0, 2.0, 3.0])]
    assert whitening.whiten(spark.createDataFrame(odd[:5], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    # of two dimensions, two rows: the second eigenvalue is nothing
    got = whitening.whiten(spark.createDataFrame([*odd, (7, [0.0, 0.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])], schema)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["7", "7", "None", "None", "None", "None"]
    assert {(r["component"], r["n"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in got} == {(1, 2, 1.0), (2, 2, None)}
    alone = whitening.whiten(spark.createDataFrame([(1, [3.0, 4.0])], schema)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(c, 1, 0, None, None, None) for c in (1, 2)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    assert len(huge) == 6 and {r["n"] for r in huge} == {3} and {r["vec_id"] for r in huge if r["deviation"] is None} == {1, 2, 3}


# resampling


def test_grams_crcs_are_those_of_the_joined_words():
    rng = random.Random(6)
    letters = "abz09 .,AÉßKKİK中 x-\n"
    texts = [None if rng.random() < 0.05 else "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30, 300]))) for _ in range(300)]
    texts += ["a" * 70_000 + " " + "b" * 100 + " c", "", None, "q" * 63 + " " + "q" * 64 + " " + "q" * 65]
    grams = resampling.Grams(4)
    for chunk in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        got = list(grams.grams(chunk))
        for n, (crcs, owner) in enumerate(got, 1):
            want = [(zlib.crc32(" ".join(w[i : i + n]).encode()), k) for k, w in enumerate(map(plain_words, texts)) for i in range(len(w) - n + 1)]
            assert list(zip(crcs.tolist(), owner.tolist(), strict=True)) == want


def plain_resample(docs, target, buckets=10_000, percent=5, least=20, seed=42):
    features = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [plain_words(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in features(text):
            s[f] += 1
    for text in target:
        for f in features(text):
            t[f] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        own = features(text)
        weight = sum(gain[f] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_query_of_resampling_is_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_importance_resampling"](spark, DATA).collect()), key=str)
    assert got == plain_resample(docs, target)


def test_resampling_of_odd_tables(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(None if i % 9 == 0 else i % 50, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 19, 20, 25])))) for i in range(200)]
    docs += [(900, None), (901, ""), *[(7, "same text " * 10)] * 30]
    target = ["w1 w2 w3", None, ""]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"n_words": F.lit("x"), "rank": F.lit(1), "score": F.lit(2), "fit": F.lit(0), "t": F.lit(0)})
    items = spark.createDataFrame([(t,) for t in target], "text string")
    strip = lambda rows: sorted((r[:4] for r in rows), key=str)
    got, want = [tuple(r) for r in resampling.resample(table, items, percent=40).collect()], plain_resample(docs, target, percent=40)
    assert strip(got) == strip(want)  # equal rows may have each other's ranks
    assert sorted((r[4], r[3]) for r in got if r[4]) == sorted((r[4], r[3]) for r in want if r[4])
    assert resampling.resample(table.limit(0), items).collect() == []
    none = resampling.resample(table, items.limit(0), percent=40).collect()
    assert len(none) == len(docs)


# places of rows


def test_places_of_a_partitioned_table(spark, tmp_path):
    folder = f"{tmp_path}/a b+c%20=é"
    spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("l +%"), (F.col("id") % 3).cast("string")).alias("lang")).coalesce(1).write.partitionBy("lang").parquet(folder)
    placed = common.with_places(spark.read.parquet(folder)).collect()
    assert len({r["place"] for r in placed}) == 30
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: r["place"])] == [i for k in range(3) for i in range(30) if i % 3 == k]


def test_near_duplicates_of_a_partitioned_table(spark, tmp_path):
    """Documents in folders of one file name: only the copy goes."""
    text = {i: " ".join(f"w{i}x{k}" for k in range(30)) for i in (1, 2, 4)}
    rows = [(1, text[1], "de"), (2, text[2], "de"), (3, text[2], "fr"), (4, text[4], "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.partitionBy("lang").parquet(f"{tmp_path}/docs")
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.read.parquet(f"{tmp_path}/docs"), DATA).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 4]


def test_mix_under_filters(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    mixed = mixing.mix(docs, block_chars=3000)
    rows = mixed.collect()
    for column, value in (("mix_slot", 3), ("mix_block", 0), ("mix_offset", 0), ("mix_weight", 0.1)):
        for op in ("=", "<", ">="):
            want = sum({"=": r[column] == value, "<": r[column] < value, ">=": r[column] >= value}[op] for r in rows)
            assert mixed.where(f"{column} {op} {value}").count() == want
