"""Joins and near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest

from brindle.llm import embedding_dedup, line_dedup, ngram_join
from brindle.llm.common import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_shingles string, component_id int"


def closed(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = closed(len(rows), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], doc), doc)
    return [(doc, len(sets[i]), least[root[i]]) for i, (doc, _) in enumerate(rows)]


def made_documents(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Àé", "ΣΣ", "x\x1cy"]
    passage = " ".join(rng.choices(words, k=60))
    bases = [" ".join(rng.choices(words, k=rng.choice([1, 3, 4, 6, 9, 40, 150, 400]))) for _ in range(20)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "One two")]
    for i in range(6, n):
        t = rng.choice(bases).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            t = passage.split(" ") + t
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(t)))
    return rows


@pytest.mark.parametrize("bound", [1_500_000, 900])
def test_ngram_join_loses_no_link(spark, bound):
    rows = made_documents(1)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)
    got = sorted(map(tuple, ngram_join.ngram_components(df, bound=bound).collect()))
    assert got == sorted(brute_components(rows))


def test_ngram_join_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.ngram_components(docs).collect())) == sorted(brute_components(rows))


def test_ngram_join_edges(spark):
    assert not ngram_join.ngram_components(spark.createDataFrame([], DOCS)).collect()
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, long), (9, long + " end"), (10, "a")]
    got = ngram_join.ngram_components(spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 2, 7), (7, 2, 7), (7, 2, 7), (8, 29_997, 8), (9, 29_998, 8), (10, 1, 10)]


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    levels = ngram_join.Levels(percent)
    for _ in range(400):
        n = int(rng.integers(2, 300))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 2**64, int(rng.integers(0, 3)), dtype=np.uint64)]))
        base = np.unique(base)
        both, union = len(np.intersect1d(base, other)), len(np.union1d(base, other))
        if len(other) and both < union and 100 * both >= percent * union:
            assert set(ngram_join.signatures(base, levels).tolist()) & set(ngram_join.signatures(other, levels).tolist())


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (4, 4)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)}
    assert not components(spark.createDataFrame([], "src long, dst long")).collect()


def vectors(seed):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(12):
        center = rng.normal(size=16)
        out += [((center + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35])).tolist(), int(c % 3)) for _ in range(int(rng.integers(1, 9)))]
    out += [(out[0][0], out[0][1])] * 3 + [([0.0] * 16, 0), ([float("nan")] * 16, 0), ([float("inf")] + [1.0] * 15, 0), ([None] + [1.0] * 15, 0), (None, 0), ([], 0), (out[0][0], None), ([1e-30] * 16, 1), ([1e-30] * 16, 1), ([1.0, 2.0], 0)]
    return [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, lab) for i, (v, lab) in enumerate(out)]


@pytest.mark.parametrize("group", [8192, 7])
def test_embeddings(spark, group):
    rows = vectors(4)
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(3)
    fit = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    links = [(i, j) for i, v, a in rows for j, w, b in rows if i != j and a is not None and a == b and fit(v) and fit(w) and len(v) == len(w) and cosine(v, w) >= 0.93]
    root = closed(len(rows), links)
    want = [(i, sum(1 for a, _ in links if a == i), root[i], root[i] == i) for i, _, _ in rows]
    assert len(links) > 50
    assert sorted(map(tuple, embedding_dedup.embedding_components(df, group=group).collect())) == want
    assert not embedding_dedup.embedding_components(df.limit(0)).collect()


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 40)) * rng.choice([0.01, 1, 100], size=(300, 40))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, held, err = embedding_dedup.quantise(u)
    near = embedding_dedup.integer_products(q, q) * s[:, None] * s
    assert (np.abs(near - u @ u.T) <= err[:, None] * held + held[:, None] * err + err[:, None] * err + 1e-12).all()
    wide = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (embedding_dedup.integer_products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


def test_lines(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    bases = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 5, 9, 12, 20, 22, 40, 80)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(4):
            t = rng.choice(bases)
            if rng.random() < 0.4:
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice("xyz") + t[k + 1 :]
            lines.append(rng.choice([t, t.upper(), f"  {t} ", ""]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, line_no int")
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_components(df).collect()}
    lines = [(d, i, x.strip(" ")) for d, t in rows for i, x in enumerate((t or "").split("\n"))]
    assert sorted(got) == sorted((d, i) for d, i, _ in lines)
    first = {}
    for d, i, x in lines:
        if x:
            first.setdefault(x, (d, i))
    distinct = list(first)
    sets = [frozenset(x[k : k + 8] for k in range(len(x) - 7)) or frozenset([x]) for x in distinct]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    place = lambda r: (r["first_doc"], r["first_line"])
    root = closed(len(sets), links)
    same = sum(place(got[first[distinct[i]]]) == place(got[first[distinct[j]]]) for i, j in links)
    assert same >= 0.9 * len(links) > 60
    head = {}
    for i, r in enumerate(root):
        head[r] = min(head.get(r, (1 << 60, 0)), first[distinct[i]])
    at = {x: i for i, x in enumerate(distinct)}
    for d, i, x in lines:
        r = got[(d, i)]
        assert r["kept"] == (place(r) == (d, i))
        if not x:
            assert r["kept"]
        else:  # no component has lines that aren't reachable
            assert root[at[x]] == root[at[next(y for e, j, y in lines if (e, j) == place(r))]]
    assert not line_dedup.line_components(df.limit(0)).collect()


def test_lines_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.line_components(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
