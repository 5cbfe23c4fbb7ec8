"""Euclidean neighbours in cells of space against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import prep, vectors


@pytest.mark.parametrize("others", [True, False])
def test_same_neighbours_as_by_brute_force(spark, monkeypatch, others):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(300, 3)), rng.integers(0, 3, (250, 3)) / 2, np.tile([[9.0, 0.0, 0.0]], (40, 1)), [[1e6, -1e6, 0.0]]])
    ids = rng.permutation(len(v)) * 3
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, v)], "id long, v array<double>").repartition(3)
    rows = lambda found: {(r["q"], r["rank"], r["neighbour"], r["distance"]) for r in found.collect()}
    want = rows(vectors.nearest(df.where("id % 2 = 0"), df, 4, "euclidean", others))
    monkeypatch.setattr(vectors, "CELL_ROWS", 8)
    monkeypatch.setattr(vectors, "CUT_ROWS", 200)
    assert rows(vectors.nearest(df.where("id % 2 = 0"), df, 4, "euclidean", others)) == want


def test_smote_compares_few_pairs(spark, monkeypatch):
    """Pairs that are compared grow with the rows, not with their square."""
    pairs = spark.sparkContext.accumulator(0)
    top = vectors._top

    def counted(a, ids, b, *rest):
        pairs.add(len(a) * len(b))
        return top(a, ids, b, *rest)

    monkeypatch.setattr(vectors, "_top", counted)
    rows = spark.range(24_000).select("id", F.when(F.col("id") < 8_000, 1).otherwise(0).alias("target"), *(F.rand(i).alias(c) for i, c in enumerate("abc")))
    assert prep.smote(rows.where("id >= 0"), "target", 1, ["a", "b", "c"], "id").count() == 8_000
    assert 0 < pairs.value < 8_000**2 / 2
