"""Decision trees as plain tables, and what each column contributes to their predictions: exact Shapley values by paths.

A leaf's path is a set of columns, each with an interval that its splits leave, whether a missing value goes along, and the share of the training
rows that went along its splits. For the game in which an unknown column goes each way in these shares, a leaf's Shapley values are sums of
products over subsets of the path's columns; a polynomial has them all, for whole batches of rows at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tree(NamedTuple):
    """Nodes in arrays, the root first; feature is -1 at leaves. Left takes values up to the threshold, and missing ones where missing_left."""

    feature: list[int]
    threshold: list[float]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]
    cover: list[float]


class Path(NamedTuple):
    """A leaf's value and, for each column on the way, the interval (low, high], whether missing values fit, and the share of rows."""

    value: float
    columns: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    share: np.ndarray


def paths(tree: Tree) -> list[Path]:
    out: list[Path] = []

    def walk(node: int, seen: dict[int, tuple[float, float, bool, float]]) -> None:
        if tree.feature[node] < 0:
            columns = tuple(seen)
            parts = [np.array([seen[c][k] for c in columns]) for k in range(4)]
            out.append(Path(tree.value[node], columns, *parts))
            return
        f, t = tree.feature[node], tree.threshold[node]
        low, high, missing, share = seen.get(f, (-math.inf, math.inf, True, 1.0))
        for child, interval, goes in ((tree.left[node], (low, min(high, t)), tree.missing_left[node]), (tree.right[node], (max(low, t), high), not tree.missing_left[node])):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.5
            walk(child, seen | {f: (*interval, missing and goes, share * part)})

    walk(0, {})
    return out


def _fits(path: Path, x: np.ndarray) -> np.ndarray:
    """For each row and column of the path, 1 where the row's value goes along."""
    own = x[:, path.columns]
    inside = (own > path.low) & (own <= path.high)
    return np.where(np.isnan(own), path.missing, inside).astype(float)


def predicted(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """The sum of the trees' values for each row; missing values are NaN."""
    out = np.zeros(len(x))
    for tree in trees:
        at = np.zeros(len(x), int)
        feature, threshold, missing_left = (np.array(a) for a in (tree.feature, tree.threshold, tree.missing_left))
        left, right = np.array(tree.left), np.array(tree.right)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            value = x[inner, feature[node]]
            go = np.where(np.isnan(value), missing_left[node], value <= threshold[node])
            at[inner] = np.where(go, left[node], right[node])
        out += np.array(tree.value)[at]
    return out


def expected(trees: list[Tree]) -> float:
    """The trees' prediction when no column is known."""
    return math.fsum(p.value * float(np.prod(p.share)) for t in trees for p in paths(t))


def shapley(known: list[Path], x: np.ndarray, columns: int) -> np.ndarray:
    """(rows, columns): each column's part of each row's prediction; with `expected` they add up to it."""
    out = np.zeros((len(x), columns))
    for path in known:
        m = len(path.columns)
        if not m:
            continue
        fits = _fits(path, x)
        weights = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
        for j, column in enumerate(path.columns):
            # coefficients of t: products over subsets of the others, by size; those in the subset fit, the others go by their shares
            poly = np.zeros((len(x), m))
            poly[:, 0] = 1.0
            for i in (i for i in range(m) if i != j):
                grown = poly * path.share[i]
                grown[:, 1:] += poly[:, :-1] * fits[:, i, None]
                poly = grown
            out[:, column] += path.value * (fits[:, j] - path.share[j]) * (poly @ weights)
    return out


def spark_trees(model: object) -> list[Tree]:
    """The trees of a fitted forest, whose class 1 shares are averaged, or of boosted trees, whose weighted values are added to the margin."""
    forest = "RandomForest" in type(model).__name__
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        table = Tree([], [], [], [], [], [], [])

        def add(node, table=table, factor=weight / (len(model.trees) if forest else 1)) -> int:
            at = len(table.feature)
            stats = node.impurityStats().stats()
            value = float(list(stats)[1]) / sum(stats) if forest else node.prediction()
            for part, v in zip(table, (-1, 0.0, False, -1, -1, value * factor, float(node.impurityStats().count())), strict=True):
                part.append(v)
            if node.subtreeDepth():
                table.feature[at], table.threshold[at] = node.split().featureIndex(), node.split().threshold()
                table.left[at], table.right[at] = add(node.leftChild()), add(node.rightChild())
            return at

        add(tree._java_obj.rootNode())
        out.append(table)
    return out


def contributions(rows: DataFrame, trees: list[Tree], columns: list[str], out: str = "contributions") -> DataFrame:
    """rows with an array of each column's Shapley value, in the order of columns; nulls and NaN are missing values.

    The trees are sent to every task; rows only pass through. An empty table gives no rows.
    """
    known = [p for t in trees for p in paths(t)]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch], float).reshape(len(batch), len(columns))
            yield pd.Series(list(shapley(known, x, len(columns))), dtype=object)

    return rows.withColumn(out, F.pandas_udf(run, "array<double>")(F.array(*(F.col(f"`{c}`").cast("double") for c in columns))))


def mean_contributions(rows: DataFrame, trees: list[Tree], columns: list[str]) -> DataFrame:
    """(column, mean_abs): how far each column moves predictions on average; nulls without rows."""
    each = contributions(rows.select(*(F.col(f"`{c}`") for c in columns)), trees, columns, "__s")
    means = each.select(F.posexplode("__s").alias("i", "v")).groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs"))
    names = rows.sparkSession.createDataFrame(list(enumerate(columns)), "i int, column string")
    return names.join(means, "i", "left").select("column", "mean_abs")
