"""Gradient boosting by histograms: missing values go the way that fits them better, and rounds end when validation rows say so.

Rows become blocks of bin numbers. A tree's level is one pass: each task adds up gradients by node, column and bin, Spark adds the tasks' sums,
and the driver picks splits from as many numbers as there are nodes, columns and bins. Gradients are whole numbers of 2 ** -24, so that the
order in which they are added up changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .trees import Tree, predicted

#: Bins of a column besides that of missing values, and rows of a block.
BINS, BLOCK_ROWS = 64, 32_768
#: Rounds after which blocks are written anew with their rows' margins, so that a pass applies no more trees than these.
REWRITE = 25
_ONE = float(1 << 24)


class Boosted(NamedTuple):
    """trees: with their values times the rate. base: the margin before the first. losses: of the validation rows after each round, the stopping ones too."""

    columns: list[str]
    base: float
    trees: list[Tree]
    losses: list[float]

    @property
    def best(self) -> int:
        return len(self.trees)


def bin_cuts(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Rising cuts of each column at about equal shares of its known values: bin k has the values up to cut k."""
    shares = [i / bins for i in range(1, bins)]
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    found = rows.agg(*(F.percentile_approx(value(c), shares, 100 * bins).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [sorted(set(found[f"c{i}"] or [])) for i in range(len(columns))]


def _blocks(rows: DataFrame, columns: list[str], label: str, weight: str | None, held_out: str, cuts: list[list[float]], base: float) -> DataFrame:
    """(block, bins, y, w, valid, margin) of arrays as bytes."""
    edges = [np.array(c) for c in cuts]
    picked = rows.where(F.col(f"`{label}`").isin(0, 1)).select(
        *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)), F.col(f"`{label}`").cast("double").alias("y"),
        (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"), F.coalesce(F.col(f"`{held_out}`").cast("boolean"), F.lit(False)).alias("valid"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[at : at + BLOCK_ROWS]
                x = part[[f"c{i}" for i in range(len(columns))]].to_numpy(float)
                binned = np.stack([np.where(np.isnan(x[:, i]), BINS, np.searchsorted(e, x[:, i])) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                margin = np.full(len(part), base)
                yield pd.DataFrame({"bins": [binned.tobytes()], "y": [part["y"].to_numpy(float).tobytes()], "w": [part["w"].fillna(0.0).to_numpy(float).tobytes()], "valid": [part["valid"].to_numpy(bool).tobytes()], "margin": [margin.tobytes()]})

    packed = picked.mapInPandas(pack, "bins binary, y binary, w binary, valid binary, margin binary")
    return cut(packed.withColumn("block", F.monotonically_increasing_id()))


def _read(r: pd.Series, columns: int) -> tuple[np.ndarray, ...]:
    y = np.frombuffer(r["y"])
    return np.frombuffer(r["bins"], np.uint8).reshape(len(y), columns), y, np.frombuffer(r["w"]), np.frombuffer(r["valid"], bool), np.frombuffer(r["margin"])


def _leaves(bins: np.ndarray, tree: Tree) -> np.ndarray:
    """The node that each row of bin numbers has come to; thresholds are numbers of bins."""
    at = np.zeros(len(bins), np.int64)
    feature, threshold, missing_left = np.array(tree.feature), np.array(tree.threshold), np.array(tree.missing_left)
    left, right = np.array(tree.left), np.array(tree.right)
    while len(inner := np.flatnonzero(feature[at] >= 0)):
        node = at[inner]
        b = bins[inner, feature[node]]
        go = np.where(b == BINS, missing_left[node], b <= threshold[node])
        at[inner] = np.where(go, left[node], right[node])
    return at


def _margins(bins: np.ndarray, margin: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + np.array(tree.value)[_leaves(bins, tree)]
    return margin


def _sampled(block: int, rows: int, turn: int, seed: int, share: float) -> np.ndarray:
    """Which rows of a block a round learns from: by a hash of block, row and round."""
    x = np.arange(rows, dtype=np.uint64) + np.uint64((block * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 + seed * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * 2.0**63) * 2 - (share == 1.0))


def _sums(blocks: DataFrame, columns: int, done: list[Tree], growing: Tree, turn: int, seed: int, share: float) -> dict[int, tuple[int, int, int]]:
    """Of each node, column and bin the sums of gradients, of second derivatives and of rows; under -1 the loss and weight of validation rows.

    The result has as many entries as there are nodes, columns and bins.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = columns * (BINS + 1)
        total = np.zeros((3, len(growing.feature) * wide), np.int64)
        loss = [0, 0]
        for b in batches:
            for _, r in b.iterrows():
                bins, y, w, valid, margin = _read(r, columns)
                margin = _margins(bins, margin, done)
                p = 1 / (1 + np.exp(-margin))
                if valid.any():
                    each = np.logaddexp(0, np.where(y > 0, -margin, margin)) * w
                    loss[0] += int(np.rint(each[valid] * _ONE).sum())
                    loss[1] += int(np.rint(w[valid] * _ONE).sum())
                use = np.flatnonzero(~valid & _sampled(int(r["block"]), len(y), turn, seed, share))
                g, h = np.rint((p - y)[use] * w[use] * _ONE), np.rint((p * (1 - p))[use] * w[use] * _ONE)
                node = _leaves(bins[use], growing) * wide
                for c in range(columns):
                    slot = node + c * (BINS + 1) + bins[use, c]
                    for k, v in enumerate((g, h, None)):
                        total[k] += np.rint(np.bincount(slot, weights=v, minlength=total.shape[1])).astype(np.int64)
        at = np.flatnonzero(total[2])
        yield pd.DataFrame({"slot": np.append(at, -1), "g": np.append(total[0][at], loss[0]), "h": np.append(total[1][at], loss[1]), "n": np.append(total[2][at], 0)})

    got = blocks.mapInPandas(add, "slot long, g long, h long, n long").groupBy("slot").agg(*(F.sum(c).alias(c) for c in "ghn")).collect()
    return {r["slot"]: (r["g"], r["h"], r["n"]) for r in got}


def _split(node: np.ndarray, penalty: float, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, column, last bin on the left, whether missing values go left) of the best split of a node's sums (3, columns, bins)."""
    best = None
    score = lambda g, h: g * g / (h + penalty)
    for c in range(node.shape[1]):
        g, h = node[0, c] / _ONE, node[1, c] / _ONE
        whole = score(g.sum(), h.sum())
        for missing_left in (True, False):
            gl, hl = np.cumsum(g[:BINS]) + g[BINS] * missing_left, np.cumsum(h[:BINS]) + h[BINS] * missing_left
            gr, hr = g.sum() - gl, h.sum() - hl
            fit = (hl >= least) & (hr >= least)
            gain = np.where(fit, score(gl, hl) + score(gr, hr) - whole, -np.inf)[: BINS - 1]
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), c, k, missing_left)
    return best


def fit(rows: DataFrame, columns: list[str], label: str = "target", held_out: str = "held_out", weight: str | None = None, rounds: int = 1000, patience: int = 20, rate: float = 0.1, depth: int = 2, penalty: float = 1.5, least: float = 1.0, subsample: float = 0.8, seed: int = 42) -> Boosted:
    """Boosted trees for labels 0 and 1, of at most `rounds`: as many as give validation rows, those of held_out, the least log loss.

    It stops once `patience` rounds have not lowered that; without validation rows all rounds are made. Nulls and NaN are no numbers to be filled in: each
    split sends them the way that its training rows do better with. penalty: of squared leaf values. least: second derivatives that a leaf needs. subsample: the share of
    rows that a round learns from. Rows of another label are left out, a null weight is 0; columns without values are never split; an
    empty table gives a model without trees.
    """
    known = rows.where(F.col(f"`{label}`").isin(0, 1))
    train = known.where(~F.coalesce(F.col(f"`{held_out}`").cast("boolean"), F.lit(False)))
    of = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    sums = train.agg(F.sum(of * F.col(f"`{label}`")).alias("ones"), F.sum(of).alias("all")).first()
    if not sums["all"]:
        return Boosted(columns, 0.0, [], [])
    mean = min(max(sums["ones"] / sums["all"], 1e-6), 1 - 1e-6)
    base = math.log(mean / (1 - mean))
    cuts = bin_cuts(train, columns)
    blocks = _blocks(known, columns, label, weight, held_out, cuts, base)
    n, wide = len(columns), len(columns) * (BINS + 1)
    binned: list[Tree] = []
    losses: list[float] = []
    written = 0
    for turn in range(rounds + 1):
        tree = Tree([-1], [0.0], [False], [-1], [-1], [0.0], [0.0])
        open_nodes = [0]
        for level in range(depth + 1):
            if turn == rounds and level:
                break
            got = _sums(blocks, n, binned[written:], tree, turn, seed, subsample)
            loss = got.pop(-1, (0, 0, 0))
            if level == 0 and turn and loss[1]:
                losses.append(loss[0] / loss[1])
            if turn == rounds or (level == 0 and losses and len(losses) - 1 - int(np.argmin(losses)) >= patience):
                open_nodes = None
                break
            sums_of = np.zeros((3, len(tree.feature) * wide))
            for slot, values in got.items():
                sums_of[:, slot] = values
            sums_of = sums_of.reshape(3, len(tree.feature), n, BINS + 1)
            grown = []
            for node in open_nodes:
                g, h, c = (float(sums_of[k, node, 0].sum()) for k in range(3))
                tree.value[node], tree.cover[node] = -g / _ONE / (h / _ONE + penalty) * rate, c
                split = _split(sums_of[:, node], penalty, least) if level < depth else None
                if split:
                    _, column, last, missing_left = split
                    tree.feature[node], tree.threshold[node], tree.missing_left[node] = column, float(last), missing_left
                    tree.left[node], tree.right[node] = len(tree.feature), len(tree.feature) + 1
                    for part, v in zip(tree, (-1, 0.0, False, -1, -1, 0.0, 0.0), strict=True):
                        part.extend([v, v])
                    grown += [tree.left[node], tree.right[node]]
            open_nodes = grown
            if not open_nodes:
                break
        if open_nodes is None:
            break
        binned.append(tree)
        if len(binned) - written >= REWRITE:
            blocks, written = _rewritten(blocks, n, binned[written:]), len(binned)
    keep = int(np.argmin(losses)) + 1 if losses else len(binned)
    real = [t._replace(threshold=[cuts[f][int(b)] if f >= 0 and b < len(cuts[f]) else math.inf for f, b in zip(t.feature, t.threshold, strict=True)]) for t in binned[:keep]]
    return Boosted(columns, base, real, losses)


def _rewritten(blocks: DataFrame, columns: int, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees in their margins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, r in b.iterrows():
                bins, *_, margin = _read(r, columns)
                out.append(_margins(bins, margin, trees).tobytes())
            yield b.assign(margin=out)

    return cut(blocks.mapInPandas(run, blocks.schema))


def predict(rows: DataFrame, model: Boosted) -> DataFrame:
    """rows with prob and y_pred of the model; nulls and NaN go the learnt ways."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([[np.nan if v is None else v for v in r] for r in batch], float).reshape(len(batch), len(model.columns))
            yield pd.Series(1 / (1 + np.exp(-(model.base + predicted(model.trees, x)))))

    prob = F.pandas_udf(run, "double")(F.array(*(F.col(f"`{c}`").cast("double") for c in model.columns)))
    return rows.withColumn("prob", prob).withColumn("y_pred", F.when(F.col("prob") >= 0.5, 1).otherwise(0))
