"""Statistics: Welch's test, classification measures, exact ROC and precision-recall areas."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import quantile_cuts, slots


def welch(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> tuple[Column, Column]:
    """t and degrees of freedom of two samples of unequal variance; null where a sample has under two rows."""
    a, b = F.try_divide(var_a, n_a.cast("double")), F.try_divide(var_b, n_b.cast("double"))
    t = F.try_divide(mean_a - mean_b, F.sqrt(a + b))
    return t, F.try_divide((a + b) * (a + b), F.try_divide(a * a, n_a - 1.0) + F.try_divide(b * b, n_b - 1.0))


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        part = 1.0 if not i else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + part * d or tiny)
        c = 1 + part / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """The chance of a larger |t| under Student's distribution."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def with_welch_p(summary: DataFrame) -> DataFrame:
    """A summary with t and df, with their two-sided p; null where one of them is, NaN where one is NaN."""

    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype=float)

    p.__annotations__ = {"t": pd.Series, "df": pd.Series, "return": pd.Series}
    # pandas takes NaN for null
    lost = F.isnan("t") | F.isnan("df")
    return summary.withColumn("p", F.when(F.col("t").isNotNull() & F.col("df").isNotNull() & lost, F.lit(float("nan"))).otherwise(F.pandas_udf(p, "double")(F.col("t"), F.col("df"))))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tn, fp, fn, tp, accuracy, precision, recall, f1."""
    count = lambda p, a: F.count_if((predicted == p) & (actual == a))
    sums = rows.agg(count(0, 0).alias("tn"), count(1, 0).alias("fp"), count(0, 1).alias("fn"), count(1, 1).alias("tp"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return sums.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn)), "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
    })


def _by_score(rows: DataFrame, prob: str, label: str) -> DataFrame:
    """Positives and negatives at each distinct score: far fewer rows than scores where those repeat."""
    return rows.where(F.col(prob).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(prob).alias("p")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


#: Ranges of scores, of about as many distinct ones each.
PARTS = 256


def _running(points: DataFrame, columns: list[str]) -> DataFrame:
    """points with <column>_before: sums over higher scores p, in two levels so that no one task sorts all; and __b, the range of scores."""
    dealt = slots(points, quantile_cuts(points, "p", PARTS), "p", "__b")
    order = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each of the ranges
    bases = dealt.groupBy("__b").agg(*(F.sum(c).alias(f"__{c}") for c in columns)).select("__b", *(F.coalesce(F.sum(f"__{c}").over(order), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__b").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(bases), "__b").withColumns({f"{c}_before": F.col(f"__{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}).drop(*(f"__{c}" for c in columns))


def roc_auc(rows: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """One row, auc: exact, with equal scores counted as halves; null with one label only."""
    points = _running(_by_score(rows, prob, label), ["pos"])
    wins = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / F.lit(2.0)))
    return points.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def log_loss(rows: DataFrame, prob: str = "prob", label: str = "label", eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    return rows.agg(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))).alias("log_loss"))


def _curve(rows: DataFrame, prob: str, label: str) -> DataFrame:
    points = _running(_by_score(rows, prob, label), ["pos", "neg"])
    total = points.agg(F.sum("pos").cast("double").alias("__all"))
    tp, fp = (F.col("pos_before") + F.col("pos")).cast("double"), (F.col("neg_before") + F.col("neg")).cast("double")
    curve = points.crossJoin(F.broadcast(total)).select("__b", F.col("p").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.try_divide(tp, F.col("__all")).alias("recall"))  # one row
    return curve.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def pr_curve(rows: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """(threshold, precision, recall, f1) at each distinct score."""
    return _curve(rows, prob, label).drop("__b")


def pr_summary(rows: DataFrame, prob: str = "prob", label: str = "label") -> DataFrame:
    """One row: best_threshold by f1, of equals the lowest, best_f1, and pr_auc by trapezoids from recall 0 at precision 1."""
    # the point before lies in the same range of thresholds, or is the last of the ranges before, of which there are PARTS
    placed = _curve(rows, prob, label).withColumn("__x", F.struct("recall", "precision"))
    ends = placed.groupBy("__b").agg(F.min_by("__x", "threshold").alias("__end"))
    carried = ends.select("__b", F.lag("__end").over(Window.orderBy(F.desc("__b"))).alias("__before"))
    inside = Window.partitionBy("__b").orderBy(F.desc("threshold"))
    first = F.struct(F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    lagged = placed.join(F.broadcast(carried), "__b").withColumn("__l", F.coalesce(F.lag("__x").over(inside), "__before", first))
    area = F.sum((F.col("recall") - F.col("__l.recall")) * (F.col("precision") + F.col("__l.precision")) / 2)
    return lagged.agg(F.max_by("threshold", F.struct(F.round("f1", 12), -F.col("threshold"))).alias("best_threshold"), F.max("f1").alias("best_f1"), area.alias("pr_auc"))


def poisson_cuts(most: int = 9) -> list[float]:
    """Shares below which a Poisson variable of mean 1 is 0, at most 1, at most 2 ..."""
    out, total, term = [], 0.0, math.exp(-1)
    for k in range(most):
        total += term
        out.append(total)
        term /= k + 1
    return out


def poisson_weights(hashes: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """(rows, rounds): how often each row takes part in each round, a Poisson variable of mean 1 by the row's 64-bit hash and the round's number."""
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + rounds.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(34)).astype(float) / float(1 << 30)
    return np.searchsorted(np.array(poisson_cuts()), u, side="right")


def bootstrap_auc(rows: DataFrame, rounds: int = 1000, seed: int = 42, prob: str = "prob", label: str = "label", key: str = "id") -> DataFrame:
    """One row: p = the share of rounds, of rows drawn again with replacement, in which the AUC is at most 0.5; and the mean AUC.

    A row's part in a round is a Poisson variable of mean 1 by a hash of its key, the seed and the round. Rows are shuffled once, whatever the number of rounds: to
    ranges of scores, where one task adds up all rounds; ranges are joined by running sums. A score that many rows have is a range of its own, dealt to
    several tasks, as only its sums count. Rows of a null score, or a label but 0 and 1, are left out; without both labels both values are null.
    """
    known = rows.where(F.col(f"`{prob}`").isNotNull() & ~F.isnan(F.col(f"`{prob}`")) & F.col(f"`{label}`").isin(0, 1))
    drawn = known.select(F.xxhash64(F.col(f"`{key}`"), F.lit(seed)).alias("h"), F.col(f"`{prob}`").cast("double").alias("p"), F.col(f"`{label}`").cast("int").alias("y"))
    parts = max(2, min(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    cuts = quantile_cuts(drawn, "p", parts)
    hot = sorted(c for c, n in Counter(cuts).items() if n > 1)
    common = F.col("p").isin(hot) if hot else F.lit(False)
    dealt = slots(drawn, cuts, "p", "b").withColumns({"b": (2 * F.col("b") + F.when(common, 0).otherwise(1)).cast("long"), "salt": F.when(common, F.pmod("h", F.lit(parts))).otherwise(0).cast("int")})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("p", ascending=False, kind="stable")
        h, p, y = group["h"].to_numpy(), group["p"].to_numpy(), group["y"].to_numpy()
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        out = []
        step = max(1, 4_000_000 // len(p))
        for at in range(1, rounds + 1, step):
            turns = np.arange(at, min(rounds + 1, at + step))
            w = poisson_weights(h, turns)
            pos, neg = np.add.reduceat(w * (y == 1)[:, None], first), np.add.reduceat(w * (y == 0)[:, None], first)
            wins = (neg * (np.cumsum(pos, axis=0) - pos / 2.0)).sum(axis=0)
            out.append(pd.DataFrame({"round": turns, "b": key[0], "common": key[0] % 2 == 0, "pos": pos.sum(axis=0), "neg": neg.sum(axis=0), "wins": wins}))
        return pd.concat(out)

    sums = dealt.groupBy("b", "salt").applyInPandas(add, "round int, b long, common boolean, pos long, neg long, wins double")
    # a common score's parts count half against each other too
    each = sums.groupBy("round", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("wins").alias("wins"), F.first("common").alias("common"))
    won = F.when(F.col("common"), F.col("pos") * F.col("neg") / 2.0).otherwise(F.col("wins"))
    over = Window.partitionBy("round").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    placed = each.withColumn("won", won + F.col("neg") * F.coalesce(F.sum("pos").over(over), F.lit(0)))
    aucs = placed.groupBy("round").agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
    return aucs.where("auc is not null").agg(F.avg((F.col("auc") <= 0.5).cast("double")).alias("p"), F.avg("auc").alias("mean_auc"))
