"""Vectors: topic centroids, nearest topics, how sure they are, and neighbours among labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranks import ranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between two vectors; null for a zero one."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def usable(a: Column) -> Column:
    """Whether a vector is there, and all its entries are numbers."""
    values = a.cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return a.isNotNull() & (F.size(a) > 0) & ~bad


def commonest_size(rows: DataFrame, vector_col: str = "v") -> int | None:
    """The commonest length of usable vectors, of equally common ones the greatest; null without any."""
    best = rows.where(usable(F.col(vector_col))).groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else None


def centroids(vectors: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(topic, centroid): the mean vector of each label, without collecting a label's vectors. Null labels and vectors count nowhere; a zero vector does."""
    parts = vectors.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("topic"), F.posexplode(vector_col).alias("i", "x"))
    means = parts.groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


#: Rows of centroids that may be sent to all executors; topics are few, and more than that aren't topics.
MAX_TOPICS = 10_000


def _few(rows: DataFrame) -> DataFrame:
    if rows.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} centroids")
    return F.broadcast(rows)


def topic_distances(vectors: DataFrame, of: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, topic, distance, rank): cosine distance to every centroid, nearest first; ties by topic.

    Vectors that have no direction, or another length than a centroid, have no distance to it and no row: null, zero and not finite ones. Ids are to be unique.
    """
    pairs = vectors.select(F.col(id_col), F.col(vector_col).alias("__v")).crossJoin(_few(of))
    known = pairs.select(id_col, "topic", (1 - cosine(F.col("__v"), F.col("centroid"))).alias("distance")).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return known.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "topic")))


def assign_topics(vectors: DataFrame, of: DataFrame, temperature: float = 10.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, topic, distance, entropy): the nearest topic and the entropy of softmax(-temperature * distance).

    The centroids come along as one array, so that each vector is one row throughout and nothing is shuffled. Vectors without a distance to any, as null,
    zero, not finite ones and those of another length, have a null topic, distance and entropy; all rows stay.
    """
    all_of = _few(of).agg(F.array_sort(F.collect_list(F.struct("topic", "centroid"))).alias("__c"))
    near = vectors.select(F.col(id_col), F.col(vector_col).alias("__v")).crossJoin(F.broadcast(all_of)).select(  # one row, of MAX_TOPICS at most
        id_col, F.filter(F.transform("__c", lambda c: F.struct((1 - cosine(F.col("__v"), c["centroid"])).alias("d"), c["topic"].alias("t"))), lambda x: x["d"].isNotNull() & ~F.isnan(x["d"])).alias("__d")
    )
    weights = near.withColumn("__e", F.transform("__d", lambda x: F.exp(-F.lit(temperature) * x["d"])))
    summed = weights.withColumn("__s", F.aggregate("__e", F.lit(0.0), lambda s, x: s + x)).withColumn("__n", F.array_min("__d"))
    entropy = F.aggregate("__e", F.lit(0.0), lambda h, x: h - x / F.col("__s") * F.log(x / F.col("__s") + F.lit(1e-8)))
    return summed.select(id_col, F.col("__n.t").alias("topic"), F.col("__n.d").alias("distance"), F.when(F.col("__n").isNotNull(), entropy).alias("entropy"))


def intertopic_cosine(of: DataFrame) -> DataFrame:
    """(topic_a, topic_b, cosine) of each pair of centroids, topic_a < topic_b."""
    a, b = of.select(F.col("topic").alias("topic_a"), F.col("centroid").alias("a")), _few(of.select(F.col("topic").alias("topic_b"), F.col("centroid").alias("b")))
    return a.join(b, F.col("topic_a") < F.col("topic_b")).select("topic_a", "topic_b", cosine(F.col("a"), F.col("b")).alias("cosine"))


def intratopic_cosine(vectors: DataFrame, of: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(topic, n, cosine): the mean cosine of a label's vectors to its centroid."""
    joined = vectors.join(_few(of), F.col(label_col) == F.col("topic"))
    return joined.groupBy("topic").agg(F.count("*").alias("n"), F.avg(cosine(F.col(vector_col), F.col("centroid"))).alias("cosine"))


#: Numbers in a labelled side that may be sent to all executors.
MOST_SENT = 8_000_000
#: Rows of a block where both sides are cut.
BLOCK_ROWS = 16_384


def _top(a: np.ndarray, ids: np.ndarray, b: np.ndarray, others_ids: np.ndarray, k: int, metric: str, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest of b to each of a; b is in order of its ids, which break ties."""
    if metric == "cosine":
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None] for x in (a, b))
    step, out = max(1, 4_000_000 // max(1, len(b))), []
    for at in range(0, len(a), step):
        x = a[at : at + step]
        if metric == "cosine":
            far = 1 - x @ b.T
        else:
            far = sum(((x[:, None, i] - b[None, :, i]) ** 2 for i in range(1, x.shape[1])), (x[:, None, 0] - b[None, :, 0]) ** 2)
        if others:
            far[ids[at : at + step, None] == others_ids[None, :]] = np.inf
        best = np.argsort(np.round(far, 12), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(x)), best.shape[1])
        found = far[rows, best.ravel()]
        fit = np.isfinite(found)
        out.append((rows[fit] + at, best.ravel()[fit], found[fit]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


#: Rows of a cell where few dimensions are cut into cells, the most dimensions for that, and the rows that the cuts are made from.
CELL_ROWS, CELL_DIMENSIONS, CUT_ROWS = 512, 8, 100_000


class Cells:
    """Boxes that cut a space into parts of about equal numbers of rows: each box is halved at the median of its widest dimension."""

    def __init__(self, rows: np.ndarray, count: int):
        self.dim, self.at, self.next, self.leaves = [], [], [], 0
        self._cut(rows, max(1, count))

    def _cut(self, rows: np.ndarray, count: int) -> int:
        node = len(self.dim)
        self.dim.append(-1), self.at.append(0.0), self.next.append((self.leaves, -1))
        wide = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if count < 2 or wide.max() <= 0:
            self.leaves += 1
            return node
        dim = int(wide.argmax())
        at = float(np.median(rows[:, dim]))
        if not (rows[:, dim] < at).any():  # the median is the least value
            at = float(rows[rows[:, dim] > at, dim].min())
        below = rows[:, dim] < at
        self.dim[node], self.at[node] = dim, at
        self.next[node] = (self._cut(rows[below], count // 2), self._cut(rows[~below], count - count // 2))
        return node

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The number of each row's cell."""
        out, ahead = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while ahead:
            node, own = ahead.pop()
            if not len(own):
                continue
            if self.dim[node] < 0:
                out[own] = self.next[node][0]
                continue
            below = rows[own, self.dim[node]] < self.at[node]
            ahead += [(self.next[node][0], own[below]), (self.next[node][1], own[~below])]
        return out

    def within(self, rows: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that have a place at the squared distance `far` of each row, or nearer."""
        found, ahead = [], [(0, np.arange(len(rows)), np.zeros(rows.shape))]
        while ahead:
            node, own, gap = ahead.pop()  # gap: how far a row is from the box in each dimension
            if not len(own):
                continue
            if self.dim[node] < 0:
                found.append((own, np.full(len(own), self.next[node][0])))
                continue
            dim, off = self.dim[node], rows[own, self.dim[node]] - self.at[node]
            for side, beyond in ((0, np.maximum(off, 0)), (1, np.maximum(-off, 0))):
                more = gap.copy()
                more[:, dim] = np.maximum(more[:, dim], beyond)
                fit = (more**2).sum(axis=1) <= far[own]
                ahead.append((self.next[node][side], own[fit], more[fit]))
        return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _nearest_in_cells(left: DataFrame, right: DataFrame, k: int, others: bool) -> DataFrame:
    """nearest by euclidean distance in few dimensions: no row meets rows of cells that are farther than k rows of its own cell.

    Of equal vectors only the k first ids can be neighbours, and all that are equal ask once; so copies don't make cells large.
    """
    most = k + others  # a row itself is left out at the end
    left, right = (df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")) for df in (left, right))
    kept = cut(right.withColumn("__n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("__n") <= most).drop("__n"))
    n = kept.count()
    some = kept.orderBy(F.xxhash64("id"), "id").limit(CUT_ROWS).toPandas()  # the cuts alone are made from these; all rows are dealt
    sample = np.stack(some["v"].to_list())
    held = left.sparkSession.sparkContext.broadcast((Cells(sample, min(n // CELL_ROWS, len(sample) // 8)), sample))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=held.value[0].of(np.stack(batch["v"].to_list())))

    def to_ask(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        """The cells in which each row's neighbours may be: as near as `most` rows of its own cell, or of the sample."""
        if one.empty:
            return pd.DataFrame({"id": one["id"], "v": one["v"], "cell": one["cell"]})
        cells, sample = held.value
        x, y = np.stack(one["v"].to_list()), np.stack(two["v"].to_list()) if len(two) >= most else sample
        if len(y) < most:
            far = np.full(len(x), np.inf)
        else:
            row, _, d = _top(x, np.zeros(len(x)), y, np.zeros(len(y)), most, "euclidean", False)
            far = np.full(len(x), -np.inf)
            np.maximum.at(far, row, d)
            far = far * (1 + 1e-9) + 2e-12  # distances are compared after rounding
            far[np.bincount(row, minlength=len(x)) < most] = np.inf
        row, cell = cells.within(x, far)
        return pd.DataFrame({"id": one["id"].to_numpy()[row], "v": one["v"].to_numpy()[row], "cell": cell})

    def ask(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"c": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "distance": pd.Series(dtype=float)})
        two = two.sort_values("id", kind="stable")
        ids, other = one["id"].to_numpy(np.int64), two["id"].to_numpy(np.int64)
        x, y, d = _top(np.stack(one["v"].to_list()), ids, np.stack(two["v"].to_list()), other, most, "euclidean", False)
        return pd.DataFrame({"c": ids[x], "neighbour": other[y], "distance": d})

    schema = "id long, v array<double>, cell long"
    first = cut(left.groupBy("v").agg(F.min("id").alias("c")))
    asking = first.select(F.col("c").alias("id"), "v").mapInPandas(deal, schema)
    placed = kept.mapInPandas(deal, schema)
    asked = asking.groupBy("cell").cogroup(placed.groupBy("cell")).applyInPandas(to_ask, schema)
    found = asked.groupBy("cell").cogroup(placed.groupBy("cell")).applyInPandas(ask, "c long, neighbour long, distance double")
    best = found.withColumn("__n", F.row_number().over(Window.partitionBy("c").orderBy(F.round("distance", 12), "neighbour"))).where(F.col("__n") <= most).drop("__n")
    each = left.join(first, "v").select(F.col("id").alias("q"), "c").join(best, "c")
    return (each.where("neighbour <> q") if others else each).select("q", "neighbour", "distance")


def nearest(left: DataFrame, right: DataFrame, k: int, metric: str = "cosine", others: bool = False) -> DataFrame:
    """(q, rank, neighbour, distance): the k rows (id, v) of right at the least cosine, or squared euclidean, distance to each of left; ties by id.

    Exact. others: rows of a row's own id don't count. A right side of at most MOST_SENT numbers is sent to all executors, so that left is only read;
    of a larger one pairs of blocks are tasks that return the k best of each row, and these are merged. In up to CELL_DIMENSIONS dimensions euclidean
    neighbours are looked for in cells of space, in time that hardly grows faster than the rows, and equal vectors ask once.
    Rows of a null id take no part, nor do vectors that are null, not finite or of another length than right's commonest. A zero vector has the cosine distance 1.
    """
    dimension = commonest_size(right) or 0
    left, right = (df.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == dimension)) for df in (left, right))
    size = right.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("m")).first()
    schema = "q long, neighbour long, distance double"

    def best(ids: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        x, y, d = _top(a, ids, b, other, k, metric, others)
        return pd.DataFrame({"q": ids[x], "neighbour": other[y], "distance": d})

    empty = pd.DataFrame({"q": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "distance": pd.Series(dtype=float)})
    if metric == "euclidean" and dimension <= CELL_DIMENSIONS and size["n"] > 8 * CELL_ROWS:
        some = _nearest_in_cells(left, right, k, others)
    elif (size["m"] or 0) <= MOST_SENT:
        sent = right.select("id", F.col("v").cast("array<double>").alias("v")).orderBy("id").toPandas()  # bounded by MOST_SENT
        held = left.sparkSession.sparkContext.broadcast((sent["id"].to_numpy(np.int64), np.stack(sent["v"].to_list()) if len(sent) else None))

        def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            other, b = held.value
            for batch in batches:
                yield best(batch["id"].to_numpy(np.int64), np.stack(batch["v"].to_list()), other, b) if b is not None and len(batch) else empty

        some = left.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInPandas(look_up, schema)
    else:
        qb, lb = max(1, -(-left.count() // BLOCK_ROWS)), max(1, -(-size["n"] // BLOCK_ROWS))
        deal = lambda df, own, n, other, m: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

        def per_pair(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            if one.empty or two.empty:
                return empty
            two = two.sort_values("id", kind="stable")
            return best(one["id"].to_numpy(np.int64), np.stack(one["v"].to_list()), two["id"].to_numpy(np.int64), np.stack(two["v"].to_list()))

        some = deal(left, "x", qb, "y", lb).groupBy("x", "y").cogroup(deal(right, "y", lb, "x", qb).groupBy("x", "y")).applyInPandas(per_pair, schema)
    order = Window.partitionBy("q").orderBy(F.round("distance", 12), "neighbour")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "neighbour", "distance")


def nearest_labelled(vectors: DataFrame, labelled: DataFrame, k: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", payload: str = "label", others: bool = False) -> DataFrame:
    """(id, rank, neighbour, payload, distance): the k labelled rows at the least cosine distance, by `nearest`; others: not itself."""
    sides = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")) for df in (vectors, labelled))
    found = nearest(*sides, k, others=others)
    said = labelled.select(F.col(id_col).cast("long").alias("neighbour"), F.col(payload).alias("__p"))
    return found.join(said, "neighbour").select(F.col("q").alias(id_col), "rank", "neighbour", F.col("__p").alias(payload), "distance")


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y: by one product of matrices, and by differences where a pair is so near that the product would lose its digits."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    far = x @ y.T
    far *= -2
    far += xx[:, None]
    far += yy
    top = yy.max(initial=0.0)
    i, j = np.nonzero(far <= 1e-4 * (xx[:, None] + top))
    for a in range(0, len(i), 100_000):
        some = slice(a, a + 100_000)
        far[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(axis=1)
    return np.sqrt(far, out=far)


def silhouettes(vectors: DataFrame, folds: int = 20, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", metric: str = "euclidean", block_rows: int = 8192) -> DataFrame:
    """(id, label, fold, silhouette): computed inside folds that are stratified by label.

    Folds are dealt in turn by a checksum of the id in each label. A row alone in its label has 0. A fold's pairs of blocks are tasks that
    add up distances by label, so a fold may be of any size. Ids are to be unique. Rows of a null label, or of a vector that is null, not finite or of
    another length than the commonest, have no row and count nowhere. With the cosine metric use cosine_silhouettes, which needs no pairs.
    """
    kinds = dict(vectors.dtypes)
    dimension = commonest_size(vectors, vector_col) or 0
    vectors = vectors.where(F.col(label_col).isNotNull() & usable(F.col(vector_col)) & (F.size(vector_col) == dimension))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("lab"), F.col(vector_col).cast("array<double>").alias("v"))
    dealt = ranked(rows, ["lab"], "id").withColumn("fold", (F.col("__r") % folds).cast("int")).drop("__r", "__n")
    sizes = dealt.groupBy("fold", "lab").agg(F.count("*").alias("n"))
    tiles = sizes.groupBy("fold").agg(F.ceil(F.sum("n") / F.lit(block_rows)).cast("int").alias("g"))
    # a row for each fold
    placed = dealt.join(F.broadcast(tiles), "fold").withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    # named anew, so that the two sides of one table differ
    side = lambda x, y: placed.select(F.col(x).alias("x"), F.col(y).alias("y"), *(F.col(c).alias(c) for c in ("fold", "id", "lab", "v")))
    one, two = side("own", "other"), side("other", "own")

    def per_pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": left["id"][:0], "lab": left["lab"][:0], "fold": left["fold"][:0], "of": left["lab"][:0], "total": pd.Series(dtype=float)})
        x, y = np.stack(left["v"].to_list()), np.stack(right["v"].to_list())
        if metric == "cosine":
            x, y = (m / np.linalg.norm(m, axis=1)[:, None] for m in (x, y))
        names, code = np.unique(right["lab"].to_numpy(), return_inverse=True)
        member, step, sums = np.eye(len(names))[code], max(1, 4_000_000 // len(y)), []
        for a in range(0, len(x), step):
            z = x[a : a + step]
            sums.append((1 - z @ y.T if metric == "cosine" else euclidean(z, y)) @ member)
        m = len(names)
        return pd.DataFrame({"id": np.repeat(left["id"].to_numpy(), m), "lab": np.repeat(left["lab"].to_numpy(), m), "fold": np.repeat(left["fold"].to_numpy(), m), "of": np.tile(names, len(x)), "total": np.concatenate(sums).ravel()})

    found = one.groupBy("fold", "x", "y").cogroup(two.groupBy("fold", "x", "y")).applyInPandas(per_pair, f"id {kinds[id_col]}, lab {kinds[label_col]}, fold int, of {kinds[label_col]}, total double")
    totals = found.groupBy("id", "lab", "fold", "of").agg(F.sum("total").alias("total")).join(sizes.withColumnRenamed("lab", "of"), ["fold", "of"])
    own = F.col("of") == F.col("lab")
    sides = totals.groupBy("id", "lab", "fold").agg(F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return sides.select(F.col("id").alias(id_col), F.col("lab").alias(label_col), "fold", score.alias("silhouette"))


def cosine_silhouettes(vectors: DataFrame, folds: int = 1, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, fold, silhouette) by cosine distance, exact, without pairs: in time that grows with rows times labels.

    The mean distance of a vector to a label's vectors is 1 less its product with the sum of their unit vectors over their number; its own is
    left out of its label's by the number alone, as it is at distance 0. Folds are dealt by a checksum of the id; one fold, by default, is the whole table. A row
    alone in its label has 0, and so have all where there is one label. Rows of a null label, and of vectors that are null, zero, not finite or
    of another length than the commonest, have no row and count nowhere; repeated rows count each. At most MAX_TOPICS labels and folds.
    """
    rows = vectors.where(F.col(label_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("lab"), F.col(vector_col).cast("array<double>").alias("v"))
    dimension = commonest_size(rows) or 0
    sized = rows.where(F.size("v") == dimension).withColumn("l", norm(F.col("v"))).where("l > 0")
    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)).cast("int")
    unit = sized.select("id", "lab", fold.alias("fold"), F.transform("v", lambda x: F.try_divide(x, F.col("l"))).alias("u"))
    # sums of each place, a few values for each label: an entry at a time, so that the width doesn't matter
    sums = unit.select("fold", "lab", F.posexplode("u").alias("i", "x")).groupBy("fold", "lab", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    labels = sums.groupBy("fold", "lab").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"))
    if labels.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} labels and folds")
    of_fold = F.broadcast(labels.groupBy("fold").agg(F.collect_list(F.struct("lab", "n", "s")).alias("of")))
    far = unit.join(of_fold, "fold").select("id", "lab", "fold", F.transform("of", lambda c: F.struct(c["lab"].alias("lab"), c["n"].alias("n"), (c["n"] - dot(F.col("u"), c["s"])).alias("d"))).alias("d"))
    own = F.filter("d", lambda c: c["lab"] == F.col("lab"))[0]
    a = F.when(own["n"] > 1, F.try_divide(F.greatest(own["d"], F.lit(0.0)), own["n"] - 1))
    b = F.array_min(F.transform(F.filter("d", lambda c: c["lab"] != F.col("lab")), lambda c: F.greatest(c["d"] / c["n"], F.lit(0.0))))
    sides = far.select("id", "lab", "fold", a.alias("a"), b.alias("b"))
    score = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return sides.select(F.col("id").alias(id_col), F.col("lab").alias(label_col), "fold", score.alias("silhouette"))


def infer(rows: DataFrame, load: Callable[[], Callable[[pd.Series], np.ndarray]], input_col: str, out: str, kind: str = "array<double>") -> DataFrame:
    """rows with a model's output for each batch of inputs; the model is loaded once in each worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(model(batch)))

    return rows.withColumn(out, F.pandas_udf(run, kind)(F.col(input_col)))


def classified(rows: DataFrame, load: Callable[[], Callable[[pd.Series], np.ndarray]], input_col: str, labels: tuple[str, ...], prefix: str = "") -> DataFrame:
    """rows with <prefix>class, <prefix>label and <prefix>prob: the likeliest of the labels by a model's scores, as of sentiment or of statements about the future.

    Rows of a null input have null ones.
    """
    scored = infer(rows.withColumn("__in", F.coalesce(input_col, F.lit(""))), load, "__in", "__scores")
    top = F.when(F.col(input_col).isNotNull(), best_class(F.col("__scores")))
    told = scored.withColumn("__top", top)
    return told.withColumns({f"{prefix}class": F.col("__top.class"), f"{prefix}label": F.get(F.array(*map(F.lit, labels)), F.col("__top.class")), f"{prefix}prob": F.col("__top.prob")}).drop("__in", "__scores", "__top")


def best_class(scores: Column, softmax: bool = True) -> Column:
    """struct(class, prob) of the highest of an array of scores, the first of equal ones."""
    top = F.array_max(scores)
    total = F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    prob = F.lit(1.0) / total if softmax else top
    return F.struct((F.array_position(scores, top) - 1).cast("int").alias("class"), prob.alias("prob"))
