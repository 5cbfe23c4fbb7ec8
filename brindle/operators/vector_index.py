"""A stored index for nearest neighbours: lists around centres, several of which are looked through, distances exact.

Vectors are filed under the nearest of some centres, which k-means finds on a bounded sample. A search ranks the centres for each
query and compares it with all vectors of the first lists, in full precision, so only a neighbour filed farther away can be missed. How many
lists that takes is measured when the index is made, on queries of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import _top, commonest_size, nearest, norm, usable

#: Rows on which the centres are fitted at most; all rows are filed.
FIT_ROWS = 100_000
#: Rows that ask for their NEIGHBOURS nearest when the index is made; as many lists are looked through as hold RECALL of these.
ASKED, NEIGHBOURS, RECALL = 256, 10, 0.95
#: Centres that may be sent to all tasks; rows of a list, or queries of one, that meet in a task.
MOST_LISTS, LIST_ROWS = 16_384, 8_192


def _unit(rows: DataFrame, size: int) -> DataFrame:
    """(id, v) of usable vectors of the size, of length 1; others can't be near to anything."""
    good = rows.where(F.col("id").isNotNull() & usable(F.col("v")) & (F.size("v") == size)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    return good.withColumn("__l", norm(F.col("v"))).where("__l > 0").select("id", F.transform("v", lambda x: F.try_divide(x, F.col("__l"))).alias("v"))


def build(vectors: DataFrame, folder: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, seed: int = 42) -> None:
    """Write the index of the vectors' directions to the folder: its lists, and its centres with how many vectors each has.

    lists: about the root of the number of vectors. Null, zero and not finite vectors, those of another length than the commonest and those of null ids aren't
    filed; repeated rows are, each. An empty table makes an empty index.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    size = commonest_size(rows) or 0
    unit = _unit(rows, size)
    n = unit.count()
    wanted = min(MOST_LISTS, lists or max(1, round(math.sqrt(n))))
    centres = np.zeros((0, size))
    if n:
        sample = unit.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, -(-n // FIT_ROWS)))) == 0)
        sample = sample if not sample.isEmpty() else unit
        model = KMeans(k=max(2, wanted), seed=seed, maxIter=10, featuresCol="f", distanceMeasure="cosine").fit(sample.select(array_to_vector("v").alias("f")))
        centres = np.array(model.clusterCenters())
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)[:, None]
    held = spark.sparkContext.broadcast(centres)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(list=np.argmax(np.stack(b["v"].to_list()) @ held.value.T, axis=1).astype(np.int32))

    filed = unit.mapInPandas(file, "id long, v array<double>, list int")
    filed.repartitionByRange("list", "id").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{folder}/lists")
    counts = {r["list"]: r["n"] for r in spark.read.parquet(f"{folder}/lists").groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS at most
    probes = _probes(spark.read.parquet(f"{folder}/lists"), centres, n, seed) if n else 1
    table = [(i, c.tolist(), counts.get(i, 0), probes) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list int, centre array<double>, n long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")


def _probes(filed: DataFrame, centres: np.ndarray, n: int, seed: int) -> int:
    """Lists to be looked through, in the order of their centres, so that RECALL of the exact neighbours of some rows are in them; ASKED rows, about, ask."""
    some = filed.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(max(1, n // ASKED))) == 0).select("id", "v").limit(4 * ASKED)
    asked = {r["id"]: np.array(r["v"]) for r in some.collect()}
    if not asked:
        return len(centres)
    queries = filed.sparkSession.createDataFrame([(i, v.tolist()) for i, v in asked.items()], "id long, v array<double>")
    exact = nearest(queries, filed.select("id", "v"), NEIGHBOURS, others=True)
    held = exact.join(filed.select(F.col("id").alias("neighbour"), "list"), "neighbour").select("q", "list").collect()  # NEIGHBOURS for each that asks
    order = {i: np.argsort(np.argsort(-(centres @ v), kind="stable")) for i, v in asked.items()}
    ranks = np.sort([order[r["q"]][r["list"]] for r in held])
    return int(ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)))]) + 1 if len(ranks) else 1


def search(spark: SparkSession, queries: DataFrame, folder: str, k: int, probes: int | None = None, others: bool = False) -> DataFrame:
    """(q, rank, neighbour, distance): of each query (id, v) the k nearest filed vectors, by cosine distance, in the lists of its `probes` nearest centres.

    Ties go by id. probes: as the index was made for, by default; as many as there are lists make it exact. others: vectors of a query's own id don't count. Queries that
    are null, zero, not finite or of another length find nothing. Large lists, and lists of many queries, are dealt to several tasks.
    """
    table = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()  # MOST_LISTS rows at most
    schema = "q long, neighbour long, distance double"
    if not table:
        return spark.createDataFrame([], "q long, rank int, neighbour long, distance double")
    held = spark.sparkContext.broadcast(np.array([r["centre"] for r in table]))
    depth = min(len(table), probes or table[0]["probes"])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.stack(b["v"].to_list())
                near = np.argsort(-(v @ held.value.T), axis=1, kind="stable")[:, :depth]
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), depth), "v": [x for x in b["v"] for _ in range(depth)], "list": near.ravel().astype(np.int32)})

    asked = _unit(queries, len(table[0]["centre"])).mapInPandas(probe, "id long, v array<double>, list int")
    # a row for each list: the parts that its vectors make, and those that its queries make
    parts = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(LIST_ROWS)).cast("int").alias("many"))
    sizes = spark.read.parquet(f"{folder}/centres").select("list", F.greatest(F.ceil(F.col("n") / F.lit(LIST_ROWS)), F.lit(1)).cast("int").alias("parts"))
    dealt = F.broadcast(parts.join(sizes, "list"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = asked.join(dealt, "list").withColumn("y", part("many")).withColumn("x", every("parts")).select("list", "x", "y", "id", "v")
    two = spark.read.parquet(f"{folder}/lists").join(dealt, "list").withColumn("x", part("parts")).withColumn("y", every("many")).select("list", "x", "y", "id", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "neighbour": pd.Series(dtype="int64"), "distance": pd.Series(dtype=float)})
        right = right.sort_values("id", kind="stable")
        ids, other = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        x, y, d = _top(np.stack(left["v"].to_list()), ids, np.stack(right["v"].to_list()), other, k, "cosine", others)
        return pd.DataFrame({"q": ids[x], "neighbour": other[y], "distance": d})

    keys = ("list", "x", "y")
    found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInPandas(compare, schema)
    order = Window.partitionBy("q").orderBy(F.round("distance", 12), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "neighbour", "distance")


def recall(found: DataFrame, exact: DataFrame) -> float | None:
    """The share of exact neighbours (q, neighbour) that were found; null without any."""
    pairs = exact.select("q", "neighbour").distinct()
    hits = pairs.join(found.select("q", "neighbour").distinct(), ["q", "neighbour"], "left_semi").count()
    total = pairs.count()
    return hits / total if total else None
