"""Near duplicates among embeddings, by int8 tiles with error bounds.

Unit vectors u are held as s * q + e with integers q in -127..127. For two of them
|u.v - s_u s_v q_u.q_v| <= |e_u| |s_v q_v| + |s_u q_u| |e_v| + |e_u| |e_v|, so a tile of integer
products tells which pairs may reach the threshold; only those are computed in double precision.
Equal vectors of a label are one class from the start. A label with more than `group` classes is
cut into blocks, and every pair of blocks is a task that returns link counts and a spanning
forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, cut


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components, of which one isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """q, s, |s q| and |e| of unit vectors, the norms rounded up."""
    s = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / s[:, None])
    held = q * s[:, None]
    up = 1 + 1e-12
    return q.astype(np.int8), s, np.linalg.norm(held, axis=1) * up, np.linalg.norm(unit - held, axis=1) * up + 1e-15


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of int8 rows: sums of 1024 products stay below 2**24, so float32 holds them."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], 1024):
        out += a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
    return out


def join_tiles(vectors: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float, tile: int = 1024) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted numbers of linked others of each vector, and a spanning forest of the links.

    side: 0 and 1 for two blocks of which only pairs across count; 2 where all pairs count.
    """
    scaled = vectors / np.abs(vectors).max(axis=1)[:, None]
    unit = scaled / np.linalg.norm(scaled, axis=1)[:, None]
    q, s, held, err = quantise(unit)
    links, forest = np.zeros(len(unit), np.int64), Forest(len(unit))
    within = bool(len(side)) and side[0] == 2
    first = np.arange(len(unit)) if within else np.flatnonzero(side == 0)
    second = first if within else np.flatnonzero(side == 1)
    for i in range(0, len(first), tile):
        a = first[i : i + tile]
        for j in range(i if within else 0, len(second), tile):
            b = second[j : j + tile]
            near = integer_products(q[a], q[b]) * s[a][:, None] * s[b]
            near += err[a][:, None] * held[b] + held[a][:, None] * err[b] + err[a][:, None] * err[b] + 1e-9
            x, y = np.nonzero(near >= threshold)
            if within and i == j:
                x, y = x[x < y], y[x < y]
            keep = np.concatenate([np.einsum("ij,ij->i", unit[a[x[k : k + 65536]]], unit[b[y[k : k + 65536]]]) for k in range(0, len(x), 65536)] or [np.zeros(0)]) >= threshold
            x, y = a[x[keep]], b[y[keep]]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
            for k, end in zip(edge, [*edge[1:], len(x)], strict=False):
                forest.link_all(x[k], y[k:end])
    return links, forest.edges


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, group: int = 8192) -> DataFrame:
    """One row per row of vectors: (vec_id, n_links, component_id, kept).

    Rows with equal labels link when the cosine of their vectors is at least the threshold.
    n_links counts the other rows linked directly, component_id is the smallest id reachable by
    links, itself included, and kept tells whether that is the row's own.

    A row links with nothing where its label or vector is null, the vector is empty or zero or
    holds a null or non-finite component, or no other has its length. Repeated rows link with each
    other; rows of a null id take part, count as links and never give a component its id (null where no row of it has one, and never kept). An empty table gives no
    rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.col("label").isNotNull() & usable(F.col("v"))).withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v")))
    # a class of null ids goes by its hash until components are known
    classes = cut(rows.where("ok").groupBy("label", "v", "h").agg(F.min("id").alias("real"), F.count("*").alias("m")).withColumn("id", F.coalesce("real", "h")))
    known = classes.withColumn("dim", F.size("v"))
    blocks = known.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("g"))
    dealt = known.join(blocks, ["label", "dim"]).withColumn("blk", F.pmod(F.xxhash64("h"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("id", "h", "m", "v", "label", "dim", F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1).alias("side"))

    def per_pair(part: pd.DataFrame) -> pd.DataFrame:
        ids, h = part["id"].to_numpy(np.int64), part["h"].to_numpy(np.int64)
        links, edges = join_tiles(np.stack(part["v"].to_list()).astype(np.float64), part["side"].to_numpy(np.int64), part["m"].to_numpy(np.int64), threshold)
        some = np.flatnonzero(links)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        counts = pd.DataFrame({"src": ids[some], "dst": h[some], "links": links[some]})
        return pd.concat([counts, pd.DataFrame({"src": ids[ends[:, 0]], "dst": ids[ends[:, 1]], "links": np.zeros(len(ends), np.int64)})])

    found = cut(dealt.groupBy("label", "dim", "x", "y").applyInPandas(per_pair, "src long, dst long, links long"))
    counts = found.where("links > 0").groupBy(F.col("src").alias("id"), F.col("dst").alias("h")).agg(F.sum("links").alias("links"))
    comps = components(found.where("links = 0").select("src", "dst")).select(F.col("node").alias("id"), "comp")
    if not classes.where("real is null").isEmpty():
        least = comps.join(classes.select("id", "real"), "id").groupBy("comp").agg(F.min("real").alias("least"))
        comps = comps.join(least, "comp").select("id", F.col("least").alias("comp"))
    of_class = classes.join(counts, ["id", "h"], "left").join(comps, "id", "left").select(
        "label", "h", F.col("v").alias("cv"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "real").alias("comp")
    )
    # a class may hold a third of all rows and has one row here: adaptive execution splits the rows' side
    joined = rows.join(of_class, ["label", "h"], "left").where("cv is null or cv = v")
    comp = F.coalesce("comp", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(False)).alias("kept"))
