"""Jaccard join of documents on word n-grams, by signature trees.

Documents with equal shingle sets are one class from the start. Classes are dealt into
clusters between which no link can exist, and each cluster is joined with itself by a dual
traversal of a signature tree.

Clusters. The universe of shingles is cut into k parts by hash. Two sets of a size level that
link differ in at most d shingles, so of k = d + 1 + e parts at least e + 1 are equal in both.
Parts with too few shingles to tell anything are not used; a set may have up to e of them, and
one with more is also cut by another hash, in the last resort by all of its parts. So linked
sets always share a part's signature, whatever the data are like, while passages that many
otherwise different documents hold seldom fill a whole part. Signatures travel packed,
and each partition returns only a spanning forest of the sets it has seen together.

Trees. Leaves hold sets of similar size; nodes hold OR-combined bitmaps of the shared tokens and
the range of sizes. A pair of nodes is left as soon as their sizes, or the tokens in both
bitmaps, can't reach the threshold, or when all below is one component already. Clusters above a
bound of tokens are cut into blocks per size level, and every pair of blocks that may link is a
task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, components, cut, mix64, release_memory, shingle_sets, small_batches

LEAF, FAN = 48, 8
RESCUES = 3


class Levels:
    """Size levels and how many parts each cuts the universe into, for a threshold in percent."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("the threshold is a percentage from 50 to 100")
        self.percent, self.bounds = percent, [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(self.bounds[-1] * 100 // percent + 1)
        self._parts: dict[int, tuple[int, int, int, int, np.ndarray]] = {}

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def parts(self, level: int) -> tuple[int, int, int, np.ndarray]:
        """Parts, weak parts allowed, fewest shingles of a part that isn't weak, lower bounds of parts."""
        if level not in self._parts:
            high, low = self.bounds[level + 1] - 1, self.bounds[max(0, level - 1)]
            differ = 2 * high * (100 - self.percent) // (100 + self.percent)
            fewest = 2 if low >= 16 else 1
            k = differ + 1
            for _ in range(20):
                mean = low / k
                weak = k * math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(fewest))
                k = differ + 1 + min(math.ceil(weak + 2.5 * math.sqrt(weak)), differ + 1)
            self._parts[level] = (0, 0, 0, np.zeros(0, np.uint64)) if not differ else (
                k, k - differ - 1, fewest, np.array([-(-(i << 64) // k) for i in range(k)], dtype=np.uint64)
            )
        return self._parts[level]


def signatures(tokens: np.ndarray, levels: Levels) -> np.ndarray:
    """The part signatures of a sorted set of hashes: equal parts of one level have equal ones."""
    out, own = [], levels.of(len(tokens))
    for level in (own, own + 1):
        k, allowed, fewest, low = levels.parts(level)
        if not k:
            continue
        for turn in range(RESCUES + 1):
            seed = np.uint64((turn << 40) + (level << 20) + 1)
            hashed = tokens if not turn else np.sort(mix64(tokens ^ np.uint64(turn * 0x9E3779B9)))
            sums = np.zeros(len(hashed) + 1, np.uint64)
            np.cumsum(mix64(hashed + seed), out=sums[1:])
            edge = np.append(np.searchsorted(hashed, low), len(hashed))
            count = np.diff(edge)
            sign = mix64(sums[edge[1:]] - sums[edge[:-1]] + mix64(np.arange(k, dtype=np.uint64) + (seed << np.uint64(8))))
            weak = count < fewest
            out.append(sign if turn == RESCUES else sign[~weak])
            if weak.sum() <= allowed:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def join_sets(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets by the dual traversal of a signature tree.

    side: 0 and 1 for two blocks of which only pairs across count; 2 where all pairs count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, side = sizes[order], side[order]
    every = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), sizes)
    _, token, df = np.unique(every, return_inverse=True, return_counts=True)
    shared = df > 1
    rename = np.cumsum(shared) - 1
    keep = shared[token]
    owner, token = owner[keep], rename[token[keep]]
    vocabulary = int(shared.sum())
    start = np.searchsorted(owner, np.arange(n + 1))
    bits = max(64, min(1 << 15, 1 << max(0, vocabulary - 1).bit_length()))
    slot = token & (bits - 1) if vocabulary <= bits else (mix64(token.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
    weight = np.bincount(np.arange(vocabulary) if vocabulary <= bits else (mix64(np.arange(vocabulary, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    forest = Forest(n)

    # the tree, bottom up: nodes are ranges of the sets in order of size
    tree = [[(a, min(n, a + LEAF)) for a in range(0, n, LEAF)]]
    maps = [np.zeros((len(tree[0]), bits), bool)]
    maps[0][owner // LEAF, slot] = True
    while len(tree[-1]) > 1:
        below = tree[-1]
        tree.append([(below[i][0], below[min(len(below), i + FAN) - 1][1]) for i in range(0, len(below), FAN)])
        maps.append(np.array([maps[-1][i : i + FAN].any(axis=0) for i in range(0, len(below), FAN)]))

    held = [np.unique(token[start[a] : start[b]]) for a, b in tree[0]]

    def incidence(i: int, columns: np.ndarray) -> np.ndarray:
        """Which of a leaf's sets hold which of the tokens."""
        a, b = tree[0][i]
        own, row = token[start[a] : start[b]], owner[start[a] : start[b]] - a
        at = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
        fit = columns[at] == own
        x = np.zeros((b - a, len(columns)), np.float32)
        x[row[fit], at[fit]] = 1
        return x

    stack = [(len(tree) - 1, 0, 0)]
    while stack:
        height, i, j = stack.pop()
        (a, b), (c, d) = tree[height][i], tree[height][j]
        if sizes[b - 1] * 100 < percent * sizes[c]:
            continue
        if (forest.root[a:b] == forest.root[a]).all() and (forest.root[c:d] == forest.root[a]).all():
            continue
        needed = percent * (sizes[a] + sizes[c])
        if (100 + percent) * int(weight[maps[height][i] & maps[height][j]].sum()) < needed:
            continue
        if height:
            # nearest sizes last, so that they are taken first and later pairs are one component
            stack += [(height - 1, x, y) for x in range(i * FAN, min(len(tree[height - 1]), i * FAN + FAN)) for y in range(max(x, j * FAN), min(len(tree[height - 1]), j * FAN + FAN))][::-1]
            continue
        both = held[i] if i == j else np.intersect1d(held[i], held[j], assume_unique=True)
        if not len(both):
            continue
        overlap = incidence(i, both) @ incidence(j, both).T
        linked = (100 + percent) * overlap.astype(np.int64) >= percent * (sizes[a:b, None] + sizes[None, c:d])
        linked &= (side[a:b, None] == 2) | (side[a:b, None] != side[None, c:d])
        for x in np.flatnonzero(linked.any(axis=1)):
            forest.link_all(a + x, c + np.flatnonzero(linked[x]))
    return [(int(order[x]), int(order[y])) for x, y in forest.edges]


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _classes(rows: DataFrame, width: int) -> DataFrame:
    """(doc, n, h1, h2) of each row: the size and a 128-bit hash of its shingle set."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            n = np.array([len(s) for s in sets], np.int64)
            h1 = np.array([np.add.reduce(mix64(s), dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            h2 = np.array([np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(_as_long(h1)), pa.array(_as_long(h2))], ["doc", "n", "h1", "h2"])

    return rows.mapInArrow(per_batch, "doc long, n long, h1 long, h2 long")


def _candidate_edges(rows: DataFrame, width: int, percent: int, pieces: int) -> DataFrame:
    """(src, dst) of h1: a spanning forest of the sets that share a part's signature."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(percent)
        for batch in batches:
            found, owners, table = [], [], []
            for tokens in shingle_sets(batch.column(0), width):
                if len(tokens) and len(got := signatures(tokens, levels)):
                    found.append(got)
                    owners.append(np.full(len(got), len(table), np.uint32))
                    table.append(np.add.reduce(mix64(tokens), dtype=np.uint64))
            if not found:
                continue
            sign, owner, known = np.concatenate(found), np.concatenate(owners), np.array(table, np.uint64)
            piece = (sign >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)
            order = np.argsort(piece, kind="stable")
            sign, owner, piece = sign[order], owner[order], piece[order]
            edge = np.searchsorted(piece, np.arange(pieces + 1, dtype=np.uint64))
            full = [p for p in range(pieces) if edge[p] < edge[p + 1]]
            each = [(sign[edge[p] : edge[p + 1]], owner[edge[p] : edge[p + 1]]) for p in full]
            used = [np.unique(o) for _, o in each]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()),
                pa.array([s.tobytes() for s, _ in each], pa.binary()),
                pa.array([np.searchsorted(u, o).astype(np.uint32).tobytes() for (_, o), u in zip(each, used, strict=True)], pa.binary()),
                pa.array([known[u].tobytes() for u in used], pa.binary()),
            ], ["piece", "sign", "owner", "known"])
        release_memory()

    def forest(batch: pd.DataFrame) -> pd.DataFrame:
        sign, owner, known, base = [], [], [], 0
        for s, o, k in zip(batch["sign"], batch["owner"], batch["known"], strict=True):
            sign.append(np.frombuffer(s, np.uint64))
            owner.append(np.frombuffer(o, np.uint32).astype(np.int64) + base)
            known.append(np.frombuffer(k, np.uint64))
            base += len(known[-1])
        sign, owner, known = np.concatenate(sign), np.concatenate(owner), np.concatenate(known)
        order = np.argsort(sign, kind="stable")
        sign, owner = sign[order], owner[order]
        same = np.flatnonzero(sign[1:] == sign[:-1])
        a, b = known[owner[same]], known[owner[same + 1]]
        a, b = a[a != b], b[a != b]
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        out = []
        for x, y in pairs.tolist():
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
        ends = np.array(out, np.uint64).reshape(-1, 2)
        del sign, owner, known, order, parent
        release_memory()
        return pd.DataFrame({"src": _as_long(ends[:, 0].copy()), "dst": _as_long(ends[:, 1].copy())})

    packed = rows.select("text").mapInArrow(pack, "piece int, sign binary, owner binary, known binary")
    return packed.groupBy("piece").applyInPandas(forest, "src long, dst long")


def _links(sets: DataFrame, percent: int, bound: int) -> DataFrame:
    """(src, dst): a spanning forest of the links inside each cluster of (id, cluster, n, tokens)."""
    sized = sets.select("id", "cluster", "n", "level", "tokens")
    totals = cut(sized.groupBy("cluster", "level").agg(F.sum("n").alias("t")))
    whole = totals.groupBy("cluster").agg(F.sum("t").alias("all"))
    plan = totals.join(whole.where(F.col("all") > bound).drop("all"), "cluster").select(
        "cluster", "level", F.ceil(F.col("t") / F.lit(bound / 2)).cast("int").alias("m")
    )
    near = (
        plan.alias("p")
        .join(plan.select("cluster", F.col("level").alias("l2"), F.col("m").alias("m2")).alias("q"), "cluster", "left")
        .groupBy("cluster", "level", "m")
        .agg(F.max(F.when(F.col("l2") == F.col("level") + 1, F.col("m2"))).alias("up"), F.max(F.when(F.col("l2") == F.col("level") - 1, F.col("m2"))).alias("down"))
    )
    keyed = sized.join(near, ["cluster", "level"], "left").withColumn("blk", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("id"), F.col("m")).cast("int")))
    keys = F.when(F.col("m").isNull(), F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("x"), F.lit(-1).alias("b"), F.lit(-1).alias("y"), F.lit(2).alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.struct(F.col("level").alias("a"), F.least("blk", j).alias("x"), F.col("level").alias("b"), F.greatest("blk", j).alias("y"), F.when(F.col("blk") == j, 2).when(F.col("blk") < j, 0).otherwise(1).alias("side"))),
            F.when(F.col("up").isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda j: F.struct(F.col("level").alias("a"), F.col("blk").alias("x"), (F.col("level") + 1).alias("b"), j.alias("y"), F.lit(0).alias("side")))),
            F.when(F.col("down").isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda j: F.struct((F.col("level") - 1).alias("a"), j.alias("x"), F.col("level").alias("b"), F.col("blk").alias("y"), F.lit(1).alias("side")))),
        )
    )
    dealt = keyed.select("id", "cluster", "tokens", F.explode(keys).alias("k")).select("id", "cluster", "tokens", "k.*")

    def per_group(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy(np.int64)
        if len(ids) < 2:
            return pd.DataFrame({"src": [], "dst": []}).astype("int64")
        got = join_sets([np.frombuffer(t, np.uint64) for t in group["tokens"]], group["side"].to_numpy(np.int64), percent)
        ends = np.array(got, np.int64).reshape(-1, 2)
        return pd.DataFrame({"src": ids[ends[:, 0]], "dst": ids[ends[:, 1]]})

    return dealt.groupBy("cluster", "a", "x", "b", "y").applyInPandas(per_group, "src long, dst long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, bound: int = 1_500_000) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id).

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of width-word shingles;
    component_id is the smallest doc_id reachable by links, itself included. No link between
    different sets is lost.

    Null, empty and blank texts have n_shingles 0 and link with nothing. Texts are taken whole at any length. Repeated rows are one
    class and all returned; rows with a null id are returned and never give a component its id
    (null where no row of the component has one). Other columns of docs are ignored, an empty
    table gives no rows. bound: tokens of a cluster beyond which it is joined by pairs of blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        if rows.where("doc is null").isEmpty():
            return _ngram_components(rows, width, percent, bound)
        # rows of a null id go by a hash of their text until components are known
        named = F.coalesce("doc", F.xxhash64("text", F.lit("no id")))
        found = cut(_ngram_components(rows.select(named.alias("doc"), "text"), width, percent, bound))
    nameless = rows.where("doc is null").select(named.alias("doc_id"), F.lit(True).alias("nameless")).distinct()
    told = found.join(nameless, "doc_id", "left")
    least = told.where("nameless is null").groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return told.join(least, "component_id", "left").select(F.when(F.col("nameless").isNull(), F.col("doc_id")).alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _ngram_components(rows: DataFrame, width: int, percent: int, bound: int) -> DataFrame:
    per_doc = cut(_classes(rows, width))
    classes = per_doc.where("n > 0").groupBy("h1", "h2").agg(F.min("doc").alias("id"), F.first("n").alias("n"))
    total = per_doc.agg(F.sum("n")).first()[0] or 0
    # by volume alone: each piece returns a forest, and more pieces than memory asks for only repeat its edges
    pieces = max(8, math.ceil(total * 0.5 / 1_500_000))
    edges = _candidate_edges(rows, width, percent, pieces)
    clusters = components(edges).select(F.col("node").alias("h1"), F.col("comp").alias("cluster"))
    taking_part = cut(classes.join(clusters, "h1"))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(percent)
        for batch in batches:
            sets = shingle_sets(batch.column(4), width)
            h1 = _as_long(np.array([np.add.reduce(mix64(s), dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64))
            fit = h1 == batch.column(2).to_numpy(zero_copy_only=False)
            sets = [s for s, ok in zip(sets, fit, strict=True) if ok]
            mask = pa.array(fit)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).filter(mask), batch.column(1).filter(mask), batch.column(3).filter(mask), pa.array([levels.of(len(s)) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["id", "cluster", "n", "level", "tokens"])

    texts = taking_part.join(rows, taking_part["id"] == rows["doc"]).select("id", "cluster", "h1", "n", "text")
    sets = texts.mapInArrow(tokens_of, "id long, cluster long, n long, level int, tokens binary")
    found = components(_links(sets, percent, bound)).select(F.col("node").alias("id"), "comp")
    of_class = classes.join(found, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("comp"))
    return per_doc.join(of_class, ["h1", "h2"], "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc")).alias("component_id")
    )
