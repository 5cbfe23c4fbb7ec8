"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal volume. Were blocks divisible, all sources that still have some would be served at once, each
by its weight's share of theirs; a source's i-th block (from 0) would begin and end at times that are known exactly. The block is released at the
slot in which it would begin, and due at the end of the one in which it would end. Of the released blocks the one due first gets the slot.
Every block is on time, so at each moment each source is less than one block away from its exact share. Times are
ratios of whole numbers, nothing is rounded and nothing repeats; weights of any ratio hold. The blocks, of which there are MOST_BLOCKS and one a source at
most, are laid out on the driver; a document finds its slot by a join with its block.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_SOURCES = 512
#: Where block_chars would make more blocks than these, blocks are longer: it is a volume over this.
MOST_BLOCKS = 1 << 19
#: Blocks of a source whose slots are one row of the schedule.
CHUNK = 256
BUCKET_ROWS = 20_000
#: The columns that mix() adds.
MINE = ("mix_source", "mix_weight", "mix_block", "mix_slot", "mix_offset")


class Shares:
    """When the blocks of sources begin and end if all are served at once by their weights, and those left share what others leave."""

    def __init__(self, weights: list[float], blocks: list[int]):
        exact = [Fraction(w) for w in weights]
        if any(w <= 0 for w in exact):
            raise ValueError("weights are above 0")
        scale = math.lcm(*(w.denominator for w in exact))
        self.weights, self.blocks = [int(w * scale) for w in exact], blocks
        # sources in the order in which they run out; ends[k]: how far each source is when the k-th does
        order = sorted(range(len(blocks)), key=lambda s: (Fraction(blocks[s], self.weights[s]), s))
        self.ends = [[self.weights[s] * blocks[k] // self.weights[k] for k in order] for s in range(len(blocks))]
        gone, live = 0, sum(self.weights)
        self.before = [(gone, live)]  # blocks of those that have run out, weight of the others
        for k in order:
            gone, live = gone + blocks[k], live - self.weights[k]
            self.before.append((gone, live))
        self.phase = [0] * len(blocks)

    def window(self, s: int, i: int) -> tuple[int, int]:
        """The slot of release and the one before which block i of source s is due; to be asked for rising i."""
        return self._time(s, i, False), self._time(s, i + 1, True)

    def _time(self, s: int, i: int, up: bool) -> int:
        ends, k = self.ends[s], self.phase[s]
        while i > ends[k]:  # the last phase of a source ends with its last block
            k += 1
        if not up:
            self.phase[s] = k
        gone, live = self.before[k]
        return gone + (-(-i * live // self.weights[s]) if up else i * live // self.weights[s])


def slots_of(weights: list[float], blocks: list[int]) -> list[list[int]]:
    """The slot of each block of each source: earliest deadline first among the released."""
    shares, out = Shares(weights, blocks), [[] for _ in blocks]
    waiting: list[tuple[int, int, int]] = []
    ready: list[tuple[int, int]] = []
    for s, n in enumerate(blocks):
        if n:
            waiting.append((*shares.window(s, 0), s))
    heapq.heapify(waiting)
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            _, due, s = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s))
        due, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline has passed")
        out[s].append(t)
        if len(out[s]) < blocks[s]:
            heapq.heappush(waiting, (*shares.window(s, len(out[s])), s))
    return out


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, power: float = 0.5, block_chars: int = 100_000) -> DataFrame:
    """docs with (mix_source, mix_weight, mix_block, mix_slot, mix_offset): read by slot and offset, the sources mix.

    weights: of sources, by name; without them, volume to the given power. Sources outside of weights get the
    least weight. Weights are above 0. Each row is kept once. A source's documents come in the order of a hash of their
    id and text; a block has those that begin in its block_chars characters, or in its part where those would make more than MOST_BLOCKS
    blocks, and one of greater length takes up the blocks that it covers. Until a source runs out, each is less than a block from its weight's share
    of the slots at any time; from then on the others share by their weights.

    A null source is the source "". A null or empty text takes one character, so that nothing vanishes; null
    ids, repeated rows and clashing column names are kept (mix_ columns are replaced). An empty
    table gives no rows. At most MAX_SOURCES sources.
    """
    docs = docs.drop(*MINE)
    volume = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    held = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s")).agg(F.count("*").alias("n"), F.sum(volume).alias("v"))
    table = held.limit(MAX_SOURCES + 1).collect()
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    table.sort(key=lambda r: r["s"])
    rows = sum(r["n"] for r in table)
    buckets = max(1, -(-rows // BUCKET_ROWS))
    least = min(weights.values()) if weights else 0.0
    share = [weights.get(r["s"], least) if weights else float(r["v"]) ** power for r in table]
    total = math.fsum(share) or 1.0
    block_chars = max(block_chars, -(-sum(r["v"] for r in table) // MOST_BLOCKS))
    slots = slots_of(share, [-(-r["v"] // block_chars) for r in table]) if table else []
    plan = [(r["s"], at // CHUNK, own[at : at + CHUNK]) for r, own in zip(table, slots, strict=True) for at in range(0, len(own), CHUNK)]
    spark = docs.sparkSession
    schedule = spark.createDataFrame(plan, "__t string, __chunk long, __slots array<long>")
    weight = spark.createDataFrame([(r["s"], w / total) for r, w in zip(table, share, strict=True)], "__t string, mix_weight double")

    # the text spreads rows of one id, or of none, over buckets
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    known = docs.withColumns({"__s": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__v": volume, "__o": order, "__b": _bucket(order, buckets)})
    if buckets > 1:
        sums = known.groupBy("__s", "__b").agg(F.sum("__v").alias("v"))
        base = sums.select("__s", "__b", (F.sum("v").over(Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("v")).alias("__base"))
        known = known.join(cut(base), ["__s", "__b"])
    else:
        known = known.withColumn("__base", F.lit(0).cast("long"))
    inside = Window.partitionBy("__s", "__b").orderBy("__o", id_col).rowsBetween(Window.unboundedPreceding, 0)
    placed = known.withColumn("mix_offset", F.col("__base") + F.sum("__v").over(inside) - F.col("__v")).withColumn("mix_block", F.floor(F.col("mix_offset") / F.lit(block_chars)).cast("long"))
    chunk = F.floor(F.col("mix_block") / F.lit(CHUNK)).cast("long")
    # of MAX_SOURCES rows, and MOST_BLOCKS slots
    found = placed.join(F.broadcast(schedule), (F.col("__s") == F.col("__t")) & (chunk == F.col("__chunk"))).drop("__t")
    found = found.join(F.broadcast(weight), F.col("__s") == F.col("__t")).drop("__t")
    slot = F.get("__slots", F.pmod("mix_block", F.lit(CHUNK)).cast("int"))
    return found.withColumn("mix_slot", slot).select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__s").alias("mix_source"), *MINE[1:3], "mix_slot", "mix_offset")


def _bucket(order: Column, buckets: int) -> Column:
    """The hash's part of its range, so that buckets ascend with it."""
    return F.floor((order.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(buckets)).cast("long")


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with their columns, in the order of the mix, over files and within.

    Nulls, empty texts, repeated rows and empty tables as in mix(); columns named like its own are kept as they are.
    """
    held = {c: f"__held_{c}" for c in docs.columns if c in MINE}
    mixed = mix(docs.withColumnsRenamed(held), **options)
    ordered = mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
    return ordered.select(*(F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns))
