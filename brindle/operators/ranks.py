"""Ranks and exact quantiles in two levels, so that no task sorts a whole table or class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cuts that deal a column's values into buckets of about equal size.
CUTS = 64


def checksum(key: str, seed: int) -> Column:
    """A number of 32 bits from a key's text and a seed, to deal rows by."""
    return F.crc32(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed))))


def ranked(rows: DataFrame, by: list[str], key: str, seed: int = 42, rank: str = "__r", size: str = "__n") -> DataFrame:
    """rows with their rank from 0 among those of equal `by`, in the order of the key's checksum and the key, and the number of those.

    The checksum's buckets are ranked each on its own, and begin at the number of rows in those before. Null keys come
    first among equal checksums, null values of `by` are a class, repeated rows have ranks of their own in any order, and no rows give none.
    """
    dealt = rows.withColumn("__h", F.coalesce(checksum(key, seed), F.lit(0))).withColumn("__b", F.shiftright("__h", 24))
    names = [f"__by{i}" for i in range(len(by))]
    keys = dealt.withColumns({n: F.struct(F.col(f"`{c}`")) for n, c in zip(names, by, strict=True)}) if by else dealt
    counts = keys.groupBy(*names, "__b").agg(F.count("*").alias("__c"))
    # a row for each class and bucket, of which there are 256
    over = Window.partitionBy(*names)
    base = counts.select(*names, "__b", (F.sum("__c").over(over.orderBy("__b")) - F.col("__c")).alias("__base"), F.sum("__c").over(over).alias(size))
    inside = Window.partitionBy(*names, "__b").orderBy("__h", key)
    return keys.join(base, [*names, "__b"]).withColumn(rank, F.col("__base") + F.row_number().over(inside) - 1).drop("__h", "__b", "__base", *names)


def quantiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...]) -> DataFrame:
    """One row with an array of exact, interpolated quantiles for each column; nulls for a column without values.

    Approximate cuts deal a column's values into buckets, whose sizes tell which hold the wanted ranks; only in those
    are values counted one by one. NaN counts as the highest value.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("a quantile lies between 0 and 1")
    spots = {f"__c{i}": F.col(f"`{c}`").cast("double") for i, c in enumerate(columns)}
    values = rows.select(*(v.alias(n) for n, v in spots.items())).unpivot([], list(spots), "c", "v").where("v is not null")
    # all that is broadcast here has at most CUTS rows for each column
    known = values.groupBy("c").agg(F.percentile_approx("v", F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), F.lit(20 * CUTS)).alias("cuts"))
    placed = values.join(F.broadcast(known), "c").select("c", "v", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("b"))
    counts = placed.groupBy("c", "b").agg(F.count("*").alias("m"))
    each = Window.partitionBy("c")
    held = counts.select("c", "b", (F.sum("m").over(each.orderBy("b")) - F.col("m")).alias("before"), "m", F.sum("m").over(each).alias("n"))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(s) * (F.col("n") - 1)), F.ceil(F.lit(s) * (F.col("n") - 1))) for s in shares))))
    wanted = held.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("m")))).where(F.size("ranks") > 0).select("c", "b", "before", "n", "ranks")
    repeats = placed.join(F.broadcast(wanted), ["c", "b"]).groupBy("c", "b", "before", "n", "ranks", "v").agg(F.count("*").alias("m"))
    until = F.col("before") + F.sum("m").over(Window.partitionBy("c", "b").orderBy("v"))
    found = repeats.withColumn("until", until).select("c", "n", "v", F.explode(F.filter("ranks", lambda r: (r < F.col("until")) & (r >= F.col("until") - F.col("m")))).alias("rank"))
    at = found.groupBy("c").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def value(share: float) -> Column:
        spot = F.lit(share) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(spot)), F.element_at("at", F.ceil(spot))
        return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    listed = at.select("c", F.array(*(value(s) for s in shares)).alias("q"))
    return listed.agg(*(F.max_by("q", F.when(F.col("c") == n, 1)).alias(c) for n, c in zip(spots, columns, strict=True)))
