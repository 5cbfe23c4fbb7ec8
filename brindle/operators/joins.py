"""Joins on time: the last value before, values within an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import quantile_cuts, slots

#: Rows that an as-of table may have to be sent whole to every executor.
SMALL = 200_000
#: Whole numbers up to this are exact as doubles.
EXACT = float(1 << 53)


def _number(c: Column, kind: str) -> Column | None:
    """A time as a number that never falls as it rises; null where the type has none."""
    if kind == "date":
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return c.cast("double")
    return None


def _named(left: DataFrame, values: list[str]) -> dict[str, str]:
    """The values' names in the result: _right is added where left has a column of that name."""
    return {v: f"{v}_right" if v in left.columns else v for v in values}


def _latest(values: list[str], order: str | None) -> Column:
    """Of rows of one time the values of the one with the highest order; equal ones by a hash of the values."""
    columns = [F.col(f"`{v}`") for v in values]
    return F.max_by(F.struct(*(c.alias(f"v{i}") for i, c in enumerate(columns))), F.struct((F.col(f"`{order}`") if order else F.lit(0)).cast("double"), F.xxhash64(*columns)))


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: list[str], by: list[str] | None = None, order: str | None = None) -> DataFrame:
    """left with the values of the last right row whose time isn't after its own, null where there is none.

    by: columns that both sides must agree in; null keys agree. order: of right rows of one time the one with the highest counts, of equal ones any that
    its values' hash tells. A null time on the left has null values, on the right it counts nowhere. Repeated rows all stay, empty sides do no harm; a value
    named like a column of left comes with _right added.

    Different times of both sides, with the values at each, are dealt by key and range of time, at quantiles of all times. A range is
    filled forward on its own, and what the ranges before it end with is carried over their borders. So neither a key
    with a long history, nor many rows at one time, nor having no keys puts the rows into one task; rows then find their time by an equal join.
    """
    by, names = by or [], _named(left, values)
    kinds = dict(left.dtypes)[left_on], dict(right.dtypes)[right_on]
    keys = [f"__k{i}" for i in range(len(by))]
    keyed = [F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)]
    ticks = right.where(F.col(f"`{right_on}`").isNotNull()).groupBy(*keyed, F.col(f"`{right_on}`").alias("__t")).agg(_latest(values, order).alias("__v"))
    asks = left.where(F.col(f"`{left_on}`").isNotNull()).select(*keyed, F.col(f"`{left_on}`").alias("__t"), F.lit(None).cast(ticks.schema["__v"].dataType).alias("__v"))
    times = asks.unionByName(ticks)  # of the wider type, where the sides differ
    number = _number(F.col("__t"), dict(times.dtypes)["__t"]) if all(_number(F.lit(0), k) is not None for k in kinds) else None
    if number is None:
        dealt = times.withColumn("__b", F.lit(0.0))
    else:
        parts = max(2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        numbered = times.withColumn("__n", number)
        dealt = slots(numbered, quantile_cuts(numbered, "__n", parts), "__n", "__b").drop("__n")
    each = dealt.groupBy(*keys, "__b", "__t").agg(F.first("__v", ignorenulls=True).alias("__v"))
    inside = Window.partitionBy(*keys, "__b")
    filled = each.withColumn("__in", F.last("__v", ignorenulls=True).over(inside.orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)))
    # a row for each key and range of time
    ends = each.groupBy(*keys, "__b").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__t"))).alias("__end"))
    carried = ends.select(*keys, "__b", F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    known = filled.alias("a").join(carried.alias("c"), [F.col("a.__b") == F.col("c.__b"), *same]).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.__t").alias("__t"), F.coalesce("a.__in", "c.__before").alias("__found"))
    asked = left.alias("l").join(known.alias("r"), [F.col(f"l.`{left_on}`") == F.col("r.__t"), *(F.col(f"l.`{b}`").eqNullSafe(F.col(f"r.{k}")) for b, k in zip(by, keys, strict=True))], "left")
    return asked.select("l.*", *(F.col(f"r.__found.v{i}").alias(names[v]) for i, v in enumerate(values)))


def asof_small(left: DataFrame, right: DataFrame, left_on: str, right_on: str, values: list[str], order: str | None = None) -> DataFrame:
    """The same without keys, for a right side of at most SMALL times, which all executors get; over that bound it is `asof`.

    The right side's times are cuts, and each row of left finds its own between two of them by binary search, however they are spread: the number of the
    cut is the key of a hash join with one row for each. left is not shuffled. Times that doubles can't tell apart go to `asof`.
    """
    names, kinds = _named(left, values), (dict(left.dtypes)[left_on], dict(right.dtypes)[right_on])
    plain = all(k == "date" or k.startswith("timestamp") for k in kinds) or all(k in ("tinyint", "smallint", "int", "bigint", "float", "double") for k in kinds)
    ticks = right.where(F.col(f"`{right_on}`").isNotNull()).groupBy(F.col(f"`{right_on}`").alias("__t")).agg(_latest(values, order).alias("__v"))
    numbered = ticks.select(_number(F.col("__t"), kinds[1]).alias("__n"), "__v") if plain else None
    found = [r["__n"] for r in numbered.select("__n").limit(SMALL + 1).collect()] if plain else []
    if not plain or len(found) > SMALL or any(not abs(n) < EXACT for n in found):
        return asof(left, right, left_on, right_on, values, order=order)
    if not found:
        return left.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(names[v]) for v in values))
    table = slots(numbered, found, "__n", "__slot").select("__slot", *(F.col(f"__v.v{i}").alias(f"__v{i}") for i in range(len(values))))
    # the row as one column: whatever its columns are called
    rows = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__row"), _number(F.col(f"`{left_on}`"), kinds[0]).alias("__n"))
    asked = slots(rows, found, "__n", "__slot")
    joined = asked.join(F.broadcast(table), (asked["__slot"] == table["__slot"]) & asked["__n"].isNotNull(), "left")  # SMALL rows at most
    return joined.select(*(F.col(f"__row.`{c}`").alias(c) for c in left.columns), *(F.col(f"__v{i}").alias(names[v]) for i, v in enumerate(values)))


def within_interval(left: DataFrame, right: DataFrame, start: Column, end: Column, at: str, by: list[str], bucket_days: int = 366) -> DataFrame:
    """Inner join of left to the right rows with equal keys and a date from start to end, both included.

    The keys are joined with the dates' buckets, so that a key with a long history is still dealt out.
    """
    number = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / F.lit(bucket_days))
    spread = left.withColumns({"__s": start, "__e": end}).where(F.col("__s") <= F.col("__e"))
    spread = spread.withColumn("__b", F.explode(F.sequence(number(F.col("__s")), number(F.col("__e")))))
    placed = right.withColumn("__b", number(F.col(at)))
    return spread.join(placed, [*by, "__b"]).where(F.col(at).between(F.col("__s"), F.col("__e"))).drop("__b", "__s", "__e")
