"""Rows dealt to ranges between cuts, by binary search."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slots(df: DataFrame, cuts: list[float], number: str, slot: str) -> DataFrame:
    """df with the number of cuts up to `number` as a slot, a double; one more than all for null and NaN."""
    rising = sorted({c for c in cuts if math.isfinite(c)})
    if not rising:
        return df.withColumn(slot, F.lit(0.0))
    return Bucketizer(splits=[-math.inf, *rising, math.inf], inputCol=number, outputCol=slot, handleInvalid="keep").transform(df)


def quantile_cuts(df: DataFrame, number: str, parts: int) -> list[float]:
    """Cuts that deal the rows of df into `parts` of about equal size, rising; one comes more than once where a value has more rows than a part."""
    if parts < 2:
        return []
    return list(df.agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [])
