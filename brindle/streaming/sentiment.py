"""The sentiment aggregates as a stream: by document and time window, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sentiment import METHODS, measures


def windowed_sentiment(stream: DataFrame, at: str = "ts", window: str = "1 day", late: str = "2 hours", methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(doc_id, start, end, methods) of rows (doc_id, at, sentiment_class, sentiment_prob); for batches and streams alike."""
    of = measures(F.col("sentiment_class"), F.col("sentiment_prob"))
    rows = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    grouped = rows.groupBy("doc_id", F.window("__at", window).alias("w")).agg(*(of[m].alias(m) for m in methods))
    return grouped.select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *methods)
