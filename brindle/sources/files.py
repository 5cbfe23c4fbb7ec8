"""Reading archives of filings, answers and feature tables, and writing them."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILING = "archive string, entry string, text string"
ANSWERS = "sentence_index long, sentence string, prompt string, topic string, explanation string, probability int"


def read_archives(spark: SparkSession, path: str, name_has: str = "_10-K_", suffix: str = "*.zip") -> DataFrame:
    """(archive, entry, text): a row for each member of the zip files whose name has the keyword, decoded as UTF-8.

    For stores that only Spark's own readers open: an archive is one task and beyond spark.sql.sources.binaryFile.maxLength it is an error;
    archives.read_members splits them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name_has in name and not name.endswith("/"):
                            yield pd.DataFrame({"archive": [at], "entry": [name], "text": [archive.read(name).decode("utf-8", errors="replace")]})

    return files.mapInPandas(members, FILING)


def read_answers(spark: SparkSession, path: str, schema: str = ANSWERS) -> DataFrame:
    """Answers from JSON lines, with written, file and position, in this order of which later ones replace earlier ones.

    position: where the line's part of the file begins, and the line's number in it.
    """
    rows = spark.read.schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("begins"), F.monotonically_increasing_id().alias("line"))
    return rows.select("*", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_name").alias("file"), at.alias("position"))


def append_answers(answers: DataFrame, path: str) -> None:
    """Add rows as JSON lines; a run that is repeated adds them again, unlike archives.append_batch."""
    answers.write.mode("append").json(path)


def read_table(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A Parquet table, of one model where it is partitioned by that."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("model") == model) if model is not None else rows


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_results(rows: DataFrame, path: str, experiment: Experiment, model: str) -> None:
    """The results of a model's run, in place of those of the same settings; results of all others stay as they are.

    The table is partitioned by model and settings, and only the partition of this run is overwritten. Columns named like the settings are replaced.
    """
    keys = experiment.partition(model)
    named = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in keys), *(F.lit(v).alias(k) for k, v in keys.items()))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_results(spark: SparkSession, path: str, experiment: Experiment | None = None, model: str | None = None) -> DataFrame:
    """Results of all runs, or of those with an experiment's settings or of a model: only their partitions are read."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    keys = experiment.partition(model or "") if experiment else {}
    for k, v in ({k: v for k, v in keys.items() if k != "model"} | ({"model": model} if model else {})).items():
        rows = rows.where(F.col(k).cast("string") == v)
    return rows


def write_bucketed(rows: DataFrame, table: str, by: tuple[str, ...], buckets: int) -> None:
    """A table in the warehouse whose rows are dealt and sorted by the keys: joins of such tables on them, with as many buckets, need no exchange."""
    rows.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(table)


def read_vectors(spark: SparkSession, pattern: str) -> DataFrame:
    """The vectors of all batches whose paths match, with file and row, by which they are in order: batches by name, then as written."""
    rows = spark.read.parquet(pattern)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


@dataclass(frozen=True)
class Catalogue:
    """Where a project's tables lie, under one folder: texts with their headers, nearest topics, classes of sentences, vectors and answers."""

    root: str
    texts: str = "texts"
    topics: str = "topics"
    classes: str = "classes"
    vectors: str = "vectors"
    answers: str = "answers"

    def load(self, spark: SparkSession, name: str, model: str | None = None) -> DataFrame:
        """A table by its name; of one model where several have made it."""
        if name not in {f.name for f in fields(self)} - {"root"}:
            raise ValueError(f"no table {name}")
        path = f"{self.root.rstrip('/')}/{getattr(self, name)}"
        return read_answers(spark, path) if name == "answers" else read_vectors(spark, path) if name == "vectors" else read_table(spark, path, model)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


@dataclass(frozen=True)
class Experiment:
    """What an experiment is run with; its names make up where results lie."""

    target_period: str = "FY"
    target_variable: str = "eps"
    kpi_min_abs_value: float | None = None
    kpi_max_abs_value: float | None = None
    binary_label: bool = True
    exclude_quarter_features: bool = True
    encoder: str = "base"
    adjust_target_variable: bool = True
    sample: str = "full"
    feature_set: str = "all"
    outlier_detection: bool = True
    oversample_method: str | None = None
    test_year_start: int = 2020
    min_trading_days: int = 210
    value_weighting: bool = False
    min_year_target: int | None = None
    max_year_target: int | None = None
    long_threshold: float = 0.6
    short_threshold: float = 0.4
    n_bootstrap_auc: int = 10_000

    @classmethod
    def load(cls, text: str) -> Experiment:
        """From JSON; names that aren't settings are an error."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    def partition(self, model: str) -> dict[str, str]:
        """The partition of a results table for a model's run."""
        keys = ("feature_set", "target_period", "encoder", "sample", "exclude_quarter_features")
        return {"model": model} | {k: str(asdict(self)[k]).lower() for k in keys}
