"""A corpus from documents: good ones, one of each near copy, no test items, mixed, as token shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import cut, delete, shared_dir, with_places
from brindle.llm.decontaminate import decontaminate
from brindle.llm.mixing import mixed_order
from brindle.llm.ngram_join import ngram_components
from brindle.llm.quality import keep_good
from brindle.llm.queries import tokenizer_file
from brindle.llm.token_store import read_shards, starts_by_place, write_shards


# All stages: an empty table stays empty, columns beyond those of documents are kept until the last stage, and texts are read
# whole at any length.


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. Null and empty texts are scored as such; each of repeated rows is judged the same."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that of the smallest id, null ids last, then the first read.

    Documents link when their sets of four-word shingles are alike by 85 %, which an edit of words reaches about when five-word
    shingles are alike by 0.82. Rows count as documents of their own whatever their ids:
    rows of one id and different texts all stay, and of equal rows, or of copies without an id, one does. Documents without words stay.
    """
    placed = with_places(docs, "__place")
    found = cut(ngram_components(placed, id_col="__place", width=4, percent=85))
    copies = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    grouped = found.join(copies, "component_id").select("component_id", F.col("doc_id").alias("__place"))
    rank = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("__place").alias("place"))
    ranked = placed.select("doc_id", "__place").join(grouped, "__place").select("component_id", "__place", rank.alias("rank"))
    best = ranked.groupBy("component_id").agg(F.min("rank").alias("best")).select("component_id", F.col("best.place").alias("best"))
    gone = ranked.join(best, "component_id").where("__place <> best").select("__place")
    return placed.join(gone, "__place", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. Null and empty texts hold none; all of repeated rows go or stay; null ids do no harm."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources mix to their weights: over the files written, and within each."""
    return mixed_order(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents, read back from token shards keyed by doc_id.

    start: the ids of all documents before it in the order of docs, which is that of the mix and kept in the shards.
    """
    manifest = write_shards(with_places(docs, "__place"), tokenizer_file(), end_id=2, place_col="__place")
    return starts_by_place(read_shards(manifest, places=True)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The first stage is a learnt model and the last an encoder, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next, until the shards are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, folder)  # what is left to do reads the shards alone
    return out
