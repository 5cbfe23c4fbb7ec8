"""Shared pieces of the training-data operators: shared storage, token hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset a temporary folder takes its place, but only in local mode, where
    driver and executors are one machine.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured is None and known.isEmpty():
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="brindle-")
    if known.isEmpty():
        context.setCheckpointDir(configured)
    return configured or known.get()


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared storage with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a file whose places follow one another.
FILE_ROWS = 1 << 40


def with_places(docs: DataFrame, name: str = "place") -> DataFrame:
    """docs with a number of its own for each row; for rows read from files their place in the order of writing, by file, then by row.

    Files are told apart by their whole path, as those of one task have one name in all folders of a partitioned table.
    """
    files = sorted({_path(f) for f in docs.inputFiles()})
    try:
        seen = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")) if files else None
    except AnalysisException:  # rows of files no more
        seen = None
    if seen is None:
        return cut(docs.withColumn(name, F.monotonically_increasing_id()))
    ranks = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__name string, __rank long")
    # a row for each file; the path alone, as one side of these may leave out an empty authority
    bare = F.regexp_replace(F.try_url_decode(F.regexp_replace("__file", r"\+", "%2B")), "^[a-z0-9+.-]+:/*(?=/)", "")
    placed = seen.join(F.broadcast(ranks), bare == F.col("__name"), "left")
    place = F.when(F.col("__rank").isNotNull(), F.col("__rank") * FILE_ROWS + F.col("__row")).otherwise(F.raise_error(F.concat(F.lit("no place for "), "__file")).cast("long"))
    placed = placed.withColumn(name, place)
    return placed.drop("__file", "__name", "__rank", "__row")


def _path(uri: str) -> str:
    """A file's decoded path without its scheme and an empty authority."""
    return re.sub("^[a-z0-9+.-]+:/*(?=/)", "", unquote(uri))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For what is computed inside, fewer rows at a time go to Python: texts are long."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def release_memory() -> None:
    """Give freed memory back to the system: a worker lives on, idle, beside the executor's next tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the offsets of each text.

    A-Z are lower-cased and words are runs of anything but space and tab to carriage return.
    Null texts have no words.
    """
    n = len(texts)
    # a copy without an offset: the string kernels misplace the bytes of some slices
    texts = pc.fill_null(texts.cast(pa.large_string()), "").filter(pa.array(np.ones(n, bool)))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    values, parents = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(values), 0)
    values, parents = values.filter(full), parents.filter(full)
    coded = values.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(parents.to_numpy(zero_copy_only=False).astype(np.int64), minlength=n), out=offsets[1:])
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return (known[codes] if len(codes) else np.zeros(0, np.uint64)), offsets


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles.

    A text with fewer words than the width has its whole sequence as its one shingle; one
    without words has none.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    if len(texts) > 1 and ends[-1] > SLICE_BYTES:  # few words are held as strings at a time
        out, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
            out += _shingle_sets(texts.slice(at, stop - at), width)
            at = stop
        return out
    return _shingle_sets(texts, width)


def _shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    words, offsets = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled = rolled * _MULT + words[j : len(words) - width + 1 + j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            got = np.sort(rolled[a : b - width + 1])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = np.uint64((int(whole) * int(_MULT) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix64(np.array([whole ^ np.uint64(0x5BD1E995)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (src, dst), as (node, comp) with the smallest node of each.

    Alternating large-star and small-star steps; each round is two aggregations and two joins
    by node, with its lineage cut. Nodes are those on an edge to another node. Loops and
    repeated edges do no harm, and no edges give no rows.
    """
    star = cut(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    seen = None
    for _ in range(rounds):
        mark = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        star = cut(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = star.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return pairs.unionByName(pairs.select(F.col("comp").alias("node"), "comp").distinct())


class Forest:
    """Union-find over n items that keeps the joining edges only."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def link_all(self, i: int, js: np.ndarray) -> None:
        """Link i with each of js."""
        while len(js := js[self.root[js] != self.root[i]]):
            self.link(i, js[0])
