"""Resampling towards a target's distribution: documents drawn by the weights of their hashed n-grams.

An n-gram's bucket is the CRC-32 of its words joined by spaces, modulo the buckets, but no n-gram is ever put together. A
CRC is linear over GF(2): crc(a + b) = shift(crc(a), length of b) xor crc(b), where shift is a 32 x 32 matrix of bits, the power of the
matrix that appends one zero byte. So each word's CRC is computed once, and those of n-grams follow by matrices, for whole batches of texts at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release_memory, small_batches

#: The CRC's polynomial, its bits reversed (that of zlib).
POLYNOMIAL = 0xEDB88320
#: Shifts up to so many bytes have tables of their own; longer ones go by powers of two.
SHORT = 64
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 4 << 20


def zero_byte() -> np.ndarray:
    """The matrix that appends a zero byte: column i is what bit i alone becomes."""
    columns = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        columns.append(c)
    return np.array(columns, np.uint32)


def times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The matrix applied to each of the values."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def by_bytes(matrix: np.ndarray) -> np.ndarray:
    """The matrix as four tables, one for each byte of a value."""
    return np.stack([times(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


class Shifts:
    """Appends any number of zero bytes to many CRCs at once."""

    def __init__(self):
        one = zero_byte()
        powers = [np.uint32(1) << np.arange(32, dtype=np.uint32)]  # the identity
        for _ in range(SHORT):
            powers.append(times(one, powers[-1]))
        self.short = np.stack([by_bytes(m) for m in powers]).reshape(-1)
        self.doubled, m = [], one
        for _ in range(32):
            self.doubled.append(by_bytes(m))
            m = times(m, m)  # twice as many bytes

    def __call__(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        base = np.minimum(lengths, SHORT).astype(np.int64) << 10
        out = np.zeros(len(values), np.uint32)
        for k in range(4):
            out ^= self.short[base + (k << 8) + (values >> np.uint32(8 * k) & np.uint32(255))]
        at = np.flatnonzero(lengths > SHORT)
        if len(at):
            out[at] = self._long(values[at], lengths[at])
        return out

    def _long(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        for bit, tables in enumerate(self.doubled):
            on = np.flatnonzero(lengths >> bit & 1)
            if len(on):
                values[on] = sum_bytes(tables, values[on])
        return values


def sum_bytes(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint32)
    for k in range(4):
        out ^= tables[k][values >> np.uint32(8 * k) & np.uint32(255)]
    return out


#: Of each byte, whether it belongs to a word: digits, letters, and all of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


class Grams:
    """CRCs of the words of texts, and of n-grams by combination."""

    def __init__(self, longest: int = 3):
        self.longest, self.shift = longest, Shifts()
        self.space = np.uint32(zlib.crc32(b" "))

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRCs and byte lengths of all words, and the number of words of each text."""
        low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        low = pa.concat_arrays([low])  # without an offset
        ends = np.frombuffer(low.buffers()[1], np.int64)[: len(low) + 1]
        data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        inside = IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = ends[1:-1][ends[1:-1] < len(data)]
        first[cuts] = inside[cuts]  # a text's first character begins a word
        starts = np.flatnonzero(first)
        kept = np.flatnonzero(inside)
        offsets = np.append(np.searchsorted(kept, starts), len(kept)).astype(np.int64)
        counts = np.diff(np.searchsorted(starts, ends))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), counts
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
        coded = found.dictionary_encode()
        crcs = np.fromiter((zlib.crc32(w) for w in coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
        return crcs[coded.indices.to_numpy()], np.diff(offsets), counts

    def grams(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n, the CRCs of all n-grams and the text that each is from."""
        crcs, lengths, counts = self.words(texts)
        owner = np.repeat(np.arange(len(counts)), counts)
        # what a word ahead becomes: a space and the word after it
        joint = self.shift(np.full(len(crcs), self.space, np.uint32), lengths) ^ crcs
        gram = crcs
        yield gram, owner
        for n in range(2, self.longest + 1):
            if len(gram) < 2:
                return
            # the gram of one word less that begins at the same word, then the n-th
            ahead, last = gram[:-1], joint[n - 1 :]
            gram = self.shift(ahead, lengths[n - 1 :] + 1) ^ last
            whole = owner[: len(gram)] == owner[n - 1 :]
            yield gram[whole], owner[: len(gram)][whole]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of at most SLICE_BYTES, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def bucket_counts(rows: DataFrame, text_col: str, buckets: int, longest: int) -> list[int]:
    """Features of all rows in each bucket; a task sends a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(longest), np.zeros(buckets, np.int64)
        for b in batches:
            for part in slices(b.column(0)):
                for crcs, _ in grams.grams(part):
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])
        release_memory()

    text = rows.select(F.col(f"`{text_col}`").cast("string").alias("t"))
    got = text.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in got:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Of each bucket, floor(1000 ln) of its smoothed share in the target over that in the rows."""
    all_raw, all_target, buckets = sum(raw), sum(target), len(raw)
    return [math.floor(1000 * math.log((t + 1.0) * (all_raw + buckets) / ((s + 1.0) * (all_target + buckets)))) for s, t in zip(raw, target, strict=True)]


def weighted(docs: DataFrame, text_col: str, gain: list[int], longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of rows (doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = Grams(longest), np.array(gain, np.int64)
        for b in batches:
            at = 0
            for part in slices(b.column(1)):
                m = len(part)
                n_words, n_features, weight = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
                for n, (crcs, owner) in enumerate(grams.grams(part)):
                    each = np.bincount(owner, minlength=m)
                    n_words, n_features = (each if n == 0 else n_words), n_features + each
                    # whole numbers far below 2 ** 53
                    weight += np.bincount(owner, weights=table[crcs % np.uint32(len(table))], minlength=m).astype(np.int64)
                yield pa.record_batch([b.column(0).slice(at, m), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
                at += m
        release_memory()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(text_col).cast("string").alias("t")).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variable) that the id's hash gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest: int = 3, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs: percent of those of least_words or more are drawn.

    weight: the gains of all n-grams of 1 to `longest` words, repeats counted. score: weight and a Gumbel variable by the id, so that the
    highest scores are a draw without replacement. rank: 1, 2, 3 ... of drawn rows by falling score, ties by rising id, null ids last; null otherwise.

    A null or empty text has no features, weight 0. Null ids count as an empty text in the hash; repeated rows count and are ranked one
    by one. Other columns are neither read nor returned. An empty table gives no rows; an empty target gives all buckets alike.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    with small_batches(spark):
        gain = gains(bucket_counts(own, "__text", buckets, longest), bucket_counts(target, target_col, buckets, longest))
        scored = weighted(own, "__text", gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        fit = F.col("n_words") >= least_words
        # sorted over all partitions and written: places in it are then fixed
        ordered = cut(scored.withColumn("fit", fit).orderBy(F.desc("fit"), F.desc("score"), F.col("doc_id").asc_nulls_last()))
    spot = F.spark_partition_id()
    counts = ordered.groupBy(spot.alias("part")).agg(F.count("*").alias("rows"), F.sum(F.col("fit").cast("long")).alias("fit")).orderBy("part").collect()  # one for each partition
    drawn = percent * sum(r["fit"] for r in counts) // 100
    before, begin = [], 0
    for r in counts:
        before.append((r["part"], begin))
        begin += r["rows"]
    table = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ordered.withColumns({"part": spot, "inside": inside}).join(table, "part").withColumn("rank", F.col("before") + F.col("inside") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
