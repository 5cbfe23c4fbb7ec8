"""Embedding whitening with exact covariances by digit-slice GEMM.

Vectors become integers x. With n distinct ones and their sums S, y = n * x - S is an integer too, n times the centred vector, and
the covariance V is the sum of y's outer products over n cubed. That sum is computed without any rounding: y is cut into limbs of
few bits, so that the products of two limbs, added up over a batch of rows, stay below 2 ** 53 and float64 matrix products (BLAS)
give them exactly; the products are recombined as big integers, batches and tasks are merged as such, and only the finished
sums are divided and decomposed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Bits of a limb and rows whose limbs' products are added up in float64: 2 * LIMB_BITS + log2(BATCH_ROWS) is at most 53.
LIMB_BITS, BATCH_ROWS = 18, 1 << 16
#: An entry beyond this counts as this, so that x fits 64 bits.
LARGEST = float(1 << 55)
#: The driver decomposes a matrix of so many rows at most.
MOST_DIMENSIONS = 4096
#: Eigenvalues below this share of the largest are rounding.
NOTHING = 1e-12
#: Groups of tasks whose sums are merged first.
FANS = 64


def to_integers(embedding: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of each entry; entries beyond LARGEST in size count as that."""
    return F.transform(embedding.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))).cast("long") + F.lit(offset))


def sound(embedding: Column) -> Column:
    """Whether a vector is there and has entries, none of which is null, NaN or infinite."""
    bad = F.exists(embedding.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad


def limbs_of(y: np.ndarray, count: int) -> list[np.ndarray]:
    """The limbs of integers, the lowest first, each as float64; the highest carries the sign. y is int64 or of Python's integers."""
    out, rest = [], y
    for _ in range(count - 1):
        high = rest >> LIMB_BITS
        out.append((rest - (high << LIMB_BITS)).astype(np.float64))
        rest = high
    return [*out, rest.astype(np.float64)]


def limb_count(largest: int) -> int:
    """Limbs that integers up to `largest` in size need, so that the highest is no greater than the others."""
    return max(1, -(-(largest.bit_length()) // LIMB_BITS))


class OuterProducts:
    """The exact sum of rows' outer products: limbs' products by BLAS, added up as 64-bit and then as Python's integers."""

    def __init__(self, d: int, count: int):
        self.d, self.count, self.batches = d, count, 0
        self.parts = {(i, j): np.zeros((d, d), np.int64) for i in range(count) for j in range(i, count)}
        self.total = np.zeros((d, d), object)

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), BATCH_ROWS):
            limbs = limbs_of(y[at : at + BATCH_ROWS], self.count)
            for (i, j), part in self.parts.items():
                part += (limbs[i].T @ limbs[j]).astype(np.int64)
            self.batches += 1
            if self.batches % 512 == 0:  # 2 ** 53 for each batch
                self.sum()

    def sum(self) -> np.ndarray:
        for (i, j), part in self.parts.items():
            shifted = part.astype(object) << (LIMB_BITS * (i + j))
            self.total = self.total + (shifted if i == j else shifted + shifted.T)
            part[:] = 0
        return self.total


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n * x - sums as int64 where all that fits, else as Python's integers."""
    if largest < 1 << 62 and n * (int(np.abs(x).max()) if x.size else 0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _vectors(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), d)


def dimension_sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows of fit, the exact sum of each dimension of its x and the largest distance of an x from a dimension's mean, times rows."""
    schema = "dimension int, high decimal(38,0), low decimal(38,0), n long, least long, most long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, least, most = [0] * d, 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = _vectors(b, "x", d)
            n += len(x)
            parts = x >> 24, x & 0xFFFFFF  # halves whose sums fit
            total = [t + (int(h) << 24) + int(lo) for t, h, lo in zip(total, parts[0].sum(0), parts[1].sum(0), strict=True)]
            least = x.min(0) if least is None else np.minimum(least, x.min(0))
            most = x.max(0) if most is None else np.maximum(most, x.max(0))
        if n:
            dec = pa.decimal128(38, 0)
            yield pa.record_batch(
                [pa.array(range(d), pa.int32()), pa.array([Decimal(t >> 48) for t in total], dec), pa.array([Decimal(t & ((1 << 48) - 1)) for t in total], dec), pa.array([n] * d, pa.int64()), pa.array(least, pa.int64()), pa.array(most, pa.int64())],
                names=["dimension", "high", "low", "n", "least", "most"],
            )

    parts = fit.select("x").mapInArrow(sums, schema)
    got = parts.groupBy("dimension").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()
    if not got:
        return 0, [0] * d, 0
    got.sort(key=lambda r: r["dimension"])
    n, total = got[0]["n"], [int(r["high"]) * (1 << 48) + int(r["low"]) for r in got]
    largest = max(max(abs(n * r["least"] - s), abs(n * r["most"] - s)) for r, s in zip(got, total, strict=True))
    return n, total, largest


def covariance_sums(fit: DataFrame, d: int, n: int, total: list[int], largest: int) -> list[list[int]]:
    """The exact sum of outer products of n * x - total over fit: a matrix of integers.

    A task sends a matrix row by row, each as bytes; those of a row are added up by groups of tasks, then over the groups.
    """
    count = limb_count(largest)
    # a sum has twice the bits of y, and those of the number of rows
    size = (2 * largest.bit_length() + n.bit_length()) // 8 + 2

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, rows = OuterProducts(d, count), 0
        for b in batches:
            rows += b.num_rows
            if b.num_rows:
                products.add(centred(_vectors(b, "x", d), n, total, largest))
        if rows:
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([_packed(row, size) for row in products.sum()], pa.binary())], names=["line", "sums"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(d, object)
        for value in table.column("sums"):
            out += _unpacked(value.as_py(), size)
        return pa.table({"line": pa.array([key[0].as_py()], pa.int32()), "fan": pa.array([0], pa.int32()), "sums": pa.array([_packed(out, size)], pa.binary())})

    schema = "line int, fan int, sums binary"
    rows = fit.select("x").mapInArrow(added, "line int, sums binary").withColumn("fan", F.spark_partition_id() % FANS)
    once = rows.groupBy("line", "fan").applyInArrow(merged, schema)
    # d rows: the matrix that the driver decomposes
    got = sorted(once.groupBy("line").applyInArrow(merged, schema).collect(), key=lambda r: r["line"])
    return [list(_unpacked(bytes(r["sums"]), size)) for r in got]


def _packed(row: np.ndarray, size: int) -> bytes:
    return b"".join(int(v).to_bytes(size, "little", signed=True) for v in row)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.empty(len(data) // size, object)
    out[:] = [int.from_bytes(data[i : i + size], "little", signed=True) for i in range(0, len(data), size)]
    return out


def decomposed(sums: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance, falling, its unit eigenvectors as columns, and its trace. sums: of (n * x - S)'s outer products."""
    cube = n**3
    v = np.array([[float(Fraction(e, cube)) for e in row] for row in sums])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order], float(Fraction(sum(row[i] for i, row in enumerate(sums)), cube))


def whitened_moments(fit: DataFrame, d: int, n: int, total: list[int], largest: int, matrix: np.ndarray) -> np.ndarray:
    """The covariance of the whitened fit list, centred before multiplying: tasks' means and scatter, merged pairwise."""
    k = matrix.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                w = (centred(_vectors(b, "x", d), n, total, largest) / n).astype(np.float64) @ matrix
                mean = w.mean(0)
                state = _joined(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state:
            yield pa.record_batch([pa.array([state[0]], pa.int64()), pa.array([state[1].tobytes()]), pa.array([state[2].tobytes()])], names=["n", "mean", "scatter"])

    def merged(table: pa.Table) -> pa.Table:
        state = None
        for r in table.to_pylist():
            state = _joined(state, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(k, k)))
        return pa.table({"n": [state[0]], "mean": [state[1].tobytes()], "scatter": [state[2].tobytes()]}, schema=pa.schema([("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary())]))

    schema = "n long, mean binary, scatter binary"
    parts = fit.select("x").mapInArrow(moments, schema).withColumn("fan", F.spark_partition_id() % FANS)
    state = None
    for r in parts.groupBy("fan").applyInArrow(merged, schema).collect():  # FANS rows at most
        state = _joined(state, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(k, k)))
    return state[2] / state[0]


def _joined(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and scatter of both together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _usual_size(good: DataFrame, most: int) -> int | None:
    """The commonest length of vectors, the longest of equally common ones."""
    best = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    if best["d"] > most:
        raise ValueError(f"more than {most} dimensions")
    return best["d"]


SCHEMA = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each sound row and component up to `components`.

    Each entry c counts as x = floor(scale * c) + offset. The covariance is that of the n distinct vectors x, divisor n. component: from
    1, by falling eigenvalue. deviation: the sum over dimensions of (n * x - S) ** 2, exact, null where it is beyond 64 bits.
    whitened: x less the mean, projected on the component, over the eigenvalue's root. explained: the eigenvalue's share of the trace.
    identity_error: the largest entry, by size, of the whitened fit list's covariance less the identity.

    Vectors that are null, empty or hold null or non-finite entries have no rows, nor those of another length than the commonest (of
    equally common ones the longest). Components whose eigenvalue is nothing but rounding, as with fewer vectors than
    dimensions, have rows with whitened null, and don't count in identity_error, which is null where none counts; explained is
    null where all vectors are equal. Repeated rows and null ids all have their rows; other columns don't matter.
    An empty table gives no rows. Entries beyond 2 ** 55 in size count as that.
    """
    spark: SparkSession = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    schema = SCHEMA.format(id=kind)
    source = F.col(f"`{vector_col}`")
    good = vectors.where(sound(source)).select(F.col(f"`{id_col}`").alias("vec_id"), to_integers(source, scale, offset).alias("x"))
    d = _usual_size(good, MOST_DIMENSIONS)
    if d is None:
        return spark.createDataFrame([], schema)
    own = good.where(F.size("x") == d)
    fit = cut(own.select("x").distinct())
    n, total, largest = dimension_sums(fit, d)
    values, axes, trace = decomposed(covariance_sums(fit, d, n, total, largest), n)
    k = min(components, d)
    real = values[:k] > max(values[0], 0.0) * NOTHING
    matrix = axes[:, :k] * np.where(real, 1.0 / np.sqrt(np.where(real, values[:k], 1.0)), 0.0)
    error = None
    if real.any():
        error = float(np.abs((whitened_moments(fit, d, n, total, largest, matrix) - np.eye(k))[np.ix_(real, real)]).max())
    share = [float(v / trace) if trace > 0 else None for v in values[:k]]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS // k + 1):
                part = b.slice(at, BATCH_ROWS // k + 1)
                y = centred(_vectors(part, "x", d), n, total, largest)
                m = len(y)
                if largest * largest * d < 1 << 63 and y.dtype != object:
                    deviation = (y * y).sum(1).tolist()
                else:
                    deviation = [s if (s := sum(int(v) * int(v) for v in row)) < 1 << 63 else None for row in y]
                w = (y / n).astype(np.float64) @ matrix
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch(
                    [
                        part.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array(deviation, pa.int64()).take(each),
                        pa.array(w.ravel(), pa.float64(), mask=np.tile(~real, m)),
                        pa.array(share * m, pa.float64()),
                        pa.array([error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return own.mapInArrow(project, schema)
