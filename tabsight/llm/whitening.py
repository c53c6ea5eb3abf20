"""Embedding whitening on Spark MLlib's BlockMatrix.

1. Vectors are quantised to integers, so sums and means are exact. The distinct ones are
   the fit list; a vector that a third of the rows share weighs as much as any other.
2. Centred rows are indexed into blocks of ``BLOCK_BYTES``. A partition fills blocks of
   its own and pads the last one with zero rows, which add nothing to a product, so
   the blocks need no shuffle.
3. Scatter = transpose x matrix as a BlockMatrix product, its long inner dimension split
   so that a task holds ``SPLIT`` blocks of each side. Only the d x d result reaches the
   driver, where its eigenvectors are taken (``eigh``).
4. Projection = matrix x whitening matrix as a BlockMatrix product. MLlib lays a product
   out as a square grid, which a tall matrix would fill with the root of the
   partitions; the row blocks are therefore wrapped into a near-square grid, and the
   whitening matrix stands once per column of it on a block diagonal.

Defined results: rows whose vector is null or holds null or non-finite entries are
dropped, and so are those whose length is not the most common one (the largest of them
on ties; empty vectors never count); rows that repeat, and rows without an id, get a
result each; components whose variance is below ``RANK`` of the largest have no unit
scale and are left out, so a table with one distinct vector or none gives no rows;
integers beyond 64 bits raise an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabsight.llm.common import saved

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_BYTES, MOST_COLUMNS, SPLIT = 1 << 19, 1024, 64
RANK = 1e-10
#: Blocks pass between Arrow and MLlib as they are, without a Python object per entry.
BLOCK_SCHEMA = StructType([StructField("at", StructType([StructField("i", LongType()), StructField("j", LongType())])), StructField("matrix", MatrixUDT())])
MATRIX_TYPES = (pa.int8(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))


def counts(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def quantised(vector: Column) -> Column:
    """Entries as integers floor(SCALE * c) + SHIFT."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def block_rows(dim: int) -> int:
    """Rows of a block of about BLOCK_BYTES."""
    return max(1, BLOCK_BYTES // (8 * min(dim, MOST_COLUMNS)))


def indexed(df: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """``df`` saved with a row index ``idx`` that starts a new block with every partition, and the number of blocks.

    Only one count per partition reaches the driver.
    """
    kept = saved(df.withColumn("idx", F.monotonically_increasing_id()))
    part = F.shiftright("idx", 33)
    counts = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, blocks = [], 0
    for k in range(max(counts, default=-1) + 1):
        first.append(blocks * per_block)
        blocks += -(-counts.get(k, 0) // per_block)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in first or [0]]), part.cast("int"))
    return kept.withColumn("idx", start + F.col("idx").bitwiseAND((1 << 33) - 1)), blocks


def to_blocks(rows: DataFrame, blocks: int, n: int, sums: np.ndarray, wrap: int = 1) -> BlockMatrix:
    """The centred vectors of ``rows`` (idx, x) as a BlockMatrix; row block b stands at (b // wrap, b % wrap)."""
    dim = len(sums)
    size, width = block_rows(dim), min(dim, MOST_COLUMNS)
    wide = -(-dim // width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = -1, None

        def packed() -> pa.RecordBatch:
            at = pa.StructArray.from_arrays([pa.array([block // wrap] * wide, pa.int64()),
                                             pa.array([block % wrap * wide + j for j in range(wide)], pa.int64())], names=["i", "j"])
            values = pa.array(held.reshape(size, wide, width).transpose(1, 2, 0).ravel())  # column by column
            parts = [[1] * wide, [size] * wide, [width] * wide, [None] * wide, [None] * wide]
            matrix = pa.StructArray.from_arrays(
                [*(pa.array(v, t) for v, t in zip(parts, MATRIX_TYPES)),
                 pa.ListArray.from_arrays(pa.array(np.arange(wide + 1) * size * width, pa.int32()), values), pa.array([False] * wide)],
                names=MatrixUDT.sqlType().names)
            return pa.RecordBatch.from_arrays([at, matrix], ["at", "matrix"])

        for rows in batches:
            if not rows.num_rows:
                continue
            idx = rows.column("idx").to_numpy()
            x = rows.column("x").flatten().to_numpy().reshape(len(idx), dim)
            for b in np.unique(idx // size).tolist():
                if b != block:
                    if held is not None:
                        yield packed()
                    block, held = b, np.zeros((size, wide * width))
                own = idx // size == b
                held[idx[own] - b * size, :dim] = (n * x[own] - sums) / n
        if held is not None:
            yield packed()

    packed = rows.select("idx", "x").mapInArrow(pack, BLOCK_SCHEMA)
    shape = (size, width, -(-blocks // wrap) * size, wrap * wide * width)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", packed, *shape), *shape)


def scatter(a: BlockMatrix, blocks: int) -> np.ndarray:
    """transpose(a) x a as a local matrix."""
    splits = -(-blocks // SPLIT)
    # the number of splits of the inner dimension has no Python argument
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def project(rows: DataFrame, blocks: int, n: int, sums: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(idx, z): the centred vectors of ``rows`` times ``weights``."""
    spark, (dim, k) = rows.sparkSession, weights.shape
    size, width = block_rows(dim), min(dim, MOST_COLUMNS)
    wide, wrap = -(-dim // width), max(1, int(np.ceil(np.sqrt(blocks))))
    padded = np.zeros((wide * width, k))
    padded[:dim] = weights
    tiles = [padded[j * width:(j + 1) * width] for j in range(wide)]
    slices = min(wrap, spark.sparkContext.defaultParallelism)
    diagonal = spark.sparkContext.range(wrap, numSlices=slices).flatMap(
        lambda c: [((c * wide + j, c), DenseMatrix(width, k, tile.ravel("F"))) for j, tile in enumerate(tiles)])
    a = to_blocks(rows, blocks, n, sums, wrap).persist(StorageLevel.MEMORY_AND_DISK)
    z = a.multiply(BlockMatrix(diagonal, width, k, wrap * wide * width, wrap * k))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in zip(b.column(0).to_pylist(), b.column(1)):
                i, c = at.values()
                first = (i * wrap + c) * size
                values = m["values"].values.to_numpy().reshape(k, size).T.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + size)), pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * k, pa.int32()), pa.array(values))],
                    ["idx", "z"])

    # rows of padding have no partner in the join by idx
    found = callMLlibFunc("getMatrixBlocks", z._java_matrix_wrapper._java_model).mapInArrow(unpack, "idx long, z array<double>")
    out = saved(found.join(rows.select("idx"), "idx"))
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)
    return out


@dataclass
class Whitening:
    """A fitted whitening: ``weights`` (dim x components) for centred vectors, eigenvalue shares, size and sums of the fit list."""

    n: int
    sums: np.ndarray
    weights: np.ndarray
    explained: np.ndarray


def fit_whitening(vectors: DataFrame, most: int = COMPONENTS) -> Whitening:
    """Whitening of the distinct vectors ``x`` (arrays of long, one length)."""
    dim = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    distinct, blocks = indexed(vectors.select("x").distinct(), block_rows(max(dim, 1)))
    row = distinct.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(k))) for k in range(dim)]).first()
    n, sums = row[0], np.array(row[1:], dtype=np.int64)
    if not n or not dim:
        return Whitening(0, sums, np.zeros((dim, 0)), np.zeros(0))
    a = to_blocks(distinct, blocks, n, sums).persist(StorageLevel.MEMORY_AND_DISK)
    cov = scatter(a, blocks)[:dim, :dim] / n
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)
    values, vecs = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(), 0) * RANK]
    return Whitening(n, sums, vecs[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov))


def identity_error(z: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``z`` (k entries, divisor n) minus the identity."""
    at = [F.get("z", F.lit(i)) for i in range(k)]
    mean = z.agg(*[F.avg(c) for c in at]).first()
    c = [x - F.lit(m) for x, m in zip(at, mean)]
    cov = z.agg(*[F.avg(c[i] * c[j]) for i in range(k) for j in range(i, k)]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(cov, ((i, j) for i in range(k) for j in range(i, k))))


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, z, explained, identity_error) per row that counts; z is the whitened vector.

    ``deviation`` is the sum over dimensions of (n * x - sum)^2, exact.
    """
    good = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).filter(counts(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    kept, blocks = indexed(good.filter(F.size("v") == dim), block_rows(max(dim, 1)))
    x = kept.select("idx", "key", quantised(F.col("v")).alias("x"))
    fit = fit_whitening(x, most)
    k = fit.weights.shape[1]
    if not k:
        return x.limit(0).select("key", F.lit(fit.n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                                 F.array().cast("array<double>").alias("z"), F.array().cast("array<double>").alias("explained"),
                                 F.lit(0.0).alias("identity_error"))
    z = project(x, blocks, fit.n, fit.sums, fit.weights)
    error = identity_error(z.join(x.groupBy("x").agg(F.min("idx").alias("idx")), "idx"), k)
    sums = F.array(*[F.lit(int(s)).cast("long") for s in fit.sums])
    n = F.lit(fit.n).cast("long")
    off = F.zip_with("x", sums, lambda a, s: (n * a - s) * (n * a - s))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda s, v: s + v)
    return x.select("idx", "key", deviation.alias("deviation")).join(z, "idx").select(
        "key", n.alias("n"), "deviation", "z", F.array(*[F.lit(float(e)) for e in fit.explained]).alias("explained"),
        F.lit(float(error)).alias("identity_error"))
