"""Exact k nearest neighbours over pivot cells, so far blocks are never compared.

1. Pivots (at most ``MOST_PIVOTS``, about the root of the rows) come from a bounded sample.
   Every training row joins the cell of its nearest pivot; a cell is cut by distance to its pivot into
   blocks of about ``block_rows`` rows, however many rows it has.  A block is known by its
   cell, its number of rows and its ring: the least and the largest distance to the pivot.
2. For a query at distance D from a pivot, all rows of a block with ring [lo, hi] lie between
   max(D - hi, lo - D) and D + hi (triangle inequality).  The nearest blocks that hold k
   rows are compared first; the k-th distance found there bounds all neighbours.
3. Only blocks whose lower bound is within that distance are compared with the query.

The ring table has at most ``MOST_BLOCKS`` rows plus one per pivot, as blocks grow with
the table; it goes to every task.  Blocks of near cells make up a bundle; a task compares
one bundle with one chunk of queries, so a query's vector is sent once to each bundle in
which it asks a block, and a row once to each chunk.  Bundles and chunks grow with the
table, and so does what is sent, not with its square.  Rows beyond a query's bound leave no task.
Distances are found in matrix form, and exactly for the rows that can be among the k.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.operators.ranks import ordered_prefix
from tabsight.session import ensure_checkpoint_dir

MOST_PIVOTS, MOST_BLOCKS, BLOCK_ROWS = 256, 200_000, 2048
#: Numbers of one distance matrix; relative room for rounding in bounds.
CELLS, ROOM = 4_000_000, 1e-7
#: Blocks go to tasks in bundles: as many as BUNDLES, with at most MOST_ROWS rows; queries in at most CHUNKS chunks of at most MOST_ROWS.
BUNDLES, CHUNKS, MOST_ROWS = 16, 8, 32_768
FOUND = "qid long, dist double, tid long, tlabel double"


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """All distances between the rows of ``a`` and ``b``, up to rounding."""
    if p == 2:
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
        return np.sqrt(np.maximum(squares, 0.0))
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += np.abs(a[:, d][:, None] - b[:, d])
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _slack(d: np.ndarray, scale: float) -> np.ndarray:
    """Room for rounding: distances in matrix form lose half the digits of the vectors' length."""
    return ROOM * (d + scale)


def _spread(points: np.ndarray, count: int, p: int) -> np.ndarray:
    """Farthest-first choice among a sample."""
    picked = [0]
    near = distances(points, points[:1], p)[:, 0]
    while len(picked) < count and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[picked[-1]:picked[-1] + 1], p)[:, 0])
    return points[picked]


def _pairs(Q: np.ndarray, T: np.ndarray, tid: np.ndarray, bound: np.ndarray, k: int, p: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's best k rows that are not beyond its bound."""
    kk, out = min(k, len(T)), []
    for s in range(0, len(Q), max(1, CELLS // len(T))):
        block = Q[s:s + max(1, CELLS // len(T))]
        d = distances(block, T, p)
        edge = np.minimum(np.partition(d, kk - 1, axis=1)[:, kk - 1], bound[s:s + len(block)])[:, None]
        i, j = np.nonzero(d <= edge + 2 * _slack(edge, scale))
        diff = block[i] - T[j]
        out.append((s + i, j, np.abs(diff).sum(axis=1) if p == 1 else np.sqrt((diff * diff).sum(axis=1))))
    i, j, exact = (np.concatenate(x) for x in zip(*out))
    on = exact <= bound[i] * (1 + ROOM)
    return _best(i[on], j[on], exact[on], tid, kk)


def _best(i: np.ndarray, j: np.ndarray, exact: np.ndarray, tid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((tid[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1])[:len(i)])
    keep = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k
    return i[keep], j[keep], exact[keep]


def _nearest(k: int, p: int):
    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"qid": [], "dist": [], "tid": [], "tlabel": []})
        Q, T = np.stack(q["qv"].to_numpy()).astype(np.float64), np.stack(t["tv"].to_numpy()).astype(np.float64)
        qid, tid, label, block, bound = q["qid"].to_numpy(), t["tid"].to_numpy(), t["tlabel"].to_numpy(), t["block"].to_numpy(), q["bound"].to_numpy(dtype=np.float64)
        bound = np.where(np.isnan(bound), np.inf, bound)
        scale = float(np.sqrt((T * T).sum(axis=1)).max())
        # queries by the block they ask
        lens = np.fromiter((len(b) for b in q["blocks"]), np.int64, len(q))
        who, asked = np.repeat(np.arange(len(q)), lens), np.concatenate(q["blocks"].to_numpy())
        out = []
        for b in np.unique(asked):
            rows, own = np.flatnonzero(block == b), who[asked == b]
            if len(rows):
                i, j, exact = _pairs(Q[own], T[rows], tid[rows], bound[own], k, p, scale)
                out.append((own[i], rows[j], exact))
        i, j, exact = _best(*(np.concatenate(x) for x in zip(*out)), tid, k) if out else (np.zeros(0, int),) * 3
        return pd.DataFrame({"qid": qid[i], "dist": exact, "tid": tid[j], "tlabel": label[j]})
    return lambda key, q, t: run(q, t)


def _bundles(cell: np.ndarray, size: np.ndarray, pivots: np.ndarray, p: int, rows: int) -> np.ndarray:
    """Bundle of each block: cells in a chain of nearest pivots, cut after about ``rows`` rows."""
    left, at, place = np.ones(len(pivots), bool), 0, np.zeros(len(pivots), np.int64)
    for k in range(len(pivots)):
        place[at], left[at] = k, False
        d = distances(pivots[at:at + 1], pivots, p)[0]
        at = int(np.where(left, d, np.inf).argmin())
    order = np.lexsort((np.arange(len(cell)), place[cell]))
    out = np.empty(len(cell), np.int32)
    out[order] = (np.cumsum(size[order]) - 1) // rows
    return out


class PivotCells:
    """The training rows (tid, tv, tlabel) in blocks, with the ring and the bundle of each block."""

    bundle: np.ndarray | None = None

    def __init__(self, train: DataFrame, p: int = 2, block_rows: int = BLOCK_ROWS, pivots: int | None = None):
        spark = train.sparkSession
        ensure_checkpoint_dir(spark)
        self.p = p
        rows = train.select(F.col("tid").cast("long"), F.col("tv").cast("array<double>"), F.col("tlabel").cast("double")).where(F.col("tv").isNotNull()).checkpoint(eager=True)
        self.n = rows.count()
        self.dim = 0
        if not self.n:
            return
        count = pivots or max(1, min(MOST_PIVOTS, ceil(self.n ** 0.5)))
        sample = rows.orderBy(F.xxhash64("tid"), "tid").select("tv").limit(4 * count).collect()  # bounded by the number of pivots
        points = np.array([r["tv"] for r in sample])
        self.dim, self.pivots = points.shape[1], _spread(points, count, p)
        dim, chosen, size = self.dim, self.pivots, max(block_rows, ceil(self.n / MOST_BLOCKS))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = distances(_vectors(b.column("tv"), dim), chosen, p)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], [*b.schema.names, "cell", "far"])

        placed = rows.mapInArrow(assign, "tid long, tv array<double>, tlabel double, cell int, far double").withColumn("one", F.lit(1))
        ordered = ordered_prefix(placed, ["cell"], "far", "one", out_col="at", tiebreak=["tid"]).withColumn("part", F.floor(F.col("at") / size).cast("int"))
        self.rows = ordered.select("tid", "tv", "tlabel", "cell", "part", "far").checkpoint(eager=True)
        rings = self.rows.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("cell", "part").collect()
        self.cell, self.part = (np.array([r[c] for r in rings]) for c in ("cell", "part"))
        self.size, self.lo, self.hi = (np.array([r[c] for r in rings]) for c in ("n", "lo", "hi"))
        self.bundle = _bundles(self.cell, self.size, chosen, p, max(size, min(MOST_ROWS, ceil(self.n / BUNDLES))))
        keys = spark.createDataFrame([(int(c), int(a), k, int(b)) for k, (c, a, b) in enumerate(zip(self.cell, self.part, self.bundle))],
                                     "cell int, part int, block int, bundle int")
        self.rows = self.rows.join(F.broadcast(keys), ["cell", "part"]).select("tid", "tv", "tlabel", "block", "bundle")

    def _ask(self, query: DataFrame, pick, extra: str = "") -> DataFrame:
        """(qid, qv, bound, block, blocks) of the bundles with blocks that ``pick(lower bounds, batch)`` marks for each query."""
        dim, p, pivots, cell, lo, hi = self.dim, self.p, self.pivots, self.cell, self.lo, self.hi
        bundle = np.arange(len(cell), dtype=np.int32) if self.bundle is None else self.bundle
        scale = float(np.sqrt((pivots * pivots).sum(axis=1)).max())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                step = max(1, CELLS // len(cell))
                for s in range(0, whole.num_rows, step):
                    b = whole.slice(s, step)
                    d = distances(_vectors(b.column("qv"), dim), pivots, p)[:, cell]
                    least = np.maximum(np.maximum(d - hi, lo - d), 0.0) - _slack(d, scale)
                    i, j = np.nonzero(pick(least, b))
                    order = np.lexsort((j, bundle[j], i))
                    i, j = i[order], j[order].astype(np.int32)
                    ends = np.append(np.flatnonzero((i[1:] != i[:-1]) | (bundle[j[1:]] != bundle[j[:-1]])) + 1, len(i)) if len(i) else np.zeros(0, np.int64)
                    starts = np.append(0, ends)[:len(ends)]
                    bound = b.column("bound") if "bound" in b.schema.names else pa.nulls(b.num_rows, pa.float64())
                    # a vector is repeated for each of its bundles: a batch at a time holds CELLS numbers, however many are asked
                    for t in range(0, len(ends), max(1, CELLS // dim)):
                        first, last = starts[t:t + max(1, CELLS // dim)], ends[t:t + max(1, CELLS // dim)]
                        rows = pa.array(i[first])
                        blocks = pa.ListArray.from_arrays(pa.array(np.append(first, last[-1:]) - first[0], pa.int32()), pa.array(j[first[0]:last[-1]]))
                        yield pa.RecordBatch.from_arrays([b.column("qid").take(rows), b.column("qv").take(rows), bound.take(rows), pa.array(bundle[j[first]]), blocks],
                                                         ["qid", "qv", "bound", "block", "blocks"])

        return query.select("qid", "qv", *([extra] if extra else [])).mapInArrow(run, "qid long, qv array<double>, bound double, block int, blocks array<int>")

    def _compared(self, asked: DataFrame, k: int, chunks: int) -> DataFrame:
        """The k best rows of each asked bundle for each query, none beyond its bound."""
        asked = asked.withColumnRenamed("block", "bundle").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))
        needed = asked.select(F.col("bundle").alias("own"), F.col("chunk").alias("to")).distinct()
        rows = self.rows.join(needed, F.col("bundle") == F.col("own")).select("tid", "tv", "tlabel", "block", "bundle", F.col("to").alias("chunk"))
        return asked.groupBy("bundle", "chunk").cogroup(rows.groupBy("bundle", "chunk")).applyInPandas(_nearest(k, self.p), FOUND)

    def neighbours(self, query: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """(qid, dist, tid, tlabel, rank); ``self.compared`` is then the number of pairs that were compared in full."""
        spark = query.sparkSession
        self.compared = 0
        if not self.n:
            return spark.createDataFrame([], FOUND + ", rank int")
        query = query.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>")).where(F.col("qv").isNotNull()).checkpoint(eager=True)
        asking, size, need = query.count(), self.size, min(k, self.n)
        chunks = max(1, ceil(asking / max(block_rows, min(MOST_ROWS, ceil(asking / CHUNKS)))))

        def home(least: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            order = np.argsort(least, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            mark = np.zeros(least.shape, bool)
            np.put_along_axis(mark, order, before < need, axis=1)
            return mark

        def near(least: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            return least <= b.column("bound").to_numpy()[:, None]

        best = Window.partitionBy("qid").orderBy("dist", "tid")
        first = self._compared(self._ask(query, home), k, chunks)
        bounds = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == need).select("qid", F.col("dist").alias("bound")).checkpoint(eager=True)
        # all blocks within the bound, those of the first round included
        asked = self._ask(query.join(bounds, "qid"), near, "bound").checkpoint(eager=True)
        counts = spark.createDataFrame([(b, int(n)) for b, n in enumerate(size)], "block int, n long")
        self.compared = asked.select(F.explode("blocks").alias("block")).groupBy("block").count().join(F.broadcast(counts), "block").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        found = self._compared(asked, k, chunks)
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_neighbours(query: DataFrame, train: DataFrame, k: int, p: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest training rows for every query row, ties by training id.

    ``query``: (qid, qv array<double>); ``train``: (tid, tv array<double>, tlabel); rows without a vector are left out.
    """
    return PivotCells(train, p, block_rows).neighbours(query, k, block_rows)
