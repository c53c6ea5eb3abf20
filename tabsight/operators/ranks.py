"""Running sums and ranks in value order without a one-task window.

``rank_columns`` ranks many columns at once; see there.  ``ordered_prefix(df, groups, order_col, weight_col)`` adds ``before``: the sum of
``weight_col`` over rows of the same group with a strictly smaller ``order_col``.  The
input is expected to hold one row per distinct (group, value) - e.g. a value-count
table - so a hot value is one row.

Spark range-partitions the rows by (groups, value); equal values stay together, and
a group goes over as many partitions as it needs.  Each partition sums on its own
(a window per partition and group); the totals of (partition, group) - groups plus
partitions rows - give each partition its offset.  The partitioned rows are saved once
in the shared checkpoint folder, since range bounds come from a sample and must be
the same for both readers.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.session import ensure_checkpoint_dir


def ordered_prefix(df: DataFrame, groups: list[str], order_col: str, weight_col: str, out_col: str = "before",
                   tiebreak: list[str] | None = None, total_col: str | None = None) -> DataFrame:
    """``tiebreak`` columns order rows with equal ``order_col`` (rows must then be unique on
    (order_col, tiebreak)); ``total_col`` names a column for the group's total weight."""
    groups, tiebreak = list(groups), list(tiebreak or [])
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows with equal (groups, order_col) must share a partition unless tiebreaks make them distinct
    ranged = (df.repartitionByRange(parts, *groups, order_col, *tiebreak)
              .withColumn("__part", F.spark_partition_id()).checkpoint(eager=True))
    totals = ranged.groupBy("__part", *groups).agg(F.sum(weight_col).alias("__t"))
    # one row per (partition, group): a group has one row unless it spans partitions
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *groups, F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__off"),
                            F.sum("__t").over(over).alias("__all"))
    inside = Window.partitionBy("__part", *groups).orderBy(F.col(order_col), *tiebreak)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow) if tiebreak else inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("__cum", F.sum(weight_col).over(inside))
    names = [f"__g{k}" for k in range(len(groups))]
    offsets = offsets.select(F.col("__part").alias("__p"), *[F.col(g).alias(n) for g, n in zip(groups, names)], "__off", "__all")
    same = F.col("__part") == F.col("__p")
    for g, n in zip(groups, names):
        same = same & F.col(g).eqNullSafe(F.col(n))
    out = summed.join(offsets, same).withColumn(out_col, F.col("__off") + F.col("__cum") - F.col(weight_col))
    if total_col:
        out = out.withColumn(total_col, F.col("__all"))
    return out.drop("__part", "__p", "__cum", "__off", "__all", *names)


def average_ranks(counts: DataFrame, groups: list[str], value_col: str, n_col: str, out_col: str = "rank") -> DataFrame:
    """1-based average rank of each distinct value (ties share the mean rank)."""
    pre = ordered_prefix(counts, groups, value_col, n_col, out_col="__before")
    return pre.withColumn(out_col, F.col("__before") + (F.col(n_col) + 1) / 2.0).drop("__before")


# ----------------------------------------------------------------------------- many columns
#: A column with up to FEW values is ranked from their counts; at most FEW_IN_ALL values are sent to the tasks.
FEW, FEW_IN_ALL = 1 << 14, 1 << 18
#: Rows that a task sorts or puts back at once, log2 of the ids that stay together, and values that go back in one row.
TASK_ROWS, BLOCK_BITS, WIDTH = 1 << 21, 8, 8


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """A partition's rows, in one piece; None without any."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _runs(batches: Iterator[pa.RecordBatch]) -> tuple | None:
    """A partition's rows sorted by g, x, these as arrays, and where its runs of equal (g, x) and its groups start."""
    table = _table(batches)
    if table is None:
        return None
    order = np.lexsort((table.column("x").to_numpy(), table.column("g").to_numpy()))
    table = table.take(pa.array(order))
    g, x = table.column("g").to_numpy(), table.column("x").to_numpy()
    group = np.append(True, g[1:] != g[:-1])
    run = group | np.append(True, x[1:] != x[:-1])
    return table, g, x, np.flatnonzero(group), np.flatnonzero(run)


def _edge_runs(found: list) -> dict[tuple[int, int], tuple]:
    """(part, g) -> (offset of its rows in the group, start and length of its first run, start and length of its last run).

    A run of equal values may go over several partitions; ``found`` has one entry per partition and group.
    """
    runs: dict[tuple[int, int, str], list] = {}
    offsets, seen, last = {}, defaultdict(int), {}
    for r in sorted(found, key=lambda r: (r["g"], r["part"])):
        key, start = (r["part"], r["g"]), seen[r["g"]]
        offsets[key] = start
        run = last.get(r["g"])
        if run is None or run[2] != r["first_x"]:
            run = [start, 0, r["first_x"]]
        run[1] += r["head"]
        runs[(*key, "head")] = runs[(*key, "tail")] = run
        if r["head"] < r["n"]:
            run = [start + r["n"] - r["tail"], r["tail"], r["last_x"]]
            runs[(*key, "tail")] = run
        last[r["g"]] = run
        seen[r["g"]] += r["n"]
    return {k: (offsets[k], *runs[(*k, "head")][:2], *runs[(*k, "tail")][:2]) for k in offsets}


RANKED = ("id long, g int, part int, kind int, rank double, ties bigint, "
          "edge struct<n: bigint, first_x: double, head: bigint, last_x: double, tail: bigint>")


def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks within partition and group, and a row with ``edge`` per group.

    ``kind`` tells a row of the group's first run of equal values in the partition (1), of its last one (2), and all
    others (0); a first run that is the last one, too, counts as first.
    """
    own = _runs(batches)
    if own is None:
        return
    table, g, x, group, run = own
    ends, bounds = np.append(group[1:], len(g)), np.append(run, len(g))
    first, last = np.searchsorted(run, group), np.searchsorted(run, ends) - 1
    length = np.diff(bounds)
    offset = np.repeat(group, np.diff(np.append(first, len(run))))
    kind = np.zeros(len(run), dtype=np.int32)
    kind[last], kind[first] = 2, 1
    rank = np.repeat(run - offset + (length + 1) / 2.0, length)
    part = table.column("part")
    rows = pa.table({"id": table.column("id"), "g": table.column("g"), "part": part, "kind": np.repeat(kind, length), "rank": rank,
                     "ties": np.repeat(length, length), "edge": pa.nulls(len(g), EDGE)})
    edge = pa.StructArray.from_arrays([pa.array(v) for v in (ends - group, x[group], length[first], x[ends - 1], length[last])],
                                      names=[f.name for f in EDGE])
    groups = pa.table({"id": pa.nulls(len(group), pa.int64()), "g": pa.array(g[group], pa.int32()), "part": part.slice(0, 1).combine_chunks().take([0] * len(group)),
                       "kind": pa.nulls(len(group), pa.int32()), "rank": pa.nulls(len(group), pa.float64()),
                       "ties": pa.nulls(len(group), pa.int64()), "edge": edge})
    for t in (rows, groups):
        yield from t.to_batches(max_chunksize=1 << 16)


EDGE = pa.struct([("n", pa.int64()), ("first_x", pa.float64()), ("head", pa.int64()), ("last_x", pa.float64()), ("tail", pa.int64())])


def value_ranks(wide: DataFrame, groups: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """g -> (values, their average ranks, their counts) for the columns x0 .. of ``wide`` that have few values.

    A task gives up a column whose values are more than FEW, or most of its rows; such a column is left out.
    """
    spark, most = wide.sparkSession, FEW
    ensure_checkpoint_dir(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {g: (np.zeros(0), np.zeros(0, np.int64)) for g in range(groups)}
        many, rows = {}, 0
        for b in batches:
            rows += b.num_rows
            for g in list(found):
                x = b.column(f"x{g}").to_numpy(zero_copy_only=False)
                v, n = np.unique(x[~np.isnan(x)], return_counts=True)
                v, at = np.unique(np.append(found[g][0], v), return_inverse=True)
                found[g] = v, np.bincount(at, np.append(found[g][1], n), len(v)).astype(np.int64)
                if len(v) > most:
                    many[g] = found.pop(g)
        for g in [g for g, (v, _) in found.items() if len(v) > max(1024, rows // 2)]:
            many[g] = found.pop(g)
        for g in many:
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.nulls(1, pa.float64()), pa.array([0], pa.int64())], ["g", "x", "n"])
        for g, (v, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g, np.int32)), pa.array(v), pa.array(n)], ["g", "x", "n"])

    counts = wide.select(*[f"x{g}" for g in range(groups)]).mapInArrow(count, "g int, x double, n long").groupBy("g", "x").agg(
        F.sum("n").alias("n")).checkpoint(eager=True)
    sizes = counts.groupBy("g").agg(F.count("x").alias("kinds"), F.count(F.lit(1)).alias("all")).collect()
    few, total = [], 0
    for r in sorted(sizes, key=lambda r: r["kinds"]):
        total += r["kinds"]
        if r["kinds"] == r["all"] <= FEW and total <= FEW_IN_ALL:
            few.append(r["g"])
    out = {}
    if few:
        table = counts.where(F.col("g").isin(few)).toArrow()  # at most FEW_IN_ALL rows
        g, x, n = (table.column(c).to_numpy() for c in ("g", "x", "n"))
        for k in few:
            own = np.flatnonzero(g == k)
            own = own[np.argsort(x[own])]
            out[k] = x[own], np.cumsum(n[own]) - n[own] + (n[own] + 1) / 2.0, n[own]
    return out


def rank_columns(long: DataFrame, groups: int, ties: bool = False, rows: int = 0,
                 few: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None, wide: DataFrame | None = None) -> DataFrame:
    """(id, r0 .. r<groups - 1>): average ranks of ``x`` within ``g`` (0 .. groups - 1), back in one row per ``id``.

    ``ties`` adds t0 ..: how many rows of the group share the value.

    ``long`` (id long, g int, x double; of about ``rows`` rows) has no missing or NaN ``x`` and must not change between two
    reads.  It is range partitioned by (g, x, id), so a value that many rows share is cut like any other stretch.  Each
    partition ranks its own rows and reports, per group, their number and the lengths of the first and last runs of equal
    values - groups plus partitions rows - which give the offsets and the ranks of runs that go over a boundary.

    Groups in ``few`` (from ``value_ranks``) are not in ``long``: ``wide`` (id, x0 ..) has their values, null for missing.
    They go back WIDTH to a row; a nested column would make Spark's Arrow rows several times slower.
    """
    spark = long.sparkSession
    ensure_checkpoint_dir(spark)
    few = few or {}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)
    back = "id long, " + ", ".join(f"{c} {t}" for k in range(groups) for c, t in ((f"r{k}", "double"), (f"t{k}", "long"))[:1 + ties])
    sources, places, own_groups = [], np.zeros((0, groups, 5)), list(few)
    width = max(1, min(WIDTH, len(few)))
    ws, none = [f"w{k}" for k in range(width)], F.lit(None).cast("double")
    if len(few) < groups:
        ranged = (long.repartitionByRange(parts, "g", "x", "id").withColumn("part", F.spark_partition_id())
                  .mapInArrow(_local_ranks, RANKED).checkpoint(eager=True))
        edges = _edge_runs(ranged.where("edge IS NOT NULL").select("part", "g", "edge.*").collect())
        places = np.zeros((1 + max((p for p, _ in edges), default=0), groups, 5))
        for (p, g), (off, h0, hn, t0, tn) in edges.items():
            places[p, g] = off, h0 + (hn + 1) / 2.0, hn, t0 + (tn + 1) / 2.0, tn
        sources.append(ranged.where("edge IS NULL").select("id", "g", (F.col("part") * 3 + F.col("kind")).alias("code"), F.col("rank").alias("w0"),
                                                           *[none.alias(w) for w in ws[1:]], *["ties"][:ties]))
    for at in range(0, len(few), width):  # g tells which of them: -1, -2 ..
        values = [F.col(f"x{g}") for g in own_groups[at:at + width]] + [none] * width
        sources.append(wide.select("id", F.lit(-1 - at // width).alias("g"), F.lit(0).alias("code"), *[v.alias(w) for v, w in zip(values, ws)],
                                   *[F.lit(0).cast("long").alias("ties")][:ties]))
    sent = spark.sparkContext.broadcast((places, few))

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        places, few = sent.value
        row, ids = pd.factorize(table.column("id").to_numpy())
        g = table.column("g").to_numpy()
        rank, same = np.full((groups, len(ids)), np.nan), np.zeros((groups, len(ids)), np.int64)
        at = np.flatnonzero(g >= 0)
        if len(at):
            part, kind = np.divmod(table.column("code").to_numpy()[at], 3)
            own = places[part, g[at]].T
            rank[g[at], row[at]] = np.choose(kind, (table.column("w0").to_numpy()[at] + own[0], own[1], own[3]))
            if ties:
                same[g[at], row[at]] = np.choose(kind, (table.column("ties").to_numpy()[at], own[2].astype(np.int64), own[4].astype(np.int64)))
        for k, (own, (x, r, n)) in enumerate(few.items()):
            at = np.flatnonzero(g == -1 - k // width)
            v = table.column(f"w{k % width}").to_numpy()[at]
            at, v = at[~np.isnan(v)], v[~np.isnan(v)]
            place = np.searchsorted(x, v)
            rank[own, row[at]], same[own, row[at]] = r[place], n[place]
        out = {"id": pa.array(ids)}
        for k in range(groups):
            missing = np.isnan(rank[k])
            out[f"r{k}"] = pa.array(rank[k], mask=missing)
            if ties:
                out[f"t{k}"] = pa.array(same[k], mask=missing)
        yield from pa.table(out).to_batches(max_chunksize=1 << 16)

    blocks = functools.reduce(DataFrame.unionByName, sources).repartition(parts, F.shiftright("id", BLOCK_BITS))
    return blocks.mapInArrow(put_back, back)
