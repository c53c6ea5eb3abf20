"""Helpers shared by the training-data operators.

Lineage is cut with reliable checkpoints in the shared folder that
``spark.checkpoint.dir`` names, so a lost executor never loses a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.session import ensure_checkpoint_dir

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def saved(df: DataFrame, few: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    ``few``: for tables of short rows after a shuffle, a file for eight shuffle
    partitions, or four files per core if that is more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(4 * spark.sparkContext.defaultParallelism, parts // 8)
    if few and parts > most:
        df = df.coalesce(most)
    return df.checkpoint(eager=True)


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def with_global_index(df: DataFrame, order: list[str], index: str = "idx") -> DataFrame:
    """Add a 0-based position in ascending ``order`` (nulls first) without a one-task window.

    The rows are range partitioned and saved with their partition number; each
    partition is numbered on its own and shifted by the rows before it. Only one
    count per partition reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns
    ranged = saved(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before, offsets = 0, {}
    for row in ranged.groupBy("__part").count().orderBy("__part").collect():
        offsets[row["__part"]] = before
        before += row["count"]
    shift = F.array(*[F.lit(offsets.get(k, 0)).cast("long") for k in range(max(offsets, default=0) + 1)])
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.select(*cols, (F.get(shift, F.col("__part")) + local).cast("long").alias(index))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is a map-side
    combined minimum per node and a join, and its edges are saved, so nothing but
    a count and a checksum reaches the driver. Self edges and nulls are ignored.
    """
    a, b = F.col(src), F.col(dst)
    e = saved(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), few=True)
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), few=True)
        large = saved(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), few=True)
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")), few=True)
        e = saved(large.join(low, "a")
                  .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
                  .select("x.a", "x.b").filter("a != b").distinct(), few=True)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return (e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            .unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root")))


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def split_hot_groups(df: DataFrame, keys: list[str], salt: str, cap: int) -> DataFrame:
    """Deal a group of more than ``cap`` rows into chunk pairs: columns ``ci``, ``cj``, ``chunk``.

    A group of at most ``cap`` rows stays one unit (0, 0). A larger one is cut by
    the hash of ``salt`` into C chunks; unit (i, i) has the rows of chunk i, unit
    (i, j) those of chunks i and j, so any two rows meet and no unit holds much
    more than ``2 * cap`` rows. ``chunk`` tells a row's own chunk.
    """
    hot = saved(df.groupBy(*keys).count().filter(F.col("count") > cap)
                .select(*keys, (F.floor(F.col("count") / cap) + 1).cast("int").alias("__c")), few=True)
    zero = F.lit(0).cast("int")
    if hot.isEmpty():
        return df.withColumns({"ci": zero, "cj": zero, "chunk": zero})
    own = F.when(F.col("__c").isNull(), zero).otherwise(F.pmod(F.xxhash64(F.col(salt)), F.col("__c")).cast("int"))
    pairs = F.transform(F.sequence(zero, F.coalesce(F.col("__c"), F.lit(1)) - 1), lambda j: F.struct(
        F.least(j, F.col("chunk")).alias("ci"), F.greatest(j, F.col("chunk")).alias("cj")))
    return (df.join(hot, keys, "left").withColumn("chunk", own).withColumn("__u", F.explode(pairs))
            .select(*df.columns, "__u.ci", "__u.cj", "chunk"))


def whole_groups(batches, keys: list[str], size: int):
    """Frames of about ``size`` rows that never cut a group, from batches sorted by ``keys``."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n < size:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()  # its group may go on in the next batch
        if not last.all():
            yield rows[~last]
        held, n = [rows[last]], int(last.sum())
    if n:
        yield pd.concat(held, ignore_index=True)


def merged_labels(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after the links i-j; a label is the smallest index of its component."""
    while True:
        a, b = comp[i], comp[j]
        apart = a != b
        if not apart.any():
            return comp
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(comp))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        comp = parent[comp]
