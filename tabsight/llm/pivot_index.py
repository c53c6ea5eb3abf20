"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its ``prefix`` nearest reference points (pivots), in order.
Inverted lists are kept per pair of pivots within a label: two vectors meet where
they share at least two of their nearest pivots. Where they meet, their
shared pivots are counted, so that only the list of the two smallest shared ones
reports a pair, and the cosine is verified in double precision.

The pivots come from a bounded sample (``4 * pivots`` distinct vectors, thinned so
that they lie far apart); their number grows with the root of the number of
vectors, which keeps the lists' lengths. Every vector is indexed. Equal vectors
are one entry with a weight. A list beyond ``UNIT`` entries is dealt out in pairs of
chunks. A task returns link counts and a star per component, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of different
lengths do not link; repeated rows are vectors of their own; a null vec_id never
names a component unless all of its are null, and is not kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import connected_components, merged_labels, saved, split_hot_groups, whole_groups

COSINE, PREFIX, SHARED = 0.98, 6, 2
FEWEST, MOST = 32, 1024
UNIT, BATCH, BLOCK = 2048, 50_000, 1024


def pivot_count(n: int) -> int:
    return int(min(MOST, max(FEWEST, np.ceil(np.sqrt(n) / 4))))


class Pivots:
    """Reference points for each vector length."""

    def __init__(self, sample: list[np.ndarray], count: int, seed: int = 5):
        self.count, self.seed, self.points = count, seed, {}
        for dim in {len(v) for v in sample}:
            same = [v for v in sample if len(v) == dim]
            self.points[dim] = self._spread(np.array(same) / np.linalg.norm(same, axis=1, keepdims=True))

    def _spread(self, u: np.ndarray) -> np.ndarray:
        """Farthest-first choice from unit vectors; random directions make up for missing ones."""
        picked, near = [], np.full(len(u), -2.0)
        for _ in range(min(self.count, len(u))):
            k = int(near.argmin())
            if near[k] > 0.98:
                break
            picked.append(k)
            near = np.maximum(near, u @ u[k])
        extra = np.random.default_rng(self.seed).normal(size=(self.count - len(picked), u.shape[1]))
        return np.vstack([u[picked], extra / np.linalg.norm(extra, axis=1, keepdims=True)])

    def nearest(self, v: np.ndarray, prefix: int) -> np.ndarray:
        """Ordered ids of each row's nearest pivots."""
        if v.shape[1] not in self.points:
            self.points[v.shape[1]] = self._spread(np.zeros((0, v.shape[1])))
        return np.argsort(-(v @ self.points[v.shape[1]].T), axis=1, kind="stable")[:, :prefix]


def _with_validity(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, fine): v holds doubles without negative zeros, fine tells whether it can link."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") + F.lit(0.0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", "label", v.alias("v")).withColumn("fine", F.coalesce(fine, F.lit(False)))


def _links(u: np.ndarray, top: np.ndarray, w: np.ndarray, chunk: np.ndarray, q: int, cross: bool,
           cosine: float, shared: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and component labels within one inverted list (of the pivot pair p < q)."""
    n = len(u)
    links, comp = np.zeros(n, np.int64), np.arange(n)
    has = np.zeros((n, pivots), np.float32)
    np.put_along_axis(has, top, 1, axis=1)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            x, y = slice(a, min(n, a + BLOCK)), slice(b, min(n, b + BLOCK))
            mine = has[x, :q] @ has[y, :q].T == 1  # p is the only one below q: no other list reports the pair
            if shared > 2:
                mine &= has[x] @ has[y].T >= shared
            if cross:
                mine &= chunk[x, None] != chunk[None, y]
            if a == b:
                mine = np.triu(mine, 1)
            i, j = np.nonzero(mine)
            near = np.concatenate([np.einsum("ij,ij->i", u[a + i[k:k + 100_000]], u[b + j[k:k + 100_000]]) for k in range(0, max(1, len(i)), 100_000)]) >= cosine
            i, j = a + i[near], b + j[near]
            links += np.bincount(i, w[j], n).astype(np.int64) + np.bincount(j, w[i], n).astype(np.int64)
            comp = merged_labels(comp, i, j)
    return links, comp


def near_vectors(classes: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """(cid, links, root) from the lists; ``classes`` has (cid, label, w, v), and a cid may come from several lists."""
    spark = classes.sparkSession
    count = pivot_count(classes.count())
    sample = classes.orderBy(F.xxhash64("v", F.lit("pivots")), "cid").limit(4 * count).select("v").collect()
    sent = spark.sparkContext.broadcast(Pivots([np.array(r["v"]) for r in sample], count))

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = list(combinations(range(prefix), 2))
        for pdf in batches:
            size = pdf["v"].map(len).to_numpy()
            for dim in np.unique(size):
                rows = pdf[size == dim]
                v = np.stack(rows["v"].to_numpy())
                top = np.sort(sent.value.nearest(v / np.linalg.norm(v, axis=1, keepdims=True), prefix), axis=1).astype(np.int32)
                base = pd.DataFrame({"cid": rows["cid"].to_numpy(), "label": rows["label"].to_numpy(), "w": rows["w"].to_numpy(), "dim": np.int32(dim),
                                     "top": [t.tobytes() for t in top], "v": [x.tobytes() for x in v]})
                for i, j in pairs:
                    yield base.assign(p=top[:, i], q=top[:, j])

    kind = classes.schema["label"].dataType.simpleString()
    filed = classes.select("cid", "label", "w", "v").mapInPandas(
        file, f"cid long, label {kind}, w long, dim int, top binary, v binary, p int, q int")
    keys = ["label", "dim", "p", "q", "ci", "cj"]
    units = split_hot_groups(filed, keys[:4], "cid", UNIT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, *keys).sortWithinPartitions(*keys)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, keys, BATCH):
            out = [np.zeros((0, 3), np.int64)]
            edge = (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1)
            ends = np.concatenate(([0], np.flatnonzero(edge) + 1, [len(rows)]))
            for s, e in zip(ends[:-1], ends[1:]):
                if e - s < 2:
                    continue
                g = rows.iloc[s:e]
                v = np.frombuffer(b"".join(g["v"]), np.float64).reshape(e - s, -1)
                top = np.frombuffer(b"".join(g["top"]), np.int32).reshape(e - s, -1).astype(np.int64)
                u = v / np.linalg.norm(v, axis=1, keepdims=True)
                cid = g["cid"].to_numpy()
                links, comp = _links(u, top, g["w"].to_numpy(), g["chunk"].to_numpy(), int(g["q"].iloc[0]),
                                     bool(g["ci"].iloc[0] != g["cj"].iloc[0]), cosine, shared, count)
                on = links > 0
                out.append(np.stack([cid[on], links[on], cid[comp[on]]], axis=1))
            yield pd.DataFrame(np.concatenate(out), columns=["cid", "links", "root"])
    return dealt.mapInPandas(join, "cid long, links long, root long")


def embedding_components(vectors: DataFrame, cosine: float = COSINE, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    checked = _with_validity(vectors)
    valid = checked.filter("fine").drop("fine")
    classes = saved(valid.groupBy("label", "v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first_id"))
                    .withColumn("cid", F.monotonically_increasing_id()))
    found = saved(near_vectors(classes, cosine, prefix, shared), few=True)
    roots = connected_components(found.select(F.col("cid").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    linked = saved(classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                   .select("label", "v", "first_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")), few=True)
    ids = saved(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), few=True)
    named = saved(linked.join(ids, "root").select("label", "v", "n_links", "component_id"), few=True)
    rows = valid.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = checked.filter("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
