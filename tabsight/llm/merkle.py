"""Merkle dataset manifest: a postorder append log written by aligned builders.

The rows of a group (a source) are its leaves, in key order; every 16 consecutive
nodes become their digest until one node, the group's subroot, is left. The
subroots in group order make the root by the same rule.

1. Leaves are digests of length-prefixed fields, so only digests travel. They are
   range partitioned by (group, key) and numbered from one summary row per partition.
2. A builder owns an aligned block of 256 leaves, whatever the size of its group, and
   appends its nodes to a log in completion order: a parent comes directly after the
   last node of its subtree. The nodes that blocks end in are the leaves of the next
   round, so a round leaves 1/256 of the nodes and no task holds a group.
3. A node's place in the log follows from the sizes of the subtrees before it
   (``postorder``), so siblings are read by address; no tree is walked. Proofs
   are joined downwards: what lies above a block is shared by all its leaves.

Defined results: nulls are hashed as ``-``; a null group is a group of its own and the
first; null keys come first; rows with one key stand by digest, and repeated rows are
leaves of their own with one digest; a group of one row has its leaf as subroot, a
table of one group its subroot as root; a row without an altered digest is checked as it
stands; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import saved, whole_groups, with_global_index

ARITY = 16
#: Levels a builder closes; it owns ARITY ** LEVELS leaves.
LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record_digest(fields: list[Column]) -> Column:
    """sha256 (binary) of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for c in fields:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ascii_lower(text: Column) -> Column:
    return F.translate(text.cast("string"), UPPER, LOWER)


# ----------------------------------------------------------------------------- one log
def digest(nodes: list[bytes]) -> bytes:
    """H of the nodes' hex texts, joined."""
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


def log_levels(n: int, block: int, most: int = LEVELS) -> int:
    """Levels above the ``n`` nodes of a block; a first block that is not full is the group's only one."""
    return most if block else next(h for h in range(most + 1) if ARITY ** h >= n)


def write_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes in completion order; the last one is the block's root."""
    log, waiting = [], [[] for _ in range(levels + 1)]
    for k, leaf in enumerate(leaves):
        log.append(leaf)
        waiting[0].append(leaf)
        for h in range(levels):
            if waiting[h] and (len(waiting[h]) == ARITY or k + 1 == len(leaves)):
                log.append(digest(waiting[h]))
                waiting[h + 1].append(log[-1])
                waiting[h] = []
            elif len(waiting[h]) < ARITY:
                break
    return log


def postorder(level: int, n: int) -> np.ndarray:
    """Places in the log of ``n`` leaves of all nodes of a level, by the nodes that are complete before each."""
    last = np.minimum((np.arange(-(-n // ARITY ** level)) + 1) * ARITY ** level, n) - 1
    place, below = last + level, last // ARITY
    while below.any():
        place, below = place + below, below // ARITY
    return place


def read_levels(log: bytes, n: int, levels: int) -> list[list[bytes]]:
    """The nodes of every level below the root, read by place."""
    return [[log[32 * p:32 * p + 32] for p in postorder(h, n).tolist()] for h in range(levels)]


def run_path(nodes: list[list[bytes]], i: int) -> tuple[bytes, bytes]:
    """Siblings of leaf ``i`` up to the block's root, and per level its place in the run and the run's length."""
    sibs, shape = [], []
    for level in nodes:
        run, at = level[i - i % ARITY:i - i % ARITY + ARITY], i % ARITY
        sibs += run[:at] + run[at + 1:]
        shape += (at, len(run))
        i //= ARITY
    return b"".join(sibs), bytes(shape)


def fold(node: bytes, sibs: bytes, shape: bytes) -> bytes:
    """The root that follows from a node and its siblings."""
    text, used, cur = sibs.hex(), 0, node.hex()
    for at, length in zip(shape[::2], shape[1::2]):
        left, right = used + 64 * at, used + 64 * (length - 1)
        cur = sha256((text[used:left] + cur + text[left:right]).encode()).hexdigest()
        used = right
    return bytes.fromhex(cur)


# ----------------------------------------------------------------------------- building
@dataclass
class Manifest:
    """``blocks``: per round, rows (grp, block, n, log), in round 0 also ``keys`` and ``altered``;
    ``subroots``: (grp, idx, digest); ``top``: the blocks of the tree over subroots; ``root``: 32 bytes, None if empty."""

    blocks: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: bytes | None
    levels: int
    key_type: str


def _positions(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, key, tie, digest, altered) with ``idx``, the position within the group, and the key as text.

    ``tie`` tells equal rows apart, so that many of them still spread over partitions.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "key", "digest", "tie"]
    ranged = saved(leaves.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, head, last, tail = None, None, 0, None, 0
        for b in batches:
            if not len(b):
                continue
            g = b["grp"].to_numpy(dtype=object)
            if part is None:
                part, first = int(b["part"].iat[0]), g[0]
            # rows are sorted: a group is one run
            head += int((g == first).sum())
            tail = int((g == g[-1]).sum()) + (tail if g[-1] == last else 0)
            last = g[-1]
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "head": [head], "last": [last], "tail": [tail]})

    known = ranged.select("part", "grp").mapInPandas(summary, "part int, first string, head long, last string, tail long").collect()
    before, group, seen = {}, None, 0
    for r in sorted(known, key=lambda r: r["part"]):
        before[r["part"]] = seen if r["first"] == group else 0
        seen = r["tail"] + (before[r["part"]] if r["first"] == r["last"] else 0)
        group = r["last"]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen = None, None
        for b in batches:
            if not len(b):
                continue
            g = b["grp"].to_numpy(dtype=object)
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            idx = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
            carry = before[int(b["part"].iat[0])] if seen is None else seen if g[0] == last else 0
            idx[:start[1] if len(start) > 1 else len(g)] += carry
            last, seen = g[-1], int(idx[-1]) + 1
            yield b.drop(columns="part").assign(idx=idx)

    # as text: a numeric column with nulls would reach pandas as doubles
    return (ranged.select("part", "grp", F.col("key").cast("string"), "digest", "altered")
            .mapInPandas(number, "grp string, key string, digest binary, altered binary, idx long"))


def _blocks(nodes: DataFrame, levels: int, leaves: bool = False) -> DataFrame:
    """One row (grp, block, n, log) per aligned block of ``nodes`` (grp, idx, digest); of ``leaves``, keys and altered digests go along."""
    size, more = ARITY ** levels, ", keys array<string>, altered array<binary>" if leaves else ""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["grp", "block"], size):
            g, block = rows["grp"].to_numpy(dtype=object), rows["block"].to_numpy()
            cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])))
            out = []
            for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(g)).tolist()):
                log = write_log(rows["digest"].iloc[s:e].tolist(), log_levels(e - s, int(block[s]), levels))
                row = (g[s], block[s], e - s, b"".join(log))
                out.append(row + (rows["key"].iloc[s:e].tolist(), rows["altered"].iloc[s:e].tolist()) if leaves else row)
            yield pd.DataFrame(out, columns=["grp", "block", "n", "log"] + (["keys", "altered"] if leaves else []))

    dealt = (nodes.withColumn("block", F.floor(F.col("idx") / size)).repartition("grp", "block")
             .sortWithinPartitions("grp", "block", "idx").drop("idx"))
    return saved(dealt.mapInPandas(build, f"grp string, block long, n int, log binary{more}"))


def _rounds(first: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of all rounds above ``first``, and (grp, digest) of the last node of each group."""
    rounds = [first]
    while True:
        ends = rounds[-1].select("grp", F.col("block").alias("idx"), F.expr("substring(log, length(log) - 31, 32)").alias("digest"))
        if rounds[-1].filter("block > 0").isEmpty():
            return rounds, ends.select("grp", "digest")
        rounds.append(_blocks(ends, levels))


def build_manifest(docs: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS,
                   altered: Column | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``. ``altered``: digest of a row as it is found later (null: unchanged), kept for ``audit``."""
    name = F.col(group).cast("string")
    leaves = saved(docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("grp"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("tie"),
        record_digest([F.col(c) for c in fields]).alias("digest"),
        (F.lit(None).cast("binary") if altered is None else altered).alias("altered")))
    blocks, ends = _rounds(_blocks(_positions(leaves), levels, leaves=True), levels)
    subroots = saved(with_global_index(ends, ["grp"]))
    top, root = _rounds(_blocks(subroots.select(F.lit("").alias("grp"), "idx", "digest"), levels), levels)
    found = root.first()
    return Manifest(blocks, subroots, top, bytes(found["digest"]) if found else None, levels, docs.schema[key].dataType.simpleString())


# ----------------------------------------------------------------------------- proofs
def _below(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(grp, block, sibs, shape, subroot) of every node of ``blocks``, which is a block of the round below."""
    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for g, block, n, log, sibs, shape, subroot in zip(*(rows[c] for c in ("grp", "block", "n", "log", "sibs", "shape", "subroot"))):
                nodes = read_levels(log, n, log_levels(n, block, levels))
                for i in range(n):
                    low = run_path(nodes, i)
                    out.append((g, block * ARITY ** levels + i, low[0] + sibs, low[1] + shape, subroot))
            yield pd.DataFrame(out, columns=["grp", "block", "sibs", "shape", "subroot"])

    return blocks.join(above, ["grp", "block"]).mapInPandas(paths, "grp string, block long, sibs binary, shape binary, subroot binary")


def _down(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Paths of the blocks of the first round, from those of the last."""
    for blocks in reversed(rounds[1:]):
        above = _below(blocks, above, levels)
    return above


def audit(manifest: Manifest) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root (hex) and verified.

    The proof is the digest of the siblings' hex texts from leaf to root; the folded root
    is recomputed from the altered digest, or the leaf where there is none, and the siblings.
    """
    spark = manifest.subroots.sparkSession
    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root, levels = manifest.root, manifest.levels
    if root is None:
        return spark.createDataFrame([], schema).withColumn("key", F.col("key").cast(manifest.key_type))
    none = F.lit(b"")
    peak = manifest.top[-1].select("grp", "block", none.alias("sibs"), none.alias("shape"), F.lit(None).cast("binary").alias("subroot"))
    over = _below(manifest.top[0], _down(manifest.top, peak, levels), levels).select(F.col("block").alias("idx"), "sibs", "shape")
    above = manifest.subroots.join(over, "idx").select("grp", F.lit(0).cast("long").alias("block"), "sibs", "shape", F.col("digest").alias("subroot"))

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for rows in batches:
            for block, n, log, keys, altered, sibs, shape, subroot in zip(*(rows[c] for c in (
                    "block", "n", "log", "keys", "altered", "sibs", "shape", "subroot"))):
                nodes, out = read_levels(log, n, log_levels(n, block, levels)), []
                leaves = nodes[0] if nodes else [log]
                for i in range(n):
                    low = run_path(nodes, i)
                    path = low[0] + sibs
                    folded = fold(leaves[i] if altered[i] is None else altered[i], path, low[1] + shape)
                    out.append((keys[i], leaves[i].hex(), subroot.hex(), root.hex(), sha256(path.hex().encode()).hexdigest(), folded.hex(),
                                folded == root))
                yield pd.DataFrame(out, columns=names)

    proofs = manifest.blocks[0].join(_down(manifest.blocks, above, levels), ["grp", "block"]).mapInPandas(prove, schema)
    return proofs.withColumn("key", F.col("key").cast(manifest.key_type))
