"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``VNODES`` points of a ring of 64-bit hashes; a key belongs to the
first point clockwise. No shard takes more than ``1 + SLACK`` of its even share of
the bytes: what a full shard cannot take goes on clockwise to the next one that can,
so loads are near equal (law ``bytes``) and one more shard moves few keys.

1. Rows of (key, size, text hash) are range partitioned by ring position. The rows of
   an arc between two points lie side by side, so an arc's bytes are one interval of the
   running total, which needs one number per partition.
2. Only bytes per arc reach the driver, and the rows larger than 1/HEAVY of a share:
   their number cannot exceed shards x HEAVY. Heavy rows are placed one by one, the
   largest first. The arcs then flow: every arc offers its rest to the next shard with
   room, a shard takes offers from near points first, and what it has no room for
   goes on. This gives each arc its pieces, at most shards more than arcs.
3. Each task finds the piece of a row from its running total, and its slot from the rows of
   the piece before it. A hot key is cut like any other stretch of the ring.

Defined results: null texts have size EXTRA; a null key has a position like any other;
rows with one key lie together and may be cut by a full shard; equal rows are taken alike;
a row larger than a share goes where it fits or, if nowhere, to the least loaded shard;
an empty table gives an empty result; only the columns in ``carry`` travel along.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tabsight.llm.common import saved

SHARDS, VNODES, HEAVY, EXTRA = 40, 128, 256, 16
#: Room above an even share, in thousandths.
SLACK = 1
LAW = "bytes"


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points and the shard at each. A last point at the end of the range repeats the first one's shard."""
    at = np.array([int.from_bytes(blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big", signed=True)
                   for s in range(shards) for v in range(vnodes)], dtype=np.int64)
    order = np.argsort(at, kind="stable")
    owner = order // vnodes
    return np.append(at[order], np.iinfo(np.int64).max), np.append(owner, owner[0])


def place_heavy(owner: np.ndarray, load: np.ndarray, cap: int, heavy: list[tuple[int, int]]) -> list[int]:
    """The shard of each (arc, size), which come in descending size: the first one clockwise with room, else the least loaded."""
    out, arcs = [], len(owner)
    for arc, size in heavy:
        fits = load + size <= cap
        if fits.any():
            shard = next(s for s in (owner[(arc + k) % arcs] for k in range(arcs)) if fits[s])
        else:
            shard = int(load.argmin())
        load[shard] += size
        out.append(int(shard))
    return out


def flow(owner: np.ndarray, light: np.ndarray, load: np.ndarray, cap: int) -> list[tuple[int, int, int]]:
    """(arc, shard, bytes) pieces of all arcs in ring order; the pieces of an arc in the order of its rows."""
    arcs = len(owner)
    room, rest, at = np.maximum(cap - load, 0), light.copy(), np.arange(arcs)
    pieces = [[] for _ in range(arcs)]
    while rest.any():
        place = np.arange(2 * arcs)
        open_at = np.where(np.tile(room[owner] > 0, 2), place, 2 * arcs)
        following = np.minimum.accumulate(open_at[::-1])[::-1][:arcs]
        live = np.flatnonzero(rest)
        at[live] += following[at[live] % arcs] - at[live] % arcs
        shard, far = owner[at[live] % arcs], at[live] - live
        order = np.lexsort((live, far, shard))
        live, shard = live[order], shard[order]
        before = np.cumsum(rest[live]) - rest[live]
        start = np.append(True, shard[1:] != shard[:-1])
        before -= np.repeat(before[start], np.diff(np.append(np.flatnonzero(start), len(live))))
        take = np.clip(room[shard] - before, 0, rest[live])
        for a, s, x in zip(live.tolist(), shard.tolist(), take.tolist()):
            if x:
                pieces[a].append((a, s, x))
        rest[live] -= take
        np.subtract.at(room, shard, take)
    return [p for arc in pieces for p in arc]


def capacity(total: int, shards: int, slack: int = SLACK) -> int:
    return -(-total * (1000 + slack) // (1000 * shards))


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (),
                  vnodes: int = VNODES, slack: int = SLACK) -> DataFrame:
    """(key, size, text_crc32, shard, slot, *carry) of every row; size is the text's bytes plus EXTRA, slots are gapless from 0."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # carried columns keep to names that cannot clash
    rows = saved(docs.select(F.xxhash64(F.col(key)).alias("pos"), (F.octet_length(body) + EXTRA).cast("long").alias("size"),
                             F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("tie"), F.col(key).alias("key"),
                             *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]))
    order = ["pos", "size", "text_crc32", "tie"]
    ranged = saved(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order).drop("tie"))
    schema = StructType([f for f in ranged.schema.fields if f.name not in ("pos", "part")]).add("shard", IntegerType()).add("slot", LongType())
    total = ranged.agg(F.sum("size")).first()[0] or 0
    points, owner = ring(shards, vnodes)
    least, cap = total // (shards * HEAVY) + 1, capacity(total, shards, slack)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Per batch: itself, partition, sizes, whether heavy, and first row's number in the partition."""
        n = 0
        for b in batches:
            if b.num_rows:
                size = b.column("size").to_numpy()
                yield b, b.column("part")[0].as_py(), size, size >= least, n
                n += b.num_rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, arc, at, size): bytes of light rows of each arc (at -1), and each heavy row by its number."""
        for b, part, size, heavy, n in numbers(batches):
            arc = np.searchsorted(points, b.column("pos").to_numpy(), side="left")
            light = np.zeros(arc[-1] - arc[0] + 1, dtype=np.int64)
            np.add.at(light, (arc - arc[0])[~heavy], size[~heavy])
            some, big = np.flatnonzero(light), np.flatnonzero(heavy)
            cols = (np.full(len(some) + len(big), part), np.append(some + arc[0], arc[big]),
                    np.append(np.full(len(some), -1), n + big), np.append(light[some], size[big]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "arc", "at", "size"])

    found = ranged.select("part", "pos", "size").mapInArrow(measure, "part long, arc long, at long, size long").collect()
    light, before, load = np.zeros(len(owner), dtype=np.int64), defaultdict(int), np.zeros(shards, dtype=np.int64)
    for r in found:
        if r["at"] < 0:
            light[r["arc"]] += r["size"]
            before[r["part"]] += r["size"]
    heavy = sorted(((r["size"], r["arc"], r["part"], r["at"]) for r in found if r["at"] >= 0), key=lambda x: (-x[0], *x[1:]))
    homes = place_heavy(owner, load, cap, [(arc, size) for size, arc, _, _ in heavy])
    used, special = [0] * shards, defaultdict(dict)
    for (_, _, part, at), s in zip(heavy, homes):
        special[part][at] = (s, used[s])
        used[s] += 1
    pieces = flow(owner, light, load, cap)
    ends, home = np.cumsum([x for _, _, x in pieces], dtype=np.int64), np.array([s for _, s, _ in pieces], dtype=np.int32)
    offsets, seen = {}, 0
    for part in sorted({r["part"] for r in found}):
        offsets[part] = seen
        seen += before[part]

    def pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Per batch: itself, partition, first row's number, places of heavy rows, places and pieces of light rows."""
        run = None
        for b, part, size, heavy, n in numbers(batches):
            run = offsets[part] if run is None else run
            own = np.where(heavy, 0, size)
            start = run + np.cumsum(own) - own
            run += int(own.sum())
            at = np.flatnonzero(~heavy)
            yield b, part, n, np.flatnonzero(heavy), at, np.searchsorted(ends, start[at], side="right")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, _, _, _, piece in pieced(batches):
            p, c = np.unique(piece, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(p), part), p, c)], ["part", "piece", "n"])

    counted = ranged.select("part", "size").mapInArrow(count, "part long, piece long, n long")
    first = defaultdict(dict)
    for r in counted.groupBy("part", "piece").agg(F.sum("n").alias("n")).orderBy("part", "piece").collect():
        s = int(home[r["piece"]])
        first[r["part"]][r["piece"]] = used[s]
        used[s] += r["n"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(int)
        for b, part, n, big, at, piece in pieced(batches):
            shard, slot = np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows, dtype=np.int64)
            p, where, c = np.unique(piece, return_index=True, return_counts=True)
            base = np.array([first[part][x] + seen[x] for x in p.tolist()], dtype=np.int64) - where
            shard[at], slot[at] = home[piece], np.repeat(base, c) + np.arange(len(at))
            for x, y in zip(p.tolist(), c.tolist()):
                seen[x] += y
            for k in big.tolist():
                shard[k], slot[k] = special[part][n + k]
            kept = b.drop_columns(["part"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shard), pa.array(slot)], [*kept.schema.names, "shard", "slot"])

    out = ranged.drop("pos").mapInArrow(place, schema)
    return out.select("key", "size", "text_crc32", "shard", "slot", *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """``docs`` as Parquet in one folder per shard, rows in slot order; a large shard has several files."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.struct(*docs.columns).alias("doc"))
    placed = assign_shards(rows, shards, "key", "body", carry=("doc",))
    (placed.repartitionByRange(max(parts, shards), "shard", "slot").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", "doc").write.partitionBy("shard").mode("overwrite").parquet(path))
