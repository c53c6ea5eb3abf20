"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Ranks of positions are doubled until unique or past the threshold. Equal strings
have equal hashes, so a hash serves as a rank and needs no global order:

1. In a task, the ranks of all positions double from 1 to 64 bytes. Any ``length``
   bytes hold a position whose 64-byte rank is the least of all 64-byte strings in
   them. A run of start positions with the same least position (its anchor) is
   taken together; equal strings have the same anchor at the same place.
2. Spark sorts rank pairs: the rank of what all strings of the run share, and that of
   the run's whole context, which reaches past the threshold. Runs with a unique
   first rank are done: none of their strings repeats. Runs with an equal pair are
   done as well: all theirs repeat.
3. What is left stands where copies begin, end or differ. These runs are cut into
   blocks of ``STEPS`` start positions, down to single ones, and Spark sorts the rank
   pairs of the blocks that are still open. The pair of a single position has its
   ranks at offsets 0 and ``length / 2``.

Nothing depends on how often a string repeats: groups are counted with map-side
partial sums and never gathered, and no pair of positions is formed. Of runs or
blocks with an equal pair only one goes on, to be compared with the open ones.

Defined results: null texts are empty; texts shorter than ``length`` bytes keep all;
rows that repeat are documents of their own and thus copies; a null doc_id stays; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import saved, text_of

LENGTH, FIRST = 400, 64
#: Start positions in a block, by round.
STEPS = (32, 4, 1)
#: Bytes that one numpy pass takes.
SLICE = 1 << 20
NO_ID = -(1 << 63)
_ODD = np.random.default_rng(8).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def first_ranks(raw: np.ndarray) -> np.ndarray:
    """Hash of the FIRST bytes from each position, by doubling; shorter than ``raw`` by FIRST - 1."""
    h = _ODD[15] * (raw.astype(np.uint64) + np.uint64(1))
    h ^= h >> np.uint64(31)
    size, level = 1, 0
    while size < FIRST:
        h = h[:-size] * _ODD[level] + h[size:]
        h ^= h >> np.uint64(29)
        size, level = 2 * size, level + 1
    return h


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of each start position, and the first ranks."""
    h = first_ranks(raw)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = length - FIRST + 1, 1
    while have < width:
        more = min(have, width - have)
        key = np.minimum(key[:-more], key[more:])
        have += more
    return (key & low).astype(np.int64), h


def runs_of(data: bytes, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first rank, context rank, lo, hi, gap) for the runs lo..hi of start positions with one anchor, at lo + gap."""
    from xxhash import xxh3_64_intdigest as digest
    raw = np.frombuffer(data, np.uint8)
    for base in range(0, len(raw) - length + 1, SLICE):
        part = raw[base:base + SLICE + length - 1]
        at, h = anchors(part, length)
        lo = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        hi = np.append(lo[1:] - 1, len(at) - 1)
        for kh, gap, s, e in zip(h[at[lo]].view(np.int64).tolist(), (at[lo] - lo).tolist(), (lo + base).tolist(), (hi + base).tolist()):
            yield kh, digest(data[s:e + length], gap) - (1 << 63), s, e, gap


def blocks_of(x: bytes, lo: int, hi: int, gap: int, step: int, length: int, among: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, rank of the shared part, rank of the whole) of the blocks of a run, within the ranges ``among``.

    ``x`` is the run's context from ``lo`` on. Blocks lie at multiples of ``step`` from
    the anchor, so equal strings have equal blocks. A block that the run's ends cut
    has no whole and gets a rank of its own.
    """
    from xxhash import xxh3_64_intdigest as digest
    anchor, half = lo + gap, length // 2
    for first, last in among:
        for k in range((anchor - last) // step, (anchor - first) // step + 1):
            s1, s2 = anchor - (k + 1) * step + 1, anchor - k * step
            a, b = max(s1, first), min(s2, last)
            if a > b:
                continue
            if step == 1:
                yield a, b, digest(x[a - lo:a - lo + half]) - (1 << 63), digest(x[a - lo + half:a - lo + length]) - (1 << 63)
            else:
                whole = x[s1 - lo:s2 - lo + length] if s1 >= lo and s2 <= hi else b"%d:%d:" % (a, b) + x
                yield a, b, digest(x[s2 - lo:s1 - lo + length]) - (1 << 63), digest(whole, s1 >= lo and s2 <= hi) - (1 << 63)


def _packed(text: Column) -> Column:
    """UTF-8 bytes, compressed: texts are sent by their key twice."""
    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        import zstandard
        z = zstandard.ZstdCompressor(level=3)
        return pd.Series([z.compress(t.encode("utf-8", "surrogatepass")) for t in s], dtype=object)
    return pack(text)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text_of()).alias("k2"), text_of().alias("text"))


def run_table(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, kh, xh, n, lo, spans): each document's different runs, how often, and their (lo, hi, gap) as 32-bit numbers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: list[list] = [[] for _ in names]
            for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["text"]):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                found: dict[tuple[int, int], list[int]] = {}
                for kh, xh, *span in runs_of(data, length):
                    found.setdefault((kh, xh), []).extend(span)
                for (kh, xh), spans in found.items():
                    for c, x in zip(cols, (k1, k2, kh, xh, len(spans) // 3, spans[0], np.array(spans, np.int32).tobytes())):
                        c.append(x)
                if len(cols[0]) > 50_000:
                    yield pd.DataFrame(dict(zip(names, cols)))
                    cols = [[] for _ in names]
            yield pd.DataFrame(dict(zip(names, cols)))
    names = ("k1", "k2", "kh", "xh", "n", "lo", "spans")
    return _keyed(docs).select("k1", "k2", "text").mapInPandas(run, "k1 long, k2 long, kh long, xh long, n long, lo int, spans binary")


def decided(rows: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose pair (kh, xh) repeats, and those that go on: open ones and, to compare with, one of each pair.

    ``rows`` has kh, xh, n and open (whether the row itself asks); ``place`` are its key columns.
    """
    # per first rank: unique, one context, or several; partial sums, so a hot rank is a row per task
    ranks = saved(rows.groupBy("kh").agg(F.sum("n").alias("total"), F.min("xh").alias("x1"), F.max("xh").alias("x2"))
                  .filter("total > 1").select("kh", (F.col("x1") < F.col("x2")).alias("several")), few=True)
    alive = saved(rows.join(ranks, "kh"), few=True)
    pairs = saved(alive.groupBy("kh", "xh").agg(F.sum("n").alias("same"), F.min(F.struct(*place)).alias("rep")), few=True)
    known = alive.join(pairs, ["kh", "xh"])
    here = F.struct(*place)
    going = known.filter(F.col("several") & ((F.col("open") & (F.col("same") == 1)) | (here == F.col("rep"))))
    return (known.filter("open AND same > 1").drop("several", "same", "rep"),
            going.withColumn("open", F.col("open") & (F.col("same") == 1)).drop("several", "same", "rep"))


def contexts(docs: DataFrame, runs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, lo, hi, gap, open, x): the runs with the bytes of their context."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for k1, k2, packed, mine in zip(pdf["k1"], pdf["k2"], pdf["packed"], pdf["runs"]):
                data = z.decompress(packed)
                for r in mine:
                    lo, hi, gap = np.frombuffer(r["spans"], np.int32)[:3].tolist()
                    out.append((k1, k2, lo, hi, gap, r["open"], data[lo:hi + length]))
            yield pd.DataFrame(out, columns=["k1", "k2", "lo", "hi", "gap", "open", "x"])
    by_doc = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("spans", "open")).alias("runs"))
    sent = _keyed(docs).select("k1", "k2", _packed(F.col("text")).alias("packed"))
    return (sent.join(by_doc, ["k1", "k2"]).select("k1", "k2", "packed", "runs")
            .mapInPandas(run, "k1 long, k2 long, lo int, hi int, gap int, open boolean, x binary"))


def block_table(runs: DataFrame, step: int, length: int = LENGTH) -> DataFrame:
    """(k1, k2, lo, a, b, kh, xh, n, open) of the blocks of runs with their context; ``among`` has the ranges and whether they ask."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k1, k2, lo, hi, gap, x, among in zip(pdf["k1"], pdf["k2"], pdf["lo"], pdf["hi"], pdf["gap"], pdf["x"], pdf["among"]):
                for r in among:
                    out += [(k1, k2, lo, a, b, t, w, 1, r["open"]) for a, b, t, w in blocks_of(x, lo, hi, gap, step, length, [(r["a"], r["b"])])]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)
    names = ["k1", "k2", "lo", "a", "b", "kh", "xh", "n", "open"]
    return runs.mapInPandas(run, "k1 long, k2 long, lo int, a int, b int, kh long, xh long, n long, open boolean")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans, blocks): start positions whose ``length`` bytes also start elsewhere."""
    table = saved(run_table(docs, length).withColumn("open", F.lit(True)))
    past, going = decided(table, ["k1", "k2", "lo"])
    spans = past.select("k1", "k2", "spans").distinct().groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans"))
    runs = saved(contexts(docs, going, length), few=True)
    todo, found = runs.withColumn("among", F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"), "open"))), None
    for step in STEPS:
        rows = saved(block_table(todo, step, length), few=True)
        past, going = decided(rows, ["k1", "k2", "lo", "a"])
        past = past.select("k1", "k2", "a", "b")
        found = past if found is None else found.unionByName(past)
        still = going.groupBy("k1", "k2", "lo").agg(F.collect_list(F.struct("a", "b", "open")).alias("among"))
        todo = runs.join(still, ["k1", "k2", "lo"]).select(*runs.columns, "among")
    blocks = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("blocks"))
    return spans.join(blocks, ["k1", "k2"], "full")


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every document; kept holds the remaining bytes."""
    if length < FIRST + max(STEPS) or length % 2:
        raise ValueError("length must be even and at least 96")
    spans = repeated_spans(docs, length)
    own = _keyed(docs).select("doc_id", "k1", "k2", _packed(F.col("text")).alias("packed"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(packed: pd.Series, spans: pd.Series, blocks: pd.Series) -> pd.DataFrame:
        import zstandard
        z, rows = zstandard.ZstdDecompressor(), []
        for data, triples, pairs in zip(map(z.decompress, packed), spans, blocks):
            p = [np.frombuffer(x, np.int32).reshape(-1, 3)[:, :2] for x in (triples if triples is not None else [])]
            if pairs is not None:
                p.append(np.array([(x["a"], x["b"]) for x in pairs], np.int32))
            if not p:
                rows.append((len(data), 0, 0, data))
                continue
            p = np.concatenate(p).astype(np.int64)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, p[:, 0], 1)
            np.add.at(edge, p[:, 1] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            rows.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
    joined = own.join(spans, ["k1", "k2"], "left")
    return joined.select("doc_id", cut("packed", "spans", "blocks").alias("x")).select("doc_id", "x.*")
