"""SimHash near-dedup by a binary trie self-join.

A fingerprint has a bit set when over half of the document's shingle hashes set
it. Two fingerprints link at ``max_bits`` or fewer differing bits.

The 64 bits are cut into ``max_bits + 1`` blocks. Linked fingerprints agree in
one block at least, so each is filed once per block with its bits rotated to
start there: the block is the top of a trie, and only equal top nodes can hold a
pair without a bit of error spent. Spark deals these top nodes to tasks. A task
descends node pairs together, bit by bit, adds up differing bits and drops a pair
beyond the budget, or when both nodes already lie in one component. It returns a
star per component, never all pairs.

Defined results: null texts are empty; a text without a word has fingerprint
zero and links like any other; equal fingerprints are one node; null doc_ids never
name a component (a component of nulls alone has a null id); repeated rows stay
repeated in ``simhash_components`` and count as a group in ``simhash_dedup``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import (LOWER, connected_components, merged_labels, saved, split_hot_groups,
                                 text_of, whole_groups)

SEED = 42
#: Fingerprints of one top node that one task unit takes; more are dealt out as chunk pairs.
UNIT = 4096
#: Node pairs that are taken one level deeper at once, and rows of one numpy pass.
FRONTIER, BATCH = 400_000, 100_000


def simhash(text: str, shingle: int = 4) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest as digest
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts[at:to], starts[at + shingle:to + shingle])),
                        np.uint64, to - at)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * counts > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``also``: fp is the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp(text_of(text_col)).alias("fp"), *also)


def trie_components(vals: np.ndarray, bounds: np.ndarray, skip: int, budget: int) -> np.ndarray:
    """Component label of each fingerprint after the self-joins of many tries.

    ``vals`` (uint64) holds the groups one after another, each sorted and
    distinct; ``bounds`` are the groups' ends with a leading 0; the first ``skip``
    bits are equal within a group.
    """
    n = len(vals)
    comp = np.arange(n)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo > 256:  # a dense group: join neighbours at one bit first, so that whole subtrees are one component
            sub = vals[lo:hi]
            for bit in range(64 - skip):
                other = sub ^ np.uint64(1 << bit)
                at = np.minimum(np.searchsorted(sub, other), len(sub) - 1)
                hit = np.flatnonzero(sub[at] == other)
                comp = merged_labels(comp, lo + hit, lo + at[hit])
    ones: dict[int, np.ndarray] = {}
    big = bounds[1:] - bounds[:-1] > 1
    lo, hi = bounds[:-1][big], bounds[1:][big]
    stack = [(63 - skip, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, used = stack.pop()
        if not len(alo):
            continue
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(bit, *(x[half:] for x in (alo, ahi, blo, bhi, used))), (bit, *(x[:half] for x in (alo, ahi, blo, bhi, used)))]
            continue
        changes = np.concatenate(([0], np.cumsum(comp[1:] != comp[:-1]))) if n > 1 else np.zeros(1, np.int64)
        one = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (comp[alo] == comp[blo])
        leaf = ~one & (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = np.bitwise_count(vals[i] ^ vals[j]) <= budget
            comp = merged_labels(comp, i[near], j[near])
        on = ~one & ~leaf
        alo, ahi, blo, bhi, used = (x[on] for x in (alo, ahi, blo, bhi, used))
        if bit < 0 or not len(alo):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((vals >> np.uint64(bit)) & np.uint64(1)))).astype(np.int32)
        c = ones[bit]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = alo == blo
        nxt = []
        for p, q, r, s, extra, which in (
                (alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None),
                (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~own)):
            ok = (q > p) & (s > r) & (used + extra <= budget)
            if which is not None:
                ok &= which
            nxt.append((p[ok], q[ok], r[ok], s[ok], used[ok] + np.int8(extra)))
        stack.append((bit - 1, *(np.concatenate([x[k] for x in nxt]) for k in range(5))))
    return comp


def near_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(src, dst) stars that connect the distinct fingerprints ``fp`` within ``max_bits``."""
    blocks = max_bits + 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    fp = F.col("fp")
    turned = [fp if s == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, 64 - s)) for s in cuts[:-1]]
    filed = fps.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("rot"), F.shiftrightunsigned(t, 64 - (cuts[k + 1] - cuts[k])).alias("top"), t.alias("v"))
        for k, t in enumerate(turned)])).alias("x")).select("x.*")
    units = split_hot_groups(filed, ["rot", "top"], "v", UNIT)
    keys = ["rot", "top", "ci", "cj"]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, *keys).sortWithinPartitions(*keys)

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rot, part in pdf.groupby("rot", sort=True):
            g = part.groupby(["top", "ci", "cj"], sort=True).ngroup().to_numpy()
            v = part["v"].to_numpy(np.int64).view(np.uint64)
            order = np.lexsort((v, g))
            g, v = g[order], v[order]
            bounds = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]))
            comp = trie_components(v, bounds, cuts[rot + 1] - cuts[rot], max_bits)
            s = np.uint64(cuts[rot])
            back = v if rot == 0 else (v >> s) | (v << (np.uint64(64) - s))
            linked = np.flatnonzero(comp != np.arange(len(comp)))
            out.append(pd.DataFrame({"src": back[linked].view(np.int64), "dst": back[comp[linked]].view(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": []}, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, keys, BATCH):
            yield stars(rows)

    return dealt.mapInPandas(run, "src long, dst long")


def _rooted_rows(docs: DataFrame, shingle: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text",
                 also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, ``also``) of every row of ``docs``, and (fp, first_id, root) of every fingerprint."""
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must lie between 0 and 15")
    rows = saved(fingerprints(docs, shingle, id_col, text_col, also))
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), few=True)
    roots = connected_components(near_links(nodes.select("fp"), max_bits))
    return rows, saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                       .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), few=True)


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows, rooted = _rooted_rows(docs, shingle, max_bits, id_col, text_col)
    ids = saved(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), few=True)
    named = saved(rooted.join(ids, "root").select("fp", "component_id"), few=True)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, with all columns.

    The row with the smallest doc_id stays; null ids come last, and rows that share the
    doc_id follow the hashes of the text and of the row. Of equal rows one stays.
    """
    key = ("__null", "__id", "__text", "__row")
    long_id = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__null": long_id.isNull(), "__id": F.coalesce(long_id, F.lit(0)), "__text": F.xxhash64(text_of()),
                              "__row": F.xxhash64(*[F.to_json(F.col(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])})
    rows, rooted = _rooted_rows(keyed, shingle, max_bits, also=key)
    per_fp = rows.groupBy("fp").agg(F.min(F.struct(*key)).alias("k"))
    kept = saved(per_fp.join(rooted, "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.*"), few=True)
    return keyed.dropDuplicates(list(key)).join(kept, list(key), "left_semi").select(*docs.columns)
