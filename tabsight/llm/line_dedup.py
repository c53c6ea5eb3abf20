"""Line dedup by pairwise alignment of overlapping documents.

A line belongs to the first document (smallest doc_id) that has it. Every later
document with that line is paired with this owner, so a line in n documents makes
n - 1 pairs, not n squared, and every pair whose shared lines could make a block is
aligned, however common its lines are (a caller can ask for less with ``rare``: then
a pair must share a line of at most ``rare`` documents or ``shared`` different lines).
The shared lines are aligned by patience diff: equal ends first, then the lines unique
on both sides in their longest common order, then the gaps between them. Aligned runs
of ``min_chars`` characters or more are deleted from the later document; the owner
keeps them.

The lines of a block may have different owners. So each smallest block of ``min_chars``
(``blocks_of``) has an owner of its own, the first document with that block, and joins
it in the same way. A block that stands in one piece in its owner is deleted from each
later document, also where it crosses the order of the other shared lines: with that,
whatever run of lines, with at most a blank line between two, an alignment with any
earlier document finds goes, without those pairs. A run around a line that differs is
found in the pairs with line owners only.

Defined results: null texts are empty; blank lines match nothing and stay; a null
doc_id counts as the smallest; rows that repeat doc_id and text are one document
and come out alike; rows that share only the doc_id are ordered by text hash; an
empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import saved, text_of

SHARED, MIN_CHARS = 3, 40
NO_ID = -(1 << 63)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j), rising in both, with a[i] == b[j]."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        there = {x: j for j, x in enumerate(b[blo:bhi], blo) if cb[x] == 1}
        both = [(i, there[x]) for i, x in enumerate(a[alo:ahi], alo) if ca[x] == 1 and x in there]
        ends: list[int] = []  # last j of the best run of each length
        at: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(both):
            n = bisect_left(ends, j)
            back.append(at[n - 1] if n else -1)
            if n == len(ends):
                ends.append(j)
                at.append(k)
            else:
                ends[n], at[n] = j, k
        k = at[-1] if at else -1
        upto = (ahi, bhi)
        while k >= 0:
            i, j = both[k]
            out.append((i, j))
            todo.append((i + 1, upto[0], j + 1, upto[1]))
            upto, k = (i, j), back[k]
        if at:
            todo.append((alo, upto[0], blo, upto[1]))
    return sorted(out)


def aligned_blocks(lines: list[tuple[np.ndarray, np.ndarray, int]], min_chars: int) -> list[int]:
    """Places to delete in the later document; ``lines``: per shared line its places in it and in the owner, and its length."""
    mine = sorted((int(p), k) for k, (own, _, _) in enumerate(lines) for p in own)
    theirs = sorted((int(p), k) for k, (_, first, _) in enumerate(lines) for p in first)
    found = [(mine[i], theirs[j][0]) for i, j in patience([k for _, k in mine], [k for _, k in theirs])]
    gone, run, chars = [], [], 0
    for n, ((p, k), q) in enumerate(found):
        run.append(p)
        chars += lines[k][2]
        after = found[n + 1] if n + 1 < len(found) else None
        if after is None or after[0][0] - p != after[1] - q or after[0][0] - p > 2:  # a blank line may lie between
            if chars >= min_chars:
                gone += run
            run, chars = [], 0
    return gone


def block_places(common: list, min_chars: int) -> list[int]:
    """Places to delete for one pair: shared blocks wherever they stand, and aligned runs of its shared lines."""
    gone = {int(p) for x in common if x["chars"] >= min_chars for p in x["at"]}
    lines = [(x["at"], x["first"], x["chars"]) for x in common if x["n"] == 1]
    if any(chars < min_chars for _, _, chars in lines):  # else each of them is a block
        gone.update(aligned_blocks(lines, min_chars))
    return sorted(gone)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text_of()).alias("k2"), text_of().alias("text"))


def blocks_of(found: list[tuple[int, str]], min_chars: int) -> set[tuple[int, int]]:
    """The smallest blocks of two lines or more with ``min_chars``: first and last position in ``found``, (place, line) of a text.

    One starts and one ends at each line, if the lines beside it (a blank line may lie
    between) are enough; any run of ``min_chars`` is made up of such blocks and of lines
    that have ``min_chars`` alone.
    """
    out = set()
    for step in (1, -1):
        for i, (_, line) in enumerate(found):
            chars, j = len(line), i
            while chars < min_chars and 0 <= j + step < len(found) and abs(found[j + step][0] - found[j][0]) <= 2:
                j += step
                chars += len(found[j][1])
            if chars >= min_chars and j != i:
                out.add((min(i, j), max(i, j)))
    return out


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, h1, h2, n, chars, at): the places of each different line (n = 1) and smallest block of n lines of each document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest
        for pdf in batches:
            k1, k2, keys, sizes, chars, at = [], [], [], [], [], []
            for a, b, text in zip(pdf["k1"], pdf["k2"], pdf["text"]):
                found = [(i, line) for i, line in enumerate(text.split("\n")) if line and not line.isspace()]
                places: dict[str, list[int]] = {}
                for i, line in found:
                    places.setdefault(line, []).append(i)
                digest = {x: xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in places}
                keys += digest.values()
                sizes += [1] * len(places)
                chars += map(len, places)
                at += [np.array(x, np.int32) for x in places.values()]
                blocks: dict[bytes, list] = {}
                for i, j in blocks_of(found, min_chars):
                    part = found[i:j + 1]
                    gaps = bytes(q - p for (p, _), (q, _) in zip(part, part[1:]))
                    key = xxh3_128_digest(b"".join(digest[x] for _, x in part) + gaps)
                    blocks.setdefault(key, [len(part), sum(len(x) for _, x in part), set()])[2].update(p for p, _ in part)
                keys += blocks
                sizes += [x[0] for x in blocks.values()]
                chars += [x[1] for x in blocks.values()]
                at += [np.array(sorted(x[2]), np.int32) for x in blocks.values()]
                k1 += [a] * (len(places) + len(blocks))
                k2 += [b] * (len(places) + len(blocks))
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"k1": k1, "k2": k2, "h1": h[:, 0], "h2": h[:, 1], "n": sizes, "chars": chars, "at": pd.Series(at, dtype=object)})
    return _keyed(docs).mapInPandas(run, "k1 long, k2 long, h1 long, h2 long, n int, chars long, at array<int>")


def deletions(docs: DataFrame, rare: int | None = None, shared: int = SHARED, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, gone): the places of the lines to delete from each later document."""
    lines = line_table(docs, min_chars).dropDuplicates(["k1", "k2", "h1", "h2"])
    lines = saved(lines, few=True)
    owners = saved(lines.groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "at")).alias("o"), F.count(F.lit(1)).alias("df"))
                   .filter("df > 1").select("h1", "h2", F.col("o.k1").alias("o1"), F.col("o.k2").alias("o2"), F.col("o.at").alias("first"), "df"), few=True)
    pairs = (lines.join(owners, ["h1", "h2"]).filter("k1 > o1 OR (k1 = o1 AND k2 > o2)")
             .groupBy("k1", "k2", "o1", "o2").agg(F.collect_list(F.struct("n", "at", "first", "chars")).alias("common"), F.min("df").alias("df"),
                                                  F.sum(F.col("chars") * F.size("at")).alias("most"))
             .filter(F.col("most") >= min_chars))  # no block can be longer
    if rare is not None:
        pairs = pairs.filter((F.col("df") <= rare) | (F.size(F.filter("common", lambda x: x["n"] == 1)) >= shared)
                             | (F.array_max(F.col("common")["n"]) >= shared))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gone = [np.array(block_places(c, min_chars), np.int32) for c in pdf["common"]]
            yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "gone": pd.Series(gone, dtype=object, index=pdf.index)})
    return (pairs.select("k1", "k2", "common").mapInPandas(align, "k1 long, k2 long, gone array<int>").filter(F.size("gone") > 0)
            .groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))


def line_dedup(docs: DataFrame, rare: int | None = None, shared: int = SHARED, min_chars: int = MIN_CHARS, count: str | None = None) -> DataFrame:
    """``docs`` with the deleted lines gone from ``text``; ``count`` names a column for their number, in place of one of that name."""
    gone = saved(deletions(docs, rare, shared, min_chars), few=True).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("gone").alias("__gone"))
    keyed = docs.withColumns({"__d1": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__d2": F.xxhash64(text_of())})
    both = keyed.join(gone, (F.col("__d1") == F.col("__k1")) & (F.col("__d2") == F.col("__k2")), "left")
    parts = F.split(F.col("text"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c != count]
    if count:
        cols.append(F.coalesce(F.size("__gone"), F.lit(0)).alias(count))
    return both.select(*cols)
