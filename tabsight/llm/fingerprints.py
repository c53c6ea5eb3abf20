"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A document's paragraphs (lines, long ones in pieces of ``PIECE`` code points) are
hashed to 64-bit digests. A sketch has three tables of cells; each digest is added
to one cell of each table: a count, the xor of digests, the xor of their checks.
Sketches of equal size subtract cell by cell, so what two versions share cancels.
A cell with count 1 or -1 and a fitting check holds one differing digest; peeling
takes it out of its other cells, and so on. If cells are left, the attempt failed
and is repeated with tables twice as large.

A pair of documents is compared in buckets of digests (by hash) that hold about a
dozen differences, each with a sketch of its own, so long documents stay bounded
arrays. Likeness is the Jaccard similarity that the recovered digests imply.

The fingerprint is the base sketch (``3 * BASE`` cells) in hexadecimal.

Defined results: null texts are empty; a null doc_id counts as the smallest; rows
that repeat doc_id and text are one document and come out alike; rows that share
only the doc_id are ordered by text hash; a single document is its own next one;
two documents without a paragraph are alike (1.0); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabsight.llm.common import saved, text_of, with_global_index

PIECE, BASE = 200, 4
#: Cells of a bucket's table, and the digests that a bucket takes on average, by pair.
TABLE, LOAD = 8, {"edited": 20, "next": 12}
ROUNDS = 10
NO_ID = -(1 << 63)
_CELL = "struct<cnt: bigint, key: bigint, chk: bigint>"
_ITEM = "struct<cnt: bigint, key: bigint, chk: bigint, s0: bigint, s1: bigint, s2: bigint>"


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    found = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PIECE), 0)
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _slots(key: str, table: int) -> str:
    """A digest's cell in each of the three tables; the hash depends on the size, so a retry deals anew."""
    return ", ".join(f"{j * table} + pmod(xxhash64({key}, {table}, {j}), {table}) AS s{j}" for j in range(3))


def _cells(digests: str, table: int) -> str:
    """SQL for the sketch of an array of digests."""
    items = f"transform({digests}, d -> struct(1L AS cnt, d AS key, xxhash64(d, -1) AS chk, {_slots('d', table)}))"
    add = "if(v.s0 = i OR v.s1 = i OR v.s2 = i, struct(a.cnt + 1L AS cnt, a.key ^ v.key AS key, a.chk ^ v.chk AS chk), a)"
    return f"transform(sequence(0L, {3 * table - 1}L), i -> aggregate({items}, struct(0L AS cnt, 0L AS key, 0L AS chk), (a, v) -> {add}))"


def sketch(digests: Column | str, table: int = BASE) -> str:
    return _cells(str(digests), table)


def _peeled(cells: str) -> str:
    """SQL for the state after peeling: cells left, digests found. ``pure`` alternates with its removal."""
    pure = ("array_distinct(transform(filter(st.cells, c -> abs(c.cnt) = 1 AND c.chk = xxhash64(c.key, -1)), "
            "c -> struct(c.cnt AS cnt, c.key AS key, c.chk AS chk, {slots})))")
    take = "if(v.s0 = i OR v.s1 = i OR v.s2 = i, struct(a.cnt - v.cnt AS cnt, a.key ^ v.key AS key, a.chk ^ v.chk AS chk), a)"
    rest = f"transform(st.cells, (c, i) -> aggregate(st.pure, c, (a, v) -> {take}))"
    zero = f"struct({cells} AS cells, CAST(array() AS array<{_ITEM}>) AS pure, CAST(array() AS array<{_ITEM}>) AS found)"
    step = (f"if(r % 2 = 1, struct(st.cells AS cells, {pure} AS pure, st.found AS found), "
            f"if(size(st.pure) = 0, st, struct({rest} AS cells, st.pure AS pure, concat(st.found, st.pure) AS found)))")
    return f"aggregate(sequence(1, {2 * ROUNDS}), {zero}, (st, r) -> {step})"


def peel(mine: str, other: str, table: int) -> str:
    """SQL for the peeled difference of two arrays' sketches: subtract cells, then peel."""
    minus = (f"zip_with({_cells(mine, table)}, {_cells(other, table)}, (p, q) -> "
             "struct(p.cnt - q.cnt AS cnt, p.key ^ q.key AS key, p.chk ^ q.chk AS chk))")
    return _peeled(minus).replace("{slots}", _slots("c.key", table))


def recovered(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pair, n): how many digests of ``mine`` and ``other`` differ, by peeling; ``pairs`` has the arrays."""
    load = F.coalesce(*[F.when(F.col("pair") == k, F.lit(v)) for k, v in LOAD.items()])
    total = F.size("mine") + F.size("other")
    sized = pairs.filter(total > 0).withColumn("b", F.greatest(F.lit(1), F.ceil(total / load).cast("int")))
    # buckets in two steps, so that a long document costs its length times the root of its buckets
    sized = sized.withColumn("wide", F.ceil(F.sqrt("b")).cast("int"))
    in_bucket = "pmod(xxhash64(d, -2), b)"
    outer = sized.withColumn("o", F.explode(F.expr("sequence(0, CAST((b - 1) / wide AS int))")))
    outer = outer.withColumns({c: F.expr(f"filter({c}, d -> CAST({in_bucket} AS int) div wide = o)") for c in ("mine", "other")})
    inner = outer.withColumn("k", F.explode(F.expr("sequence(o * wide, least(b, (o + 1) * wide) - 1)")))
    inner = inner.withColumns({c: F.expr(f"filter({c}, d -> {in_bucket} = k)") for c in ("mine", "other")})
    todo = inner.filter((F.size("mine") > 0) | (F.size("other") > 0)).select(*keys, "pair", "mine", "other")
    table, done = TABLE, None
    while True:
        tried = todo.withColumn("st", F.expr(peel("mine", "other", table)))
        left = F.exists("st.cells", lambda c: (c["cnt"] != 0) | (c["key"] != 0) | (c["chk"] != 0))
        tried = saved(tried.select(*keys, "pair", left.alias("failed"), F.size("st.found").alias("n"), F.when(left, F.col("mine")).alias("mine"),
                                   F.when(left, F.col("other")).alias("other")), few=True)
        fine = tried.filter("NOT failed").select(*keys, "pair", "n")
        done = fine if done is None else done.unionByName(fine)
        todo = tried.filter("failed").select(*keys, "pair", "mine", "other")
        if todo.isEmpty():
            return done.groupBy(*keys, "pair").agg(F.sum("n").alias("n"))
        table *= 2


def versions(docs: DataFrame) -> DataFrame:
    """(k1, k2, n_chars, edited_sha256, a, e, x): digests of each document, its edited text and the next document."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text_of()).alias("k2"), text_of().alias("text"))
    placed = with_global_index(keyed.select("k1", "k2", F.char_length("text").alias("n")).distinct(), ["k1", "k2"])
    count = max(1, placed.count())
    after = placed.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("idx").alias("next"))
    links = saved(placed.withColumn("next", (F.col("idx") + 1) % count).join(after, "next").select("k1", "k2", "n", "n1", "n2"), few=True)
    one = keyed.withColumn("__row", F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))).filter("__row = 1").drop("__row")
    # the next document sends its first code points and its digests to the one before it
    given = links.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("n"))
    sent = one.join(given, ["k1", "k2"]).select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.expr("substring(text, 1, n div 4)").alias("head"),
                                                paragraphs(F.col("text")).alias("x"))
    edited = one.join(sent, ["k1", "k2"]).withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "edited", F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS int)), head)"))
    return edited.select("k1", "k2", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("a"),
                         paragraphs(F.col("edited")).alias("e"), "x")


def _hex(cells: str) -> Column:
    cell = "concat(lpad(hex(c.cnt), 4, '0'), lpad(hex(c.key), 16, '0'), lpad(hex(c.chk), 16, '0'))"
    return F.expr(f"lower(array_join(transform({cells}, c -> {cell}), ''))")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document."""
    rows = saved(versions(docs))
    keys = ["k1", "k2"]
    pairs = rows.select(*keys, F.explode(F.array(F.struct(F.lit("edited").alias("pair"), F.col("a").alias("mine"), F.col("e").alias("other")),
                                                 F.struct(F.lit("next").alias("pair"), F.col("a").alias("mine"), F.col("x").alias("other")))).alias("p"))
    differ = recovered(pairs.select(*keys, "p.*"), keys)
    wide = saved(differ.groupBy(*keys).agg(F.sum(F.when(F.col("pair") == "edited", F.col("n"))).alias("d_edited"),
                                           F.sum(F.when(F.col("pair") == "next", F.col("n"))).alias("d_next")), few=True)

    def near(other: str, d: str) -> Column:
        total, n = F.size("a") + F.size(other), F.coalesce(F.col(d), F.lit(0))
        return F.when(total == 0, F.lit(1.0)).otherwise((total - n) / (total + n))
    result = rows.join(wide, keys, "left").select(
        *keys, "n_chars", "edited_sha256", _hex(sketch("a")).alias("fingerprint"), _hex(sketch("e")).alias("edited_fingerprint"),
        near("e", "d_edited").alias("near_edited"), near("x", "d_next").alias("near_next"))
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text_of()).alias("k2"))
    return own.join(result, keys).drop(*keys)
