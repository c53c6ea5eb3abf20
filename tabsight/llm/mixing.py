"""Mixing sources to target weights, in DataFrame operations only.

Every source gets a target number of words and a rate = target / size. A document
is emitted floor(rate) times, plus once more when a hash of its id, read as a
number in [0, 1), lies below the fraction.

Sources stand in code-point order, null last, with weights that repeat over them;
the targets share all words by weight, and a target above ``cap`` times its
source is cut there, the excess reshared by weight until none is above.

Defined results: null texts have size 0; a null source is a source of its own; a
source without words has rate 0; repeated rows with one doc_id are taken alike; a
null doc_id hashes as the word null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import WORD, saved, text_of, with_global_index

WEIGHTS = (5, 2, 1)
#: Sources up to this number are sent to every executor (a few MB); more are joined by a shuffle.
FEW_SOURCES = 50_000
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = totals.withColumn("__null", F.col("source").isNull().cast("int"))
    placed = with_global_index(order, ["__null", "source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    table = saved(placed.select("source", "source_size", weight.cast("long").alias("weight")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # `level`: words for a unit of weight; sources above their cap leave the sharing, which raises it for the rest
    level, capped = 0.0, -1
    while True:
        full = F.col("source_size") * cap < F.col("weight") * level
        r = table.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("held"), F.count(F.when(full, 1)).alias("n"),
                      F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["n"] == capped or not r["open"]:
            break
        capped, level = r["n"], (total - (r["held"] or 0)) / r["open"]
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * cap).cast("double"))
    return table.withColumn("target", target)


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of seed and id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _rated(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, ...) with __source_size, __target, __rate and __copies."""
    t = saved(source_targets(sized, weights, cap).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    if t.count() <= FEW_SOURCES:
        t = F.broadcast(t)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    more = (uniform(F.col("doc_id"), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return (rows.join(t, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__rate", rate)
            .withColumn("__copies", F.floor("__rate").cast("long") + more))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken) for every document."""
    sized = saved(docs.select("doc_id", "source", n_words(text_of()).alias("size")))
    return _rated(sized, sized, weights, cap, seed).select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__rate").alias("rate"),
        F.col("__copies").alias("copies"), (F.col("size") * F.col("__copies")).alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    sized = docs.select("source", n_words(text_of()).alias("size"))
    return (_rated(docs, sized, weights, cap, seed)
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(*docs.columns))
