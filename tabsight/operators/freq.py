"""Value-frequency table: the shared base of the profiling operators.

``value_frequencies(df)`` unpivots the columns to ``(column, key)`` and counts each
pair, combined map-side, so a hot value costs one row per map partition no
matter how many rows carry it.  A value of up to ``SHORT`` bytes is its own key; a longer
one is keyed by its first bytes and its 128-bit digest, so no text is shuffled.  Missing
counts, distinct counts, top values, quasi-constant shares, value counts and categorical
histograms are then small aggregates over this table, instead of one ``count(DISTINCT)``
per column (Spark expands the input once per distinct aggregate).

``top_values`` finds the most frequent values; only the winners' texts are read, by
a second scan that keeps the rows with their keys.  ``frequency_table`` saves the table
for several operators, which take it as ``freq``.

``column_stats(df)`` reduces it to one row per column (bounded by the column
count) with the schema facts attached; the logical type is a column expression
over that row, so the whole chain stays a lazy plan.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.types import logical_type_expr, storage_kind
from tabsight.session import ensure_checkpoint_dir

FREQ_SCHEMA = "column_name string, key binary, long boolean, n bigint"
TOP_SCHEMA = "column_name string, rank int, value string, n bigint"
#: Bytes of a value that is its own key, and the bytes of a longer one that its key starts with.
SHORT, HEAD = 32, 16
#: Keys of long values that are sent to every task; more of them are joined.
FEW_KEYS = 10_000


def _value_as_string(name: str, dt: T.DataType):
    c = F.col(f"`{name}`")
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dt, T.BinaryType):
        return F.base64(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0).cast(dt)  # -0.0 is 0.0
    return c.cast("string")


def comparable(df: DataFrame, name: str):
    """A column as something with an order: itself, or its text for nested types."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        return _value_as_string(name, dt)
    return F.col(f"`{name}`")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_missing, n_rows) of every column: one aggregate row, no values shuffled."""
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit(c).alias("column_name"), (n - F.count(F.col(f"`{c}`"))).alias("n_missing"), n.alias("n_rows")) for c in df.columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")) if rows else df.sparkSession.createDataFrame(
        [], "column_name string, n_missing bigint, n_rows bigint")


def _keyed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, key, long) of every cell."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        v = _value_as_string(c, fields[c])
        long = F.coalesce(F.octet_length(v) > SHORT, F.lit(False))
        digest = F.concat(F.substring(v.cast("binary"), 1, HEAD), F.unhex(F.md5(v.cast("binary"))))
        structs.append(F.struct(F.lit(c).alias("column_name"), v.alias("value"), F.when(long, digest).otherwise(v.cast("binary")).alias("key"),
                                long.alias("long")))
    return df.select(F.inline(F.array(*structs)))


def _counted(df: DataFrame, cols: list[str], values: list, text) -> DataFrame:
    """Counts of the ``values`` of ``cols``, which share a type, as keys; ``text(column, value)`` is a value's text."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("c"), v.alias("v")) for k, v in enumerate(values)])))
    counts = cells.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    as_text: dict[str, list] = {}
    for k, c in enumerate(cols):
        as_text.setdefault(df.schema[c].dataType.simpleString(), []).append((k, c))
    key = None
    for own in as_text.values():
        on, t = F.col("c").isin([k for k, _ in own]), text(own[0][1], F.col("v"))
        key = F.when(on, t) if key is None else key.when(on, t)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1)
    return counts.select(name.alias("column_name"), key.cast("binary").alias("key"), F.lit(False).alias("long"), "n")


def value_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, key, long, n)`` for every value of every column; NULL is a value.

    Columns are counted in three groups - whole numbers (with dates, times and truth values), doubles, and
    everything else - each from a scan of its own columns: counting numbers as numbers is several times
    faster than counting their texts, which only the distinct values need.
    """
    cols = columns if columns is not None else df.columns
    if not cols:
        return df.sparkSession.createDataFrame([], FREQ_SCHEMA)
    fields = {c: df.schema[c].dataType for c in cols}
    whole, real, other = [], [], []
    for c, dt in fields.items():
        is_whole = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType))
        (whole if is_whole else real if isinstance(dt, (T.FloatType, T.DoubleType)) else other).append(c)
    parts = []
    if whole:
        def number(c: str):
            x = F.col(f"`{c}`")
            return F.unix_date(x).cast("long") if isinstance(fields[c], T.DateType) else F.unix_micros(x) if isinstance(fields[c], T.TimestampType) else x.cast("long")

        def whole_text(c: str, v):
            v = (F.date_from_unix_date(v.cast("int")) if isinstance(fields[c], T.DateType) else F.timestamp_micros(v)
                 if isinstance(fields[c], T.TimestampType) else v.cast("boolean") if isinstance(fields[c], T.BooleanType) else v)
            return v.cast("string")
        parts.append(_counted(df, whole, [number(c) for c in whole], whole_text))
    if real:
        # -0.0 is 0.0
        parts.append(_counted(df, real, [F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in real], lambda c, v: v.cast(fields[c]).cast("string")))
    if other:
        parts.append(_keyed(df, other).groupBy("column_name", "key", "long").agg(F.count(F.lit(1)).alias("n")))
    return functools.reduce(DataFrame.unionByName, parts)


def frequency_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``value_frequencies`` saved in the shared checkpoint folder, for operators that read it more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    return value_frequencies(df, columns).checkpoint(eager=True)


def frequency_stats(freq: DataFrame) -> DataFrame:
    """Per column: n_rows, n_missing, n_unique and the count of the most frequent value (NULL counts)."""
    missing = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).cast("long")
    return freq.groupBy("column_name").agg(F.sum("n").alias("n_rows"), missing.alias("n_missing"), F.count("key").alias("n_unique"),
                                           F.max("n").alias("most"))


def top_values(df: DataFrame, freq: DataFrame, k: int = 1, columns: list[str] | None = None) -> DataFrame:
    """(column_name, rank, value, n): the ``k`` most frequent non-null values of each column, lowest first on ties.

    ``freq`` should be a saved table of ``df``.  Ties are told apart by the first bytes, which keys carry; rows that
    these leave tied with the last place are kept until their texts are known.
    """
    some = freq.where(F.col("key").isNotNull())
    if columns is not None:
        some = some.where(F.col("column_name").isin(columns))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.substring("key", 1, HEAD))
    ensure_checkpoint_dir(df.sparkSession)
    best = some.withColumn("place", F.rank().over(order)).where(F.col("place") <= k).drop("place").checkpoint(eager=True)
    long = best.where("long")
    per_column = {r["column_name"]: r["count"] for r in long.groupBy("column_name").count().collect()}
    named = best.where("NOT long").withColumn("value", F.col("key").cast("string"))
    if per_column:
        keys = long.select("column_name", "key", "n")
        if sum(per_column.values()) <= FEW_KEYS:
            keys = F.broadcast(keys)
        texts = _keyed(df, list(per_column)).where("long").join(keys, ["column_name", "key"])
        named = named.unionByName(texts.groupBy("column_name", "key", "long", "n").agg(F.first("value").alias("value")))
    final = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return (named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("column_name", "rank", "value", "n"))


def schema_table(spark: SparkSession, df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column: position, name, Spark type string, storage kind, target flag."""
    rows = [(i, f.name, f.dataType.simpleString(), storage_kind(f.dataType), f.name == target)
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "pos int, column_name string, dtype string, kind string, is_target boolean")


def column_stats(df: DataFrame, target: str | None = None,
                 freq: DataFrame | None = None) -> DataFrame:
    """Per-column n_rows, n_missing, n_unique, binary test and logical type."""
    spark = df.sparkSession
    freq = freq if freq is not None else value_frequencies(df)
    binary = F.when(~F.col("long"), F.col("key").cast("string")).try_cast("double").isin(0.0, 1.0)
    agg = (freq.groupBy("column_name")
               .agg(F.sum("n").alias("n_rows"),
                    F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0))
                     .cast("long").alias("n_missing"),
                    F.count("key").alias("n_unique"),
                    F.bool_and(F.when(F.col("key").isNotNull(), F.coalesce(binary, F.lit(False)))).alias("all_binary")))
    # Every column has the same row count; take it once so empty tables give 0.
    # Derived from the same aggregate, so the input is scanned once.
    total = agg.agg(F.coalesce(F.max("n_rows"), F.lit(0)).cast("long").alias("total_rows"))
    st = (schema_table(spark, df, target)
          .join(agg, "column_name", "left")
          .crossJoin(total)  # one-row side: a broadcast of a single row
          .select("pos", "column_name", "dtype", "kind", "is_target",
                  F.col("total_rows").alias("n_rows"),
                  F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"),
                  F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
                  F.col("all_binary")))
    return st.withColumn(
        "logical_type",
        logical_type_expr(F.col("kind"), F.col("n_rows"), F.col("n_unique"), F.col("all_binary")))
