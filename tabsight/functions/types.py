"""Column typing from the schema (no job) and logical types (one small agg).

Logical type rules (the profiler's contract):

* ``boolean``  - BooleanType
* ``datetime`` - DateType / TimestampType / TimestampNTZType
* ``categorical`` - a numeric column whose non-null values are all 0 or 1
  (an all-null numeric column lands here as well)
* ``numeric``  - every other numeric column
* ``high_cardinality`` - a string column with more than ``max(20, int(0.05*n))``
  distinct non-null values
* ``categorical`` - every other string column
* ``unknown``  - arrays, maps, structs, binary, intervals, variants
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the profiler contract.
HIGH_CARDINALITY_SHARE = 0.05
HIGH_CARDINALITY_FLOOR = 20
NUMERIC_AS_CATEGORICAL_MAX_UNIQUE = 10

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def storage_kind(dt: T.DataType) -> str:
    """Coarse storage class of a Spark type: boolean/datetime/numeric/text/other."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "other"


def _fields(df: DataFrame):
    return [(f.name, f.dataType) for f in df.schema.fields]


def numeric_cols(df: DataFrame, target: str | None = None) -> list[str]:
    """Number-typed columns (booleans excluded) minus the target."""
    return [n for n, t in _fields(df) if storage_kind(t) == "numeric" and n != target]


def cat_cols(df: DataFrame, target: str | None = None) -> list[str]:
    """Text columns minus the target."""
    return [n for n, t in _fields(df) if storage_kind(t) == "text" and n != target]


def datetime_cols(df: DataFrame) -> list[str]:
    """Date/time columns (target not excluded)."""
    return [n for n, t in _fields(df) if storage_kind(t) == "datetime"]


def bool_cols(df: DataFrame) -> list[str]:
    """Boolean columns (target not excluded)."""
    return [n for n, t in _fields(df) if storage_kind(t) == "boolean"]


def feature_cols(df: DataFrame, target: str | None = None) -> list[str]:
    return [c for c in df.columns if c != target]


def is_corr_compatible(df: DataFrame, col: str) -> bool:
    """Boolean or numeric storage (booleans are read as 0/1)."""
    check_col(df, col)
    return storage_kind(df.schema[col].dataType) in ("boolean", "numeric")


def check_col(df: DataFrame, col: str) -> None:
    if col not in df.columns:
        raise ValueError(f"no column {col!r} among {df.columns}")


def normalize_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float/double columns (one notion of 'missing')."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)


def logical_type_expr(kind: Column, n_rows: Column, n_unique: Column,
                      all_binary: Column) -> Column:
    """Logical type as a column expression over per-column statistics."""
    threshold = F.greatest(F.lit(HIGH_CARDINALITY_FLOOR),
                           F.floor(n_rows * F.lit(HIGH_CARDINALITY_SHARE)).cast("long"))
    return (F.when(kind == "boolean", "boolean")
            .when(kind == "datetime", "datetime")
            .when((kind == "numeric") & F.coalesce(all_binary, F.lit(True)), "categorical")
            .when(kind == "numeric", "numeric")
            .when((kind == "text") & (n_unique > threshold), "high_cardinality")
            .when(kind == "text", "categorical")
            .otherwise("unknown"))


def simplify_type(t: str) -> str:
    """Pair typing: numeric -> numeric; categorical/boolean/high_cardinality -> categorical."""
    if t == "numeric":
        return "numeric"
    if t in ("categorical", "boolean", "high_cardinality"):
        return "categorical"
    return t


def plot_roles(logical_type: str, is_numeric_storage: bool, n_unique: int) -> set[str]:
    """Role set used to pick the bivariate view of a column."""
    roles: set[str] = set()
    if logical_type == "numeric":
        roles.add("numeric")
    if logical_type in ("categorical", "boolean", "high_cardinality"):
        roles.add("categorical")
    if is_numeric_storage and n_unique <= NUMERIC_AS_CATEGORICAL_MAX_UNIQUE:
        roles.add("categorical")
    return roles


def simplify_expr(logical_type: Column) -> Column:
    """Pair typing as a column expression (see ``simplify_type``)."""
    return (F.when(logical_type == "numeric", "numeric")
             .when(logical_type.isin("categorical", "boolean", "high_cardinality"), "categorical")
             .otherwise(logical_type))


def roles_expr(logical_type: Column, kind: Column, n_unique: Column) -> Column:
    """Sorted role set as array<string> (see ``plot_roles``)."""
    cat = (logical_type.isin("categorical", "boolean", "high_cardinality")
           | ((kind == "numeric") & (n_unique <= NUMERIC_AS_CATEGORICAL_MAX_UNIQUE)))
    return F.array_sort(F.array_compact(F.array(
        F.when(logical_type == "numeric", F.lit("numeric")), F.when(cat, F.lit("categorical")))))
