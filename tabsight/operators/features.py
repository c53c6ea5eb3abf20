"""Feature engineering: string categories, counts, group sizes, encodings, binning.

All steps are column expressions (``withColumn``) except ``group_size`` (groupBy +
join-back, so a hot key is one aggregated row and AQE splits the join) and
``qcut`` (quantile edges from one aggregate, attached as a one-row broadcast).
``FeaturePlan`` folds a list of steps over a frame; ``QuantileBinner`` and
``GroupSizeEncoder`` are ``pyspark.ml`` estimators that learn the edges /
group sizes at ``fit`` and reuse them at ``transform``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.types import check_col


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ----------------------------------------------------------------------------- P6 / P7 / P11
def drop_if_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def drop_required(df: DataFrame, cols: list[str]) -> DataFrame:
    for c in cols:
        check_col(df, c)
    return df.drop(*cols)


def flag_below(df: DataFrame, col: str, threshold: float, out_col: str) -> DataFrame:
    """``out_col`` = 1 if col < threshold else 0 (NULL -> 0)."""
    return df.withColumn(out_col, F.coalesce((_c(col) < threshold).cast("int"), F.lit(0)))


# ----------------------------------------------------------------------------- X1
def regex_category(df: DataFrame, col: str, pattern: str, out_col: str, group: int = 1,
                   rename: dict[str, str] | None = None, rare: list[str] | None = None,
                   rare_label: str = "Rare") -> DataFrame:
    """Regex group as a category (no match -> NULL), then renames and a rare bucket."""
    v = F.nullif(F.regexp_extract(_c(col), pattern, group), F.lit(""))
    if rename:
        m = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
        v = F.coalesce(m[v], v)
    if rare:
        v = F.when(v.isin(list(rare)), F.lit(rare_label)).otherwise(v)
    return df.withColumn(out_col, v)


# ----------------------------------------------------------------------------- X2 / X3 / X8
def count_sum(df: DataFrame, cols: list[str], out_col: str, plus: int = 1) -> DataFrame:
    """Sum of count columns plus a constant (NULL propagates)."""
    total = _c(cols[0])
    for c in cols[1:]:
        total = total + _c(c)
    return df.withColumn(out_col, total + F.lit(plus))


def is_single(df: DataFrame, col: str, out_col: str) -> DataFrame:
    """1 where ``col`` == 1, else 0 (NULL -> 0)."""
    return df.withColumn(out_col, F.coalesce((_c(col) == 1).cast("int"), F.lit(0)))


def interaction(df: DataFrame, a: str, b: str, out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or f"{a}_{b}", _c(a) * _c(b))


# ----------------------------------------------------------------------------- X4
def group_sizes(df: DataFrame, col: str) -> DataFrame:
    """(key, size) for every non-null key: combined map-side, one row per key."""
    return (df.where(_c(col).isNotNull()).groupBy(_c(col).alias("__key"))
              .agg(F.count(F.lit(1)).alias("__size")))


def group_size(df: DataFrame, col: str, out_col: str | None = None,
               sizes: DataFrame | None = None) -> DataFrame:
    """Size of the row's own ``col`` group; NULL key -> NULL.

    ``sizes`` lets a fitted model reuse the sizes learned on another frame
    (unseen keys -> NULL).
    """
    out_col = out_col or f"{col}_group_size"
    s = sizes if sizes is not None else group_sizes(df, col)
    j = df.join(s, _c(col) == F.col("__key"), "left")
    return j.withColumn(out_col, F.col("__size")).drop("__key", "__size")


# ----------------------------------------------------------------------------- X5 / X6 / X7
def strip_digits_prefix(df: DataFrame, col: str, out_col: str, empty: str = "NONE") -> DataFrame:
    """'.' and '/' -> space, digits removed, trimmed; empty or NULL -> ``empty``."""
    v = F.regexp_replace(F.regexp_replace(_c(col), r"[./]", " "), r"[0-9]+", "")
    return df.withColumn(out_col, F.coalesce(F.nullif(F.trim(v), F.lit("")), F.lit(empty)))


def first_char(df: DataFrame, col: str, out_col: str, unknown: str = "Unknown") -> DataFrame:
    """First character; NULL or empty -> ``unknown``."""
    return df.withColumn(out_col, F.coalesce(F.nullif(F.substring(_c(col), 1, 1), F.lit("")),
                                             F.lit(unknown)))


def map_encode(df: DataFrame, col: str, mapping: dict, out_col: str | None = None,
               strict: bool = True) -> DataFrame:
    """Map values through ``mapping``; strict: unmapped or NULL values fail the job."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = m[_c(col)]
    if strict:
        v = F.when(v.isNotNull(), v).otherwise(
            F.raise_error(F.concat(F.lit(f"map_encode: unmapped value in '{col}': "),
                                   F.coalesce(_c(col).cast("string"), F.lit("NULL")))))
    return df.withColumn(out_col or col, v)


# ----------------------------------------------------------------------------- X9
def log1p(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """ln(1 + x); ``out_col=None`` replaces the column in place."""
    return df.withColumn(out_col or col, F.log1p(_c(col).cast("double")))


# ----------------------------------------------------------------------------- X10 / X11
def cut_expr(x: Column, edges: list[float]) -> Column:
    """Right-closed bins (e_i, e_{i+1}] labelled 0..k-1; outside -> NULL."""
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(float(edges[i]))) & (x <= F.lit(float(edges[i + 1])))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def cut(df: DataFrame, col: str, edges: list[float], out_col: str | None = None) -> DataFrame:
    if sorted(edges) != list(edges) or len(set(edges)) != len(edges):
        raise ValueError("cut: edges must increase strictly")
    return df.withColumn(out_col or f"{col}_bin", cut_expr(_c(col).cast("double"), edges))


def quantile_edges(df: DataFrame, col: str, q: int, method: str = "exact") -> DataFrame:
    """One row ``__edges``: the q+1 linear-interpolated quantile edges (exact)."""
    from tabsight.operators.quantiles import quantile_arrays
    probs = [round(i / q, 10) for i in range(q + 1)]
    return quantile_arrays(df, [col], probs, method).select(F.col("q").alias("__edges"))


def qbin_expr(x: Column, edges: Column, q: int) -> Column:
    """Bin of x under edges (lowest edge included): count of inner edges below x.

    Duplicate edges fail the job, as quantile binning with equal edges is undefined.
    """
    inner = F.slice(edges, 2, q - 1)
    n_below = F.size(F.filter(inner, lambda e: e < x))
    dup = F.size(F.array_distinct(edges)) < F.size(edges)
    return (F.when(dup, F.raise_error(F.lit("qcut: bin edges must be unique")))
             .when(x.isNotNull(), n_below))


def qcut(df: DataFrame, col: str, q: int = 4, out_col: str | None = None,
         edges: DataFrame | None = None) -> DataFrame:
    """Quantile bins 0..q-1 from the edges of this frame (or of ``edges``, if given)."""
    e = edges if edges is not None else quantile_edges(df, col, q)
    j = df.crossJoin(F.broadcast(e))  # one-row side
    return (j.withColumn(out_col or f"{col}_qbin", qbin_expr(_c(col).cast("double"), F.col("__edges"), q))
             .drop("__edges"))


# ----------------------------------------------------------------------------- X12
@dataclass
class FeaturePlan:
    """An ordered list of frame -> frame steps applied by folding ``withColumn``s."""

    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def add(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> "FeaturePlan":
        self.steps.append((name, fn))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, fn in self.steps:
            df = fn(df)
        return df


# ----------------------------------------------------------------------------- X13
from pyspark import keyword_only  # noqa: E402
from pyspark.ml import Estimator, Model  # noqa: E402
from pyspark.ml.param import Param, Params, TypeConverters  # noqa: E402
from pyspark.ml.param.shared import HasInputCol, HasOutputCol  # noqa: E402
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,  # noqa: E402
                             MLReadable, MLReader, MLWritable, MLWriter)


class QuantileBinner(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Quantile bins learned at ``fit`` (exact edges) and reused at ``transform``.

    ``refit=True`` recomputes the edges on every transformed frame instead (the
    per-frame behaviour).
    """

    numBins = Param(Params._dummy(), "numBins", "number of quantile bins", TypeConverters.toInt)
    refit = Param(Params._dummy(), "refit", "recompute edges per frame", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, numBins=4, refit=False):
        super().__init__()
        self._setDefault(numBins=4, refit=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        q = self.getOrDefault(self.numBins)
        edges = list(quantile_edges(df, self.getInputCol(), q).first()[0])  # q+1 numbers
        return QuantileBinnerModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                   numBins=q, edges=edges, refit=self.getOrDefault(self.refit))


class QuantileBinnerModel(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    numBins = QuantileBinner.numBins
    refit = QuantileBinner.refit
    edges = Param(Params._dummy(), "edges", "learned bin edges", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, numBins=4, edges=None, refit=False):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        q = self.getOrDefault(self.numBins)
        if self.getOrDefault(self.refit):
            return qcut(df, self.getInputCol(), q, self.getOutputCol())
        e = F.array(*[F.lit(float(v)) for v in self.getOrDefault(self.edges)])
        x = _c(self.getInputCol()).cast("double")
        # outside the learned range: below -> bin 0, above -> last bin (edges clip)
        return df.withColumn(self.getOutputCol(), qbin_expr(x, e, q))


class GroupSizeEncoder(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Group sizes learned at ``fit`` and joined at ``transform`` (NULL is a group; unseen groups get 1)."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        sizes = df.groupBy(_c(self.getInputCol()).alias("__group")).agg(F.count(F.lit(1)).alias("__size"))
        model = GroupSizeModel(sizes)
        model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol())
        return model


class _GroupSizeWriter(MLWriter):
    def __init__(self, model: "GroupSizeModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.sizes.write.parquet(f"{path}/sizes")


class _GroupSizeReader(MLReader):
    def load(self, path: str) -> "GroupSizeModel":
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = GroupSizeModel(self.sparkSession.read.parquet(f"{path}/sizes"))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


class GroupSizeModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """The table of group sizes; a hot group is one row of it, and AQE splits the other side of the join."""

    def __init__(self, sizes: DataFrame):
        super().__init__()
        self.sizes = sizes

    def write(self) -> MLWriter:
        return _GroupSizeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _GroupSizeReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.sizes, _c(self.getInputCol()).eqNullSafe(F.col("__group")), "left")
        return joined.withColumn(self.getOutputCol(), F.coalesce("__size", F.lit(1)).cast("long")).drop("__group", "__size")
