"""Preparation stages as ``pyspark.ml`` estimators (fit learns, transform reuses).

* ``ExactImputer`` - median (exact ``percentile`` 0.5, or ``percentile_approx`` with
  ``approx=True`` for very wide/high-cardinality inputs) or most frequent value
  (``mode`` with the lowest value on ties);
* ``PopulationScaler`` - (x - mean) / population std (``ml.StandardScaler`` uses
  the sample std);
* ``CategoryIndexer`` - category index in value order, learned at fit as a table
  (column, value, position) that is saved with the model and joined; unknown
  values map to -1 (ordinal) - ``one_hot`` then gives a zero vector for them;
* ``build_preprocessor`` - the numeric + categorical pipeline chosen from the
  schema, ending in a ``features`` vector.

One learned value per column is kept as JSON in a string Param and saved with the
standard ``DefaultParamsWritable`` format; dictionaries are Parquet tables beside it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.types import storage_kind
from tabsight.session import ensure_checkpoint_dir


def _c(name: str):
    return F.col(f"`{name}`")


class _HasState(Params):
    state = Param(Params._dummy(), "state", "learned values as JSON", TypeConverters.toString)

    def _get_state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


# ----------------------------------------------------------------------------- M1 / M2
class ExactImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    strategy = Param(Params._dummy(), "strategy", "median | most_frequent", TypeConverters.toString)
    approx = Param(Params._dummy(), "approx", "approximate median", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, strategy="median", approx=False):
        super().__init__()
        self._setDefault(strategy="median", approx=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        strat = self.getOrDefault(self.strategy)
        if strat == "median":
            from tabsight.operators.quantiles import quantile_arrays
            method = "approx" if self.getOrDefault(self.approx) else "exact"
            med = {r.column_name: r.q[0] for r in quantile_arrays(df, cols, [0.5], method).collect()}
            values = {c: med.get(c) for c in cols}  # one value per column
            outs = self.getOutputCols() if self.isSet(self.outputCols) else cols
            return ExactImputerModel(inputCols=cols, outputCols=outs, state=json.dumps(values))
        elif strat == "most_frequent":
            values = most_frequent_values(df, cols)
            outs = self.getOutputCols() if self.isSet(self.outputCols) else cols
            return ExactImputerModel(inputCols=cols, outputCols=outs, state=json.dumps(values))
        raise ValueError("strategy must be 'median' or 'most_frequent'")


def most_frequent_values(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column, lowest value on ties.

    Value counts are one shuffle combined map-side (a hot value is one row per
    partition); the winner per column is a ``min_by`` over (-count, value), with
    numbers compared as numbers.  Returns one Python value per column.
    """
    kinds = {f.name: storage_kind(f.dataType) for f in df.schema.fields}
    structs = [F.struct(F.lit(c).alias("column_name"),
                        _c(c).cast("string").alias("sv"),
                        (_c(c).cast("double") if kinds[c] in ("numeric", "boolean") else F.lit(None).cast("double"))
                        .alias("dv"))
               for c in cols]
    counts = (df.select(F.inline(F.array(*structs))).where(F.col("sv").isNotNull())
                .groupBy("column_name", "sv", "dv").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("column_name").agg(
        F.min_by("sv", F.struct((-F.col("n")).alias("negn"), F.col("dv"), F.col("sv"))).alias("sv"))
    found = {r.column_name: r.sv for r in best.collect()}  # one row per column
    return {c: typed_value(found.get(c), df.schema[c].dataType) for c in cols}


def typed_value(text: str | None, dt):
    """A value's text as the Python value that a literal of the column takes."""
    if text is None:
        return None
    kind = storage_kind(dt)
    if kind == "numeric":
        return int(text) if dt.typeName() in ("integer", "long", "short", "byte") else float(text)
    return text == "true" if kind == "boolean" else text


class ExactImputerModel(Model, HasInputCols, HasOutputCols, _HasState,
                        DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        vals = self._get_state()
        out = {}
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            v = vals[c]
            # a fractional median widens an integer column to double
            out[o] = _c(c) if v is None else F.coalesce(_c(c), F.lit(v))
        return df.withColumns(out)


# ----------------------------------------------------------------------------- M3
class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        row = df.agg(*[F.struct(F.avg(_c(c).cast("double")).alias("m"),
                                F.stddev_pop(_c(c).cast("double")).alias("s")).alias(c)
                       for c in cols]).first()
        st = {c: [row[c]["m"], row[c]["s"]] for c in cols}
        outs = self.getOutputCols() if self.isSet(self.outputCols) else cols
        return PopulationScalerModel(inputCols=cols, outputCols=outs, state=json.dumps(st))


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, _HasState,
                            DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._get_state()
        out = {}
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            m, s = st[c]
            x = _c(c).cast("double")
            # zero variance: centre only (scale 1)
            out[o] = (x - F.lit(m)) / F.lit(s if s not in (None, 0.0) else 1.0)
        return df.withColumns(out)


# ----------------------------------------------------------------------------- M4 / M5
#: Categories of one column that are sent to every task; a longer dictionary is joined by a shuffle.
FEW_CATEGORIES = 50_000


def category_table(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[int]]:
    """(col int, value string, position long): the distinct non-null values of each column in order, and how many each has."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("col"), _c(c).cast("string").alias("value")) for k, c in enumerate(cols)])))
    return numbered_categories(cells.where(F.col("value").isNotNull()).distinct(), len(cols))


def numbered_categories(distinct: DataFrame, cols: int) -> tuple[DataFrame, list[int]]:
    """``distinct`` (col, value) with the position of each value in its column, saved, and the size of each column.

    The values are range partitioned by (column, value) and saved; a partition
    numbers its own and adds the rows of earlier partitions, of which the driver learns one
    number per partition and column.
    """
    spark = distinct.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = distinct.repartitionByRange(parts, "col", "value").withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    sizes, before = [0] * cols, {}
    for r in ranged.groupBy("part", "col").count().orderBy("part").collect():
        before.setdefault(r["part"], {})[r["col"]] = sizes[r["col"]]
        sizes[r["col"]] += r["count"]

    def number(batches):
        for rows in whole_partition(batches):
            rows = rows.sort_values(["col", "value"], key=lambda c: c.map(str.encode) if c.name == "value" else c, kind="stable")
            start = rows["col"].map(before[int(rows["part"].iat[0])])
            yield rows[["col", "value"]].assign(position=start + rows.groupby("col").cumcount())

    return ranged.mapInPandas(number, "col int, value string, position long").checkpoint(eager=True), sizes


def whole_partition(batches):
    """The rows of a partition as one frame; nothing for an empty one."""
    held = [b for b in batches if len(b)]
    if held:
        yield pd.concat(held, ignore_index=True)


class CategoryIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Index of the categories seen at fit, in order of their UTF-8 bytes.

    ``handleUnknown='minus_one'``: unknown/NULL -> -1 (ordinal encoding);
    ``'last'``: unknown/NULL -> number of categories, the slot a one-hot encoder
    with ``handleInvalid='keep', dropLast=True`` turns into a zero vector.
    """

    handleUnknown = Param(Params._dummy(), "handleUnknown", "minus_one | last", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, handleUnknown="minus_one"):
        super().__init__()
        self._setDefault(handleUnknown="minus_one")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        table, sizes = category_table(df, cols)
        outs = self.getOutputCols() if self.isSet(self.outputCols) else [f"{c}_idx" for c in cols]
        return CategoryIndexerModel(table, inputCols=cols, outputCols=outs, sizes=sizes, handleUnknown=self.getOrDefault(self.handleUnknown))


class CategoryIndexerModel(Model, HasInputCols, HasOutputCols, MLReadable, MLWritable):
    """``table`` holds the dictionary (col, value, position); positions are joined to the rows."""

    handleUnknown = Param(Params._dummy(), "handleUnknown", "minus_one | last", TypeConverters.toString)
    sizes = Param(Params._dummy(), "sizes", "categories of each column", TypeConverters.toListInt)

    def __init__(self, table: DataFrame, **params):
        super().__init__()
        self._setDefault(handleUnknown="minus_one")
        self._set(**params)
        self.table = table

    def write(self) -> MLWriter:
        return TableWriter(self, {"categories": self.table})

    @classmethod
    def read(cls) -> MLReader:
        return TableReader(cls, ["categories"])

    def _transform(self, df: DataFrame) -> DataFrame:
        last = self.getOrDefault(self.handleUnknown) == "last"
        out = df
        for k, (c, o, n) in enumerate(zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.sizes))):
            own = self.table.where(F.col("col") == k).select(F.col("value").alias("__value"), F.col("position").alias("__position"))
            if n <= FEW_CATEGORIES:
                own = F.broadcast(own)
            out = out.join(own, _c(c).cast("string") == F.col("__value"), "left")
            found = F.coalesce(F.col("__position"), F.lit(n if last else -1)).cast("int")
            if last and n:
                # the encoder then knows the number of categories without a scan, whether or not it saw an unknown one
                found = found.alias(o, metadata={"ml_attr": {"type": "nominal", "name": o, "num_vals": n}})
            out = out.drop("__value").withColumn(o, found).drop("__position")
        return out


class TableWriter(MLWriter):
    """Parameters as metadata, a model's tables as Parquet beside them."""

    def __init__(self, model, tables: dict[str, DataFrame]):
        super().__init__()
        self.model, self.tables = model, tables

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name, table in self.tables.items():
            table.write.parquet(f"{path}/{name}")


class TableReader(MLReader):
    """A model from its parameters and tables, which its constructor takes in order."""

    def __init__(self, cls, tables: list[str]):
        super().__init__()
        self.cls, self.tables = cls, tables

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls(*[self.sparkSession.read.parquet(f"{path}/{name}") for name in self.tables])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def one_hot_stages(cols: list[str]) -> list:
    """Index (unknown -> last slot) + one-hot with the last slot dropped: unknown -> zeros."""
    idx = CategoryIndexer(inputCols=cols, outputCols=[f"{c}__idx" for c in cols], handleUnknown="last")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cols], outputCols=[f"{c}__oh" for c in cols],
                        dropLast=True, handleInvalid="keep")
    return [idx, ohe]


# ----------------------------------------------------------------------------- M6 / M7
def split_by_schema(df: DataFrame, exclude: list[str]) -> tuple[list[str], list[str]]:
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        k = storage_kind(f.dataType)
        if k in ("numeric", "boolean"):
            num.append(f.name)
        else:
            cat.append(f.name)
    return num, cat


class Preprocessor(Estimator):
    """Median impute (+ population scale) for numbers; mode impute + one-hot / ordinal for categories; assembled into ``out_col``.

    ``fit`` returns a ``PipelineModel``; ``fit_folds`` one for each fold left out, from statistics that are
    gathered once for all folds.
    """

    def __init__(self, num_cols: list[str], cat_cols: list[str], encoding: str = "onehot", scale: bool = True, out_col: str = "features"):
        super().__init__()
        if encoding not in ("onehot", "ordinal", "none"):
            raise ValueError("encoding must be 'onehot', 'ordinal' or 'none'")
        self.num, self.cat, self.encoding, self.scale, self.out_col = list(num_cols), list(cat_cols), encoding, scale, out_col
        self.num_imp, self.cat_imp = [f"{c}__imp" for c in num_cols], [f"{c}__imp" for c in cat_cols]

    def _stages(self, median, scaler, mode, index) -> list:
        """The stages in order, from those that learn."""
        stages = []
        if self.num:
            stages.append(median)
            if self.scale:
                stages.append(scaler)
        if self.cat:
            stages.append(mode)
            if self.encoding != "none":
                stages.append(index)
            if self.encoding == "onehot":
                stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in self.cat_imp], outputCols=[f"{c}__oh" for c in self.cat_imp],
                                            dropLast=True, handleInvalid="keep"))
        return stages + [self.assembler()]

    def assembler(self) -> VectorAssembler:
        """The last stage, from columns that the others have prepared."""
        assembled = [f"{c}__sc" for c in self.num] if self.scale else list(self.num_imp)
        assembled += {"onehot": [f"{c}__oh" for c in self.cat_imp], "ordinal": [f"{c}__ord" for c in self.cat_imp], "none": []}[self.encoding]
        return VectorAssembler(inputCols=assembled, outputCol=self.out_col, handleInvalid="keep")

    @property
    def _index_cols(self) -> list[str]:
        return [f"{c}__{'idx' if self.encoding == 'onehot' else 'ord'}" for c in self.cat_imp]

    @property
    def _unknown(self) -> str:
        return "last" if self.encoding == "onehot" else "minus_one"

    def getStages(self) -> list:
        return self._stages(ExactImputer(inputCols=self.num, outputCols=self.num_imp, strategy="median"),
                            PopulationScaler(inputCols=self.num_imp, outputCols=[f"{c}__sc" for c in self.num]),
                            ExactImputer(inputCols=self.cat, outputCols=self.cat_imp, strategy="most_frequent"),
                            CategoryIndexer(inputCols=self.cat_imp, outputCols=self._index_cols, handleUnknown=self._unknown))

    def _fit(self, df: DataFrame):
        return Pipeline(stages=self.getStages()).fit(df)

    def fit_folds(self, df: DataFrame, fold_col: str, k: int) -> list:
        """A fitted model for the rows outside each fold 0 .. k - 1, equal to ``fit`` on these rows.

        Medians: the order statistics of all columns without each fold come from the same scans.  Means and
        deviations: one aggregate by fold, of which all but one are put together.  Modes and categories: one count by
        (column, value, fold); a value's count without a fold is its total less the fold's.
        """
        from tabsight.operators.quantiles import quantiles
        fold, folds = _c(fold_col), range(k)
        medians: list[dict] = [{} for _ in folds]
        if self.num:
            wide = df.select(*[F.when(fold != f, _c(c)).alias(f"c{i}_{f}") for i, c in enumerate(self.num) for f in folds])
            found = quantiles(wide, wide.columns, [0.5])
            medians = [{c: found[f"c{i}_{f}"][0] for i, c in enumerate(self.num)} for f in folds]
        scales = self._fold_scales(df, fold, k, medians) if self.num and self.scale else [{}] * k
        modes, tables, sizes = self._fold_categories(df, fold, k) if self.cat else ([{}] * k, [None] * k, [[]] * k)
        models = []
        for f in folds:
            index = CategoryIndexerModel(tables[f], inputCols=self.cat_imp, outputCols=self._index_cols, sizes=sizes[f], handleUnknown=self._unknown) if self.cat else None
            stages = self._stages(ExactImputerModel(inputCols=self.num, outputCols=self.num_imp, state=json.dumps(medians[f])),
                                  PopulationScalerModel(inputCols=self.num_imp, outputCols=[f"{c}__sc" for c in self.num], state=json.dumps(scales[f])),
                                  ExactImputerModel(inputCols=self.cat, outputCols=self.cat_imp, state=json.dumps(modes[f])), index)
            fitted, frame = [], df.limit(0)
            for stage in stages:
                # the encoder reads the sizes from the columns' metadata: no job
                stage = stage.fit(frame) if isinstance(stage, OneHotEncoder) else stage
                fitted.append(stage)
                frame = stage.transform(frame)
            models.append(PipelineModel(fitted))
        return models

    def _fold_scales(self, df: DataFrame, fold, k: int, medians: list[dict]) -> list[dict]:
        """Mean and population std of each imputed column without each fold."""
        aggs = []
        for i, c in enumerate(self.num):
            x = _c(c).cast("double")
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), (F.count(F.lit(1)) - F.count(x)).alias(f"z{i}")]
        rows = {r["fold"]: r for r in df.groupBy(fold.alias("fold")).agg(*aggs).collect()}  # a row per fold
        out = []
        for f in range(k):
            own = {}
            for i, c in enumerate(self.num):
                parts = [(r[f"n{i}"], r[f"m{i}"] or 0.0, r[f"v{i}"] or 0.0) for g, r in rows.items() if g != f and r[f"n{i}"]]
                missing = sum(r[f"z{i}"] for g, r in rows.items() if g != f)
                if missing and medians[f][c] is not None:
                    parts.append((missing, float(medians[f][c]), 0.0))
                n = sum(p[0] for p in parts)
                mean = sum(p[0] * p[1] for p in parts) / n if n else None
                own[f"{c}__imp"] = [mean, (sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n) ** 0.5 if n else None]
            out.append(own)
        return out

    def _fold_categories(self, df: DataFrame, fold, k: int) -> tuple[list[dict], list[DataFrame], list[list[int]]]:
        """Mode, dictionary and its sizes without each fold."""
        cols = len(self.cat)
        kinds = {c: storage_kind(df.schema[c].dataType) for c in self.cat}
        cells = [F.struct(F.lit(i).alias("col"), _c(c).cast("string").alias("value"),
                          (_c(c).cast("double") if kinds[c] in ("numeric", "boolean") else F.lit(None).cast("double")).alias("number")) for i, c in enumerate(self.cat)]
        counts = (df.select(fold.alias("fold"), F.inline(F.array(*cells))).where(F.col("value").isNotNull()).groupBy("col", "value", "number")
                  .agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("fold") == f, 1)).alias(f"n{f}") for f in range(k)]))
        ensure_checkpoint_dir(df.sparkSession)
        counts = counts.checkpoint(eager=True)
        rest = [F.col("n") - F.col(f"n{f}") for f in range(k)]
        best = counts.groupBy("col").agg(*[F.min_by("value", F.when(r > 0, F.struct(-r, F.col("number"), F.col("value")))).alias(f"b{f}") for f, r in enumerate(rest)])
        modes: list[dict] = [{c: None for c in self.cat} for _ in range(k)]
        for row in best.collect():
            for f in range(k):
                c = self.cat[row["col"]]
                modes[f][c] = typed_value(row[f"b{f}"], df.schema[c].dataType)
        # one dictionary per fold and column, numbered together
        kept = F.filter(F.array(*[F.when(r > 0, F.lit(f)) for f, r in enumerate(rest)]), lambda f: f.isNotNull())
        distinct = counts.select(F.explode(kept).alias("f"), "col", "value").select((F.col("f") * cols + F.col("col")).cast("int").alias("col"), "value")
        table, sizes = numbered_categories(distinct, k * cols)
        own = [table.where((F.col("col") >= f * cols) & (F.col("col") < (f + 1) * cols)).withColumn("col", F.col("col") - f * cols) for f in range(k)]
        return modes, own, [sizes[f * cols:(f + 1) * cols] for f in range(k)]


def build_preprocessor(num_cols: list[str], cat_cols: list[str], encoding: str = "onehot",
                       scale: bool = True, out_col: str = "features") -> Preprocessor:
    """median impute (+ population scale) for numbers; mode impute + one-hot /
    ordinal for categories; assembled into ``out_col``."""
    return Preprocessor(num_cols, cat_cols, encoding, scale, out_col)


def mutual_info_preprocessor(num_cols, cat_cols) -> Preprocessor:
    """median + scale for numbers, mode + ordinal for categories."""
    return build_preprocessor(num_cols, cat_cols, encoding="ordinal", scale=True)


def tree_preprocessor(num_cols, cat_cols) -> Preprocessor:
    """median for numbers, mode + ordinal for categories (no scaling)."""
    return build_preprocessor(num_cols, cat_cols, encoding="ordinal", scale=False)
