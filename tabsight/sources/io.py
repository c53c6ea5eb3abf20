"""Scans and sinks: CSV/Parquet tables, predictions, experiment records, artifacts.

All writers produce directories of part files (one per task), never a single
file assembled on the driver.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("params", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold commas and doubled quotes."""
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a directory of part files (CSV with header, or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
    return path


def predictions(model, df: DataFrame, id_col: str, out_col: str, pred_col: str = "prediction") -> DataFrame:
    """(id, integer prediction) from a fitted pipeline."""
    return model.transform(df).select(F.col(id_col), F.col(pred_col).cast("int").alias(out_col))


def save_predictions(model, df: DataFrame, id_col: str, out_col: str, path: str,
                     fmt: str = "csv") -> str:
    return save_table(predictions(model, df, id_col, out_col), path, fmt)


def experiment_record(spark: SparkSession, name: str, score: float, std: float,
                      params: dict | None = None, run_id: str | None = None,
                      tags: dict | None = None, ts: _dt.datetime | None = None) -> DataFrame:
    """One typed experiment row (score/std rounded to 6 dp, params as JSON)."""
    ts = ts or _dt.datetime.now().replace(microsecond=0)
    row = (ts, run_id, name, round(float(score), 6), round(float(std), 6),
           json.dumps(params or {}, sort_keys=True), {str(k): str(v) for k, v in (tags or {}).items()})
    return spark.createDataFrame([row], EXPERIMENT_SCHEMA)


def log_experiment(spark: SparkSession, path: str, name: str, score: float, std: float,
                   params: dict | None = None, run_id: str | None = None,
                   tags: dict | None = None) -> DataFrame:
    """Append one experiment row to a JSON-lines table directory."""
    rec = experiment_record(spark, name, score, std, params, run_id, tags)
    rec.coalesce(1).write.mode("append").json(path)
    return rec


def load_experiments(spark: SparkSession, path: str) -> DataFrame:
    """The experiment table; a missing folder gives an empty table with the schema."""
    try:
        return spark.read.schema(EXPERIMENT_SCHEMA).json(path)
    except Exception as e:  # noqa: BLE001 - path not found
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], EXPERIMENT_SCHEMA)
        raise


def save_model(model, path: str) -> str:
    """Persist a fitted pipeline with Spark's own ML format."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
