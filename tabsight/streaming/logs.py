"""Experiment logs as a stream: the mixed-format parser over ``readStream.text``.

New log files dropped into a folder are parsed incrementally with the same
column expressions as the batch reader; the sink is any Structured Streaming
sink (``foreachBatch`` for an idempotent table append keyed by batch id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsight.sources.logs import parse_log_lines


def experiment_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming DataFrame of parsed experiment rows from text files in ``folder``."""
    return parse_log_lines(spark.readStream.format("text").load(folder))


def start_log_ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str,
                     trigger_once: bool = True):
    """Append parsed rows to a Parquet table; the checkpoint makes restarts exactly-once."""
    q = (experiment_log_stream(spark, folder).writeStream
         .format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    q = q.trigger(availableNow=True) if trigger_once else q
    return q.start()
