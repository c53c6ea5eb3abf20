"""Reader for experiment logs that mix four line formats.

``parse_log_lines(lines_df)`` takes a DataFrame with a ``value`` string column
(e.g. ``spark.read.text(path)`` or a stream) and returns one typed row per line:
``ts timestamp, run_id string, name string, score double, std double,
params string, tags map<string,string>, fmt string``.  Lines that match no
format are kept with ``fmt = 'unparsed'``; blank lines are dropped.  Everything
is column expressions, so the same parser runs in batch and in streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed line formats of the experiment logs.
TS = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
NUM = r"([-+0-9.eE]+)"
PIPE_RE = rf"^{TS} \| ([^|]+?) \| score={NUM} \| std={NUM}(?: \| (.*))?$"
PLAIN_RE = rf"^{TS} (\S+) score={NUM} std={NUM}(?: params=(.*))?$"
TRAINER_RE = (rf"^\[{TS}\] (\w+)\s+(\S+) — (.+?) \| score={NUM} ± {NUM}"
              r" \| params=(.*?)(?: \| run_id=(\S+))?$")

JSON_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("params", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("bad", T.StringType()),  # a line that is no JSON
])


def _g(pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(F.col("value"), pattern, i), F.lit(""))


def _ts(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    v = F.trim(F.col("value"))
    base = lines.select(v.alias("value")).where(F.length("value") > 0)
    is_json = F.col("value").startswith("{")
    is_pipe = F.col("value").rlike(PIPE_RE)
    is_plain = F.col("value").rlike(PLAIN_RE)
    is_trainer = F.col("value").rlike(TRAINER_RE)
    j = F.from_json(F.when(is_json, F.col("value")), JSON_SCHEMA, {"columnNameOfCorruptRecord": "bad"})
    # a flat object as it stands in the line; from_json writes nested ones anew
    flat_params = F.regexp_extract(F.col("value"), r'"params":\s*(\{[^{}]*\})', 1)
    empty_map = F.create_map().cast("map<string,string>")
    fmt = (F.when(is_json & j.isNotNull() & j["bad"].isNull(), "json").when(is_pipe, "pipe")
            .when(is_trainer, "trainer").when(is_plain, "plain").otherwise("unparsed"))
    b = base.withColumn("fmt", fmt).withColumn("__j", j)
    pick = lambda json_c, pipe_c, trainer_c, plain_c: (
        F.when(F.col("fmt") == "json", json_c).when(F.col("fmt") == "pipe", pipe_c)
         .when(F.col("fmt") == "trainer", trainer_c).when(F.col("fmt") == "plain", plain_c))
    return b.select(
        pick(_ts(F.col("__j.ts")), _ts(_g(PIPE_RE, 1)), _ts(_g(TRAINER_RE, 1)), _ts(_g(PLAIN_RE, 1)))
        .alias("ts"),
        pick(F.col("__j.run_id"), F.lit(None).cast("string"), _g(TRAINER_RE, 8),
             F.lit(None).cast("string")).alias("run_id"),
        pick(F.col("__j.name"), F.trim(_g(PIPE_RE, 2)), _g(TRAINER_RE, 4), _g(PLAIN_RE, 2)).alias("name"),
        pick(F.col("__j.score"), _g(PIPE_RE, 3).try_cast("double"), _g(TRAINER_RE, 5).try_cast("double"),
             _g(PLAIN_RE, 3).try_cast("double")).alias("score"),
        pick(F.col("__j.std"), _g(PIPE_RE, 4).try_cast("double"), _g(TRAINER_RE, 6).try_cast("double"),
             _g(PLAIN_RE, 4).try_cast("double")).alias("std"),
        pick(F.coalesce(F.nullif(flat_params, F.lit("")), F.col("__j.params")), _g(PIPE_RE, 5), _g(TRAINER_RE, 7), _g(PLAIN_RE, 5)).alias("params"),
        F.coalesce(F.when(F.col("fmt") == "json", F.col("__j.tags")), empty_map).alias("tags"),
        F.col("fmt"),
        F.when(F.col("fmt") == "unparsed", F.col("value")).alias("raw"))


def read_experiment_log(spark: SparkSession, path: str) -> DataFrame:
    """Parse one or more log files (text) into the typed experiment table."""
    return parse_log_lines(spark.read.text(path))
