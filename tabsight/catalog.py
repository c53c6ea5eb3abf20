"""Registered queries over the fixture tables and their DuckDB twins.

Each entry of ``QUERIES`` takes ``(spark, sf_dir)`` and returns a DataFrame built
with the library's operators over whole tables; ``ORACLE_SQL`` holds the same
computation as plain SQL over the fixture views.  Float outputs are rounded in
both (summation order differs between engines).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.operators import profile as P
from tabsight.session import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float/double column (engines sum in different orders)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def docs_labels(spark: SparkSession, sf: str) -> DataFrame:
    """documents LEFT JOIN labels: the fixture with missing values."""
    return read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id", "left")


DOCS_LABELS_SQL = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"

# (name, spark dtype, storage kind) of documents LEFT JOIN labels
DOCS_LABELS_COLS = [("doc_id", "bigint", "numeric"), ("text", "string", "text"),
                    ("lang", "string", "text"), ("source", "string", "text"),
                    ("n_chars", "bigint", "numeric"), ("quality", "int", "numeric"),
                    ("toxic", "int", "numeric")]


def _sql_logical(kind: str, col: str) -> str:
    if kind == "numeric":
        return (f"CASE WHEN coalesce(bool_and({col} IN (0, 1)), true) THEN 'categorical' "
                f"ELSE 'numeric' END")
    if kind == "text":
        return (f"CASE WHEN count(DISTINCT {col}) > greatest(20, floor(count(*) * 0.05)) "
                f"THEN 'high_cardinality' ELSE 'categorical' END")
    return f"'{kind}'"


def _sql_column_stats(table: str, cols, target: str | None) -> str:
    parts = []
    for name, dtype, kind in cols:
        parts.append(
            f"SELECT '{name}' AS column_name, '{dtype}' AS dtype, {_sql_logical(kind, name)} AS logical_type, "
            f"{'true' if name == target else 'false'} AS is_target, "
            f"count(*) AS n_rows, CAST(count(*) - count({name}) AS BIGINT) AS n_missing, "
            f"count(DISTINCT {name}) AS n_unique FROM {table} t")
    return " UNION ALL ".join(parts)


# ============================================================================ A1 overview
@register("overview", f"""
SELECT column_name, dtype, logical_type, is_target, n_missing,
       round(n_missing / n_rows * 100, 2) AS pct_missing, n_unique,
       round(n_unique / n_rows * 100, 2) AS pct_unique
FROM ({_sql_column_stats(DOCS_LABELS_SQL, DOCS_LABELS_COLS, 'quality')})
""")
def q_overview(spark, sf):
    return P.overview(docs_labels(spark, sf), target="quality")


def _stats_sql(table: str, cols, target=None) -> str:
    return f"({_sql_column_stats(table, cols, target)})"


DOCS_COLS = [c for c in DOCS_LABELS_COLS if c[0] in ("text", "lang", "source", "n_chars")]
DOCS_NOKEY_SQL = "(SELECT text, lang, source, n_chars FROM documents)"


# ============================================================================ A2 info_summary
@register("info_summary", f"""
WITH s AS {_stats_sql(DOCS_NOKEY_SQL, DOCS_COLS)},
d AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup
      FROM (SELECT count(*) AS n FROM {DOCS_NOKEY_SQL} GROUP BY text, lang, source, n_chars))
SELECT max(n_rows) AS rows, 4 AS columns, CAST(max(n_rows) * 4 AS BIGINT) AS total_cells,
       CAST(sum(n_missing) AS BIGINT) AS total_missing,
       round(sum(n_missing) / (max(n_rows) * 4) * 100, 2) AS pct_missing,
       max(d.dup) AS duplicated_rows, CAST(NULL AS VARCHAR) AS target,
       count(*) FILTER (WHERE logical_type = 'numeric') AS n_numeric,
       count(*) FILTER (WHERE logical_type = 'categorical') AS n_categorical,
       count(*) FILTER (WHERE logical_type = 'high_cardinality') AS n_high_cardinality,
       count(*) FILTER (WHERE logical_type = 'boolean') AS n_boolean,
       count(*) FILTER (WHERE logical_type = 'datetime') AS n_datetime,
       count(*) FILTER (WHERE logical_type = 'unknown') AS n_unknown
FROM s, d
""")
def q_info_summary(spark, sf):
    return P.info_summary(read_table(spark, sf, "documents").drop("doc_id"))


# ============================================================================ A3 / A4 duplicates
_DUP_SQL = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars
FROM documents d JOIN (SELECT text, count(*) AS n, min(doc_id) AS f, max(doc_id) AS l
                       FROM documents GROUP BY text) g
  ON d.text IS NOT DISTINCT FROM g.text
WHERE g.n > 1 AND {cond}
"""


@register("duplicates_first", _DUP_SQL.format(cond="d.doc_id <> g.f"))
def q_duplicates_first(spark, sf):
    return P.check_duplicates(read_table(spark, sf, "documents"), ["text"], "first", "doc_id")


@register("duplicates_last", _DUP_SQL.format(cond="d.doc_id <> g.l"))
def q_duplicates_last(spark, sf):
    return P.check_duplicates(read_table(spark, sf, "documents"), ["text"], "last", "doc_id")


@register("duplicates_all", _DUP_SQL.format(cond="true"))
def q_duplicates_all(spark, sf):
    return P.check_duplicates(read_table(spark, sf, "documents"), ["text"], False)


@register("duplicates_summary", """
SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(sum(n) AS BIGINT) AS n_rows,
       round(sum(n - 1) / sum(n) * 100, 2) AS pct_duplicates
FROM (SELECT count(*) AS n FROM documents GROUP BY text)
""")
def q_duplicates_summary(spark, sf):
    return P.duplicates_summary(read_table(spark, sf, "documents"), ["text"])


# ============================================================================ A5 / A19 missing
@register("missing_summary", f"""
SELECT column_name, n_missing, round(n_missing / n_rows * 100, 2) AS pct_missing
FROM {_stats_sql(DOCS_LABELS_SQL, DOCS_LABELS_COLS, 'quality')} WHERE n_missing > 0
""")
def q_missing_summary(spark, sf):
    return P.missing_summary(docs_labels(spark, sf), target="quality")


@register("missing_top", f"""
SELECT column_name, n_missing, round(n_missing / n_rows * 100, 2) AS pct_missing
FROM {_stats_sql(DOCS_LABELS_SQL, DOCS_LABELS_COLS, 'quality')} WHERE n_missing > 0
ORDER BY pct_missing DESC, column_name LIMIT 1
""")
def q_missing_top(spark, sf):
    return P.missing_summary(docs_labels(spark, sf), target="quality", top_n=1)


# ============================================================================ A6 describe_numeric
def _sql_numeric(table: str, cols) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, "
            f"round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50, "
            f"round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max, "
            f"round(skewness({x}), 6) AS skew, round(kurtosis({x}), 6) AS kurtosis, "
            f"CAST(count(*) - count({x}) AS BIGINT) AS missing, "
            f"round((count(*) - count({x})) / count(*) * 100, 2) AS pct_missing FROM {table}")
    return " UNION ALL ".join(parts)


LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]


@register("describe_numeric", _sql_numeric("lineitem", LINEITEM_NUM))
def q_describe_numeric(spark, sf):
    return rounded(P.describe_numeric(read_table(spark, sf, "lineitem")))


@register("describe_numeric_events", _sql_numeric("events", ["event_id", "user_id", "value"]))
def q_describe_numeric_events(spark, sf):
    return rounded(P.describe_numeric(read_table(spark, sf, "events")))


# ============================================================================ A7 / A8 categorical
def _sql_top(table: str, c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(value) AS n_unique,
        first(value ORDER BY n DESC, value ASC) FILTER (WHERE value IS NOT NULL) AS top,
        CAST(coalesce(max(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS top_freq,
        CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS missing,
        CAST(sum(n) AS BIGINT) AS n_rows
      FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {table} GROUP BY 1)"""


@register("describe_categorical", " UNION ALL ".join(
    f"""SELECT column_name, n_unique, top, top_freq,
        coalesce(round(top_freq / (n_rows - missing) * 100, 2), 0.0) AS top_pct, missing,
        round(missing / n_rows * 100, 2) AS pct_missing FROM ({_sql_top('orders', c)})"""
    for c in ["o_orderstatus", "o_orderpriority"]))
def q_describe_categorical(spark, sf):
    return P.describe_categorical(read_table(spark, sf, "orders"))


@register("describe_categorical_target", " UNION ALL ".join(
    f"""SELECT column_name, n_unique, top, top_freq,
        coalesce(round(top_freq / (n_rows - missing) * 100, 2), 0.0) AS top_pct, missing,
        round(missing / n_rows * 100, 2) AS pct_missing FROM ({_sql_top(DOCS_LABELS_SQL, c)})"""
    for c in ["text", "lang", "source", "quality"]))
def q_describe_categorical_target(spark, sf):
    return P.describe_categorical(docs_labels(spark, sf), target="quality")


@register("cardinality", " UNION ALL ".join(
    f"""SELECT column_name, n_unique AS nunique, missing AS n_missing, top AS top_value,
        top_freq FROM ({_sql_top('part', c)})"""
    for c in ["p_name", "p_brand", "p_type"]))
def q_cardinality(spark, sf):
    return P.cardinality_summary(read_table(spark, sf, "part"))


# ============================================================================ A9 - A11
def lineitem_with_constant(spark, sf):
    """lineitem plus floor(l_discount) (always 0: a constant column derived from the data)."""
    li = read_table(spark, sf, "lineitem")
    return li.withColumn("l_discount_floor", F.floor("l_discount").cast("double"))


LINEITEM_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate", "l_discount_floor"]
LINEITEM_CONST_SQL = "(SELECT *, CAST(floor(l_discount) AS DOUBLE) AS l_discount_floor FROM lineitem)"


@register("constant_cols", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name FROM {LINEITEM_CONST_SQL} HAVING count(DISTINCT {c}) <= 1"
    for c in LINEITEM_ALL))
def q_constant_cols(spark, sf):
    return P.constant_columns(lineitem_with_constant(spark, sf))


@register("low_variance_cols", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(var_samp(CAST({c} AS DOUBLE)), 9) AS variance "
    f"FROM {LINEITEM_CONST_SQL} HAVING var_samp(CAST({c} AS DOUBLE)) <= 0.01"
    for c in LINEITEM_NUM + ["l_discount_floor"]))
def q_low_variance_cols(spark, sf):
    return rounded(P.low_variance_columns(lineitem_with_constant(spark, sf)), 9)


@register("quasi_constant_cols", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(max(n) / sum(n), 6) AS top_share
        FROM (SELECT {c}, count(*) AS n FROM {LINEITEM_CONST_SQL} GROUP BY 1)
        HAVING max(n) / sum(n) >= 0.99"""
    for c in LINEITEM_ALL))
def q_quasi_constant_cols(spark, sf):
    return P.quasi_constant_columns(lineitem_with_constant(spark, sf))


# ============================================================================ A12 target summary
@register("target_summary", f"""
SELECT CAST(quality AS VARCHAR) AS value, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (), 4) AS ratio
FROM {DOCS_LABELS_SQL} GROUP BY 1
""")
def q_target_summary(spark, sf):
    return P.target_summary(docs_labels(spark, sf), "quality")


@register("target_summary_numeric", """
SELECT 'o_totalprice' AS column_name, count(o_totalprice) AS count, round(avg(o_totalprice), 6) AS mean,
       round(stddev_samp(o_totalprice), 6) AS std, round(min(o_totalprice), 6) AS min,
       round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS q50,
       round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(max(o_totalprice), 6) AS max
FROM orders
""")
def q_target_summary_numeric(spark, sf):
    return rounded(P.target_summary(read_table(spark, sf, "orders"), "o_totalprice"))


# ============================================================================ A13 / A14 outliers
@register("outliers_mask", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value,
       coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false) AS is_outlier
FROM events, b
""")
def q_outliers_mask(spark, sf):
    ev = read_table(spark, sf, "events")
    return P.detect_outliers_iqr(ev, "value").select("event_id", "value", "is_outlier")


@register("outliers_summary", """
WITH b AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1,
                  quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT 'n_chars' AS column_name, count(*) FILTER (WHERE n_chars < lo OR n_chars > hi) AS n_outliers,
       round(count(*) FILTER (WHERE n_chars < lo OR n_chars > hi) / count(*) * 100, 2) AS pct_outliers,
       round(max(lo), 4) AS lower_bound, round(max(hi), 4) AS upper_bound
FROM documents, f
""")
def q_outliers_summary(spark, sf):
    return P.outliers_summary_iqr(read_table(spark, sf, "documents"), "n_chars")


# ============================================================================ A17 / A18
@register("group_stats", """
SELECT l_orderkey, count(*) AS size, round(avg(l_quantity), 6) AS mean,
       count(DISTINCT l_quantity) AS nunique
FROM lineitem GROUP BY l_orderkey
""")
def q_group_stats(spark, sf):
    return rounded(P.group_stats(read_table(spark, sf, "lineitem"), "l_orderkey", "l_quantity")
                   .select("l_orderkey", "size", "mean", "nunique"))


@register("value_counts_topn", """
SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1
ORDER BY count DESC, value ASC NULLS FIRST LIMIT 3
""")
def q_value_counts_topn(spark, sf):
    return P.value_counts(read_table(spark, sf, "events"), "event_type", top_n=3)


@register("value_counts_share", """
SELECT p_name AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM part GROUP BY 1 ORDER BY count DESC, value ASC NULLS FIRST LIMIT 10
""")
def q_value_counts_share(spark, sf):
    return P.value_counts(read_table(spark, sf, "part"), "p_name", top_n=10, normalize=True)


# ============================================================================ C1 - C3 correlation
from tabsight.operators import assoc as A  # noqa: E402


def _sql_pearson(table: str, cols, full: bool = True, digits: int = 6) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if not full and j <= i:
                continue
            xa, xb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            parts.append(
                f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                f"CASE WHEN stddev_pop({xa}) FILTER (WHERE {b} IS NOT NULL) = 0 "
                f"OR stddev_pop({xb}) FILTER (WHERE {a} IS NOT NULL) = 0 THEN NULL "
                f"ELSE round(corr({xa}, {xb}), {digits}) END AS correlation FROM {table}")
    return " UNION ALL ".join(parts)


@register("corr_pearson", _sql_pearson("lineitem", LINEITEM_NUM))
def q_corr_pearson(spark, sf):
    return rounded(A.correlation_matrix(read_table(spark, sf, "lineitem")))


DL_NUM = ["doc_id", "n_chars", "quality", "toxic"]


@register("corr_pearson_nulls", _sql_pearson(DOCS_LABELS_SQL, DL_NUM))
def q_corr_pearson_nulls(spark, sf):
    return rounded(A.correlation_matrix(docs_labels(spark, sf)))


def _sql_spearman(table: str, cols) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = (f"(SELECT corr(ra, rb) AS r, stddev_pop(ra) AS sa, stddev_pop(rb) AS sb FROM ("
                 f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
                 f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
                 f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))")
            parts.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, "
                         f"CASE WHEN sa = 0 OR sb = 0 THEN NULL ELSE round(r, 6) END AS correlation "
                         f"FROM {r}")
    return " UNION ALL ".join(parts)


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("corr_spearman", _sql_spearman("lineitem", LI_NUM))
def q_corr_spearman(spark, sf):
    return rounded(A.correlation_matrix(read_table(spark, sf, "lineitem"), method="spearman"))


@register("corr_spearman_nulls", _sql_spearman(DOCS_LABELS_SQL, DL_NUM))
def q_corr_spearman_nulls(spark, sf):
    return rounded(A.correlation_matrix(docs_labels(spark, sf), method="spearman"))


def _sql_kendall(table: str, cols) -> str:
    """Oracle: tau-b from the contingency cells, brute force over pairs of cells."""
    parts = []
    for a in cols:
        for b in cols:
            cells = (f"(SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS n "
                     f"FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)")
            parts.append(f"""SELECT '{a}' AS feature_1, '{b}' AS feature_2,
  CASE WHEN (t.n0 - t.n1) * (t.n0 - t.n2) = 0 THEN NULL
       ELSE round(s.s / sqrt((t.n0 - t.n1) * (t.n0 - t.n2)), 6) END AS correlation
FROM (SELECT sum(sign(c1.x - c2.x) * sign(c1.y - c2.y) * c1.n * c2.n) / 2.0 AS s
      FROM {cells} c1, {cells} c2) s,
     (SELECT sum(n) * (sum(n) - 1) / 2.0 AS n0,
             (SELECT sum(t * (t - 1) / 2.0) FROM (SELECT sum(n) AS t FROM {cells} GROUP BY x)) AS n1,
             (SELECT sum(t * (t - 1) / 2.0) FROM (SELECT sum(n) AS t FROM {cells} GROUP BY y)) AS n2
      FROM {cells}) t""")
    return " UNION ALL ".join(parts)


# pairs of rows in SQL are too many for all of lineitem; tests/test_assoc.py checks the operator by brute force
@register("corr_kendall")
def q_corr_kendall(spark, sf):
    return rounded(A.correlation_matrix(read_table(spark, sf, "lineitem"), method="kendall"))


_PART_PROFILE = ["l_partkey", "n", "quantity", "price", "discount", "tax", "low", "high"]
_PART_PROFILE_SQL = """(SELECT l_partkey, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 4) AS price, round(avg(l_discount), 6) AS discount,
  round(avg(l_tax), 6) AS tax, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_partkey)"""


@register("corr_kendall_profiles", _sql_kendall(_PART_PROFILE_SQL, _PART_PROFILE))
def q_corr_kendall_profiles(spark, sf):
    """Eight columns, most of them without ties: a line per part."""
    profile = read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"), F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"))
    return rounded(A.correlation_matrix(profile, method="kendall"))


@register("corr_kendall_part", _sql_kendall("part", ["p_partkey", "p_size", "p_retailprice"]))
def q_corr_kendall_part(spark, sf):
    return rounded(A.correlation_matrix(read_table(spark, sf, "part"), method="kendall"))


@register("corr_kendall_nulls", _sql_kendall(DOCS_LABELS_SQL, DL_NUM))
def q_corr_kendall_nulls(spark, sf):
    return rounded(A.correlation_matrix(docs_labels(spark, sf), method="kendall"))


# ============================================================================ C5 - C7
@register("multicollinearity", f"""
SELECT feature_1, feature_2, round(correlation, 4) AS correlation
FROM ({_sql_pearson('part', ['p_partkey', 'p_size', 'p_retailprice'], full=False, digits=15)})
WHERE abs(correlation) >= 0.4
""")
def q_multicollinearity(spark, sf):
    return A.multicollinearity(read_table(spark, sf, "part"), threshold=0.4)


@register("target_corr", f"""
SELECT feature_1 AS feature, correlation AS correlation_with_target
FROM ({_sql_pearson(DOCS_LABELS_SQL, ['doc_id', 'n_chars', 'toxic', 'quality'])})
WHERE feature_2 = 'quality' AND feature_1 <> 'quality'
""")
def q_target_corr(spark, sf):
    return rounded(A.target_correlation(docs_labels(spark, sf), "quality"))


@register("target_corr_summary", f"""
SELECT feature_1 AS feature, correlation AS correlation_with_target
FROM ({_sql_pearson('lineitem', LINEITEM_NUM)})
WHERE feature_2 = 'l_extendedprice' AND feature_1 <> 'l_extendedprice'
""")
def q_target_corr_summary(spark, sf):
    return rounded(A.target_correlation(read_table(spark, sf, "lineitem"), "l_extendedprice",
                                        numeric_only=True))


# ============================================================================ C8 crosstab
_STATUSES = ["F", "O", "P"]
_CT_COUNTS = ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}\"" for s in _STATUSES)


@register("crosstab_counts", f"""
SELECT o_orderpriority, {_CT_COUNTS} FROM orders
WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_orderpriority
""")
def q_crosstab_counts(spark, sf):
    return A.crosstab(read_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@register("crosstab_index", f"""
SELECT o_orderpriority, {', '.join(f'round("{s}" / ("F" + "O" + "P"), 6) AS "{s}"' for s in _STATUSES)}
FROM (SELECT o_orderpriority, {_CT_COUNTS} FROM orders GROUP BY o_orderpriority)
""")
def q_crosstab_index(spark, sf):
    return rounded(A.crosstab(read_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus",
                              normalize="index"))


@register("crosstab_columns", f"""
SELECT o_orderpriority, {', '.join(f'round("{s}" / sum("{s}") OVER (), 6) AS "{s}"' for s in _STATUSES)}
FROM (SELECT o_orderpriority, {_CT_COUNTS} FROM orders GROUP BY o_orderpriority)
""")
def q_crosstab_columns(spark, sf):
    return rounded(A.crosstab(read_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus",
                              normalize="columns"))


@register("crosstab_all", f"""
SELECT o_orderpriority, {', '.join(f'round("{s}" / sum("F" + "O" + "P") OVER (), 6) AS "{s}"' for s in _STATUSES)}
FROM (SELECT o_orderpriority, {_CT_COUNTS} FROM orders GROUP BY o_orderpriority)
""")
def q_crosstab_all(spark, sf):
    return rounded(A.crosstab(read_table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus",
                              normalize="all"))


@register("crosstab_multikey", f"""
WITH t AS (SELECT lang, source, CAST(quality AS VARCHAR) AS q FROM {DOCS_LABELS_SQL}
           WHERE lang IS NOT NULL AND source IS NOT NULL AND quality IS NOT NULL),
r AS (SELECT DISTINCT lang, source FROM t), c AS (SELECT DISTINCT q FROM t),
n AS (SELECT lang, source, q, count(*) AS n FROM t GROUP BY ALL)
SELECT r.lang, r.source, c.q AS col_value, coalesce(n.n, 0) AS value
FROM r CROSS JOIN c LEFT JOIN n ON n.lang = r.lang AND n.source = r.source AND n.q = c.q
""")
def q_crosstab_multikey(spark, sf):
    return A.crosstab_long(docs_labels(spark, sf), ["lang", "source"], "quality")


# ============================================================================ F1 mutual information
_MI_BASE = "(SELECT d.lang, d.source, d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id))"


@register("mutual_info", f"""
WITH base AS {_MI_BASE},
e AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges
      FROM base),
long AS (SELECT 'lang' AS feature, lang AS x, CAST(quality AS VARCHAR) AS y FROM base
         UNION ALL SELECT 'source', source, CAST(quality AS VARCHAR) FROM base
         UNION ALL SELECT 'n_chars', CAST(len(list_filter(list_distinct(edges), lambda v: v < n_chars)) AS VARCHAR),
                          CAST(quality AS VARCHAR) FROM base, e),
cells AS (SELECT feature, x, y, count(*) AS n FROM long GROUP BY ALL),
nx AS (SELECT feature, x, sum(n) AS nx FROM cells GROUP BY ALL),
ny AS (SELECT feature, y, sum(n) AS ny FROM cells GROUP BY ALL),
nt AS (SELECT feature, sum(n) AS nt FROM cells GROUP BY ALL)
SELECT feature, round(greatest(sum(n / nt * ln(n * nt / (nx * ny))), 0.0), 9) AS mi
FROM cells JOIN nx USING (feature, x) JOIN ny USING (feature, y) JOIN nt USING (feature)
GROUP BY feature
""")
def q_mutual_info(spark, sf):
    base = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    return rounded(A.mutual_info(base, ["lang", "source", "n_chars"], "quality",
                                 discrete={"lang": True, "source": True, "n_chars": False}), 9)


# ============================================================================ X1 - X12 features
from tabsight.operators import features as X  # noqa: E402


@register("regex_category", r"""
SELECT p_partkey,
  CASE WHEN w IN ('red', 'blue', 'cold') THEN 'Rare' ELSE w END AS category
FROM (SELECT p_partkey,
        coalesce(CASE nullif(regexp_extract(p_name, '^(\S+)\s', 1), '')
                   WHEN 'small' THEN 'little' WHEN 'large' THEN 'big' END,
                 nullif(regexp_extract(p_name, '^(\S+)\s', 1), '')) AS w
      FROM part)
""")
def q_regex_category(spark, sf):
    part = read_table(spark, sf, "part")
    out = X.regex_category(part, "p_name", r"^(\S+)\s", "category",
                           rename={"small": "little", "large": "big"}, rare=["red", "blue", "cold"])
    return out.select("p_partkey", "category")


@register("family_size", """
SELECT l_orderkey, l_linenumber, l_linenumber + l_quantity + 1 AS family_size,
       CAST(coalesce(l_linenumber = 1, false) AS INTEGER) AS is_single
FROM lineitem
""")
def q_family_size(spark, sf):
    li = read_table(spark, sf, "lineitem")
    out = X.is_single(X.count_sum(li, ["l_linenumber", "l_quantity"], "family_size"),
                      "l_linenumber", "is_single")
    return out.select("l_orderkey", "l_linenumber", "family_size", "is_single")


@register("group_size", """
SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS group_size FROM lineitem
""")
def q_group_size(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return X.group_size(li, "l_orderkey", "group_size")


@register("strip_prefix", """
SELECT c_custkey, coalesce(nullif(trim(regexp_replace(regexp_replace(c_name, '[./]', ' ', 'g'),
                                                   '[0-9]+', '', 'g')), ''), 'NONE') AS prefix
FROM customer
""")
def q_strip_prefix(spark, sf):
    cu = read_table(spark, sf, "customer")
    return X.strip_digits_prefix(cu, "c_name", "prefix").select("c_custkey", "prefix")


@register("first_char", """
SELECT p_partkey, coalesce(nullif(substring(p_type, 1, 1), ''), 'Unknown') AS deck FROM part
""")
def q_first_char(spark, sf):
    return X.first_char(read_table(spark, sf, "part"), "p_type", "deck").select("p_partkey", "deck")


@register("map_encode", """
SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS status_code
FROM lineitem
""")
def q_map_encode(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return (X.map_encode(li, "l_linestatus", {"O": 0, "F": 1}, "status_code")
             .select("l_orderkey", "l_linenumber", "status_code"))


@register("interaction", """
SELECT p_partkey, round(p_size * p_retailprice, 6) AS size_price FROM part
""")
def q_interaction(spark, sf):
    part = read_table(spark, sf, "part")
    return rounded(X.interaction(part, "p_size", "p_retailprice", "size_price")
                   .select("p_partkey", "size_price"))


@register("log1p", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS o_totalprice FROM orders
""")
def q_log1p(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(X.log1p(orders, "o_totalprice"), 9)


CUT_EDGES = [0, 12, 18, 40, 45]


@register("cut", """
SELECT l_orderkey, l_linenumber, l_quantity,
  CASE WHEN l_quantity > 0 AND l_quantity <= 12 THEN 0 WHEN l_quantity > 12 AND l_quantity <= 18 THEN 1
       WHEN l_quantity > 18 AND l_quantity <= 40 THEN 2 WHEN l_quantity > 40 AND l_quantity <= 45 THEN 3
  END AS qty_bin
FROM lineitem
""")
def q_cut(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.cut(li, "l_quantity", CUT_EDGES, "qty_bin")


_QCUT_SQL = """
WITH e AS (SELECT quantile_cont(CAST({col} AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM {table})
SELECT {key}, CAST(len(list_filter(edges[2:4], lambda v: v < CAST({col} AS DOUBLE))) AS INTEGER) AS {out}
FROM {table}, e
"""


@register("qcut", _QCUT_SQL.format(col="value", table="events", key="event_id", out="value_bin"))
def q_qcut(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "value")
    return X.qcut(ev, "value", 4, "value_bin").select("event_id", "value_bin")


def lineitem_feature_plan() -> "X.FeaturePlan":
    """A fixed sequence of steps over lineitem (the order matters: edges after log1p)."""
    return (X.FeaturePlan()
            .add("log_price", lambda d: X.log1p(d, "l_extendedprice"))
            .add("price_bin", lambda d: X.qcut(d, "l_extendedprice", 4, "price_bin"))
            .add("drop_price", lambda d: X.drop_required(d, ["l_extendedprice"]))
            .add("qty_bin", lambda d: X.cut(d, "l_quantity", CUT_EDGES, "qty_bin"))
            .add("drop_qty", lambda d: X.drop_required(d, ["l_quantity"]))
            .add("status", lambda d: X.map_encode(d, "l_linestatus", {"O": 0, "F": 1}))
            .add("order_size", lambda d: X.group_size(d, "l_orderkey", "order_size"))
            .add("single", lambda d: X.is_single(d, "order_size", "single_line"))
            .add("line_tax", lambda d: X.interaction(d, "l_linenumber", "l_linestatus", "line_status"))
            .add("drop_noise", lambda d: X.drop_if_present(
                d, ["l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_tax", "l_discount"])))


@register("feature_plan", """
WITH t AS (SELECT l_orderkey, l_linenumber, ln(1 + l_extendedprice) AS lp, l_quantity,
                  CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS st,
                  count(*) OVER (PARTITION BY l_orderkey) AS order_size FROM lineitem),
e AS (SELECT quantile_cont(lp, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM t)
SELECT l_orderkey, l_linenumber, st AS l_linestatus,
       CAST(len(list_filter(edges[2:4], lambda v: v < lp)) AS INTEGER) AS price_bin,
       CASE WHEN l_quantity > 0 AND l_quantity <= 12 THEN 0 WHEN l_quantity > 12 AND l_quantity <= 18 THEN 1
            WHEN l_quantity > 18 AND l_quantity <= 40 THEN 2 WHEN l_quantity > 40 AND l_quantity <= 45 THEN 3
       END AS qty_bin,
       order_size, CAST(order_size = 1 AS INTEGER) AS single_line, l_linenumber * st AS line_status
FROM t, e
""")
def q_feature_plan(spark, sf):
    return lineitem_feature_plan().transform(read_table(spark, sf, "lineitem"))


# ============================================================================ G1 - G11 plot data
from tabsight.operators import plotdata as G  # noqa: E402


def _sql_hist(table: str, col: str, bins: int) -> str:
    return f"""SELECT '{col}' AS column_name, g.bin, round(mn + g.bin * ((mx - mn) / {bins}), 6) AS lower,
       round(CASE WHEN g.bin = {bins - 1} THEN mx ELSE mn + (g.bin + 1) * ((mx - mn) / {bins}) END, 6) AS upper,
       coalesce(b.n, 0) AS count
FROM (SELECT range::INTEGER AS bin FROM range({bins})) g
CROSS JOIN (SELECT min(CAST({col} AS DOUBLE)) AS mn, max(CAST({col} AS DOUBLE)) AS mx FROM {table}) r
LEFT JOIN (SELECT CASE WHEN mx = mn THEN 0 ELSE
                    least(CAST(floor((x - mn) / ((mx - mn) / {bins})) AS INTEGER), {bins - 1}) END AS bin,
                  count(*) AS n
           FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL),
                (SELECT min(CAST({col} AS DOUBLE)) AS mn, max(CAST({col} AS DOUBLE)) AS mx FROM {table})
           GROUP BY 1) b ON b.bin = g.bin"""


@register("hist", _sql_hist("orders", "o_totalprice", 30))
def q_hist(spark, sf):
    return rounded(G.histogram(read_table(spark, sf, "orders"), "o_totalprice", 30))


@register("hist_all", " UNION ALL ".join(_sql_hist("events", c, 20)
                                         for c in ["event_id", "user_id", "value"]))
def q_hist_all(spark, sf):
    return rounded(G.all_histograms(read_table(spark, sf, "events"), bins=20))


@register("hist_by_target", """
WITH base AS (SELECT CAST(d.n_chars AS DOUBLE) AS x, CAST(l.quality AS VARCHAR) AS target
              FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT min(x) AS mn, max(x) AS mx FROM base),
c AS (SELECT target, least(CAST(floor((x - mn) / ((mx - mn) / 20)) AS INTEGER), 19) AS bin, count(*) AS n
      FROM base, r GROUP BY ALL)
SELECT t.target, g.bin, round(mn + g.bin * ((mx - mn) / 20), 6) AS lower, coalesce(n, 0) AS count,
       round(coalesce(n, 0) / (sum(n) OVER (PARTITION BY t.target) * ((mx - mn) / 20)), 9) AS density
FROM (SELECT DISTINCT target FROM c) t CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g CROSS JOIN r
LEFT JOIN c ON c.target = t.target AND c.bin = g.bin
""")
def q_hist_by_target(spark, sf):
    base = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
    h = G.histogram_by_target(base, "n_chars", "quality", 20)
    return h.select("target", "bin", F.round("lower", 6).alias("lower"), "count",
                    F.round("density", 9).alias("density"))


@register("kde", """
WITH base AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT min(x) AS mn, max(x) AS mx, stddev_samp(x) * pow(count(*), -0.2) AS h, count(*) AS n FROM base),
c AS (SELECT (x - mn) / ((mx - mn) / 2048) AS place, least(CAST(floor((x - mn) / ((mx - mn) / 2048)) AS INTEGER), 2047) AS cell FROM base, s),
p AS (SELECT cell, sum(w) AS w FROM (SELECT cell, 1 - (place - cell) AS w FROM c UNION ALL SELECT cell + 1, place - cell FROM c) GROUP BY cell),
g AS (SELECT CAST(range AS INTEGER) AS i FROM range(200))
SELECT g.i, round(mn + g.i * ((mx - mn) / 199), 6) AS x,
       round(sum(w * exp(-0.5 * pow(((mn + g.i * ((mx - mn) / 199)) - (mn + cell * ((mx - mn) / 2048))) / h, 2))) / (n * h * sqrt(2 * pi())), 9)
         AS density
FROM g, s, p GROUP BY g.i, mn, mx, h, n
""")
def q_kde(spark, sf):
    k = G.kde(read_table(spark, sf, "events"), "value", 200)
    return k.select("i", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _sql_box(table: str, col: str, by: str | None) -> str:
    g = f"CAST({by} AS VARCHAR)" if by else None
    gsel = f"{g} AS \"group\", " if by else ""
    gby = "GROUP BY 1" if by else ""
    join = 'ON t."group" = q."group"' if by else "ON true"
    return f"""WITH t AS (SELECT {gsel}CAST({col} AS DOUBLE) AS x FROM {table}
           WHERE {col} IS NOT NULL {f'AND {by} IS NOT NULL' if by else ''}),
q AS (SELECT {'"group", ' if by else ''}quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM t {gby})
SELECT '{col}' AS column_name, {'q."group", ' if by else ''}round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3,
       round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       count(*) AS n
FROM t JOIN q {join} GROUP BY {'q."group", ' if by else ''}q1, median, q3"""


@register("boxplot_by", _sql_box("events", "value", "event_type"))
def q_boxplot_by(spark, sf):
    return rounded(G.boxplot(read_table(spark, sf, "events"), "value", by="event_type"))


@register("boxplot_all", " UNION ALL ".join(f"SELECT * FROM ({_sql_box('orders', c, None)})"
                                            for c in ["o_orderkey", "o_custkey", "o_totalprice"]))
def q_boxplot_all(spark, sf):
    return rounded(G.all_boxplots(read_table(spark, sf, "orders")))


@register("feature_vs_target", _sql_box(DOCS_LABELS_SQL, "n_chars", "quality"))
def q_feature_vs_target(spark, sf):
    specs = G.feature_vs_target(docs_labels(spark, sf), "n_chars", "quality",
                                {"numeric"}, {"categorical"})
    return rounded(specs["numeric_categorical"])


@register("category_counts", """
SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY 1
""")
def q_category_counts(spark, sf):
    return G.category_counts(read_table(spark, sf, "part"), "p_brand")


def _sql_summary_numeric(table: str, c: str, dtype: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""
SELECT '{c}' AS column_name, '{dtype}' AS dtype, count({c}) AS valid, round(count({c}) / count(*) * 100, 1) AS valid_pct,
       CAST(count(*) - count({c}) AS BIGINT) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct,
       round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25,
       round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max,
       (SELECT string_agg(count, ',' ORDER BY bin) FROM ({_sql_hist(table, c, 20)})) AS bins,
       CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS VARCHAR) AS top
FROM {table}"""


def _sql_summary_other(table: str, c: str, dtype: str) -> str:
    return f"""
SELECT '{c}' AS column_name, '{dtype}' AS dtype, count({c}) AS valid, round(count({c}) / count(*) * 100, 1) AS valid_pct,
       CAST(count(*) - count({c}) AS BIGINT) AS missing, round((count(*) - count({c})) / count(*) * 100, 1) AS missing_pct,
       CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS q25,
       CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS bins,
       count(DISTINCT {c}) AS n_unique,
       (SELECT string_agg(value || ': ' || n, '; ' ORDER BY n DESC, value)
        FROM (SELECT {c} AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5)) AS top
FROM {table}"""


@register("column_summary", " UNION ALL ".join(
    (_sql_summary_numeric if kind == "numeric" else _sql_summary_other)(DOCS_LABELS_SQL, c, dtype) for c, dtype, kind in DOCS_LABELS_COLS))
def q_column_summary(spark, sf):
    s = G.column_summary(docs_labels(spark, sf))
    top = F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit(": "), t["count"].cast("string"))), "; ")
    return rounded(s.withColumns({"bins": F.array_join(F.transform("bins", lambda n: n.cast("string")), ","), "top": top}))


@register("top_values", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, rank, value, count, round(count / n_rows * 100, 1) AS pct FROM (
  SELECT value, n AS count, sum(n) OVER () AS n_rows,
         row_number() OVER (ORDER BY (CASE WHEN value IS NULL THEN NULL ELSE n END) DESC NULLS LAST, value) AS rank,
         value IS NULL AS is_null_value
  FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {DOCS_LABELS_SQL} GROUP BY 1))
WHERE NOT is_null_value AND rank <= 5""" for c in [c for c, _, _ in DOCS_LABELS_COLS]))
def q_top_values(spark, sf):
    return G.top_k_values(docs_labels(spark, sf), [c for c, _, _ in DOCS_LABELS_COLS], 5).withColumn("rank", F.col("rank").cast("long"))


@register("pair_sample", """
SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL
ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber), 1, 2, 3, 4 LIMIT 500
""")
def q_pair_sample(spark, sf):
    return G.pair_sample(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"],
                         hue="l_returnflag", n=500, key=["l_orderkey", "l_linenumber"])


# ============================================================================ M1 - M5 preparation, E1 folds
from tabsight.operators import prep as M  # noqa: E402
from tabsight.operators import evaluate as E  # noqa: E402


@register("impute_median", f"""
WITH t AS {DOCS_LABELS_SQL}
SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM t)) AS quality,
       coalesce(CAST(toxic AS DOUBLE), (SELECT quantile_cont(toxic, 0.5) FROM t)) AS toxic
FROM t
""")
def q_impute_median(spark, sf):
    dl = docs_labels(spark, sf).select("doc_id", "quality", "toxic")
    return M.ExactImputer(inputCols=["quality", "toxic"], strategy="median").fit(dl).transform(dl)


@register("impute_mode", f"""
WITH t AS {DOCS_LABELS_SQL}
SELECT doc_id,
  coalesce(quality, (SELECT quality FROM t WHERE quality IS NOT NULL GROUP BY quality
                     ORDER BY count(*) DESC, quality LIMIT 1)) AS quality,
  coalesce(toxic, (SELECT toxic FROM t WHERE toxic IS NOT NULL GROUP BY toxic
                   ORDER BY count(*) DESC, toxic LIMIT 1)) AS toxic
FROM t
""")
def q_impute_mode(spark, sf):
    dl = docs_labels(spark, sf).select("doc_id", "quality", "toxic")
    return M.ExactImputer(inputCols=["quality", "toxic"], strategy="most_frequent").fit(dl).transform(dl)


@register("scale", """
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
                         / (SELECT stddev_pop(o_totalprice) FROM orders), 9) AS o_totalprice
FROM orders
""")
def q_scale(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(M.PopulationScaler(inputCols=["o_totalprice"]).fit(o).transform(o), 9)


@register("one_hot", """
WITH cats AS (SELECT list_sort(list(DISTINCT lang)) AS c FROM documents WHERE lang <> 'de')
SELECT doc_id, lang,
  CAST(CASE WHEN lang = c[1] THEN 1 ELSE 0 END AS DOUBLE) AS oh_0,
  CAST(CASE WHEN lang = c[2] THEN 1 ELSE 0 END AS DOUBLE) AS oh_1,
  CAST(CASE WHEN lang = c[3] THEN 1 ELSE 0 END AS DOUBLE) AS oh_2
FROM documents, cats
""")
def q_one_hot(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    model = Pipeline(stages=M.one_hot_stages(["lang"])).fit(docs.where(F.col("lang") != "de"))
    arr = vector_to_array(F.col("lang__oh"))
    return model.transform(docs).select("doc_id", "lang", *[arr[i].alias(f"oh_{i}") for i in range(3)])


@register("ordinal", """
WITH cats AS (SELECT list_sort(list(DISTINCT lang)) AS c FROM documents WHERE lang <> 'de')
SELECT doc_id, lang, CAST(coalesce(list_position(c, lang), 0) - 1 AS INTEGER) AS lang_ord
FROM documents, cats
""")
def q_ordinal(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang")
    m = M.CategoryIndexer(inputCols=["lang"], outputCols=["lang_ord"]).fit(docs.where(F.col("lang") != "de"))
    return m.transform(docs)


@register("ordinal_keys", """
WITH cats AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS position FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 7 <> 0))
SELECT c.c_custkey, CAST(coalesce(position, -1) AS INTEGER) AS name_ord FROM customer c LEFT JOIN cats USING (c_name)
""")
def q_ordinal_keys(spark, sf):
    """A dictionary with one category per customer; every seventh is unknown at fit."""
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    m = M.CategoryIndexer(inputCols=["c_name"], outputCols=["name_ord"]).fit(customers.where("c_custkey % 7 <> 0"))
    return m.transform(customers).select("c_custkey", "name_ord")


@register("stratified_folds", """
SELECT doc_id, quality,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1)
            % 5 AS INTEGER) AS fold
FROM labels
""")
def q_stratified_folds(spark, sf):
    lab = read_table(spark, sf, "labels").select("doc_id", "quality")
    return E.stratified_folds(lab, "quality", "doc_id", k=5, seed=42)


# ============================================================================ M9 neighbours
from tabsight.operators import models as MD  # noqa: E402


@register("knn", """
WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1)
                  % 5 AS fold
           FROM embeddings),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, list_distance(q.v, t.v) AS dist
      FROM f q JOIN f t ON q.fold = 0 AND t.fold <> 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, tid, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rank FROM d) WHERE rank <= 5
""")
def q_knn(spark, sf):
    emb = E.stratified_folds(read_table(spark, sf, "embeddings"), "label", "vec_id", k=5, seed=42)
    vec = F.col("embedding").cast("array<double>")
    query = emb.where(F.col("fold") == 0).select(F.col("vec_id").alias("qid"), vec.alias("qv"))
    train = emb.where(F.col("fold") != 0).select(F.col("vec_id").alias("tid"), vec.alias("tv"),
                                                 F.col("label").cast("double").alias("tlabel"))
    nb = MD.knn_neighbours(query, train, k=5, p=2)
    return nb.select("qid", "rank", "tid", F.round("dist", 6).alias("dist"))


# ============================================================================ M8 - M16, E2 - E4 (rows checks)
from tabsight.operators import select as SL  # noqa: E402
from tabsight.operators import candidates as CD  # noqa: E402
from tabsight.operators import tune as TN  # noqa: E402

MODEL_NUM = ["n_chars"]
MODEL_CAT = ["lang", "source"]


def model_frame(spark, sf):
    """documents JOIN labels with a double label and stratified folds (seed 42, k 5)."""
    d = (read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
         .select("doc_id", "n_chars", "lang", "source", F.col("quality").cast("double").alias("quality")))
    return E.stratified_folds(d, "quality", "doc_id", k=5, seed=42)


def _builder(name, **params):
    def build(cols):
        num = [c for c in cols if c in MODEL_NUM or c.startswith(("log", "freq", "groupby"))]
        cat = [c for c in cols if c not in num]
        return MD.make_classifier(name, num, cat, label="quality", id_col="doc_id", **params)
    return build


@register("cv_logreg")
def q_cv_logreg(spark, sf):
    data = model_frame(spark, sf)
    m, s, sc = E.cv_scores(_builder("logreg", C=100.0, max_iter=100)(MODEL_NUM + MODEL_CAT), data, "quality")
    return E.cv_frame(spark, "logreg", m, s, sc)


@register("compare_models")
def q_compare_models(spark, sf):
    data = model_frame(spark, sf)
    cols = MODEL_NUM + MODEL_CAT
    builders = {"logreg": lambda: _builder("logreg", C=100.0, max_iter=100)(cols),
                "tree": lambda: _builder("tree")(cols),
                "rf": lambda: _builder("rf", n_estimators=50)(cols),
                "gb": lambda: _builder("gb", n_estimators=20)(cols)}
    return E.compare_models(builders, data, "quality")


@register("coef_report")
def q_coef_report(spark, sf):
    data = model_frame(spark, sf)
    fitted = _builder("logreg", C=100.0, max_iter=100)(MODEL_NUM + MODEL_CAT).fit(data)
    return MD.coefficient_report(fitted, MD.feature_names(fitted, data))


@register("knn_classify")
def q_knn_classify(spark, sf):
    from pyspark.ml.functions import array_to_vector
    emb = E.stratified_folds(read_table(spark, sf, "embeddings"), "label", "vec_id", k=5, seed=42)
    data = emb.select("vec_id", "fold", F.col("label").cast("double").alias("label"),
                      array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    knn = MD.KNNClassifier(k=14, p=2, weights="distance", idCol="vec_id", labelCol="label")
    m, s, sc = E.cv_scores(knn, data, "label")
    return E.cv_frame(spark, "knn", m, s, sc)


@register("tree")
def q_tree(spark, sf):
    data = model_frame(spark, sf)
    m, s, sc = E.cv_scores(_builder("tree")(MODEL_NUM + MODEL_CAT), data, "quality")
    return E.cv_frame(spark, "tree", m, s, sc)


@register("forest")
def q_forest(spark, sf):
    data = model_frame(spark, sf)
    m, s, sc = E.cv_scores(_builder("rf", n_estimators=100)(MODEL_NUM + MODEL_CAT), data, "quality")
    return E.cv_frame(spark, "rf", m, s, sc)


@register("boosted")
def q_boosted(spark, sf):
    data = model_frame(spark, sf)
    m, s, sc = E.cv_scores(_builder("xgb", n_estimators=20)(MODEL_NUM + MODEL_CAT), data, "quality")
    return E.cv_frame(spark, "xgb", m, s, sc)


# ============================================================================ F2 - F12, F17 (rows checks)
@register("ablation")
def q_ablation(spark, sf):
    return SL.feature_ablation_all(_builder("logreg", max_iter=100), model_frame(spark, sf),
                                   MODEL_NUM + MODEL_CAT, "quality")


@register("permutation")
def q_permutation(spark, sf):
    data = model_frame(spark, sf)
    model = _builder("logreg", max_iter=100)(MODEL_NUM + MODEL_CAT).fit(data.where(F.col("fold") != 0))
    return SL.permutation_importance(model, data.where(F.col("fold") == 0), MODEL_NUM + MODEL_CAT,
                                     "quality", key="doc_id", n_repeats=3)


@register("removal_sets")
def q_removal_sets(spark, sf):
    return SL.removal_combinations(_builder("logreg", max_iter=100), model_frame(spark, sf), MODEL_NUM + MODEL_CAT,
                                   ["lang", "source"], "quality")


@register("snr_rank")
def q_snr_rank(spark, sf):
    data = model_frame(spark, sf)
    base, gains = SL.single_gains(_builder("logreg", max_iter=100), data, ["lang"], ["n_chars", "source"], "quality")
    df = spark.createDataFrame(gains, "col string, mean double, std double, delta double")
    return SL.signal_to_noise(df)


LI_CANDIDATE_REGISTRY = [
    ("log(l_extendedprice)", "log", ["l_extendedprice"], "ln(abs(`l_extendedprice`) + 1)"),
    ("l_extendedprice/l_quantity", "/", ["l_extendedprice", "l_quantity"],
     "try_divide(`l_extendedprice`, `l_quantity`)"),
    ("l_quantity*l_discount", "*", ["l_quantity", "l_discount"], "(`l_quantity` * `l_discount`)"),
    ("freq(l_returnflag)", "freq", ["l_returnflag"], None),
    ("groupby_then_mean(l_returnflag,l_extendedprice)", "groupby_then_mean",
     ["l_returnflag", "l_extendedprice"], None),
    ("groupby_then_rank(l_returnflag,l_quantity)", "groupby_then_rank", ["l_returnflag", "l_quantity"], None),
]
LI_CAND_NAMES = [r[0] for r in LI_CANDIDATE_REGISTRY]

_LI_CAND_SQL = """
SELECT l_orderkey, l_linenumber{extra},
  round(ln(abs(l_extendedprice) + 1), 9) AS "log(l_extendedprice)",
  round(CASE WHEN l_quantity = 0 THEN NULL ELSE l_extendedprice / l_quantity END, 9) AS "l_extendedprice/l_quantity",
  round(l_quantity * l_discount, 9) AS "l_quantity*l_discount",
  count(*) OVER (PARTITION BY l_returnflag) AS "freq(l_returnflag)",
  round(avg(l_extendedprice) OVER (PARTITION BY l_returnflag), 9) AS "groupby_then_mean(l_returnflag,l_extendedprice)",
  round(((rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1)
         + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) + 1) / 2.0)
        / count(*) OVER (PARTITION BY l_returnflag), 9) AS "groupby_then_rank(l_returnflag,l_quantity)"
FROM lineitem
"""


@register("apply_candidates", _LI_CAND_SQL.format(extra=""))
def q_apply_candidates(spark, sf):
    li = read_table(spark, sf, "lineitem")
    out = CD.apply_candidates(li, LI_CANDIDATE_REGISTRY)
    return rounded(out.select("l_orderkey", "l_linenumber", *[F.col(f"`{n}`") for n in LI_CAND_NAMES]), 9)


@register("corr_filter", f"""
WITH j AS ({_LI_CAND_SQL.format(extra=", l_quantity, l_extendedprice, l_discount, l_tax")}),
long AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS candidate, '{b}' AS base, abs(corr(\"{c}\", CAST({b} AS DOUBLE))) AS r FROM j"
    for c in LI_CAND_NAMES for b in ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])})
SELECT candidate, arg_max(base, {{'r': coalesce(r, -1), 'p': -list_position(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], base)}}) AS correlated_with,
       round(max(r), 4) AS corr, coalesce(max(r) >= 0.95, false) AS dropped
FROM long GROUP BY candidate
""")
def q_corr_filter(spark, sf):
    li = read_table(spark, sf, "lineitem")
    out = CD.apply_candidates(li, LI_CANDIDATE_REGISTRY)
    return SL.correlation_filter(out, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                                 LI_CAND_NAMES, threshold=0.95)


DOC_CANDIDATES = [
    ("log(n_chars)", "log", ["n_chars"], "ln(abs(`n_chars`) + 1)"),
    ("freq(source)", "freq", ["source"], None),
    ("groupby_then_mean(lang,n_chars)", "groupby_then_mean", ["lang", "n_chars"], None),
]


@register("permuted_column", """
WITH k AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders),
d AS (SELECT o_totalprice AS donor, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS pos FROM orders)
SELECT k.o_orderkey, k.o_custkey, d.donor AS o_totalprice FROM k JOIN d ON k.pos = d.pos
""")
def q_permuted_column(spark, sf):
    return SL.permute_column(read_table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 42).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@register("greedy")
def q_greedy(spark, sf):
    data = CD.apply_candidates(model_frame(spark, sf), DOC_CANDIDATES)
    _, hist = SL.greedy_select(_builder("logreg", max_iter=100), data, MODEL_NUM + MODEL_CAT,
                               [r[0] for r in DOC_CANDIDATES], "quality", threshold=0.001)
    return hist


@register("batch_ablation")
def q_batch_ablation(spark, sf):
    data = CD.apply_candidates(model_frame(spark, sf), DOC_CANDIDATES)
    return SL.batch_ablation(_builder("logreg", max_iter=100), data, MODEL_NUM + MODEL_CAT,
                             [r[0] for r in DOC_CANDIDATES], "quality", step=1)


@register("registry")
def q_registry(spark, sf):
    data = CD.apply_candidates(model_frame(spark, sf), DOC_CANDIDATES)
    names = [r[0] for r in DOC_CANDIDATES]
    _, hist = SL.greedy_select(_builder("logreg", max_iter=100), data, MODEL_NUM + MODEL_CAT, names, "quality")
    drops = SL.correlation_filter(data, MODEL_NUM, names)
    reg = spark.createDataFrame(DOC_CANDIDATES, CD.REGISTRY_SCHEMA)
    return SL.feature_registry(reg, hist, drops)


@register("feature_sets")
def q_feature_sets(spark, sf):
    sets = {"all": MODEL_NUM + MODEL_CAT, "no_source": ["n_chars", "lang"], "only_lang": ["lang"]}
    return SL.compare_feature_sets(_builder("logreg", max_iter=100), model_frame(spark, sf), sets, "quality")


CAND_NUM = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAND_CAT = ["l_returnflag", "l_linenumber"]


def _sql_candidate(op: str, inputs: list[str]) -> str:
    """A candidate of the default families as plain SQL over lineitem."""
    x = [f"CAST({c} AS DOUBLE)" for c in inputs]
    if op in ("abs", "log", "sqrt", "square", "sigmoid", "round"):
        return {"abs": f"abs({x[0]})", "log": f"ln(abs({x[0]}) + 1)", "sqrt": f"sqrt(abs({x[0]}))", "square": f"pow({x[0]}, 2)",
                "sigmoid": f"1 / (1 + exp(-{x[0]}))", "round": f"round({x[0]}, 0)"}[op]
    if op == "freq":
        return f"count(*) OVER (PARTITION BY {inputs[0]})"
    if op in ("+", "-", "*"):
        return f"{x[0]} {op} {x[1]}"
    if op == "/":
        return f"CASE WHEN {x[1]} = 0 THEN NULL ELSE {x[0]} / {x[1]} END"
    if op in ("min", "max"):
        return f"{'least' if op == 'min' else 'greatest'}({x[0]}, {x[1]})"
    over, stat = f"OVER (PARTITION BY {inputs[0]})", op.removeprefix("groupby_then_")
    if stat == "nunique":
        return f"(SELECT count(DISTINCT i.{inputs[1]}) FROM lineitem i WHERE i.{inputs[0]} = lineitem.{inputs[0]})"
    if stat == "rank":
        return (f"((rank() OVER (PARTITION BY {inputs[0]} ORDER BY {inputs[1]}) - 1) + (count(*) OVER (PARTITION BY {inputs[0]}, {inputs[1]}) + 1) / 2.0)"
                f" / count(*) {over}")
    fn = {"mean": f"avg({x[1]})", "std": f"stddev_samp({x[1]})", "median": f"quantile_cont({x[1]}, 0.5)"}.get(stat, f"{stat}({x[1]})")
    return f"{fn} {over}"


def lineitem_candidates() -> list[tuple]:
    """The default families over all numeric columns but the key, and the columns of few values."""
    return CD.candidate_rows(CAND_NUM, CAND_CAT)


_CANDIDATES_SQL = """
WITH j AS (SELECT l_linestatus AS y, {columns} FROM lineitem),
s AS (SELECT {sorted} FROM j),
e AS (SELECT {edges} FROM s),
cells AS ({cells}),
nx AS (SELECT "column", x, sum(n) AS nx FROM cells GROUP BY ALL),
ny AS (SELECT "column", y, sum(n) AS ny FROM cells GROUP BY ALL),
nt AS (SELECT "column", sum(n) AS nt FROM cells GROUP BY ALL)
SELECT "column", round(greatest(sum(n / nt * ln(n * nt / (nx * ny))), 0.0), 6) AS score
FROM cells JOIN nx USING ("column", x) JOIN ny USING ("column", y) JOIN nt USING ("column") GROUP BY "column"
"""


def _sql_candidates() -> str:
    # not quantile_cont: its interpolation between two equal values can end beside them, on the other side of a bin edge
    rows = lineitem_candidates()
    tenths, at = ", ".join(f"CAST({i / 10} AS DOUBLE)" for i in range(1, 10)), "(len(s{k}) - 1) * p"
    low, high = (f"s{{k}}[CAST({fn}({at}) AS BIGINT) + 1]" for fn in ("floor", "ceil"))
    edge = f"list_transform([{tenths}], lambda p: {low} + ({at} - floor({at})) * ({high} - {low})) AS e{{k}}"
    cells = [f"SELECT '{name}' AS \"column\", len(list_filter(list_distinct(e{k}), lambda v: v < c{k})) AS x, y, count(*) AS n "
             f"FROM j, e WHERE c{k} IS NOT NULL GROUP BY ALL" for k, (name, *_) in enumerate(rows)]
    return _CANDIDATES_SQL.format(columns=", ".join(f"CAST({_sql_candidate(op, inputs)} AS DOUBLE) AS c{k}" for k, (_, op, inputs, _) in enumerate(rows)),
                                  sorted=", ".join(f"list_sort(list(c{k}) FILTER (WHERE c{k} IS NOT NULL)) AS s{k}" for k in range(len(rows))),
                                  edges=", ".join(edge.format(k=k) for k in range(len(rows))), cells=" UNION ALL ".join(cells))


@register("candidates", _sql_candidates())
def q_candidates(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_linestatus", *dict.fromkeys(CAND_NUM + CAND_CAT))
    scored = CD.score_candidates(li, lineitem_candidates(), "l_linestatus")
    return scored.select("column", F.round("score", 6).alias("score"))


@register("candidate_report")
def q_candidate_report(spark, sf):
    """The best thirty candidates with their formulas."""
    docs = model_frame(spark, sf)
    reg = CD.generate_candidates(spark, MODEL_NUM, MODEL_CAT)
    return CD.importance_report(CD.top_candidates(CD.score_candidates(docs, reg, "quality"), 30), 30)


# ============================================================================ T1 - T3 (rows checks)
@register("random_search")
def q_random_search(spark, sf):
    data = model_frame(spark, sf)
    trials, best, _ = TN.search(lambda p: _builder("logreg", max_iter=100, **p)(MODEL_NUM + MODEL_CAT), "logreg",
                                data, "quality", n_iter=4, refit=False)
    return trials


# ============================================================================ P3 / P4 roles, P9, P11, P12
from tabsight.operators.freq import column_stats as _column_stats  # noqa: E402


@register("col_roles", f"""
SELECT column_name, logical_type,
  CASE WHEN logical_type = 'numeric' THEN 'numeric'
       WHEN logical_type IN ('categorical', 'boolean', 'high_cardinality') THEN 'categorical'
       ELSE logical_type END AS pair_type,
  list_sort(list_filter([CASE WHEN logical_type = 'numeric' THEN 'numeric' END,
                         CASE WHEN logical_type IN ('categorical', 'boolean', 'high_cardinality')
                                   OR (kind = 'numeric' AND n_unique <= 10) THEN 'categorical' END],
                        lambda r: r IS NOT NULL)) AS roles
FROM (SELECT *, CASE WHEN dtype IN ('bigint', 'int', 'double') THEN 'numeric' ELSE 'text' END AS kind
      FROM {_stats_sql(DOCS_LABELS_SQL, DOCS_LABELS_COLS, 'quality')})
""")
def q_col_roles(spark, sf):
    from tabsight.functions.types import roles_expr, simplify_expr
    st = _column_stats(docs_labels(spark, sf), "quality")
    return st.select("column_name", "logical_type", simplify_expr(F.col("logical_type")).alias("pair_type"),
                     roles_expr(F.col("logical_type"), F.col("kind"), F.col("n_unique")).alias("roles"))


@register("flag_below", """
SELECT l_orderkey, l_linenumber, CAST(coalesce(l_quantity < 16, false) AS INTEGER) AS is_small FROM lineitem
""")
def q_flag_below(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.flag_below(li, "l_quantity", 16, "is_small").select("l_orderkey", "l_linenumber", "is_small")


@register("outlier_rows", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
""")
def q_outlier_rows(spark, sf):
    ev = read_table(spark, sf, "events")
    return P.detect_outliers_iqr(ev, "value").where("is_outlier").select("event_id", "value")


@register("box_outliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value FROM events e JOIN q USING (event_type)
WHERE e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1)
""")
def q_box_outliers(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "event_type", "value")
    return G.box_outlier_rows(ev, "value", by="event_type")


@register("regression_line", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
       regr_count(l_extendedprice, l_quantity) AS n
FROM lineitem
""")
def q_regression_line(spark, sf):
    return rounded(G.regression_line(read_table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@register("qcut_learned", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0]) AS edges FROM orders
           WHERE o_orderstatus = 'F')
SELECT o_orderkey, CAST(len(list_filter(edges[2:4], lambda v: v < o_totalprice)) AS INTEGER) AS price_bin
FROM orders, e
""")
def q_qcut_learned(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    m = X.QuantileBinner(inputCol="o_totalprice", outputCol="price_bin", numBins=4).fit(
        o.where(F.col("o_orderstatus") == "F"))
    return m.transform(o).select("o_orderkey", "price_bin")


@register("score_bands", f"""
WITH s AS ({ORACLE_SQL['mutual_info']})
SELECT feature, mi, '>=0.005' AS band FROM s WHERE mi >= 0.005
UNION ALL SELECT feature, mi, '>=0.002' FROM s WHERE mi >= 0.002
UNION ALL SELECT feature, mi, '>=0.001' FROM s WHERE mi >= 0.001
UNION ALL SELECT feature, mi, '>0.0' FROM s WHERE mi > 0.0
""")
def q_score_bands(spark, sf):
    mi = QUERIES["mutual_info"](spark, sf)
    return SL.threshold_bands(mi, "mi", [0.005, 0.002, 0.001, 0.0])


@register("group_size_learned", """
SELECT s_suppkey, coalesce(n.size, 1) AS customers_there
FROM supplier LEFT JOIN (SELECT c_nationkey, count(*) AS size FROM customer GROUP BY c_nationkey) n ON s_nationkey = c_nationkey
""")
def q_group_size_learned(spark, sf):
    from tabsight.operators.features import GroupSizeEncoder
    nations = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    model = GroupSizeEncoder(inputCol="nation", outputCol="customers_there").fit(nations)
    suppliers = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return model.transform(suppliers).select("s_suppkey", "customers_there")


# ============================================================================ E5, F16 (rows checks)
@register("experiment")
def q_experiment(spark, sf):
    from tabsight.plans.experiment import run_experiment
    from tabsight.operators.features import GroupSizeEncoder, QuantileBinner
    d = (read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id")
         .select("doc_id", "n_chars", "lang", "source", "quality"))
    learned = [GroupSizeEncoder(inputCol="source", outputCol="source_rows"),
               QuantileBinner(inputCol="n_chars", outputCol="n_chars_bin", numBins=4)]
    scores, _ = run_experiment(d, "quality", "doc_id", [*MODEL_NUM, "source_rows", "n_chars_bin"], MODEL_CAT, model="logreg",
                               params={"C": 100.0, "max_iter": 100}, learned=learned)
    return scores


@register("candidate_stage")
def q_candidate_stage(spark, sf):
    stage = CD.CandidateFeatureStage(_builder("logreg", max_iter=100), MODEL_NUM, MODEL_CAT, "quality")
    return stage.fit(model_frame(spark, sf)).registry_


# ============================================================================ A15 / A16 reports
_DL_FEATURES = ["doc_id", "text", "lang", "source", "n_chars", "toxic"]
_DL_NUMBERS = ["doc_id", "n_chars", "toxic"]


def _sql_report(name: str, sql: str, item: str, numbers: list[str], texts: list[str] = ()) -> str:
    """A report table in long form: a row for each value."""
    cells = [f"SELECT '{name}' AS report, {item} AS item, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS number, CAST(NULL AS VARCHAR) AS text FROM ({sql})"
             for m in numbers]
    cells += [f"SELECT '{name}', {item}, '{m}', CAST(NULL AS DOUBLE), {m} FROM ({sql})" for m in texts]
    return " UNION ALL ".join(cells or [f"SELECT '{name}' AS report, {item} AS item, 'listed' AS metric, 1.0 AS number, CAST(NULL AS VARCHAR) AS text FROM ({sql})"])


_BASIC_SQL = " UNION ALL ".join([
    _sql_report("overview", ORACLE_SQL["overview"], "column_name", ["is_target", "n_missing", "pct_missing", "n_unique", "pct_unique"], ["dtype", "logical_type"]),
    _sql_report("duplicates", f"""SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(n - 1) / sum(n) * 100, 2) AS pct_duplicates
        FROM (SELECT count(*) AS n FROM {DOCS_LABELS_SQL} GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY " + ", ".join(c for c, _, _ in DOCS_LABELS_COLS)),
                "'all'", ["n_duplicates", "n_rows", "pct_duplicates"]),
    _sql_report("missing", ORACLE_SQL["missing_summary"], "column_name", ["n_missing", "pct_missing"]),
    _sql_report("numeric_summary", _sql_numeric(DOCS_LABELS_SQL, _DL_NUMBERS), "column_name", P.NUMERIC_STATS),
    _sql_report("categorical_summary", ORACLE_SQL["describe_categorical_target"], "column_name", ["n_unique", "top_freq", "top_pct", "missing", "pct_missing"], ["top"]),
    _sql_report("cardinality", " UNION ALL ".join(
        f"SELECT column_name, n_unique AS nunique, missing AS n_missing, top AS top_value, top_freq FROM ({_sql_top(DOCS_LABELS_SQL, c)})" for c in ["text", "lang", "source"]),
        "column_name", ["nunique", "n_missing", "top_freq"], ["top_value"]),
    _sql_report("constant_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM {DOCS_LABELS_SQL} HAVING count(DISTINCT {c}) <= 1" for c in _DL_FEATURES),
                "column_name", []),
    _sql_report("quasi_constant_columns", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(max(n) / sum(n), 6) AS top_share FROM (SELECT {c}, count(*) AS n FROM {DOCS_LABELS_SQL} GROUP BY 1) HAVING max(n) / sum(n) >= 0.99"
        for c in _DL_FEATURES), "column_name", ["top_share"]),
    _sql_report("target_summary", ORACLE_SQL["target_summary"], "coalesce(value, 'NULL')", ["count", "ratio"]),
])
_DL_PEARSON = _sql_pearson(DOCS_LABELS_SQL, _DL_NUMBERS)
_FULL_SQL = " UNION ALL ".join([
    _BASIC_SQL,
    _sql_report("low_variance_columns", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, var_samp(CAST({c} AS DOUBLE)) AS variance FROM {DOCS_LABELS_SQL} HAVING var_samp(CAST({c} AS DOUBLE)) <= 0.01" for c in _DL_NUMBERS),
        "column_name", ["variance"]),
    _sql_report("correlation_matrix", _DL_PEARSON, "feature_1 || '|' || feature_2", ["correlation"]),
    _sql_report("multicollinearity", f"""SELECT feature_1, feature_2, round(correlation, 4) AS correlation
        FROM ({_sql_pearson(DOCS_LABELS_SQL, _DL_NUMBERS, full=False, digits=15)}) WHERE abs(correlation) >= 0.9""", "feature_1 || '|' || feature_2", ["correlation"]),
    _sql_report("target_correlation", f"""SELECT feature_1 AS feature, correlation AS correlation_with_target
        FROM ({_sql_pearson(DOCS_LABELS_SQL, _DL_NUMBERS + ['quality'])}) WHERE feature_2 = 'quality' AND feature_1 <> 'quality'""", "feature", ["correlation_with_target"]),
])


@register("basic_eda", _BASIC_SQL)
def q_basic_eda(spark, sf):
    from tabsight.plans.report import TableProfile, report_table
    return report_table(TableProfile(docs_labels(spark, sf), "quality").run_basic_eda())


@register("full_report", _FULL_SQL)
def q_full_report(spark, sf):
    from tabsight.plans.report import TableProfile, report_table
    return report_table(TableProfile(docs_labels(spark, sf), "quality").full_report())


# ============================================================================ G6 / G7 / G10 dispatch
_LEVELS_SQL = f"SELECT CAST(lang AS VARCHAR) AS value, CAST(quality AS VARCHAR) AS target, count(*) AS count FROM {DOCS_LABELS_SQL} GROUP BY ALL"


@register("target_distribution", f"""
SELECT CAST(quality AS VARCHAR) AS value, count(*) AS count FROM {DOCS_LABELS_SQL} GROUP BY 1
""")
def q_target_distribution(spark, sf):
    return G.target_distribution(docs_labels(spark, sf), "quality")


@register("target_distribution_numeric", _sql_hist("orders", "o_totalprice", 30))
def q_target_distribution_numeric(spark, sf):
    return rounded(G.target_distribution(read_table(spark, sf, "orders"), "o_totalprice"))


@register("feature_distribution", f"""
SELECT value, target, count FROM ({_LEVELS_SQL}) WHERE value IS NOT NULL AND target IS NOT NULL
""")
def q_feature_distribution(spark, sf):
    return G.feature_distribution(docs_labels(spark, sf), "lang", "quality")


def _sql_view(view: str, sql: str, item: str, numbers: list[str]) -> str:
    return _sql_report(view, sql, item, numbers)


# every view of a pair: which ones apply follows from the roles of both columns
@register("feature_views", " UNION ALL ".join([
    _sql_view("quality|n_chars|numeric_categorical", _sql_box(DOCS_LABELS_SQL, "n_chars", "quality"), '"group"',
              ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers", "n"]),
    _sql_view("quality|lang|categorical_categorical", _LEVELS_SQL, "coalesce(value, 'NULL') || '|' || coalesce(target, 'NULL')", ["count"]),
    _sql_view("l_extendedprice|l_quantity|numeric_numeric", "SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_count(y, x) AS n "
              "FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem)", "'all'", ["slope", "intercept", "r2", "n"]),
    _sql_view("l_extendedprice|l_returnflag|categorical_numeric", _sql_box("lineitem", "l_extendedprice", "l_returnflag"), '"group"',
              ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers", "n"]),
    _sql_view("l_extendedprice|l_linenumber|categorical_numeric", _sql_box("lineitem", "l_extendedprice", "l_linenumber"), '"group"',
              ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers", "n"]),
    _sql_view("l_extendedprice|l_linenumber|numeric_numeric", "SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, regr_count(y, x) AS n "
              "FROM (SELECT l_extendedprice AS y, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem)", "'all'", ["slope", "intercept", "r2", "n"]),
]))
def q_feature_views(spark, sf):
    """Four columns against two targets; the scatter samples, whose order is free, are left to ``pair_sample``."""
    from tabsight.plans.report import long_rows
    parts = []
    for df, target, cols in ((docs_labels(spark, sf), "quality", ["n_chars", "lang"]),
                             (read_table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_returnflag", "l_linenumber"])):
        roles = G.column_roles(df, [target, *cols])  # the target's are found once
        for col in cols:
            for view, data in G.feature_vs_target(df, col, target, roles[col], roles[target]).items():
                if not view.endswith("_points"):
                    keys = [k for k in ("group", "value", "target") if k in data.columns]
                    parts.append(long_rows(f"{target}|{col}|{view}", data.drop("column_name"), keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
