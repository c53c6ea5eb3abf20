"""The data behind the profiler's charts (drawing is left to the caller).

* histograms: equal-width bins over [min, max] (last bin closed); min/max come
  from a one-row aggregate attached by a broadcast of that row, empty bins are
  filled from ``sequence(0, bins-1)``;
* box plots: per-group quartiles joined back to the counts of each group's values (one
  scan), whiskers = extreme values inside 1.5 IQR, outlier counts;
* densities by target level, Gaussian KDE on a grid (rows shared out to a fine grid
  first, so the sum is points x grid);
* column summaries: moments, quantiles and bins from shared scans, top-k values from the
  value-frequency table (a partial group limit before the shuffle);
* a bounded, hash-ordered sample for scatter plots.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions.stats import pct
from tabsight.operators.quantiles import counted_quantile_arrays, grouped_quantile_arrays
from tabsight.session import ensure_checkpoint_dir
from tabsight.functions.types import check_col, numeric_cols, storage_kind

#: Cells that a density's rows are shared out to.
KDE_CELLS = 2048
#: Groups of a box plot whose quartiles are sent to every task; those of more are joined.
FEW_GROUPS = 10_000
HIST_SCHEMA = "column_name string, bin int, lower double, upper double, count bigint"


def _c(name: str):
    return F.col(f"`{name}`")


# ----------------------------------------------------------------------------- G2 / G3
def histogram_long(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """(column_name, bin, lower, upper, count) for every numeric column, one job."""
    if not cols:
        return df.sparkSession.createDataFrame([], HIST_SCHEMA)
    long = (df.select(F.inline(F.array(*[
                F.struct(F.lit(c).alias("column_name"), _c(c).cast("double").alias("x"))
                for c in cols])))
              .where(F.col("x").isNotNull()))
    rng = long.groupBy("column_name").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / F.lit(bins)
    # range table: one row per column (bounded by the column count)
    binned = (long.join(F.broadcast(rng), "column_name")
                  .withColumn("bin", F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(
                      F.least(F.floor((F.col("x") - F.col("mn")) / width).cast("int"),
                              F.lit(bins - 1))))
                  .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = rng.select("column_name", "mn", "mx",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(binned, ["column_name", "bin"], "left")
                .select("column_name", "bin",
                        (F.col("mn") + F.col("bin") * width).alias("lower"),
                        F.when(F.col("bin") == bins - 1, F.col("mx"))
                         .otherwise(F.col("mn") + (F.col("bin") + 1) * width).alias("upper"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    check_col(df, col)
    return histogram_long(df, [col], bins)


def all_histograms(df: DataFrame, target: str | None = None, bins: int = 30) -> DataFrame:
    return histogram_long(df, numeric_cols(df, target), bins)


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of non-null values by frequency (categorical distribution view)."""
    return (df.where(_c(col).isNotNull()).groupBy(_c(col).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), "value"))


def distribution(df: DataFrame, col: str, col_type: str, bins: int = 30) -> DataFrame:
    """G2 dispatch: numeric -> histogram, categorical/boolean -> counts, else error."""
    if col_type == "numeric":
        return histogram(df, col, bins)
    if col_type in ("categorical", "boolean"):
        return category_counts(df, col)
    raise ValueError(f"no distribution for {col!r}, whose type is {col_type}")


def target_distribution(df: DataFrame, target: str, target_type: str | None = None, bins: int = 30) -> DataFrame:
    """G7: histogram of a numeric target, else counts by frequency with NULL as a value."""
    from tabsight.operators.profile import logical_type_of
    check_col(df, target)
    if (target_type or logical_type_of(df, target)) == "numeric":
        return histogram(df, target, bins)
    return (df.groupBy(_c(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc_nulls_first("value")))


# ----------------------------------------------------------------------------- G4 / G5
def boxplot_long(df: DataFrame, cols: list[str], by: str | None = None,
                 factor: float = 1.5, approx: bool = False) -> DataFrame:
    """Box statistics per (column, group): quartiles, whiskers, outlier count."""
    structs = [F.struct(F.lit(c).alias("column_name"), _c(c).cast("double").alias("x")) for c in cols]
    sel = [F.inline(F.array(*structs))]
    if by is not None:
        sel = [_c(by).cast("string").alias("group")] + sel
    long = df.select(*sel).where(F.col("x").isNotNull())
    keys = ["column_name"]
    if by is not None:
        # rows without a group level are not drawn
        long = long.where(F.col("group").isNotNull())
        keys.append("group")
    # everything but approximate quartiles follows from how often each value occurs, so the rows are read once
    ensure_checkpoint_dir(df.sparkSession)
    counts = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    number = F.col("x") + F.lit(0.0)
    q = (grouped_quantile_arrays(long, keys, "x", [0.25, 0.5, 0.75], "approx") if approx else
         counted_quantile_arrays(counts.where(~F.isnan("x")).select(*keys, number.alias("x"), "n"), keys, "x", "n", [0.25, 0.5, 0.75]))
    q = (q.select(*[F.col(k).alias(f"__{k}") for k in keys],
                     F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                     F.col("q")[2].alias("q3")).checkpoint(eager=True))
    lo = F.col("q1") - factor * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    # quartile table: one row per (column, group), which every task gets unless there are very many groups
    few = q.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    cond = [F.col(k) == F.col(f"__{k}") for k in keys]
    j = counts.join(F.broadcast(q) if few else q, cond).select(*keys, "x", "n", "q1", "median", "q3")
    return (j.groupBy(*keys, "q1", "median", "q3")
             .agg(F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_low"),
                  F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_high"),
                  F.coalesce(F.sum(F.when((F.col("x") < lo) | (F.col("x") > hi), F.col("n"))), F.lit(0)).cast("long").alias("n_outliers"),
                  F.sum("n").alias("n")))


def boxplot(df: DataFrame, col: str, by: str | None = None, factor: float = 1.5) -> DataFrame:
    check_col(df, col)
    if by is not None:
        check_col(df, by)
    return boxplot_long(df, [col], by, factor)


def all_boxplots(df: DataFrame, target: str | None = None) -> DataFrame:
    return boxplot_long(df, numeric_cols(df, target))


def box_outlier_rows(df: DataFrame, col: str, by: str | None = None, factor: float = 1.5) -> DataFrame:
    """The rows drawn as outlier points of ``boxplot(col, by)``."""
    box = boxplot(df, col, by, factor)
    keys = [] if by is None else [by]
    b = box.select(*([F.col("group").alias("__g")] if by else []), "q1", "q3")
    lo = F.col("q1") - factor * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + factor * (F.col("q3") - F.col("q1"))
    j = (df.join(b, _c(by).cast("string").eqNullSafe(F.col("__g"))) if keys
         else df.crossJoin(F.broadcast(b)))
    return j.where((_c(col) < lo) | (_c(col) > hi)).select(*df.columns)


# ----------------------------------------------------------------------------- G6
def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS line of y on x over complete rows: slope, intercept, r2, n."""
    xs, ys = _c(x).cast("double"), _c(y).cast("double")
    return df.agg(F.regr_slope(ys, xs).alias("slope"), F.regr_intercept(ys, xs).alias("intercept"),
                  F.regr_r2(ys, xs).alias("r2"), F.regr_count(ys, xs).alias("n"))


def pair_counts(df: DataFrame, col: str, target: str) -> DataFrame:
    """Counts per (value, target value) - the categorical vs categorical view."""
    return (df.groupBy(_c(col).cast("string").alias("value"), _c(target).cast("string").alias("target"))
              .agg(F.count(F.lit(1)).alias("count")))


def column_roles(df: DataFrame, cols: list[str]) -> dict[str, set[str]]:
    """Plot roles of columns, from the statistics of these columns alone."""
    from tabsight.functions.types import roles_expr
    from tabsight.operators.freq import column_stats
    roles = roles_expr(F.col("logical_type"), F.col("kind"), F.col("n_unique"))
    return {r["column_name"]: set(r["roles"]) for r in column_stats(df.select(*[_c(c) for c in cols])).select("column_name", roles.alias("roles")).collect()}


def feature_vs_target(df: DataFrame, col: str, target: str, col_roles: set[str] | None = None,
                      target_roles: set[str] | None = None) -> dict[str, DataFrame]:
    """One data set per applicable view, chosen from the two role sets (found in the data unless given)."""
    check_col(df, col)
    check_col(df, target)
    if col == target:
        raise ValueError("a column cannot be set against itself")
    if col_roles is None or target_roles is None:
        found = column_roles(df, [col, target])
        col_roles, target_roles = col_roles or found[col], target_roles or found[target]
    specs: dict[str, DataFrame] = {}
    if "numeric" in col_roles and "numeric" in target_roles:
        specs["numeric_numeric"] = regression_line(df, col, target)
        specs["numeric_numeric_points"] = pair_sample(df, [col, target], n=1000)
    if "categorical" in col_roles and "numeric" in target_roles:
        specs["categorical_numeric"] = boxplot(df, target, by=col)
    if "numeric" in col_roles and "categorical" in target_roles:
        specs["numeric_categorical"] = boxplot(df, col, by=target)
    if "categorical" in col_roles and "categorical" in target_roles:
        specs["categorical_categorical"] = pair_counts(df, col, target)
    if not specs:
        raise ValueError(f"{col!r} and {target!r} have no types that go together in a view")
    return specs


# ----------------------------------------------------------------------------- G8
def pair_sample(df: DataFrame, cols: list[str], hue: str | None = None, n: int = 1000,
                seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Up to ``n`` complete rows of ``cols`` (+hue) with the smallest seeded hash of their ``key``.

    Without a key the hash is over the values, so equal rows are in or out together.

    A deterministic sample for scatter plots: the limit is the feature; Spark plans
    it as a per-partition top-n before one small merge.
    """
    cols = [c for c in cols if c in df.columns]
    if len(cols) < 2:
        raise ValueError("a pair sample takes two columns or more")
    keep = cols + ([hue] if hue else [])
    parts = [F.coalesce(_c(c).cast("string"), F.lit("")) for c in key or keep]
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    data = df.select(*[_c(c) for c in keep], h.alias("__h")).na.drop(subset=cols)
    return data.orderBy("__h", *[_c(c) for c in keep]).limit(n).drop("__h")


def pair_plot_data(df: DataFrame, cols: list[str] | None = None, hue: str | None = None,
                   max_cols: int = 5, bins: int = 30, n: int = 1000) -> dict[str, DataFrame]:
    """Scatter sample of the columns plus the diagonal: histograms per hue level.

    ``cols`` defaults to the first ``max_cols`` numeric columns; unknown names are
    ignored; fewer than two usable columns is an error.  Rows with a NULL in any
    of the columns are left out, as in the scatter panels.
    """
    cols = numeric_cols(df)[:max_cols] if cols is None else [c for c in cols if c in df.columns]
    if len(cols) < 2:
        raise ValueError("pair data takes two columns or more")
    complete = df.na.drop(subset=cols)
    diag = {}
    for c in cols:
        diag[c] = (histogram_by_target(complete, c, hue, bins) if hue is not None
                   else histogram(complete, c, bins))
    return {"points": pair_sample(complete, cols, hue=hue, n=n), **{f"hist_{c}": h for c, h in diag.items()}}


# ----------------------------------------------------------------------------- G9
def top_k_values(df: DataFrame, cols: list[str], k: int = 5, freq: DataFrame | None = None) -> DataFrame:
    """Per column the k most frequent non-null values with counts and % of all rows."""
    from tabsight.operators.freq import frequency_stats, frequency_table, top_values
    freq = freq if freq is not None else frequency_table(df, cols)
    totals = frequency_stats(freq).select("column_name", "n_rows")  # one row per column
    return (top_values(df, freq, k, cols).join(F.broadcast(totals), "column_name")
               .select("column_name", "rank", "value", F.col("n").alias("count"),
                       pct("n", "n_rows", 1).alias("pct")))


def column_summary(df: DataFrame, columns: list[str] | None = None, max_features: int | None = None, feature_type: str = "all",
                   bins: int = 20, top_categories: int = 5, freq: DataFrame | None = None) -> DataFrame:
    """One row per column: dtype, valid and missing counts and shares, and by storage

    * numbers: mean, std, min, q25, q50, q75, max and ``bins`` counts of equal-width bins (NULL without numbers);
    * everything else: n_unique and ``top``, the most frequent values with counts and % of all rows.

    Numbers come from one aggregate and the counting scans of ``quantiles.summaries``, the rest from the
    value-frequency table of the other columns.
    """
    from tabsight.operators.quantiles import summaries
    if feature_type not in ("all", "numeric", "categorical"):
        raise ValueError("feature_type is 'all', 'numeric' or 'categorical'")
    cols = list(columns) if columns is not None else df.columns
    for c in cols:
        check_col(df, c)
    kinds = {c: storage_kind(df.schema[c].dataType) for c in cols}
    cols = [c for c in cols if feature_type == "all" or (kinds[c] == "numeric" if feature_type == "numeric" else kinds[c] == "text")]
    cols = cols if max_features is None else cols[:max_features]
    if not cols:
        raise ValueError("no columns to summarise")
    spark = df.sparkSession
    numbers, others = [c for c in cols if kinds[c] == "numeric"], [c for c in cols if kinds[c] != "numeric"]
    found = summaries(df, numbers, [0.25, 0.5, 0.75], bins=bins)
    rows = [(k, c, df.schema[c].dataType.simpleString(), *(
        [found[c]["n"], found[c]["mean"], found[c]["std"], found[c]["min"], *found[c]["q"], found[c]["max"], found[c]["bins"]]
        if c in found else [None] * 9)) for k, c in enumerate(cols)]
    base = spark.createDataFrame(rows, "pos int, column_name string, dtype string, n long, mean double, std double, min double, "
                                       "q25 double, q50 double, q75 double, max double, bins array<long>")
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    if others:
        from tabsight.operators.freq import frequency_stats, frequency_table
        freq = freq if freq is not None else frequency_table(df, others)
        stats = frequency_stats(freq.where(F.col("column_name").isin(others))).select(
            "column_name", F.col("n_missing").alias("missing_other"), "n_unique")
        top = (top_k_values(df, others, top_categories, freq).groupBy("column_name")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count", "pct"))).alias("top")))
        base = base.join(F.broadcast(stats), "column_name", "left").join(F.broadcast(top), "column_name", "left")
    else:
        base = base.withColumns({"missing_other": F.lit(None).cast("long"), "n_unique": F.lit(None).cast("long"),
                                 "top": F.lit(None).cast("array<struct<rank:int,value:string,count:bigint,pct:double>>")})
    base = base.crossJoin(F.broadcast(total))  # one-row side
    missing = F.coalesce("missing_other", F.col("n_rows") - F.col("n"), F.lit(0))
    return base.select("pos", "column_name", "dtype", (F.col("n_rows") - missing).alias("valid"), pct(F.col("n_rows") - missing, "n_rows", 1).alias("valid_pct"),
                       missing.alias("missing"), pct(missing, "n_rows", 1).alias("missing_pct"), "mean", "std", "min", "q25", "q50", "q75", "max",
                       "bins", "n_unique", "top").orderBy("pos").drop("pos")


# ----------------------------------------------------------------------------- G10
def histogram_by_target(df: DataFrame, col: str, target: str, bins: int = 30) -> DataFrame:
    """Shared bins, empty ones included; density normalised within each target level: n / (level total * width)."""
    x = _c(col).cast("double")
    base = df.select(x.alias("x"), _c(target).cast("string").alias("target")).where(F.col("x").isNotNull())
    rng = base.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / F.lit(bins)
    counts = (base.crossJoin(F.broadcast(rng))  # one-row side
                  .withColumn("bin", F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(
                      F.least(F.floor((F.col("x") - F.col("mn")) / width).cast("int"), F.lit(bins - 1))))
                  .groupBy("target", "bin", "mn", "mx").agg(F.count(F.lit(1)).alias("n")))
    # one row per target level: its bins as a map, read for every bin
    levels = counts.groupBy("target", "mn", "mx").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"), F.sum("n").alias("total"))
    wd = F.when(F.col("mx") == F.col("mn"), F.lit(1.0)).otherwise(width)
    count = F.coalesce(F.col("found")[F.col("bin")], F.lit(0)).cast("long")
    return levels.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        "target", "bin", (F.col("mn") + F.col("bin") * width).alias("lower"), count.alias("count"), (count / (F.col("total") * wd)).alias("density"))


def feature_distribution(df: DataFrame, col: str, target: str, col_type: str | None = None, bins: int = 30) -> DataFrame:
    """G10: numeric -> densities by target level, else counts by target, the most frequent values first."""
    from tabsight.operators.profile import logical_type_of
    check_col(df, col)
    check_col(df, target)
    if (col_type or logical_type_of(df, col)) == "numeric":
        return histogram_by_target(df, col, target, bins)
    counts = pair_counts(df, col, target).where(F.col("value").isNotNull() & F.col("target").isNotNull())
    totals = df.where(_c(col).isNotNull()).groupBy(_c(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("total"))
    return (counts.join(totals, "value").orderBy(F.desc("total"), "value", "target").select("value", "target", "count"))


# ----------------------------------------------------------------------------- G11
def kde(df: DataFrame, col: str, grid_size: int = 200, bw: float | None = None, cells: int = KDE_CELLS) -> DataFrame:
    """Gaussian KDE on ``grid_size`` points over [min, max], Scott bandwidth by default.

    h = std * n^(-1/5); density(g) = sum(exp(-((g-x)/h)^2 / 2)) / (n h sqrt(2 pi)).
    The rows are first shared out to ``cells`` + 1 equally spaced points: a value between two of them gives each
    the share of its distance from the other, which keeps the mass and the mean.  The sum then runs over
    points x grid, whatever the number of rows; its error falls with the square of cell width over h.
    A column without spread has no density (NULL).
    """
    x = _c(col).cast("double")
    base = df.select(x.alias("x")).where(F.col("x").isNotNull())
    st = base.agg(F.min("x").alias("mn"), F.max("x").alias("mx"),
                  F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"))
    h = (F.lit(float(bw)) if bw is not None
         else F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = st.withColumn("h", F.nullif(h, F.lit(0.0)))
    width = F.nullif((F.col("mx") - F.col("mn")) / F.lit(cells), F.lit(0.0))
    place = F.coalesce((F.col("x") - F.col("mn")) / width, F.lit(0.0))
    cell = F.least(F.floor(place), F.lit(cells - 1))
    shared = (base.crossJoin(F.broadcast(st))  # one-row side
              .select(cell.alias("cell"), (place - cell).alias("part"))
              .groupBy("cell").agg(F.sum(1 - F.col("part")).alias("w0"), F.sum("part").alias("w1")))
    points = (shared.select(F.inline(F.array(F.struct("cell", F.col("w0").alias("w")), F.struct((F.col("cell") + 1).alias("cell"), F.col("w1").alias("w")))))
              .groupBy("cell").agg(F.sum("w").alias("w")))
    at = F.col("mn") + F.col("cell") * F.coalesce(width, F.lit(0.0))
    g = F.col("mn") + F.col("i") * ((F.col("mx") - F.col("mn")) / F.lit(grid_size - 1))
    dens = (points.crossJoin(F.broadcast(st))
            .select(F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("i"), "w", at.alias("at"), "mn", "mx", "h", "n")
            .groupBy("i", "mn", "mx", "h", "n")
            .agg(F.sum(F.col("w") * F.exp(-0.5 * F.pow((g - F.col("at")) / F.col("h"), 2))).alias("s")))
    return dens.select("i", g.alias("x"),
                       (F.col("s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))))
                       .alias("density"))
