"""Association measures: correlation matrices, crosstabs, mutual information.

* Pearson: masked Gram matrices per Arrow batch (``operators.gram``), summed over
  partitions: one scan, k x k numbers, each pair on its complete rows, NULL where a
  variance is zero.
* Spearman: the ranks of every column, found together over range partitions
  (``ranks.rank_columns``; columns of few values from their counts) and brought back to the rows once, then the same moments.
* Kendall tau-b: from cells of values, see ``operators.kendall``.
* Crosstab: ``groupBy(rows).pivot(col, values)`` - the zero-filled matrix comes
  from the pivot, not from a cross join of row and column keys.
* Mutual information: one contingency of (feature, value, y) for all discrete features;
  histograms by label per Arrow batch for continuous ones.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.functions.types import check_col, is_corr_compatible, numeric_cols
from tabsight.operators.cells import SMALL
from tabsight.operators.gram import Moments, correlations, pair_moments
from tabsight.operators.kendall import kendall_tau_b
from tabsight.operators.quantiles import quantiles
from tabsight.operators.ranks import rank_columns, value_ranks
from tabsight.session import ensure_checkpoint_dir

PAIR_SCHEMA = "feature_1 string, feature_2 string, correlation double"


def corr_columns(df: DataFrame, target: str | None = None, include_target: bool = True) -> list[str]:
    cols = [c for c in df.columns if is_corr_compatible(df, c)]
    if not include_target and target in cols:
        cols.remove(target)
    return cols


def _num(df: DataFrame, c: str):
    return F.col(f"`{c}`").cast("double")


# ----------------------------------------------------------------------------- pearson
def _place(pairs: list[tuple[str, str]]) -> tuple[list[str], list[tuple[int, int]]]:
    """The columns of ``pairs`` and the pairs as positions among them."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    at = {c: k for k, c in enumerate(cols)}
    return cols, [(at[a], at[b]) for a, b in pairs]


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(feature_1, feature_2, correlation) for the given pairs, one scan."""
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    cols, places = _place(pairs)
    res = correlations(df, [_num(df, c) for c in cols], places)
    return _pair_names(df, pairs).join(F.broadcast(res), "pair", "left").select(
        "feature_1", "feature_2", "correlation")


def _full_matrix(upper_and_diag: DataFrame) -> DataFrame:
    """Mirror the upper triangle (diagonal rows have feature_1 == feature_2)."""
    both = F.array(F.struct(F.col("feature_1").alias("f1"), F.col("feature_2").alias("f2")),
                   F.struct(F.col("feature_2").alias("f1"), F.col("feature_1").alias("f2")))
    r = F.when((F.col("feature_1") == F.col("feature_2")) & F.col("correlation").isNotNull(),
               F.lit(1.0)).otherwise(F.col("correlation"))
    return (upper_and_diag.select(F.explode(F.array_distinct(both)).alias("p"), r.alias("correlation"))
                          .select(F.col("p.f1").alias("feature_1"), F.col("p.f2").alias("feature_2"),
                                  "correlation"))


def _diag_pairs(cols: list[str]) -> list[tuple[str, str]]:
    return [(c, c) for c in cols]


def correlation_matrix(df: DataFrame, target: str | None = None, include_target: bool = True,
                       method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
    """Full k x k matrix in long form (feature_1, feature_2, correlation).

    Pearson: the upper triangle and the diagonal come from one scan (r(x, x) is 1
    where x varies, NULL where it is constant); Kendall takes the diagonal from there.
    """
    cols = columns if columns is not None else corr_columns(df, target, include_target)
    if not cols:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    pairs = list(combinations(cols, 2))
    if method == "pearson":
        return _full_matrix(pearson_pairs(df, pairs + _diag_pairs(cols)))
    if method == "spearman":
        return _full_matrix(spearman_pairs(df, pairs + _diag_pairs(cols)))
    if method != "kendall":
        raise ValueError("method must be 'pearson', 'spearman' or 'kendall'")
    return _full_matrix(kendall_pairs(df, pairs).unionByName(pearson_pairs(df, _diag_pairs(cols))))


def correlation_wide(long: DataFrame, cols: list[str]) -> DataFrame:
    """Square matrix: one row per feature_1, one column per feature (pivot on known values)."""
    return (long.groupBy("feature_1").pivot("feature_2", cols)
                .agg(F.first("correlation")).withColumnRenamed("feature_1", "feature"))


def _pair_names(df: DataFrame, pairs):
    spark = df.sparkSession
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                                 "pair int, feature_1 string, feature_2 string")


# ----------------------------------------------------------------------------- spearman
def _rank_groups(n, pairs: list[tuple[int, int]]) -> tuple[list[tuple], list[tuple[int, int]]]:
    """What is ranked - (column, columns that must be there) - and both sides of each pair as positions among it.

    ``n[i, j]`` counts the rows complete in i and j.  Ranks are over a pair's complete rows; columns that are
    missing in the same rows, or wherever the other is, need no ranks of their own for the pair.
    """
    k = len(n)
    like = [next(j for j in range(k) if n[i, j] == n[i, i] == n[j, j]) for i in range(k)]
    groups: dict[tuple, int] = {}
    sides = []
    for a, b in pairs:
        there = (like[a],) if n[a, b] == n[a, a] else (like[b],) if n[a, b] == n[b, b] else tuple(sorted((like[a], like[b])))
        sides.append(tuple(groups.setdefault((c, there), len(groups)) for c in (a, b)))
    return list(groups), sides


def _ranked(df: DataFrame, pairs: list[tuple[str, str]], ties: bool = False) -> tuple[DataFrame | None, list[tuple[int, int]], list[int]]:
    """The ranks of all columns of ``pairs`` by row, both sides of each pair as positions among them, and each pair's rows."""
    ensure_checkpoint_dir(df.sparkSession)
    cols, places = _place(pairs)
    x = [F.nanvl(_num(df, c), F.lit(None).cast("double")) + F.lit(0.0) for c in cols]
    # dealt out evenly: a file with one row group would otherwise be exploded by one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = (df.select(*[c.alias(f"c{k}") for k, c in enumerate(x)]).repartition(parts)
            .select(F.monotonically_increasing_id().alias("id"), "*").checkpoint(eager=True))
    state = pair_moments(base, [F.col(f"c{k}") for k in range(len(cols))]).first()
    if state is None:
        return None, [], []
    n = Moments.unpacked(state["state"]).n
    groups, sides = _rank_groups(n, places)
    values = []
    for c, there in groups:
        value = F.col(f"c{c}")
        for other in there:
            value = F.when(F.col(f"c{other}").isNotNull(), value)
        values.append(value)
    wide = base.select("id", *[v.alias(f"x{g}") for g, v in enumerate(values)])
    few = value_ranks(wide, len(groups))
    many = [F.struct(F.lit(g).alias("g"), F.col(f"x{g}").alias("x")) for g in range(len(groups)) if g not in few]
    none = F.lit(None).cast("struct<g: int, x: double>")
    long = wide.select("id", F.inline(F.array(*(many or [none])))).where(F.col("x").isNotNull())
    rows = int(sum(n[c, c] for c, _ in groups))
    return rank_columns(long, len(groups), ties, rows, few, wide), sides, [int(n[p]) for p in places]


def _named(df: DataFrame, pairs: list[tuple[str, str]], res: DataFrame | None) -> DataFrame:
    names = _pair_names(df, pairs)
    if res is None:
        return names.select("feature_1", "feature_2", F.lit(None).cast("double").alias("correlation"))
    return names.join(F.broadcast(res), "pair", "left").select("feature_1", "feature_2", "correlation")  # one row per pair


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    ranks, sides, _ = _ranked(df, pairs)
    if ranks is None:
        return _named(df, pairs, None)
    groups = 1 + max(g for s in sides for g in s)
    return _named(df, pairs, correlations(ranks, [F.col(f"r{g}") for g in range(groups)], sides))


# ----------------------------------------------------------------------------- kendall
def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]], small: int = SMALL) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    cols, places = _place(pairs)
    return _named(df, pairs, kendall_tau_b(df, [_num(df, c) for c in cols], places, small))


# ----------------------------------------------------------------------------- C5 - C7
def multicollinearity(df: DataFrame, target: str | None = None, threshold: float = 0.9) -> DataFrame:
    """Pairs i<j (column order, target excluded) with |r| >= threshold, by |r| desc."""
    cols = corr_columns(df, target, include_target=False)
    upper = pearson_pairs(df, list(combinations(cols, 2)))
    return (upper.where(F.abs("correlation") >= threshold)
                 .select("feature_1", "feature_2", F.round("correlation", 4).alias("correlation"))
                 .orderBy(F.desc(F.abs("correlation")), "feature_1", "feature_2"))


def target_correlation(df: DataFrame, target: str, method: str = "pearson",
                       numeric_only: bool = False) -> DataFrame:
    """r of each compatible column (or each numeric feature) with the target.

    ``numeric_only=False`` orders ascending by r (chart data); ``True`` uses the
    number-typed features only and orders by |r| descending (summary table).
    """
    check_col(df, target)
    if not is_corr_compatible(df, target):
        raise ValueError("correlation needs a target of numbers or truth values")
    cols = (numeric_cols(df, target) if numeric_only
            else [c for c in corr_columns(df) if c != target])
    pairs = [(c, target) for c in cols]
    if method == "pearson":
        res = pearson_pairs(df, pairs)
    elif method == "spearman":
        res = spearman_pairs(df, pairs)
    else:
        res = kendall_pairs(df, pairs)
    res = res.select(F.col("feature_1").alias("feature"),
                     F.col("correlation").alias("correlation_with_target"))
    if numeric_only:
        return res.orderBy(F.desc_nulls_last(F.abs("correlation_with_target")), "feature")
    return res.orderBy(F.asc_nulls_last("correlation_with_target"), "feature")


# ----------------------------------------------------------------------------- C8 crosstab
def crosstab(df: DataFrame, row_cols, col: str, normalize=False,
             values: list | None = None) -> DataFrame:
    """Wide crosstab: one row per observed row-key combination, one column per value of ``col``.

    Rows with a NULL in any key are dropped; cells are zero-filled.  ``normalize``:
    False/None counts, 'index' row shares, 'columns' column shares, 'all' shares
    of the total.  ``values`` pins the column values (otherwise Spark collects the
    distinct values of ``col``, bounded by ``spark.sql.pivotMaxValues``).
    """
    rows = [row_cols] if isinstance(row_cols, str) else list(row_cols)
    for c in rows + [col]:
        check_col(df, c)
    if normalize is None:
        normalize = False
    if normalize not in (False, True, "index", "columns", "all"):
        raise ValueError("normalize must be False, 'index', 'columns' or 'all'")
    clean = df.select(*rows, F.col(col).cast("string").alias("__col")).na.drop(subset=rows + ["__col"])
    g = clean.groupBy(*rows)
    g = g.pivot("__col", values) if values is not None else g.pivot("__col")
    wide = g.agg(F.count(F.lit(1))).na.fill(0)
    vcols = [c for c in wide.columns if c not in rows]
    if normalize is False:
        return wide
    cell = {c: F.col(f"`{c}`").cast("double") for c in vcols}
    if normalize == "index":
        tot = sum((cell[c] for c in vcols), F.lit(0.0))
        return wide.select(*rows, *[(cell[c] / tot).alias(c) for c in vcols])
    if normalize == "columns":
        totals = wide.agg(*[F.sum(cell[c]).alias(f"__t_{i}") for i, c in enumerate(vcols)])
        j = wide.crossJoin(F.broadcast(totals))  # one-row side
        return j.select(*rows, *[(cell[c] / F.nullif(F.col(f"__t_{i}"), F.lit(0.0))).alias(c)
                                 for i, c in enumerate(vcols)])
    # 'all' / True
    totals = wide.agg(F.sum(sum((cell[c] for c in vcols), F.lit(0.0))).alias("__t"))
    j = wide.crossJoin(F.broadcast(totals))
    return j.select(*rows, *[(cell[c] / F.col("__t")).alias(c) for c in vcols])


def crosstab_long(df: DataFrame, row_cols, col: str, normalize=False,
                  values: list | None = None) -> DataFrame:
    """Crosstab in long form (row keys..., col_value, value), zero cells included."""
    rows = [row_cols] if isinstance(row_cols, str) else list(row_cols)
    wide = crosstab(df, rows, col, normalize, values)
    vcols = [c for c in wide.columns if c not in rows]
    vt = "double" if normalize not in (False, None) else "bigint"
    return wide.unpivot(rows, [F.col(f"`{c}`").cast(vt).alias(c) for c in vcols],
                        "col_value", "value")


# ----------------------------------------------------------------------------- F1 MI
def _label_counts(data: DataFrame, edges: list[list[float]]) -> DataFrame:
    """(k, x, y, n): rows of each numeric column k by the number of its edges below the value, and label y.

    ``data`` has the label ``y`` and the columns c0, c1, ...; a batch is counted as a whole.
    """
    inner = [np.unique(e) for e in edges]

    def count(batches):
        total: dict[str, list[np.ndarray]] = {}
        for b in batches:
            codes = b.column("y").dictionary_encode()
            label, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            for name in names:
                total.setdefault(name, [np.zeros(len(e) + 1, dtype=np.int64) for e in inner])
            for k, e in enumerate(inner):
                x = b.column(f"c{k}").to_numpy(zero_copy_only=False)
                there = ~np.isnan(x)
                cell = label[there].astype(np.int64) * (len(e) + 1) + np.searchsorted(e, x[there], side="left")
                for name, n in zip(names, np.bincount(cell, minlength=len(names) * (len(e) + 1)).reshape(len(names), -1)):
                    total[name][k] += n
        rows = [(k, x, name, int(n)) for name, per in total.items() for k, t in enumerate(per) for x, n in enumerate(t) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["k", "x", "y", "n"])

    return data.mapInArrow(count, "k int, x int, y string, n long").groupBy("k", "x", "y").agg(F.sum("n").alias("n"))


def _binned(df: DataFrame, cols: list[str], target: str, bins: int) -> DataFrame:
    """``_label_counts`` over the ``bins``-quantiles of each column, rows without a label left out."""
    y = F.col(f"`{target}`").cast("string")
    data = df.select(y.alias("y"), *[F.nanvl(_num(df, c), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(cols)])
    names = [f"c{k}" for k in range(len(cols))]
    found = quantiles(data, names, [round(i / bins, 10) for i in range(1, bins)])
    return _label_counts(data.where(F.col("y").isNotNull()), [[q for q in found[c] if q is not None] for c in names])


def binned_mutual_info(df: DataFrame, features: list[str], target: str, bins: int = 10) -> dict[str, float]:
    """Mutual information (nats) of each numeric feature, cut at its quantiles, with the target; features x bins x labels numbers."""
    cells: dict[int, dict[tuple, int]] = {}
    for r in _binned(df, features, target, bins).collect():
        cells.setdefault(r["k"], {})[r["x"], r["y"]] = r["n"]
    out = {}
    for k, c in enumerate(features):
        own = cells.get(k, {})
        nt, nx, ny = sum(own.values()), Counter(), Counter()
        for (x, y), n in own.items():
            nx[x] += n
            ny[y] += n
        out[c] = max(0.0, math.fsum(n / nt * math.log(n * nt / (nx[x] * ny[y])) for (x, y), n in own.items()))
    return out


def mutual_info(df: DataFrame, features: list[str], target: str,
                discrete: dict[str, bool] | None = None, bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each feature with the target, descending.

    Discrete features use their values; continuous ones (``discrete[c] is False``)
    are cut at their ``bins``-quantiles first (binned MI).  Rows where the feature
    or the target is NULL are left out for that feature.  The frame is read more than
    once: continuous features that are sums over other rows should be saved first, as
    their last bit may differ between scans.
    """
    discrete = discrete or {}
    y = F.col(f"`{target}`").cast("string")
    cont = [c for c in features if discrete.get(c) is False]
    parts = []
    if own := [c for c in features if c not in cont]:
        vals = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("x")) for c in own]
        parts.append(df.select(F.inline(F.array(*vals)), y.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
                     .groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    if cont:
        name = F.element_at(F.array(*[F.lit(c) for c in cont]), F.col("k") + 1)
        parts.append(_binned(df, cont, target, bins).select(name.alias("feature"), F.col("x").cast("string").alias("x"), "y", "n"))
    cells = functools.reduce(DataFrame.unionByName, parts)
    nx = cells.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ny = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    nt = cells.groupBy("feature").agg(F.sum("n").alias("nt"))
    j = cells.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(nt, "feature")
    term = (F.col("n") / F.col("nt")) * F.log(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))
    return (j.groupBy("feature").agg(F.sum(term).alias("mi"))
             .select("feature", F.greatest("mi", F.lit(0.0)).alias("mi"))
             .orderBy(F.desc("mi"), "feature"))
