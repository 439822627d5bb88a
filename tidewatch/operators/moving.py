"""Moving statistics: how much a value moves a statistic of the window before it.

score = stat(window with the value) - stat(window), in absolute terms unless
abs_diff is off; an empty window scores 0. Rows with a null value are neither
learned nor scored (null score): the window holds the last ``window`` values,
not rows. Under score_first the window is the values before the row; under
learn_first it ends with the row, whose value then counts twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.plans.stream import StreamSpec

_MEAN = "(aggregate({a}, 0D, (s, v) -> s + v) / size({a}))"


def _moment(a: str, k: int) -> str:
    """k-th central moment of an array bound as {a}."""
    power = " * ".join(["(v - m)"] * k)
    return f"transform(array({_MEAN.format(a=a)}), m -> aggregate({a}, 0D, (s, v) -> s + {power}) / size({a}))[0]"


def _quantile(a: str, q: float) -> str:
    """Linear interpolation at (n - 1) q of an array."""
    return (
        f"transform(array(struct(array_sort({a}) as s, (size({a}) - 1) * {q}D as p)), x -> "
        "element_at(x.s, cast(floor(x.p) as int) + 1) + (x.p - floor(x.p)) * "
        "(element_at(x.s, cast(ceil(x.p) as int) + 1) - element_at(x.s, cast(floor(x.p) as int) + 1)))[0]"
    )


def _ratio(a: str, k: int) -> str:
    return f"transform(array(struct({_moment(a, 2)} as v2, {_moment(a, k)} as vk)), x -> if(x.v2 = 0, null, x.vk / pow(x.v2, {k / 2}D)))[0]"


#: Statistic of a bound array; null stands for undefined.
STATS = {
    "mean": lambda a, q: _MEAN.format(a=a),
    "harmonic": lambda a, q: f"try_divide(size({a}), aggregate({a}, 0D, (s, v) -> s + 1 / v))",
    "geometric": lambda a, q: f"exp(aggregate({a}, 0D, (s, v) -> s + ln(v)) / size({a}))",
    "median": lambda a, q: _quantile(a, 0.5),
    "quantile": lambda a, q: _quantile(a, q),
    "variance": lambda a, q: _moment(a, 2),
    "iqr": lambda a, q: f"({_quantile(a, 0.75)} - {_quantile(a, 0.25)})",
    "aad": lambda a, q: f"transform(array({_MEAN.format(a=a)}), m -> aggregate({a}, 0D, (s, v) -> s + abs(v - m)) / size({a}))[0]",
    "kurtosis": lambda a, q: _ratio(a, 4),
    "skewness": lambda a, q: _ratio(a, 3),
}
#: Window aggregates that give the same without building the array.
_NATIVE = {
    "mean": lambda c, q, w: F.avg(c).over(w),
    "variance": lambda c, q, w: F.var_pop(c).over(w),
    "median": lambda c, q, w: F.percentile(c, F.lit(0.5)).over(w),
    "quantile": lambda c, q, w: F.percentile(c, F.lit(q)).over(w),
    "iqr": lambda c, q, w: F.percentile(c, F.lit(0.75)).over(w) - F.percentile(c, F.lit(0.25)).over(w),
}


def moving(
    df: DataFrame, spec: StreamSpec, value: str, stat: str, window: int, out: str = "score",
    abs_diff: bool = True, quantile: float = 0.5,
) -> DataFrame:
    """Adds the score of a moving statistic."""
    if window < 1:
        raise ValueError("window must be at least 1")
    if stat not in STATS:
        raise ValueError(f"unknown statistic {stat!r}")
    spec.check(df, value)
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v)
    enters = usable & (v != 0 if stat == "harmonic" else v > 0 if stat == "geometric" else F.lit(True))
    rows = df.withColumn("_v", F.when(enters, v)).withColumn(
        "_i", F.count("_v").over(spec.ordered().rowsBetween(Window.unboundedPreceding, 0))
    )
    # A row that enters nothing stands after the rows that share its index; give it a place of its own.
    rows = rows.withColumn("_at", F.when(F.col("_v").isNotNull(), F.col("_i")).otherwise(F.col("_i") + 1))
    learn_first = spec.discipline == "learn_first"
    over = Window.partitionBy(*spec.by).orderBy("_at")
    lead = 0 if learn_first else -1
    past = over.rangeBetween(lead - window + 1, lead)
    if stat in _NATIVE and not learn_first:
        both = over.rangeBetween(-window, 0)
        rows = rows.withColumn("_before", _NATIVE[stat]("_v", quantile, past)).withColumn("_with", _NATIVE[stat]("_v", quantile, both))
        rows = rows.withColumn("_n", F.count("_v").over(past))
    else:
        rows = rows.withColumn("_past", F.collect_list("_v").over(past)).withColumn("_n", F.size("_past"))
        make = STATS[stat]
        rows = rows.withColumn("_before", F.expr(f"if(_n = 0, null, {make('_past', quantile)})"))
        rows = rows.withColumn("_all", F.array_append("_past", F.col("_v")))
        rows = rows.withColumn("_with", F.expr(f"if(_v is null, null, {make('_all', quantile)})"))
    diff = F.col("_with") - F.col("_before")
    diff = F.abs(diff) if abs_diff else diff
    if stat in ("kurtosis", "skewness"):
        diff = F.coalesce(diff, F.lit(0.0))
    cold = F.lit(1.0 if stat == "geometric" else 0.0)
    few = F.col("_n") <= (1 if stat == "geometric" else 0)
    score = F.when(~usable, None).when(few, cold)
    if stat == "harmonic":
        score = score.when(v == 0, 0.0)
    return rows.withColumn(out, score.otherwise(diff)).drop(*[c for c in rows.columns if c not in df.columns])


def growth(df: DataFrame, spec: StreamSpec, value: str, window: int, out: str = "score", abs_diff: bool = True) -> DataFrame:
    """Geometric mean of growth ratios, which telescopes; 1 with fewer than three values."""
    spec.check(df, value)
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    past = spec.past(window)
    rows = df.withColumn("_v", v)
    rows = rows.withColumn("_first", F.first("_v", True).over(past)).withColumn("_last", F.last("_v", True).over(past))
    rows = rows.withColumn("_n", F.count("_v").over(past))
    before = F.pow(F.col("_last") / F.col("_first"), 1 / (F.col("_n") - 1))
    with_ = F.pow(F.col("_v") / F.col("_first"), 1 / F.col("_n"))
    diff = with_ - before
    score = F.when(F.col(value).isNull(), None).when(F.col("_n") <= 2, 1.0).otherwise(F.abs(diff) if abs_diff else diff)
    return rows.withColumn(out, score).drop("_v", "_first", "_last", "_n")


def _pair(spec: StreamSpec, x: str, y: str, window: int):
    """(n, var x, var y, cov) of the window and of the window with the row; population moments, null without rows.

    Under learn_first the window ends with the row, which then counts twice: its
    moments follow from those of the window and the row's distance to the mean.
    """
    past = spec.past(window)
    moments = lambda w: (F.count(x).over(w), F.var_pop(x).over(w), F.var_pop(y).over(w), F.covar_pop(x, y).over(w))
    before = moments(past)
    if spec.discipline == "score_first":
        return before, moments(spec.ordered().rowsBetween(-window, 0))
    n = before[0].cast("double")
    dx, dy = F.col(x) - F.avg(x).over(past), F.col(y) - F.avg(y).over(past)
    grown = [n / (n + 1) * (m + d / (n + 1)) for m, d in zip(before[1:], (dx * dx, dy * dy, dx * dy))]
    return before, (before[0] + 1, *grown)


def covariance(df: DataFrame, spec: StreamSpec, x: str, y: str, window: int, bias: bool = True, out: str = "score", abs_diff: bool = True) -> DataFrame:
    """cov(window with the row) - cov(window); fewer than two rows count as 0."""
    past, both = _pair(spec, x, y, window)

    def side(n, _x, _y, cov) -> Column:
        return F.when(n < 2, 0.0).otherwise(cov if bias else cov * n / F.nullif(n - 1, F.lit(0)))

    diff = side(*both) - side(*past)
    score = F.when(past[0] == 0, 0.0).otherwise(F.abs(diff) if abs_diff else diff)
    return df.withColumn(out, score)


def correlation(df: DataFrame, spec: StreamSpec, x: str, y: str, window: int, out: str = "score", abs_diff: bool = True) -> DataFrame:
    """Pearson(window with the row) - Pearson(window); a side without spread counts as 0."""
    past, both = _pair(spec, x, y, window)

    def side(_n, vx, vy, cov) -> Column:
        spread = F.sqrt(vx) * F.sqrt(vy)
        return F.when(F.coalesce(spread, F.lit(0.0)) == 0, 0.0).otherwise(cov / F.nullif(spread, F.lit(0.0)))

    diff = side(*both) - side(*past)
    return df.withColumn(out, F.abs(diff) if abs_diff else diff)


def mahalanobis(df: DataFrame, spec: StreamSpec, x: str, y: str, window: int, out: str = "score") -> DataFrame:
    """Squared distance of a row to its window, two features; 0 with fewer than three rows; a singular window gets a ridge."""
    past = spec.past(window)
    rows = (
        df.withColumn("_n", F.count(x).over(past)).withColumn("_a", F.var_samp(x).over(past)).withColumn("_b", F.var_samp(y).over(past))
        .withColumn("_c", F.covar_samp(x, y).over(past)).withColumn("_dx", F.col(x) - F.avg(x).over(past)).withColumn("_dy", F.col(y) - F.avg(y).over(past))
    )
    det = F.col("_a") * F.col("_b") - F.col("_c") * F.col("_c")
    ridge = F.when(det <= 1e-12 * F.col("_a") * F.col("_b"), 1e-6 * (F.col("_a") + F.col("_b")) / 2).otherwise(0.0)
    rows = rows.withColumn("_r", ridge).withColumn("_a", F.col("_a") + F.col("_r")).withColumn("_b", F.col("_b") + F.col("_r"))
    d2 = F.expr("try_divide(_b * _dx * _dx - 2 * _c * _dx * _dy + _a * _dy * _dy, _a * _b - _c * _c)")
    score = F.when(F.col("_n") < 3, 0.0).otherwise(F.coalesce(d2, F.lit(0.0)))
    return rows.withColumn(out, score).drop("_n", "_a", "_b", "_c", "_dx", "_dy", "_r")


def mahalanobis_all(df: DataFrame, spec: StreamSpec, features: list[str], window: int, out: str = "score") -> DataFrame:
    """Squared distance of a row to its window, for any number of features.

    The window's covariances are window functions; only the linear systems are
    solved in Arrow batches. 0 with fewer than three rows, as for two features;
    a singular covariance gets a ridge; a null feature gives a null score.
    """
    spec.check(df, *features)
    past, d = spec.past(window), len(features)
    cov = F.array(*[F.covar_samp(a, b).over(past) for a in features for b in features])
    gap = F.array(*[F.col(a) - F.avg(a).over(past) for a in features])

    @F.pandas_udf("double")
    def solve(n: pd.Series, cov: pd.Series, gap: pd.Series) -> pd.Series:
        def one(n, c, g):
            if any(v is None or v != v for v in g):
                return None if n else 0.0
            if n < 3:
                return 0.0
            m, g = np.array(c, float).reshape(d, d), np.array(g, float)
            if np.linalg.matrix_rank(m) < d:
                m = m + np.eye(d) * 1e-6 * np.trace(m) / d
            return float(g @ np.linalg.solve(m, g)) if np.trace(m) > 0 else 0.0

        return pd.Series([one(*r) for r in zip(n, cov, gap)], dtype=object).astype("float64")

    return df.withColumn(out, solve(F.count(features[0]).over(past), cov, gap))
