"""Thresholds, constant and random scores, scalers and projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.plans.stream import StreamSpec


def null_scores(df: DataFrame, out: str = "score") -> DataFrame:
    return df.withColumn(out, F.lit(0.0))


def random_scores(df: DataFrame, *key: str, seed: int = 1, out: str = "score") -> DataFrame:
    """Uniform on [0, 1) by the md5 of seed and row key: the same in every run, partitioning and engine."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key]))
    return df.withColumn(out, F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(1 << 52))


def threshold(df: DataFrame, ceiling: dict[str, float] | None = None, floor: dict[str, float] | None = None, out: str = "score") -> DataFrame:
    """1 if any listed feature is beyond its limit; null and NaN are beyond none."""
    if not ceiling and not floor:
        raise ValueError("give a ceiling or a floor")
    test = F.lit(False)
    for c, limit in (ceiling or {}).items():
        test |= F.coalesce((F.col(c) > limit) & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    for c, limit in (floor or {}).items():
        test |= F.coalesce(F.col(c) < limit, F.lit(False))
    return df.withColumn(out, F.when(test, 1.0).otherwise(0.0))


def predict(df: DataFrame, score: str = "score", limit: float = 0.5, out: str = "predicted", signed: bool = False) -> DataFrame:
    """1 where the score reaches the limit, else 0; signed: 1 where it is at most the limit, else -1. A null score gives null."""
    if signed:
        return df.withColumn(out, F.when(F.col(score) <= limit, 1).when(F.col(score) > limit, -1))
    return df.withColumn(out, (F.col(score) >= limit).cast("int"))


def quantile_threshold(df: DataFrame, spec: StreamSpec, score: str, quantile: float = 0.95, window: int = 1000, out: str = "flag") -> DataFrame:
    """A score against a quantile of the last ones: 1 at or above it, else its share of it."""
    past = spec.past(window)
    least = min(window, max(10, int(0.1 * window)))
    limit = F.when(F.count(score).over(past) >= least, F.percentile(score, F.lit(quantile)).over(past))
    rows = df.withColumn("threshold", limit).withColumn("n_scores", F.count(score).over(past))
    flag = (
        F.when(F.col("threshold").isNull(), 0.0)
        .when(F.col("threshold") <= 0, F.when(F.col(score) > 0, 1.0).otherwise(0.0))
        .when(F.col(score) >= F.col("threshold"), 1.0)
        .otherwise(F.col(score) / F.nullif(F.col("threshold"), F.lit(0.0)))
    )
    return rows.withColumn(out, flag)


def min_max(df: DataFrame, spec: StreamSpec, *features: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Adds f_scaled for each feature, by what is learned before the row; the first row is null."""
    past = spec.past()
    out = df
    for f in features:
        lo, span = F.min(f).over(past), F.max(f).over(past) - F.min(f).over(past)
        scaled = low + (F.col(f) - lo) / F.nullif(span, F.lit(0.0)) * (high - low)
        out = out.withColumn(f"{f}_scaled", F.when(lo.isNull(), None).when(span == 0, low).otherwise(scaled))
    return out


def standard(df: DataFrame, spec: StreamSpec, *features: str, with_std: bool = True) -> DataFrame:
    """Adds f_scaled for each feature: centred, over the population deviation; none gives 0."""
    past = spec.past()
    out = df
    for f in features:
        centred = F.col(f) - F.avg(f).over(past)
        deviation = F.sqrt(F.var_pop(f).over(past))
        scaled = F.when(deviation == 0, 0.0).otherwise(centred / F.nullif(deviation, F.lit(0.0))) if with_std else centred
        out = out.withColumn(f"{f}_scaled", F.when(F.avg(f).over(past).isNull(), None).otherwise(scaled))
    return out


def projection_matrix(n_features: int, n_components: int, seed: int) -> np.ndarray:
    """Entries sqrt(3) times -1, 0, 1 with probabilities 1/6, 2/3, 1/6."""
    if n_components > n_features:
        raise ValueError("more components than features")
    return np.sqrt(3) * np.random.default_rng(seed).choice([-1.0, 0.0, 1.0], (n_features, n_components), p=[1 / 6, 2 / 3, 1 / 6])


def random_projection(df: DataFrame, vector: str, n_features: int, n_components: int, seed: int = 1) -> DataFrame:
    """Adds component_i of an array column."""
    matrix = projection_matrix(n_features, n_components, seed)
    out = df
    for k in range(n_components):
        weights = F.array(*[F.lit(float(w)) for w in matrix[:, k]])
        product = F.zip_with(vector, weights, lambda a, b: a * b)
        out = out.withColumn(f"component_{k}", F.aggregate(product, F.lit(0.0), lambda s, x: s + x))
    return out
