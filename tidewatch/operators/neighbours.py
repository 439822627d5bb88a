"""Neighbours within the last rows of a stream: a band join on the position.

A band join is planned as an equality of blocks of one window's length, with the
older side repeated for its own block and the next, so it hashes instead of
comparing everything with everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(df: DataFrame, seq: str, window: int, keep: list[str]) -> DataFrame:
    """Pairs of a row (q_*) with each of the window rows before it (o_*)."""
    asked = df.select(*[F.col(c).alias(f"q_{c}") for c in (seq, *keep)]).withColumn("_b", F.expr(f"q_{seq} div {window}"))
    older = df.select(*[F.col(c).alias(f"o_{c}") for c in (seq, *keep)])
    older = older.withColumn("_b", F.explode(F.expr(f"array(o_{seq} div {window}, o_{seq} div {window} + 1)")))
    inside = (F.col(f"o_{seq}") < F.col(f"q_{seq}")) & (F.col(f"o_{seq}") >= F.col(f"q_{seq}") - window)
    return asked.join(older, "_b").where(inside).drop("_b")


def _squared(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def knn(df: DataFrame, vector: str, seq: str, k: int, window: int, warm_up: int, out: str = "score", distance: Callable[[str, str], Column] = _squared) -> DataFrame:
    """Mean distance to the k nearest of the last window rows; 0 before warm_up rows.

    distance: of two array columns, as a column; squared Euclidean by default.
    """
    if warm_up < k:
        raise ValueError("warm_up must be at least k")
    doubles = df.withColumn(vector, F.col(vector).cast("array<double>"))
    near = band(doubles, seq, window, [vector]).withColumn("_d", distance(f"q_{vector}", f"o_{vector}"))
    near = near.groupBy(F.col(f"q_{seq}").alias("_q")).agg(
        F.slice(F.array_sort(F.collect_list("_d")), 1, k).alias("_near")  # a window's rows at most
    )
    mean = F.aggregate("_near", F.lit(0.0), lambda s, x: s + x) / k
    ready = F.least(F.col(seq), F.lit(window)) >= warm_up
    joined = df.join(near, F.col(seq) == F.col("_q"), "left")
    return joined.withColumn(out, F.when(ready, mean).otherwise(0.0)).drop("_q", "_near")


def radius_counts(df: DataFrame, features: list[str], seq: str, k: int, radius: float, window: int, slide: int, warm_slides: int = 1, subspace: list[str] | None = None, eps: float = 1e-9, out: str = "score") -> DataFrame:
    """1 - n / k for n rows of the window within the radius.

    With a subspace, a row whose grid cells and their neighbours, in the full space
    or the subspace, hold fewer than k rows scores 1 outright.
    """
    names = sorted(features)
    cells = df.withColumn("_x", F.array(*[F.col(f).cast("double") for f in names]))
    cells = cells.withColumn("_c", F.transform("_x", lambda v: F.floor(v / radius)))
    pairs = band(cells, seq, window, ["_x", "_c"]).withColumn("_d", _squared("q__x", "o__x"))
    apart = F.zip_with("q__c", "o__c", lambda a, b: F.abs(a - b))
    pairs = pairs.withColumn("_apart", apart)
    near_sub = F.lit(True)
    for f in sorted(subspace or []):
        near_sub &= F.col("_apart")[names.index(f)] <= 1
    counts = pairs.groupBy(F.col(f"q_{seq}").alias("_q")).agg(
        F.count_if(F.col("_d") <= radius * radius + eps).alias("_n"),
        F.count_if(F.forall("_apart", lambda v: v <= 1)).alias("_full"),
        F.count_if(near_sub).alias("_sub"),
    )
    rows = cells.join(counts, F.col(seq) == F.col("_q"), "left")
    ready = (F.col(seq) >= warm_slides * slide) & (F.least(F.col(seq), F.lit(window)) >= k + 1)
    exact = F.greatest(1 - F.coalesce("_n", F.lit(0)) / float(k), F.lit(0.0))
    score = F.when(~ready, 0.0)
    if subspace:
        score = score.when(F.least(F.coalesce("_full", F.lit(0)), F.coalesce("_sub", F.lit(0))) < k, 1.0)
    return rows.withColumn(out, score.otherwise(exact)).drop("_x", "_c", "_q", "_n", "_full", "_sub")
