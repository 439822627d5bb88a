"""Pipelines: transformers before a detector.

A row is scored as the transformer sees it before learning it, and learned as the
transformer sees it afterwards, so each feature travels in two columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.kernels import Kernel
from tidewatch.functions.transforms import Chain
from tidewatch.operators.fold import fold
from tidewatch.operators.trees import half_space
from tidewatch.plans.stream import StreamSpec, arrival


def chain(df: DataFrame, spec: StreamSpec, features: list[str], *makers: Callable[[], Kernel]) -> DataFrame:
    """Adds the outputs of the last of the parts that makers make, one chain of them for each key."""
    return fold(df, spec, features, lambda: Chain(*[make() for make in makers]))


def _extremes(df: DataFrame, features: list[str], bucket: str, order: tuple[str, ...]) -> DataFrame:
    """Adds f_lo, f_hi over all earlier rows, by bucket extremes and a window inside the bucket."""
    per = df.groupBy(F.col(bucket).alias("_b")).agg(
        *[g(f).alias(f"_{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))]
    )
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    per = per.select("_b", *[g(f"_{n}_{f}").over(before).alias(f"_{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))])
    inside = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(per, F.col(bucket).eqNullSafe(F.col("_b")))
    for f in features:
        out = out.withColumn(f"{f}_lo", F.least(F.min(f).over(inside), F.col(f"_lo_{f}")))
        out = out.withColumn(f"{f}_hi", F.greatest(F.max(f).over(inside), F.col(f"_hi_{f}")))
    return out.drop("_b", *[f"_{n}_{f}" for f in features for n in ("lo", "hi")])


def scaled_half_space(df: DataFrame, features: list[str], order: tuple[str, ...], bucket: str, **trees) -> DataFrame:
    """Min-max scaling, then half-space trees, over one stream; the first row's score is null."""
    rows = arrival(_extremes(df, features, bucket, order), bucket, order, "_seq")

    def scaled(f: str, lo, hi):
        return F.when(lo.isNull(), None).when(lo == hi, 0.0).otherwise((F.col(f) - lo) / F.nullif(hi - lo, F.lit(0.0)))

    for f in features:
        lo, hi = F.col(f"{f}_lo"), F.col(f"{f}_hi")
        rows = rows.withColumn(f"{f}_ask", scaled(f, lo, hi)).withColumn(f"{f}_own", scaled(f, F.least(lo, f), F.greatest(hi, f)))
    out = half_space(rows, [f"{f}_own" for f in features], "_seq", score_features=[f"{f}_ask" for f in features], **trees)
    return out.drop("_seq", *[f"{f}_{x}" for f in features for x in ("lo", "hi", "ask", "own")])
