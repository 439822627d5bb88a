"""An ordered, optionally keyed stream, and the frames that its operators use."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

Discipline = Literal["score_first", "learn_first"]


@dataclass(frozen=True)
class StreamSpec:
    """by: one independent instance for each key; order: columns that make the order total.

    Without by a window runs in one task. Operators over integer time buckets
    avoid that: see ``arrival``.
    """

    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    discipline: Discipline = "score_first"

    def __post_init__(self):
        if not self.order:
            raise ValueError("a stream needs order columns")
        if self.discipline not in ("score_first", "learn_first"):
            raise ValueError(f"unknown discipline {self.discipline!r}")

    def ordered(self, *more: str) -> WindowSpec:
        return Window.partitionBy(*self.by, *more).orderBy(*self.order)

    def past(self, size: int | None = None) -> WindowSpec:
        """The last size rows (all, if None) that are learned when a row is scored."""
        lead = 0 if self.discipline == "learn_first" else -1
        first = Window.unboundedPreceding if size is None else lead - size + 1
        return self.ordered().rowsBetween(first, lead)

    def check(self, df: DataFrame, *columns: str) -> None:
        missing = [c for c in (*self.by, *self.order, *columns) if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")


#: Intervals that the range of the first order column is cut into.
INTERVALS = 1 << 14


def interval(df: DataFrame, column: str) -> Column | None:
    """The interval of a column's range that a row's value lies in, in order; null if the type has no distances."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    elif not isinstance(kind, T.NumericType):
        return None
    value = value.cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    low, high = df.select(F.min(finite), F.max(finite)).first()
    if low is None:
        return F.lit(0).cast("long")
    inside = F.floor((value - low) / (max(high - low, 1e-9) / (INTERVALS - 1)))
    place = F.when(value < low, -1).when(value > high, INTERVALS).otherwise(inside)  # NaN is greatest, as in the order
    return F.coalesce(place, F.lit(-2)).cast("long")  # nulls come first


def arrival(df: DataFrame, bucket: str, order: tuple[str, ...], name: str = "seq") -> DataFrame:
    """Adds the position of each row in the whole stream (by bucket, then order), from 0, without a global sort.

    Rows are numbered inside their interval of the first order column in their
    bucket, and shifted by the rows of what comes earlier, one number for each bucket
    and interval: so a task sorts an interval's rows, however long a bucket.
    """
    by = interval(df, order[0])
    rows = df.withColumn("_tw_part", F.lit(0).cast("long") if by is None else by)
    parts = [F.col(bucket).alias("_tw_bucket"), F.col("_tw_part").alias("_tw_at")]
    earlier = Window.orderBy("_tw_bucket", "_tw_at").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*parts).agg(F.count("*").alias("_tw_n"))
    before = before.withColumn("_tw_before", F.coalesce(F.sum("_tw_n").over(earlier), F.lit(0))).drop("_tw_n")
    inside = F.row_number().over(Window.partitionBy(bucket, "_tw_part").orderBy(*order)) - 1
    return (
        rows.withColumn("_tw_inside", inside)
        .join(before, F.col(bucket).eqNullSafe(F.col("_tw_bucket")) & (F.col("_tw_part") == F.col("_tw_at")))
        .withColumn(name, (F.col("_tw_before") + F.col("_tw_inside")).cast("long"))
        .drop("_tw_inside", "_tw_before", "_tw_bucket", "_tw_at", "_tw_part")
    )


def nonneg(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))
