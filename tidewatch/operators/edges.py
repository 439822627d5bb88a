"""Densities of edges over one stream, dealt over tasks: a piece of the stream begins with the counts of all pieces before it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import jvm
from tidewatch.functions.learners import PRIME, AnoEdge
from tidewatch.operators.fold import fold, spread
from tidewatch.plans.stream import StreamSpec

#: Pieces that a stream is cut into at most, and bytes that their first counts have at most.
PIECES, HELD = 64, 1 << 25
_CUT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _place(df: DataFrame, column: str) -> Column:
    """A number that never falls where the column's values rise."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):  # by its own digits, as a zone's clock may go back
        return F.unix_date(value.cast("date")).cast("long") * 86400 + F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
    return value.cast("double")


def _piece(at: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are not above the value, by halves; nulls come first, and NaN last, as in the order."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(at >= F.lit(bounds[half]), _piece(at, bounds[half + 1 :], first + half + 1)).otherwise(_piece(at, bounds[:half], first))


def anoedge(df: DataFrame, spec: StreamSpec, features: list[str], make: Callable[[], AnoEdge]) -> DataFrame:
    """Adds the score of each edge; features: source, target and, if wanted, time.

    Without decay the matrices are counts of earlier rows, so the stream is cut by values
    of the first order column, and a piece begins with the sums of the pieces before.
    With keys, with decay, or by a column that has no quantiles, it is one fold.
    """
    spec.check(df, *features)
    kernel, first, edge = make(), df.schema[spec.order[0]].dataType, features[:2]
    cells = kernel.m[0].size
    pieces = min(PIECES, HELD // (8 * kernel.m.size))
    native = jvm.fits(df, [], features) and kernel.twin() is not None
    whole = isinstance(first, _CUT) and all(isinstance(df.schema[c].dataType, _WHOLE) for c in edge)
    if spec.by or kernel.decay != 1.0 or not native or not whole or pieces < 2:
        return fold(df, spec, features, make)
    shares = [k / pieces for k in range(1, pieces)]
    rows = df.drop("score").withColumn("_at", _place(df, spec.order[0]))
    found = rows.agg(F.percentile_approx("_at", shares).alias("b")).first().b or []
    bounds = sorted({b for b in found if b == b})
    rows = rows.withColumn("_piece", _piece(F.col("_at"), bounds)).drop("_at")

    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])
    hashed = []
    for h in range(len(kernel.m)):
        i, j = [F.pmod(int(kernel.a[k][h]) * F.pmod(F.col(c).cast("long"), F.lit(PRIME)) + int(kernel.b[k][h]), F.lit(PRIME)) for k, c in enumerate(edge)]
        hashed.append(F.pmod(i, F.lit(kernel.m.shape[1])) * kernel.m.shape[2] + F.pmod(j, F.lit(kernel.m.shape[2])) + h * cells)
    counts = rows.where(known).select("_piece", F.explode(F.array(*hashed)).alias("_cell")).groupBy("_piece", "_cell").count().toArrow()
    before = np.zeros((len(bounds) + 2, kernel.m.size), np.int64)
    before[counts["_piece"].to_numpy() + 1, counts["_cell"].to_numpy()] = counts["count"].to_numpy()
    before = before.cumsum(0)
    twins = [make().twin(int(c[:cells].sum()), c) for c in before[:-1]]

    dealt = spread(rows, "_piece").sortWithinPartitions(*spec.order)  # pieces are in order too
    score = jvm.answer(dealt, ["_piece"], features, twins, spec.discipline == "learn_first", len(twins))
    return dealt.withColumn("score", score).drop("_piece")
