"""Detectors on running and decayed counts over integer time buckets: edge streams and tuples.

Counts are exact, so the scores are those of collision-free sketches. The
position in the whole stream comes from bucket sizes, not from a global sort.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.plans.stream import arrival


def _seen(order: tuple[str, ...], *by: str) -> Column:
    """Earlier rows with the same key."""
    return F.count("*").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def decayed(df: DataFrame, keys: list[str], bucket: str, factor: float, lag: int, name: str) -> DataFrame:
    """keys, bucket, name: the sum over earlier buckets b of factor ** (bucket - b - lag) times their rows.

    One row for each key and bucket goes into the fold, in order; powers never exceed 1.
    The fold runs over runs of about the square root of a key's buckets, so that what it
    copies to append a sum is a run, or the list of runs, and never all sums.
    """
    per = df.groupBy(*keys, bucket).agg(F.count("*").alias("_c"))
    kind = "array<struct<b:bigint,h:double>>"
    within = f"""aggregate(run, named_struct('b', before.b, 'h', before.h, 'out', cast(array() as {kind})),
      (acc, x) -> transform(array(if(acc.b is null, 0D, acc.h * pow({factor}D, x.b - acc.b))), h ->
        named_struct('b', x.b, 'h', h + x.c * pow({factor}D, -{lag}), 'out', concat(acc.out, array(named_struct('b', x.b, 'h', h)))))[0])"""
    fold = f"""aggregate(_runs, named_struct('b', cast(null as bigint), 'h', 0D, 'out', cast(array() as array<{kind}>)),
      (before, run) -> transform(array({within}), made ->
        named_struct('b', made.b, 'h', made.h, 'out', concat(before.out, array(made.out))))[0],
      made -> flatten(made.out))"""
    size = "greatest(1, cast(sqrt(size(_all)) as int))"
    runs = f"transform(sequence(1, size(_all), {size}), i -> slice(_all, i, {size}))"
    each = F.struct(F.col(bucket).cast("long").alias("b"), F.col("_c").cast("double").alias("c"))
    out = per.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("_all")).withColumn("_runs", F.expr(runs))
    return out.select(*keys, F.explode(F.expr(fold)).alias("_o")).select(*keys, F.col("_o.b").alias(bucket), F.col("_o.h").alias(name))


def running(df: DataFrame, base: DataFrame, keys: list[str], bucket: str, order: tuple[str, ...], name: str) -> DataFrame:
    """Adds the number of earlier rows with the same keys.

    base: the rows that are counted, before anything was joined to them, so that a
    chain of such counts doesn't repeat its own joins.

    Whole earlier buckets are summed over one row for each key and bucket, so a task
    holds one key's rows of one bucket at most, however frequent the key.
    """
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    hist = base.groupBy(*keys, bucket).agg(F.count("*").alias("_tw_n"))
    hist = hist.withColumn("_tw_before", F.coalesce(F.sum("_tw_n").over(past), F.lit(0))).drop("_tw_n")
    out = df.join(hist, [*keys, bucket]).withColumn(name, (F.col("_tw_before") + _seen(order, *keys, bucket)).cast("long"))
    return out.drop("_tw_before")


def midas(df: DataFrame, src: str, dst: str, bucket: str, order: tuple[str, ...], warm_up: int = 128, relational: bool = True, normalize: bool = False, eps: float = 1e-9, out: str = "score") -> DataFrame:
    """Edge microclusters: an edge's count in its bucket against its mean and its ends' totals."""
    base = df.withColumn(bucket, F.col(bucket).cast("long"))
    rows = arrival(base, bucket, order, "_n").withColumn("_a", _seen(order, src, dst, bucket) + 1)
    for name, keys in (("_s", [src, dst]), ("_u", [src]), ("_d", [dst])):
        rows = running(rows, base, keys, bucket, order, name).withColumn(name, F.col(name) + 1)
    first = df.agg(F.min(bucket).alias("_t0"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("_bi", F.col(bucket) - F.col("_t0") + 1)  # one row
    chi = lambda e: F.pow(F.col("_a") - e, F.lit(2.0)) / (e + eps)
    score = chi(F.col("_s") / F.col("_bi"))
    if relational:
        score = F.greatest(score, chi(F.col("_u") * F.col("_d") / (F.col("_n") + 1 + eps)))
    if normalize:
        score = score / (1 + score)
    score = F.when((F.col("_n") < warm_up) | (F.col("_bi") < 2), 0.0).otherwise(score)
    return rows.withColumn(out, score).drop("_n", "_a", "_s", "_u", "_d", "_t0", "_bi")


def isconna(df: DataFrame, src: str, dst: str, bucket: str, order: tuple[str, ...], decay: float = 0.5, warm_up: int = 64, normalize: bool = False, eps: float = 1e-9, out: str = "score") -> DataFrame:
    """Rarity and novelty of an edge over all time, times its burst in decayed counts."""
    base = df.withColumn(bucket, F.col(bucket).cast("long"))
    rows = arrival(base, bucket, order, "_n")
    for name, keys in (("e", [src, dst]), ("u", [src]), ("d", [dst]), ("m", [])):
        hist = decayed(base.withColumn("_one", F.lit(1)), keys or ["_one"], bucket, decay, 0, f"_h{name}")
        if not keys:
            hist = hist.drop("_one")
        rows = rows.join(hist, [*keys, bucket]).withColumn(f"_c{name}", F.col(f"_h{name}") + _seen(order, *keys, bucket) + 1)
        if keys:
            rows = running(rows, base, keys, bucket, order, f"_t{name}").withColumn(f"_t{name}", F.col(f"_t{name}") + 1)
    expected = F.col("_tu") * F.col("_td") / (F.col("_n") + 1)
    current = F.col("_cu") * F.col("_cd") / F.col("_cm")
    score = (expected / (F.col("_te") + eps) + 1 / (F.col("_te") + eps)) * (F.col("_ce") + eps) / (current + eps)
    if normalize:
        score = score / (1 + score)
    rows = rows.withColumn(out, F.when(F.col("_n") < warm_up, 0.0).otherwise(score))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def mstream(df: DataFrame, features: list[str], bucket: str, order: tuple[str, ...], alpha: float = 0.6, max_pairs: int = 64, warm_up: int = 1, eps: float = 1e-9, out: str = "score") -> DataFrame:
    """Counts of feature values and pairs in the bucket against their decayed history; the mean over views."""
    names = sorted(features)
    views = [(f,) for f in names] + list(combinations(names, 2))[:max_pairs]
    rows = df.withColumn(bucket, F.col(bucket).cast("long"))
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("view"), F.xxhash64(F.lit(i), *v).alias("key")) for i, v in enumerate(views)]))
    long = rows.select(*order, bucket, keyed.alias("v")).select(*order, bucket, "v.view", "v.key")
    hist = decayed(long, ["view", "key"], bucket, alpha, 1, "h")
    long = long.join(hist, ["view", "key", bucket]).withColumn("c", _seen(order, "view", "key", bucket) + 1)
    score = long.groupBy(*order).agg(F.avg(F.pow(F.col("c") - F.col("h"), F.lit(2.0)) / (F.col("h") + eps)).alias("_score"))
    first = df.agg(F.min(bucket).cast("long").alias("_t0"))
    rows = rows.join(score, list(order)).crossJoin(F.broadcast(first))  # one row
    ready = F.col(bucket) - F.col("_t0") >= warm_up
    return rows.withColumn(out, F.when(ready, F.col("_score")).otherwise(0.0)).drop("_score", "_t0")
