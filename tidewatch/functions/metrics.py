"""Ranking metrics of labelled scores, by ranked cumulative sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.plans.stream import interval


def _thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row for each distinct score, from the highest: positives and rows so far.

    Sums run inside intervals of the score and are shifted by those of higher intervals.
    """
    per = df.groupBy(F.col(score).cast("double").alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    per = per.withColumn("_part", interval(per, "_s"))
    before = Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each interval
    sums = per.groupBy(F.col("_part").alias("_at")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = sums.select("_at", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_p", "_n")])
    down = Window.partitionBy("_part").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    rows = per.select("_s", "p", "n", "_part", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("all"))
    rows = rows.join(F.broadcast(sums), F.col("_part") == F.col("_at"))  # INTERVALS + 3 rows at most
    return rows.select("_s", "p", "n", (F.col("tp") + F.col("_p")).alias("tp"), (F.col("all") + F.col("_n")).alias("all"))


def pr_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision: recall steps times precision, ties taken together."""
    steps = _thresholds(df, score, label)
    return steps.agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.nullif(F.sum("p"), F.lit(0))).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of pairs that the score orders rightly, ties as half."""
    s = _thresholds(df, score, label)
    below = F.col("tp") - F.col("p") / 2
    return s.agg((F.sum((F.col("n") - F.col("p")) * below) / F.nullif(F.sum("p") * F.sum(F.col("n") - F.col("p")), F.lit(0))).alias("roc_auc"))
