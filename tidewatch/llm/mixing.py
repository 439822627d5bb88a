"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target number of words: a share by weight of ``budget`` times
all words, at most ``cap`` times the source's own, the excess reshared by weight
(water filling). Every document of a source then has the same expected number
of copies. Its whole part is fixed; the fractional parts are rounded by weighted
pivotal rounding: two documents exchange word mass, in a random direction whose
expectation is nil, until one of them is integral. The words that a source
takes are kept exactly in each exchange, so only the last residual of a source
can move them, by less than one document.

Documents are dealt by hash to blocks of about ``block`` each; a block is folded
by a higher-order function and leaves at most one residual, and residuals are
folded again, level by level, as a reduction tree. No task sees more than a
block of a source, however large the source.

Randomness is a hash of seed, level and document: reruns agree.

Defined results: a null or empty text has size 0 and nothing of it is taken; a very
long text is one unit as any other; the null source is a source, last in order; a
null id is an id; repeated rows (same id, source and size) are decided together and
each is returned; ties between documents are broken by a hash; an empty table gives
no rows. Other columns, whatever their names, are ignored by the query and kept by
``take``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch, table

WORDS = r"[^\x20\x09-\x0D]++"
UNIT = "struct<doc_id:bigint,size:bigint,n:bigint,whole:bigint,w:double,p:double>"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from source, source_size. One row a source, so one task is enough."""
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by_ratio = Window.orderBy("ratio", "turn").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    level = (F.col("total") * budget - F.col("caps_before")) / (F.col("weight_all") - F.col("weight_before"))
    return (
        sizes.withColumn("turn", turn)
        .withColumn("weight", weight)
        .withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("weight_all", F.sum("weight").over(every))
        .withColumn("caps_before", F.coalesce(F.sum(cap * F.col("source_size")).over(by_ratio), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "turn", "level"))).over(every)["level"])
        .select(
            "source", "source_size",
            F.least(cap * F.col("source_size"), F.coalesce(F.col("weight") * F.col("level"), cap * F.col("source_size"))).alias("target"),
        )
    )


#: One exchange of mass between the residual r and the next document x. u in [0, 1) picks the direction:
#: up gives r what x can lose, down gives x what r can lose.
_FOLD = """
aggregate(
  array_sort(units),
  named_struct('r', cast(null as {unit}), 'done', cast(array() as array<{unit}>)),
  (acc, x) -> case
    when acc.r is null then named_struct('r', x, 'done', acc.done)
    else transform(array(named_struct(
        'up', least((1 - acc.r.p) * acc.r.w, x.p * x.w),
        'down', least(acc.r.p * acc.r.w, (1 - x.p) * x.w),
        'u', pmod(xxhash64({seed}, {level}, x.doc_id, x.size, acc.r.doc_id), 9007199254740992L) / 9007199254740992D)),
      m -> case
        when m.u * (m.up + m.down) < m.down then
          if((1 - acc.r.p) * acc.r.w <= x.p * x.w,
             named_struct('r', {x_less}, 'done', concat(acc.done, array({r_one}))),
             named_struct('r', {r_more}, 'done', concat(acc.done, array({x_zero}))))
        else
          if(acc.r.p * acc.r.w <= (1 - x.p) * x.w,
             named_struct('r', {x_more}, 'done', concat(acc.done, array({r_zero}))),
             named_struct('r', {r_less}, 'done', concat(acc.done, array({x_one}))))
      end)[0]
  end)
"""


def _with_p(of: str, p: str) -> str:
    fields = ", ".join(f"'{f}', {of}.{f}" for f in ("doc_id", "size", "n", "whole", "w"))
    return f"named_struct({fields}, 'p', cast({p} as double))"


def _fold(seed: int, level: int) -> str:
    r, x = "acc.r", "x"
    return _FOLD.format(
        unit=UNIT, seed=seed, level=level,
        r_one=_with_p(r, "1"), r_zero=_with_p(r, "0"), x_one=_with_p(x, "1"), x_zero=_with_p(x, "0"),
        r_more=_with_p(r, "greatest(0D, least(1D, acc.r.p + m.up / acc.r.w))"),
        r_less=_with_p(r, "greatest(0D, least(1D, acc.r.p - m.down / acc.r.w))"),
        x_more=_with_p(x, "greatest(0D, least(1D, x.p + m.down / x.w))"),
        x_less=_with_p(x, "greatest(0D, least(1D, x.p - m.up / x.w))"),
    )


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0,
    seed: int = 11, block: int = 64,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies; one row for each row of docs."""
    scratch = Scratch(docs.sparkSession, "mix")
    units = scratch.keep(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
        .groupBy("source", "doc_id", "size")
        .agg(F.count("*").alias("n"))
    )
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    sizes = scratch.keep(sizes)
    aims = scratch.keep(
        targets(sizes.select("source", "source_size"), weights, budget, cap)
        .withColumnRenamed("source", "_s")
        .join(sizes.select("source", "units"), F.col("_s").eqNullSafe(F.col("source")))
        .drop("source")
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (
        units.join(aims, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_share", share)
        .withColumn("whole", F.floor("_share"))
        .withColumn("p", F.col("_share") - F.col("whole"))
    )
    unit = F.struct("doc_id", "size", "n", "whole", (F.col("size") * F.col("n")).cast("double").alias("w"), "p")
    about = ["source", "source_size", "target", "units"]
    fixed = (F.col("p") <= 0) | (F.col("size") == 0)
    decided = planned.where(fixed).select("source", "source_size", "target", unit.alias("unit"), F.lit(0.0).alias("p"))
    open_ = planned.where(~fixed).select(*about, unit.alias("unit"))
    most = sizes.agg(F.max("units")).first()[0] or 1
    levels = max(1, math.ceil(math.log(max(most, 2)) / math.log(block)))
    for level in range(levels):
        blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / float(block) ** (level + 1)))
        blocks = blocks if level + 1 < levels else F.lit(1)
        deal = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "unit.doc_id", "unit.size"), blocks)
        folded = scratch.keep(
            open_.withColumn("_block", deal)
            .groupBy(*about, "_block")
            .agg(F.collect_list("unit").alias("units_of"))
            .withColumnRenamed("units", "_units")
            .withColumnRenamed("units_of", "units")
            .withColumn("_fold", F.expr(_fold(seed, level)))
            .select("source", "source_size", "target", F.col("_units").alias("units"), "_fold.r", "_fold.done")
        )
        done = folded.select("source", "source_size", "target", F.explode("done").alias("unit"))
        decided = decided.unionByName(done.withColumn("p", F.col("unit.p")))
        settled = F.col("r").isNotNull() & ((F.col("r.p") <= 0) | (F.col("r.p") >= 1))
        ended = folded.where(settled).select("source", "source_size", "target", F.col("r").alias("unit"), F.col("r.p").alias("p"))
        decided = decided.unionByName(ended)
        open_ = folded.where(F.col("r").isNotNull() & ~settled).select(*about, F.col("r").alias("unit"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "unit.doc_id", "unit.size"), F.lit(1 << 53)) / float(1 << 53)
    last = open_.select("source", "source_size", "target", "unit", F.when(draw < F.col("unit.p"), 1.0).otherwise(0.0).alias("p"))
    out = decided.unionByName(last).withColumn("copies", F.col("unit.whole") + F.col("p").cast("long"))
    # A row for each repeat, in two steps so that no array grows with the table.
    out = out.withColumn("_hi", F.explode(F.expr("sequence(0L, (unit.n - 1) div 4096)")))
    out = out.withColumn("_lo", F.explode(F.expr("sequence(1L, least(4096L, unit.n - _hi * 4096))")))
    return out.select(
        F.col("unit.doc_id").alias("doc_id"), "source", F.col("unit.size").alias("size"), "source_size", "target",
        (F.col("unit.size") * F.col("copies")).cast("long").alias("taken"), "copies",
    )


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix: docs of at least one copy, with their copies and the words taken.

    Columns of docs named copies or taken stay, as copies_before and taken_before.
    """
    made = mix(docs, **how).where("copies > 0").select(
        F.col("doc_id").alias("_tw_doc"), F.col("source").alias("_tw_source"), F.col("size").alias("_tw_size"), "copies", "taken"
    ).distinct()
    for c in ("copies", "taken"):
        docs = docs.withColumnRenamed(c, f"{c}_before")
    same = (
        F.col("doc_id").eqNullSafe(F.col("_tw_doc"))
        & F.col("source").eqNullSafe(F.col("_tw_source"))
        & (size_of(F.col("text")) == F.col("_tw_size"))
    )
    return docs.join(made, same).drop("_tw_doc", "_tw_source", "_tw_size")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
