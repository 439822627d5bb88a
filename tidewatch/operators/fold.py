"""Ordered folds of kernels: one instance for each key, in batch.

Rows are dealt by key and sorted within partitions; a task streams them in Arrow
batches and keeps the state of one key, so memory is bounded by a batch and a
state, however long a key's history is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch import jvm
from tidewatch.functions.kernels import Kernel, Resettable
from tidewatch.plans.stream import StreamSpec


def answers(kernel: Kernel, rows: Iterable[tuple], width: int, learn_first: bool = False) -> Iterator[tuple]:
    """What the kernel says of each row. A row with a null or NaN teaches nothing and gets nulls.

    learn_first: after it has learned the row.
    """
    none = (None,) * width
    for row in rows:
        if any(v is None or v != v for v in row):
            yield none
            continue
        made = kernel.step(row)
        yield kernel.score(row) if learn_first else made


def advance(kernel: Kernel, pdf: pd.DataFrame, features: list[str], outputs: list[str], learn_first: bool = False) -> pd.DataFrame:
    """pdf with the kernel's outputs, in the order of its rows."""
    rows = pdf[features].astype(object).itertuples(index=False, name=None)
    made = pd.DataFrame(list(answers(kernel, rows, len(outputs), learn_first)), columns=outputs, index=pdf.index)
    return pd.concat([pdf, made], axis=1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as the session shuffles to.

    A given number keeps adaptive execution from merging partitions that are small
    in bytes: a kernel's time grows with rows, so it wants all cores.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _keyed(batch: pa.RecordBatch, by: list[str]) -> list[tuple]:
    if not by:
        return [()] * batch.num_rows
    return [tuple("NaN" if v != v else v for v in key) for key in zip(*[batch.column(c).to_pylist() for c in by])]


def _dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return (spread(df, *by) if by else df.repartition(1)).sortWithinPartitions(*by, *order)


def _native(df: DataFrame, by: list[str], order: list[str], features: list[str], out: str, kernels: list[Kernel], learn_first: bool, stride: int = 0) -> DataFrame | None:
    """df, dealt by ``by`` and in order, with the kernels' mean answer, if the JVM knows the kernels and takes the columns."""
    twins = [k.twin() for k in kernels] if jvm.fits(df, by, features) else [None]
    if None in twins or not twins:
        return None
    rows = _dealt(df, by, order)
    return rows.withColumn(out, jvm.answer(rows, by, features, twins, learn_first, stride))


def _run(df: DataFrame, by: list[str], order: list[str], features: list[str], added: StructType, start: Callable[[tuple], list], row_of: Callable, learn_first: bool) -> DataFrame:
    """df, dealt by ``by`` and in order, with added columns: row_of(outputs of each of the kernels that start(key) makes)."""
    schema = StructType([*df.schema.fields, *added.fields])
    types = [f.type for f in to_arrow_schema(added)]
    dealt = _dealt(df, by, order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kernels = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keyed(batch, by)
            rows = list(zip(*[batch.column(c).to_pylist() for c in features]))
            edges = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]] + [len(keys)]
            made: list[tuple] = []
            for a, b in zip(edges[:-1], edges[1:]):
                if keys[a] != last:
                    last, kernels = keys[a], start(keys[a])
                each = [answers(k, rows[a:b], len(types) if len(kernels) == 1 else 1, learn_first) for k in kernels]
                made += [row_of(x) for x in zip(*each)]
            columns = [pa.array(c, t, from_pandas=True) for c, t in zip(zip(*made), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added.fieldNames()])

    return dealt.mapInArrow(run, schema)


def fold(df: DataFrame, spec: StreamSpec, features: list[str], make: Callable[[], Kernel], reset: str | None = None) -> DataFrame:
    """Adds the outputs of one kernel for each key of spec.by.

    A row with a null feature gets null outputs and isn't learned from. Without keys
    the whole stream passes through one task, as its state is one chain. reset: a
    boolean column; where it is true the kernel begins anew before the row (unless the
    row has a null feature). n_samples_seen is then added too.
    """
    spec.check(df, *features)
    if reset:
        flag = "_tw_reset"
        spec.check(df, reset)
        given = df.withColumn(flag, F.coalesce(F.col(reset), F.lit(False)).cast("int"))
        return fold(given, spec, [*features, flag], lambda: Resettable(make())).drop(flag)
    first = make()
    added = StructType.fromDDL(first.outputs)
    clean = df.drop(*added.fieldNames())
    how = clean, list(spec.by), list(spec.order), features
    made = _native(*how, "score", [first], spec.discipline == "learn_first")
    return made if made is not None else _run(*how, added, lambda key: [make()], lambda x: x[0], spec.discipline == "learn_first")


def describe(df: DataFrame, spec: StreamSpec, features: list[str], make: Callable[[], Kernel]) -> DataFrame:
    """A row for each key: rows learned, and what the kernel says of its state after the last of them."""
    spec.check(df, *features)
    by = list(spec.by)
    keep = list(dict.fromkeys([*by, *spec.order, *features]))
    schema = StructType([*[df.schema[c] for c in by], *StructType.fromDDL("n_samples_seen long, info map<string, array<double>>").fields])
    kinds = to_arrow_schema(schema)
    rows = df.select(*keep)
    dealt = (spread(rows, *by) if by else rows.repartition(1)).sortWithinPartitions(*by, *spec.order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shown, kernel, n = None, None, None, 0

        def told() -> pa.RecordBatch:
            info = [(k, [float(v) for v in x]) for k, x in kernel.info().items()]
            held = [pa.array([v], kinds.field(c).type) for c, v in zip(by, shown)]
            return pa.RecordBatch.from_arrays([*held, pa.array([n], pa.int64()), pa.array([info], kinds.field("info").type)], schema=kinds)

        for batch in batches:
            values = list(zip(*[batch.column(c).to_pylist() for c in features]))
            raw = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            for key, own, row in zip(_keyed(batch, by), raw, values):
                if kernel is None or key != last:
                    if kernel is not None:
                        yield told()
                    last, shown, kernel, n = key, own, make(), 0
                if not any(v is None or v != v for v in row):
                    kernel.step(row)
                    n += 1
        if kernel is not None:
            yield told()

    return dealt.mapInArrow(run, schema)


def _mean(x: tuple) -> tuple:
    """Sum and number of the members' answers; nulls if there are none."""
    got = [v for (v,) in x if v is not None]
    return (sum(got), len(got)) if got else (None, None)


def ensemble(df: DataFrame, spec: StreamSpec, features: list[str], members: int, make: Callable[[int], Kernel], out: str = "mean", groups: int | None = None) -> DataFrame:
    """Adds the mean output of members that each fold the whole stream of a key.

    groups: tasks that share the members of a key. With one, rows are dealt once and
    all members of a key step on the same batches; with more, rows (order, key and
    features only) are repeated for each group and the sums are joined back, which
    pays where a few keys hold most rows. By default one with keys, and as many as
    the session shuffles to without.
    """
    spec.check(df, *features)
    learn_first = spec.discipline == "learn_first"
    by, order = list(spec.by), list(spec.order)
    if groups is None:
        groups = 1 if by else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(groups, members))
    added = StructType.fromDDL("_sum double, _of long")
    kernels = [make(m) for m in range(members)]
    if groups == 1:
        made = _native(df.drop(out), by, order, features, out, kernels, learn_first)
        if made is not None:
            return made
        start = lambda key: [make(m) for m in range(members)]
        made = _run(df.drop(out), by, order, features, added, start, _mean, learn_first)
        return made.withColumn(out, F.col("_sum") / F.col("_of")).drop("_sum", "_of")
    row = list(dict.fromkeys([*by, *order]))
    wide = df.select(*row, *[c for c in features if c not in row])
    wide = wide.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    each = _native(wide, [*by, "_group"], order, features, "_mean", kernels, learn_first, groups)
    if each is not None:
        held = F.lit(members // groups) + (F.col("_group") < members % groups).cast("int")
        each = each.withColumn("_of", F.when(F.col("_mean").isNotNull(), held)).withColumn("_sum", F.col("_mean") * F.col("_of"))
        sums = each.groupBy(*row).agg((F.sum("_sum") / F.sum("_of")).alias(out))
        return df.drop(out).join(sums, row)
    start = lambda key: [make(m) for m in range(key[-1], members, groups)]
    each = _run(wide, [*by, "_group"], order, features, added, start, _mean, learn_first)
    sums = each.groupBy(*row).agg((F.sum("_sum") / F.sum("_of")).alias(out))
    return df.drop(out).join(sums, row)
