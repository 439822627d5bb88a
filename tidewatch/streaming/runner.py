"""The same kernels over a stream: state of each key between micro-batches, rows in order within one."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidewatch.functions.kernels import Kernel
from tidewatch.operators.fold import advance
from tidewatch.plans.stream import StreamSpec


def stream_fold(df: DataFrame, spec: StreamSpec, features: list[str], make: Callable[[], Kernel], late: str = "error") -> DataFrame:
    """Adds kernel outputs to a streaming frame.

    A row that is older than the newest of an earlier batch of its key is an error,
    or is dropped with late="drop".
    """
    if not spec.by:
        raise ValueError("streaming state needs keys; add a constant one for a single stream")
    if late not in ("error", "drop"):
        raise ValueError(f"unknown late policy {late!r}")
    added = StructType.fromDDL(make().outputs)
    names = added.fieldNames()
    schema = StructType([*df.schema.fields, *added.fields])
    order = list(spec.order)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kernel, newest = pickle.loads(state.get[0]) if state.exists else (make(), None)
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)
        if newest is not None and len(pdf):
            old = [tuple(r) <= newest for r in pdf[order].itertuples(index=False, name=None)]
            if any(old) and late == "error":
                raise ValueError(f"rows of key {key} are older than {newest}")
            pdf = pdf[[not x for x in old]].reset_index(drop=True)
        if len(pdf):
            newest = tuple(pdf[order].iloc[-1])
        out = advance(kernel, pdf, features, names, spec.discipline == "learn_first")
        state.update((pickle.dumps((kernel, newest)),))
        yield out

    return df.groupBy(*spec.by).applyInPandasWithState(
        run, schema, "state binary", "append", GroupStateTimeout.NoTimeout
    )
