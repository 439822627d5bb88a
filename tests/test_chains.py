import pickle

import numpy as np
import pytest

from tidewatch.functions import transforms as X
from tidewatch.functions.kernels import IncrementalPca, Lof
from tidewatch.operators import simple
from tidewatch.operators.pipelines import chain
from tidewatch.plans.stream import StreamSpec

ROWS = np.random.default_rng(3).normal(2, 4, (40, 3))


def test_scalers_against_numpy():
    low, std = X.MinMaxScaler(3, -1.0, 1.0), X.StandardScaler(3)
    for i, row in enumerate(ROWS):
        a, b = low.step(tuple(row)), std.step(tuple(row))
        past = ROWS[:i]
        if i == 0:
            assert a == b == (None, None, None)
        elif i == 1:
            assert a == (-1.0,) * 3 and b == (0.0,) * 3
        else:
            span = past.max(0) - past.min(0)
            assert a == pytest.approx(-1 + 2 * (row - past.min(0)) / span)
            assert b == pytest.approx((row - past.mean(0)) / past.std(0))
    with pytest.raises(ValueError):
        X.MinMaxScaler(1, 1.0, 1.0)


def test_chain_scores_before_and_learns_after():
    made = X.Chain(X.StandardScaler(3), Lof(3, 50))
    learned = Lof(3, 50)
    for i, row in enumerate(ROWS):
        got = made.step(tuple(row))
        if i:
            past = ROWS[:i]
            dev = past.std(0)
            asked = np.where(dev > 0, (row - past.mean(0)) / np.where(dev > 0, dev, 1), 0)
            assert got == pytest.approx(pickle.loads(pickle.dumps(learned)).step(tuple(asked)))
        else:
            assert got == (None,)
        so_far = ROWS[: i + 1]
        dev = so_far.std(0)
        learned.step(tuple(np.where(dev > 0, (row - so_far.mean(0)) / np.where(dev > 0, dev, 1), 0)))


def test_chain_shapes():
    with pytest.raises(ValueError):
        X.Chain(Lof(3, 50), X.StandardScaler(3))
    with pytest.raises(ValueError):
        X.Chain(Lof(3, 50))
    nested = X.Chain(X.Chain(X.MinMaxScaler(3), X.RandomProjection(3, 2)), IncrementalPca(2, 5))
    assert len(nested.parts) == 3 and nested.outputs == "component_0 double, component_1 double"
    flat = X.Chain(X.MinMaxScaler(3), X.RandomProjection(3, 2), IncrementalPca(2, 5))
    for row in ROWS:
        before = nested.transform(tuple(row))
        assert before == nested.step(tuple(row)) == flat.step(tuple(row))


@pytest.mark.parametrize("discipline", ["score_first", "learn_first"])
def test_chain_over_a_frame(spark, discipline):
    df = spark.createDataFrame([(i % 2, i, *map(float, r)) for i, r in enumerate(ROWS)], "k int, i int, a double, b double, c double")
    spec = StreamSpec(("i",), ("k",), discipline)
    out = chain(df, spec, ["a", "b", "c"], lambda: X.StandardScaler(3), lambda: Lof(3, 50))
    kernels = [X.Chain(X.StandardScaler(3), Lof(3, 50)) for _ in range(2)]
    for r in out.orderBy("i").collect():
        row = (r.a, r.b, r.c)
        want = kernels[r.k].step(row)
        if discipline == "learn_first":
            want = pickle.loads(pickle.dumps(kernels[r.k])).step(row)
        assert r.score == (pytest.approx(want[0]) if want[0] is not None else None)
    empty = chain(df.where("i < 0"), spec, ["a", "b", "c"], lambda: X.StandardScaler(3), lambda: Lof(3, 50))
    assert empty.collect() == [] and empty.columns == ["k", "i", "a", "b", "c", "score"]


def test_predict(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (None,)], "score double")
    assert [r.predicted for r in simple.predict(df).collect()] == [0, 1, None]
