"""Moving statistics against numpy, row by row, in both disciplines."""

import numpy as np
import pytest

from tidewatch.operators import moving
from tidewatch.plans.stream import StreamSpec, arrival


def stat(name, v, q=0.7):
    v = np.array(v, float)
    m = v.mean()
    m2 = ((v - m) ** 2).mean()
    return {
        "mean": lambda: m, "harmonic": lambda: len(v) / (1 / v).sum(), "geometric": lambda: np.exp(np.log(v).mean()),
        "median": lambda: np.median(v), "quantile": lambda: np.quantile(v, q), "variance": lambda: m2,
        "iqr": lambda: np.quantile(v, 0.75) - np.quantile(v, 0.25), "aad": lambda: np.abs(v - m).mean(),
        "kurtosis": lambda: ((v - m) ** 4).mean() / m2**2 if m2 else None,
        "skewness": lambda: ((v - m) ** 3).mean() / m2**1.5 if m2 else None,
    }[name]()


def expected(name, values, window, learn_first):
    held, out = [], []
    for x in values:
        enters = x is not None and (x != 0 if name == "harmonic" else x > 0 if name == "geometric" else True)
        if learn_first and enters:
            held.append(x)
        past = held[-window:]
        if x is None:
            out.append(None)
        elif len(past) <= (name == "geometric"):
            out.append(1.0 if name == "geometric" else 0.0)
        elif name == "harmonic" and x == 0:
            out.append(0.0)
        elif not enters:
            out.append(None)
        else:
            a, b = stat(name, past), stat(name, [*past, x])
            out.append(0.0 if a is None or b is None else abs(b - a))
        if not learn_first and enters:
            held.append(x)
    return out


@pytest.mark.parametrize("discipline", ["score_first", "learn_first"])
def test_statistics(spark, discipline):
    rng = np.random.default_rng(0)
    values = [None if i % 11 == 5 else 0.0 if i % 7 == 3 else float(x) for i, x in enumerate(np.round(rng.gamma(2, 3, 60), 2))]
    values += [4.0] * 6
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, i int, v double")
    spec = StreamSpec(("i",), ("k",), discipline)
    for name in moving.STATS:
        got = [r.score for r in moving.moving(df, spec, "v", name, 5, quantile=0.7).orderBy("i").collect()]
        want = expected(name, values, 5, discipline == "learn_first")
        assert [x is None for x in got] == [x is None for x in want], name
        np.testing.assert_allclose([x or 0 for x in got], [x or 0 for x in want], atol=1e-8, err_msg=name)


def test_golden(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i int, v double")
    got = [r.score for r in moving.moving(df, StreamSpec(("i",)), "v", "mean", 3).orderBy("i").collect()]
    assert got == [0.0, 1.0 - 0.5, 0.5]
    pairs = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 3.0), (2, 3.0, 8.0), (3, 4.0, 15.0)], "i int, x double, y double")
    x, y = np.array([1, 2, 3, 4.0]), np.array([0, 3, 8, 15.0])
    for bias in (True, False):
        want = np.cov(x, y, ddof=1 - bias)[0, 1] - np.cov(x[:3], y[:3], ddof=1 - bias)[0, 1]
        row = moving.covariance(pairs, StreamSpec(("i",)), "x", "y", 3, bias).where("i = 3").first()
        assert row.score == pytest.approx(abs(want))


def test_rejects(spark):
    df = spark.createDataFrame([(0, 1.0)], "i int, v double")
    with pytest.raises(ValueError):
        moving.moving(df, StreamSpec(("i",)), "v", "mean", 0)
    with pytest.raises(ValueError):
        moving.moving(df, StreamSpec(("i",)), "nope", "mean", 3)
    with pytest.raises(ValueError):
        StreamSpec(())
    with pytest.raises(ValueError):
        StreamSpec(("i",), (), "sometimes")


def test_empty(spark):
    df = spark.createDataFrame([], "i int, v double")
    assert moving.moving(df, StreamSpec(("i",)), "v", "iqr", 3).count() == 0


def test_arrival(spark):
    rows = [(i // 7, i * 3 % 50) for i in range(40)]
    df = spark.createDataFrame(rows, "b int, i int")
    got = {(r.b, r.i): r.seq for r in arrival(df, "b", ("i",)).collect()}
    assert got == {x: k for k, x in enumerate(sorted(rows))}
