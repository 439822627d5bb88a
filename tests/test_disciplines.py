import numpy as np
import pytest

from tidewatch.functions.kernels import Lof
from tidewatch.operators import moving
from tidewatch.operators.fold import fold
from tidewatch.plans.stream import StreamSpec

X = np.random.default_rng(5).normal(size=(30, 3))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "i long, x double, y double, z double").cache()


@pytest.mark.parametrize("discipline", ["score_first", "learn_first"])
def test_pairs_and_distance(rows, discipline):
    spec, w = StreamSpec(("i",), (), discipline), 6
    out = moving.covariance(rows, spec, "x", "y", w, bias=False, out="cov")
    out = moving.correlation(out, spec, "x", "y", w, out="corr")
    out = moving.mahalanobis_all(out, spec, ["x", "y", "z"], w, out="far")
    for r in out.orderBy("i").collect():
        end = r.i + (discipline == "learn_first")
        past = X[max(0, end - w) : end]
        both = np.vstack([past, X[r.i]])
        cov = lambda m: np.cov(m[:, 0], m[:, 1])[0, 1] if len(m) > 1 else 0.0
        corr = lambda m: np.corrcoef(m[:, 0], m[:, 1])[0, 1] if len(m) > 1 and m.std(0)[:2].all() else 0.0
        assert r["cov"] == pytest.approx(abs(cov(both) - cov(past)) if len(past) else 0.0, abs=1e-9)
        assert r["corr"] == pytest.approx(abs(corr(both) - corr(past)), abs=1e-9)
        if len(past) > 3:
            gap = X[r.i] - past.mean(0)
            assert r["far"] == pytest.approx(gap @ np.linalg.solve(np.cov(past.T), gap), rel=1e-6)


def test_fold_learns_first(rows):
    spec = StreamSpec(("i",), (), "learn_first")
    got = [r.score for r in fold(rows, spec, ["x", "y"], lambda: Lof(3, 50)).orderBy("i").collect()]
    for i in (5, 17, 29):
        kernel = Lof(3, 50)
        for row in X[: i + 1, :2]:
            kernel.step(tuple(row))
        assert got[i] == pytest.approx(kernel.step(tuple(X[i, :2]))[0])
