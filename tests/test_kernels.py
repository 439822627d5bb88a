"""Kernels by themselves: published values, behaviour, determinism, resuming from state."""

import pickle

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.functions import forests as T
from tidewatch.functions import kernels as K
from tidewatch.functions import learners as L


def run(kernel, rows):
    return [kernel.step(tuple(r)) for r in rows]


def test_pca_golden():
    k = K.IncrementalPca(2, 3)
    run(k, [(1, 2, 2.5, 5, 5), (10, 10.5, 11, 8, 4), (3, 3.5, 7, 10, 9)])
    assert k.values == pytest.approx([325.52805, 35.94132], abs=1e-5)
    k.step((2, 3, 3.5, 11, 5))
    assert k.values == pytest.approx([263.20439, 31.11496], abs=1e-5)
    k.step((4, 3.4, 9.5, 1, 1))
    assert k.values == pytest.approx([215.25829, 31.20006], abs=1e-5)


@pytest.mark.parametrize("make", [lambda: K.PageHinkley(threshold=20), K.Adwin, K.Kswin])
def test_drift(make):
    rng = np.random.default_rng(1)
    calm = [r[0] for r in run(make(), rng.normal(0, 1, (400, 1)))]
    assert sum(calm) <= 4
    shift = [r[0] for r in run(make(), [(0.0,)] * 200 + [(10.0,)] * 200)]
    assert not any(shift[:200]) and any(shift[200:])


def test_page_hinkley_modes():
    up = [(0.0,)] * 60 + [(5.0,)] * 60
    assert run(K.PageHinkley(threshold=20, mode="up"), up)[-1][2] >= 1
    with pytest.raises(ValueError):
        K.PageHinkley(mode="sideways")


def lof_brute(window, x, k):
    def near(p, rows):
        d = sorted((abs(p - r), i) for i, r in enumerate(rows))
        far = [e for e in d if e[0] > 0]
        return (far if len(far) >= k else d)[:k]

    def others(i):
        return [r for j, r in enumerate(window) if j != i], [j for j in range(len(window)) if j != i]

    def kdist(i):
        rows, _ = others(i)
        return near(window[i], rows)[-1][0]

    def lrd(p, i=None):
        rows, names = (window, range(len(window))) if i is None else others(i)
        n = near(p, rows)
        s = sum(max(kdist(list(names)[j]), d) for d, j in n)
        return len(n) / s if s > 0 else float("inf"), [list(names)[j] for _, j in n]

    own, n = lrd(x)
    return sum(lrd(window[i], i)[0] / own for i in n) / k


def test_lof_against_brute_force():
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, 60).tolist()
    kernel = K.Lof(4, 20)
    for i, v in enumerate(values):
        (got,) = kernel.step((v,))
        held = values[max(0, i - 20) : i]
        want = lof_brute(held, v, 4) if len(held) > 4 else 0.0
        assert got == pytest.approx(want)


MODELS = {
    "lof": lambda: K.Lof(5, 100), "sdo": lambda: L.SdoStream(32, 200), "rshash": lambda: L.RsHash(2),
    "xstream": lambda: L.XStream(("a", "b"), 10, 10, 8, 64, 64), "asd": lambda: T.AsdForest(20, 64),
    "histograms": lambda: K.RandomHistograms(2), "svm": lambda: K.LinearSvm(), "rcf": lambda: T.RandomCutTree(64),
    "mondrian": lambda: T.MondrianTree(2), "online": lambda: T.OnlineTree(8, window_size=128),
    "autoencoder": lambda: L.Autoencoder(2, (4,)), "lstm": lambda: L.LstmAutoencoder(2, 4, 2), "kitnet": lambda: L.KitNet(1, 100, 100), "adaptive": lambda: L.AdaptiveSvm(budget=20),
    "anoedge": lambda: L.AnoEdge(16, 16, 2, 1), "streamspot": lambda: L.StreamSpot(32, 1, 3, 20, 2), "adwin": K.Adwin,
}


def rows_of(name):
    rng = np.random.default_rng(5)
    if name in ("anoedge", "streamspot"):
        return [tuple(map(float, r)) for r in rng.integers(0, 12, (300, 2))]
    return [tuple(r) for r in rng.uniform(0.4, 0.6, (300, 2))]


@pytest.mark.parametrize("name", MODELS)
def test_deterministic_and_resumable(name):
    rows = rows_of(name)
    whole = run(MODELS[name](), rows)
    assert whole == run(MODELS[name](), rows)
    half = MODELS[name]()
    first = run(half, rows[:170])
    assert first + run(pickle.loads(pickle.dumps(half)), rows[170:]) == whole
    assert all(np.isfinite(x) for r in whole for x in r if not isinstance(x, str))


@pytest.mark.parametrize("name", MODELS)
def test_score_is_what_step_would_say(name):
    kernel, rows = MODELS[name](), rows_of(name)
    for i, row in enumerate(rows):
        if i % 7 == 0:
            for other in (row, rows[i - 3]):
                assert kernel.score(other) == pickle.loads(pickle.dumps(kernel)).step(other)
        kernel.step(row)
    whole = MODELS[name]()
    assert run(whole, rows) and whole.score(rows[0]) == kernel.score(rows[0])  # asking has taught it nothing


@pytest.mark.parametrize("name", ["lof", "sdo", "rshash", "xstream", "asd", "rcf", "kitnet", "adaptive"])
def test_outlier_scores_higher(name):
    kernel = MODELS[name]()
    normal = [r[0] for r in run(kernel, rows_of(name))][250:]
    assert kernel.step((5.0, -5.0))[0] > np.median(normal)


@pytest.mark.parametrize("name", ["mondrian", "online"])
def test_outlier_path_is_shorter(name):
    paths = []
    for member in range(10):
        kernel = T.MondrianTree(2, lifetime=20.0, member=member) if name == "mondrian" else T.OnlineTree(8, window_size=256, member=member)
        normal = [r[0] for r in run(kernel, rows_of(name))][250:]
        paths.append(kernel.step((5.0, -5.0))[0] - np.mean(normal))
    assert np.mean(paths) < 0


def test_cut_tree_holds_its_window():
    tree = T.RandomCutTree(50)
    rng = np.random.default_rng(2)
    rows = [tuple(r) for r in np.round(rng.normal(0, 1, (200, 2)), 1)]
    run(tree, rows)
    assert tree.root.n == 50
    held = np.array(rows[-50:])
    assert np.allclose(tree.root.low, held.min(0)) and np.allclose(tree.root.high, held.max(0))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=120))
def test_adwin_keeps_its_sums(values):
    k = K.Adwin()
    for v in values:
        k.step((v,))
    assert k.width == sum(n for n, *_ in k.buckets)
    assert k.total == pytest.approx(sum(s for _, s, _ in k.buckets), abs=1e-6)


def test_ks():
    d, p = K.ks_two_sample(np.arange(30.0), np.arange(30.0) + 100)
    assert d == 1 and p < 1e-6
    d, p = K.ks_two_sample(np.arange(30.0), np.arange(30.0))
    assert d == 0 and p == 1
