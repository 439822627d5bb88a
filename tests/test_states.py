"""Time, batches, resets and what states tell of themselves; fetched datasets; plug-in points."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import forests as T
from tidewatch.functions import kernels as K
from tidewatch.functions import learners as L
from tidewatch.operators import forests, neighbours, trees
from tidewatch.operators.fold import describe, fold
from tidewatch.plans.stream import StreamSpec
from tidewatch.sources.datasets import KNOWN, DatasetInfo
from tidewatch.sources.npz import Catalogue, default_catalogue, set_cache_dir

SPEC = StreamSpec(("i",), ("k",))


def points(n: int, d: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(n, d))


def frame(spark, x, k=lambda i: 0):
    rows = [(i, k(i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"i long, k long, {', '.join(f'f{j} double' for j in range(x.shape[1]))}")


@pytest.mark.parametrize("make", [lambda timed: L.RsHash(2, timed=timed), lambda timed: L.SdoStream(16, 64, timed=timed)])
def test_times_of_one_apart_are_row_numbers(make):
    plain, timed = make(False), make(True)
    for i, row in enumerate(points(300, 2)):
        assert timed.step((*row, i)) == pytest.approx(plain.step(tuple(row)))


@pytest.mark.parametrize("make", [lambda: L.RsHash(1, warm_up=2, timed=True), lambda: L.SdoStream(8, 32, timed=True)])
def test_time_may_stand_still_but_not_go_back(make):
    kernel = make()
    kernel.step((0.0, 5.0))
    kernel.step((0.0, 5.0))
    with pytest.raises(ValueError):
        kernel.step((0.0, 4.0))


def test_counts_fade_with_the_time_between_rows():
    """A cell filled long ago is as new; one filled just now is known."""
    said = []
    for gap in (1.0, 1e4):
        kernel = L.RsHash(1, components=4, warm_up=2, decay=0.1, timed=True)
        for i in range(50):
            kernel.step((0.0, float(i)))
        said.append(kernel.step((0.0, 49.0 + gap))[0])
    assert said[0] < 0.5 < said[1] == pytest.approx(1.0)


def test_loda_without_decay_is_the_plan(spark):
    x = points(400, 3, 4)
    df = frame(spark, x)
    names = ["f0", "f1", "f2"]
    how = {"n_bins": 8, "warm_up": 50}
    plan = trees.loda(df.withColumn("b", F.expr("i div 100")), names, "i", "b", n_projections=5, seed=3, **how)
    matrix = trees.loda_matrix(3, 5, 3)
    made = fold(df, SPEC, names, lambda: L.Loda(matrix, **how)).select("i", F.col("score").alias("own"))
    for r in plan.join(made, "i").collect():
        assert r.own == pytest.approx(r.score, abs=1e-9)


def test_loda_with_decay_against_brute_force():
    matrix, rows = trees.loda_matrix(2, 3, 1), points(120, 2, 5)
    kernel = L.Loda(matrix, n_bins=4, warm_up=20, decay=0.9)
    got = [kernel.step(tuple(r))[0] for r in rows]
    z = rows @ matrix.T
    low, width = z[:20].min(0), (z[:20].max(0) - z[:20].min(0)) / 4
    bins = np.clip(np.floor((z - low) / width), 0, 3)
    for n in range(len(rows)):
        if n < 20:
            assert got[n] == 0
            continue
        weight = np.array([0.9 ** (n - max(m, 19) - 1) for m in range(n)])
        held = np.array([weight[bins[:n, j] == bins[n, j]].sum() for j in range(3)])
        want = -np.log((held + 1) / (weight.sum() + 4) / width + 1e-12)
        assert got[n] == pytest.approx(max(0.0, want.mean()))
    with pytest.raises(ValueError):
        L.Loda(matrix, decay=0.0)


def test_sparse_projections_have_their_share():
    assert (trees.loda_matrix(16, 20, 1) != 0).sum(1).tolist() == [4] * 20
    assert (trees.loda_matrix(10, 20, 1, 0.3) != 0).sum(1).tolist() == [3] * 20
    assert (trees.loda_matrix(3, 5, 1, 0.01) != 0).sum(1).tolist() == [1] * 5


def test_a_batch_is_scored_before_it_is_learned():
    x = points(96, 2, 2)
    batched, plain = T.OnlineTree(4, window_size=64, batched=True), T.OnlineTree(4, window_size=64)
    got = [batched.step((*r, i // 16))[0] for i, r in enumerate(x)]
    want = []
    for b in range(6):
        part = list(x[b * 16 : b * 16 + 16])
        want += [plain.depth(r) for r in part]
        plain.learn(part)
    assert got == want
    assert got[:16] == [0.0] * 16
    assert len(plain.rows) == 64 and plain.root.n == 64


def test_batches_of_one_are_rows(spark):
    df = frame(spark, points(200, 2, 3), lambda i: i % 2).withColumn("b", F.col("i"))
    how = {"n_trees": 3, "max_leaf": 4, "window": 64}
    one = forests.online_forest(df, SPEC, ["f0", "f1"], **how)
    two = forests.online_forest(df, StreamSpec(("b", "i"), ("k",)), ["f0", "f1"], batch="b", **how)
    both = one.join(two.select("i", F.col("score").alias("other")), "i").collect()
    assert len(both) == 200 and all(r.score == pytest.approx(r.other) for r in both)
    with pytest.raises(ValueError):
        forests.online_forest(df, SPEC, ["f0", "f1"], batch="b")


def test_reset_begins_anew(spark):
    x = points(90, 1, 6)
    df = frame(spark, x).withColumn("anew", F.when(F.col("i") == 40, True).when(F.col("i") % 2 == 0, False))
    got = {r.i: r for r in fold(df, SPEC, ["f0"], lambda: K.Lof(3, 30), reset="anew").collect()}
    first, second = K.Lof(3, 30), K.Lof(3, 30)
    for i in range(90):
        want = (first if i < 40 else second).step((float(x[i, 0]),))[0]
        assert got[i].score == pytest.approx(want)
        assert got[i].n_samples_seen == (i if i < 40 else i - 40)
    assert "_tw_reset" not in fold(df, SPEC, ["f0"], lambda: K.Lof(3, 30), reset="anew").columns


def test_a_reset_row_is_learned_before_it_is_asked(spark):
    x = points(60, 1, 8)
    df = frame(spark, x).withColumn("anew", F.col("i") == 30)
    spec = StreamSpec(SPEC.order, SPEC.by, "learn_first")
    got = {r.i: r for r in fold(df, spec, ["f0"], lambda: K.Lof(3, 30), reset="anew").collect()}
    kernel = K.Lof(3, 30)
    for i, (v,) in enumerate(x.tolist()):
        kernel = K.Lof(3, 30) if i == 30 else kernel
        kernel.step((v,))
        assert got[i].score == pytest.approx(kernel.score((v,))[0])
        assert got[i].n_samples_seen == (i if i < 30 else i - 30) + 1


def test_describe_tells_the_state_of_each_key(spark):
    df = frame(spark, points(120, 2, 7), lambda i: [3, None, 5][i % 3]).withColumn("f0", F.when(F.col("i") % 10 != 0, F.col("f0")))
    got = {r.k: r for r in describe(df, SPEC, ["f0", "f1"], lambda: L.AdaptiveSvm(budget=10)).collect()}
    assert set(got) == {3, None, 5}
    assert sum(r.n_samples_seen for r in got.values()) == 108
    for r in got.values():
        assert r.info["n_samples_processed"] == [r.n_samples_seen]
        assert r.info["n_support_vectors"] == [len(r.info["sv_ages"])] and 0 < len(r.info["sv_ages"]) <= 10
    assert describe(df.where("false"), SPEC, ["f0"], lambda: K.Lof(3, 30)).collect() == []
    whole = describe(df, StreamSpec(("i",)), ["f1"], lambda: L.SdoStream(8, 32)).collect()
    assert [(r.n_samples_seen, r.info["n_observers"][0] > 0) for r in whole] == [(120, True)]


def test_knn_takes_another_distance(spark):
    x = points(60, 3, 8)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    most = lambda a, b: F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    got = {r.i: r.score for r in neighbours.knn(df, "v", "i", 2, 20, 5, distance=most).collect()}
    for i in range(5, 60):
        want = np.sort(np.abs(x[max(0, i - 20) : i] - x[i]).max(1))[:2].mean()
        assert got[i] == pytest.approx(want)


def test_losses_and_networks_of_ones_own():
    x = points(80, 3, 9)
    named, own = L.Autoencoder(3, (4,), "mse"), L.Autoencoder(3, (4,), (np.square, lambda gap: 2 * gap))
    assert [named.step(tuple(r)) for r in x] == [own.step(tuple(r)) for r in x]

    class Mean:
        """Takes every row for the mean of those before."""

        def __init__(self):
            self.n, self.mean = 0, 0.0

        def loss(self, x, kind, learn):
            out = float(np.square(x - self.mean).mean())
            self.n += learn
            self.mean = self.mean + (x - self.mean) / self.n
            return out

    kernel = L.Autoencoder(net=Mean())
    said = [kernel.step(tuple(r))[0] for r in x]
    assert said[50] == pytest.approx(np.square(x[50] - x[:50].mean(0)).mean())
    with pytest.raises(ValueError):
        L.Autoencoder(3, loss="none such")


def bundle(folder, name="toy", digest=None):
    folder.mkdir(parents=True, exist_ok=True)
    np.savez(folder / f"{name}.npz", X=points(5, 2), y=np.arange(5) % 2)
    right = hashlib.sha256((folder / f"{name}.npz").read_bytes()).hexdigest()
    return DatasetInfo(name, f"{name}.npz", sha256=digest or right)


def test_known_datasets():
    assert len(KNOWN) == len({x.name for x in KNOWN}) == 25
    assert all(len(x.sha256) == 64 and 0 < x.anomaly_rate < 1 and x.n_samples > 0 for x in KNOWN)


def test_fetch_checks_and_keeps(spark, tmp_path):
    info = bundle(tmp_path / "there")
    found = Catalogue(str(tmp_path / "here"), f"file://{tmp_path}/there")
    assert found.available() == sorted(x.name for x in KNOWN) and found.by_category("financial") == ["fraud"]
    found.entries = {"toy": info}
    assert found.cached() == [] and found.cached_bytes() == 0
    assert found.load(spark, "toy").count() == 5
    assert found.cached() == ["toy"] and found.cached_bytes() > 0
    (tmp_path / "there" / "toy.npz").unlink()
    assert found.load(spark, "toy").count() == 5  # from the folder
    assert found.clear() == 1 and found.cached() == []


def test_fetch_fails_cleanly(tmp_path, monkeypatch):
    waits = []
    monkeypatch.setattr("time.sleep", waits.append)
    found = Catalogue(str(tmp_path / "here"), f"file://{tmp_path}/there", tries=3, wait=0.5)
    found.entries = {"toy": bundle(tmp_path / "there", digest="0" * 64), "gone": DatasetInfo("gone", "gone.npz")}
    with pytest.raises(ValueError):
        found.fetch("toy")
    with pytest.raises(RuntimeError):
        found.fetch("gone")
    assert waits == [0.5, 1.0]
    assert list((tmp_path / "here").iterdir()) == []
    with pytest.raises(FileNotFoundError):
        Catalogue(str(tmp_path / "here")).path("fraud")


def test_default_catalogue(tmp_path):
    mine = set_cache_dir(str(tmp_path))
    assert default_catalogue() is mine and mine.folder == tmp_path
    assert math.isclose(mine.info("shuttle").anomaly_rate, 0.07)
