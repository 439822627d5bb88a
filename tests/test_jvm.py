"""Kernels in the JVM against the same kernels in Python: ties, copies, nulls, keys, resets of state, both disciplines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch import queries as Q
from tidewatch.functions import forests as T
from tidewatch.functions import kernels as K
from tidewatch.functions import learners as L
from tidewatch.functions import transforms as X
from tidewatch.operators import edges
from tidewatch.operators.fold import ensemble, fold
from tidewatch.plans.stream import StreamSpec

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def rows(spark):
    """Two names, a null one and a long one; coarse values, so that many are equal, with nulls and NaNs."""
    rng = np.random.default_rng(8)
    made = []
    for i in range(600):
        a, b = float(rng.integers(0, 6)), float(rng.normal())
        made.append((i, ["x", "y", None, "x"][i % 4], None if i % 37 == 5 else a, float("nan") if i % 41 == 7 else b if i % 3 else 0.5))
    return spark.createDataFrame(made, "i int, k string, a double, b double")


def walked(rows, make, learn_first=False):
    """What kernels in Python say, by row."""
    kernels, want = {}, {}
    for r in rows.orderBy("i").collect():
        row = (r.a, r.b)
        if any(v is None or v != v for v in row):
            want[r.i] = None
            continue
        kernel = kernels.setdefault(r.k, make())
        said = kernel.step(row)[0]
        want[r.i] = kernel.score(row)[0] if learn_first else said
    return want


def same(got, want):
    assert got.keys() == want.keys()
    for i, v in want.items():
        assert got[i] == (None if v is None or v != v else pytest.approx(v, rel=1e-9, abs=1e-12)), i


@pytest.mark.parametrize("discipline", ["score_first", "learn_first"])
@pytest.mark.parametrize("make", [lambda: K.Lof(3, 20), lambda: K.Lof(4, 9, "manhattan"), lambda: X.Chain(X.StandardScaler(2), K.Lof(3, 25)), lambda: X.Chain(X.StandardScaler(2, False), K.Lof(2, 2000))])
def test_outlier_factors(spark, rows, make, discipline):
    out = fold(rows, StreamSpec(("i",), ("k",), discipline), ["a", "b"], make)
    assert out.columns == [*rows.columns, "score"] and "MapInArrow" not in plan(out)
    same({r.i: r.score for r in out.collect()}, walked(rows, make, discipline == "learn_first"))


def test_scaled_outlier_factor_runs_in_the_jvm(spark):
    out = Q.QUERIES["pipe_standard_lof"](spark, DATA)
    assert "MapInArrow" not in plan(out) and out.count() == Q.lines(spark, DATA).count()


def test_what_the_jvm_does_not_take_is_folded_in_python(spark, rows):
    class Mine(K.Lof):
        def score(self, row):
            return (7.0,)

    spec = StreamSpec(("i",), ("k",))
    own = fold(rows, spec, ["a", "b"], lambda: Mine(3, 20))
    assert "MapInArrow" in plan(own) and {r.score for r in own.collect()} == {7.0, None}
    nested = rows.withColumn("k", F.struct("k"))
    out = fold(nested, spec, ["a", "b"], lambda: K.Lof(3, 20))
    assert "MapInArrow" in plan(out)


@pytest.mark.parametrize("by, groups, discipline", [(("k",), 1, "score_first"), (("k",), 3, "score_first"), ((), 3, "learn_first")])
def test_cut_trees_draw_alike(spark, rows, by, groups, discipline):
    """The same draws, cuts, copies and removals as the tree in Python, over keys and members dealt in groups."""
    rows = rows if groups == 1 else rows.fillna("z", "k")  # groups are joined by key
    out = ensemble(rows, StreamSpec(("i",), by, discipline), ["a", "b"], 5, lambda m: T.RandomCutTree(24, 10, 3, m), groups=groups)
    assert "MapInArrow" not in plan(out)
    one = rows if by else rows.withColumn("k", F.lit(1))
    each = [walked(one, lambda: T.RandomCutTree(24, 10, 3, m), discipline == "learn_first") for m in range(5)]
    want = {i: None if v is None else sum(e[i] for e in each) / 5 for i, v in each[0].items()}
    assert max(v for v in want.values() if v is not None) > 1
    same({r.i: r["mean"] for r in out.collect()}, want)


def test_random_cut_forest_runs_in_the_jvm(spark):
    for name in ("rcf", "rcf_shingle"):
        out = Q.QUERIES[name](spark, DATA)
        assert "MapInArrow" not in plan(out) and out.where("score is null").count() == 0 and out.count() == Q.lines(spark, DATA).count()


@pytest.mark.parametrize("order, discipline", [("double", "score_first"), ("timestamp_ntz", "score_first"), ("timestamp", "learn_first"), ("date", "score_first"), ("string", "score_first")])
def test_edges_in_pieces(spark, order, discipline):
    """Pieces of a stream begin with what the pieces before them counted; nulls and NaNs lie in the first and last one."""
    rng = np.random.default_rng(2)
    made = [(i, int(rng.integers(0, 40)) ** 2, None if i % 29 == 3 else int(rng.integers(-5, 9)), int(rng.integers(0, 7))) for i in range(900)]
    df = spark.createDataFrame(made, "i int, v int, src long, dst int")
    value = {"double": "cast(v as double) / 7", "string": "lpad(v, 6, '0')", "date": "date_add(date'2000-01-01', v)"}.get(order, f"cast(timestamp_seconds(v * 1800) as {order})")
    df = df.withColumn("o", F.when(F.col("i") % 11 == 4, None).otherwise(F.expr(value)))
    if order == "double":
        df = df.withColumn("o", F.when(F.col("i") % 13 == 6, F.lit(float("nan"))).otherwise(F.col("o")))
    make = lambda: L.AnoEdge(8, 6, 3, 1, warm_up=20)
    out = edges.anoedge(df, StreamSpec(("o", "i"), (), discipline), ["src", "dst"], make)
    assert "MapInArrow" not in plan(out) and out.columns == [*df.columns, "score"]
    assert ("_piece" in plan(out)) == (order != "string")
    kernel, want = make(), {}
    for r in df.orderBy("o", "i").collect():
        want[r.i] = None if r.src is None else kernel.step((r.src, r.dst))[0]
        if discipline == "learn_first" and r.src is not None:
            want[r.i] = kernel.score((r.src, r.dst))[0]
    same({r.i: r.score for r in out.collect()}, want)


def test_fading_edges_are_one_fold(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, int(rng.integers(0, 30)), int(rng.integers(0, 9)), i // 25) for i in range(400)], "i int, src long, dst long, t long")
    for how in ({"decay": 0.7}, {"decay": 0.7, "normalize": True, "hashes": 4}):
        make = lambda: L.AnoEdge(8, 6, **{"hashes": 3, "radius": 2, "warm_up": 20, **how})  # noqa: E731, B023
        out = edges.anoedge(df, StreamSpec(("i",)), ["src", "dst", "t"], make)
        assert "_piece" not in plan(out) and "MapInArrow" not in plan(out)
        kernel = make()
        same({r.i: r.score for r in out.collect()}, {r.i: kernel.step((r.src, r.dst, r.t))[0] for r in df.orderBy("i").collect()})
    assert edges.anoedge(df.limit(0), StreamSpec(("i",)), ["src", "dst", "t"], lambda: L.AnoEdge(8, 6, 2, 1)).count() == 0


def test_anoedge_is_dealt(spark):
    assert "_piece" in plan(Q.QUERIES["anoedge"](spark, DATA))
