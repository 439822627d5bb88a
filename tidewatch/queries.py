"""Registered queries of the stream operators, and the same in SQL for a second engine."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import forests as T
from tidewatch.functions import kernels as K
from tidewatch.functions import learners as L
from tidewatch.functions import transforms as X
from tidewatch.functions.metrics import pr_auc, roc_auc
from tidewatch.operators import counts, edges, forests, moving, neighbours, pipelines, simple, trees
from tidewatch.operators.fold import describe, fold
from tidewatch.plans.stream import StreamSpec, arrival

W = 10
EVENTS = StreamSpec(order=("ts", "event_id"), by=("user_id",))
LINES_ORDER = ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
LINES = StreamSpec(order=LINES_ORDER, by=("l_suppkey",))
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
MONTH = "cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("t", F.expr(MONTH))


def rounded(c: str = "score", digits: int = 6):
    """Rounded, without a negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


# Moving statistics of one column -------------------------------------------------------------

_EV = "PARTITION BY user_id ORDER BY ts, event_id"
_SCORE = "SELECT event_id, user_id, round({}, 6) + 0.0 AS score FROM ("


def _moving_sql(before: str, with_: str, cold: str = "0.0", few: int = 0) -> str:
    return f"""
SELECT event_id, user_id, round(CASE WHEN n <= {few} THEN {cold} ELSE abs({with_} - {before}) END, 6) + 0.0 AS score
FROM (SELECT event_id, user_id, value, list(value) OVER p AS a, list(value) OVER b AS c, count(*) OVER p AS n
  FROM events WINDOW p AS ({_EV} ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING), b AS ({_EV} ROWS BETWEEN {W} PRECEDING AND CURRENT ROW))
"""


def _list_sql(f: str, **how) -> str:
    return _moving_sql(f.replace("@", "a"), f.replace("@", "c"), **how)


_M = "list_avg(@)"
_C = lambda k: f"list_avg(list_transform(@, lambda v: pow(v - {_M}, {k})))"
_RATIO = lambda k: f"coalesce({_C(k)} / nullif(pow({_C(2)}, {k / 2}), 0), 0)"
_BOTH = lambda k: f"(CASE WHEN coalesce({_C(2).replace('@', 'a')}, 0) = 0 OR {_C(2).replace('@', 'c')} = 0 THEN 0 ELSE {_RATIO(k)} END)"
_STAT_SQL = {
    "mean": _list_sql(_M),
    "harmonic": f"""
WITH i AS (SELECT *, sum(CASE WHEN value <> 0 THEN 1 ELSE 0 END) OVER ({_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM events),
z AS (SELECT user_id, value, coalesce(k, 0) AS k FROM i WHERE value <> 0),
h AS (SELECT i.event_id, i.user_id, any_value(i.value) AS v, count(z.k) AS n, sum(1 / z.value) AS s
  FROM i LEFT JOIN z ON z.user_id = i.user_id AND z.k < coalesce(i.k, 0) AND z.k >= coalesce(i.k, 0) - {W} GROUP BY 1, 2)
SELECT event_id, user_id, round(CASE WHEN n = 0 OR v = 0 THEN 0.0 ELSE abs((n + 1) / (s + 1 / v) - n / s) END, 6) + 0.0 AS score FROM h""",
    "geometric": f"""
WITH i AS (SELECT *, sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) OVER ({_EV} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM events),
z AS (SELECT user_id, value, coalesce(k, 0) AS k FROM i WHERE value > 0),
h AS (SELECT i.event_id, i.user_id, any_value(i.value) AS v, count(z.k) AS n, sum(ln(z.value)) AS s
  FROM i LEFT JOIN z ON z.user_id = i.user_id AND z.k < coalesce(i.k, 0) AND z.k >= coalesce(i.k, 0) - {W} GROUP BY 1, 2)
SELECT event_id, user_id, round(CASE WHEN n <= 1 THEN 1.0 WHEN v > 0 THEN abs(exp((s + ln(v)) / (n + 1)) - exp(s / n)) END, 6) + 0.0 AS score FROM h""",
    "median": _list_sql("list_aggregate(@, 'quantile_cont', 0.5)"),
    "quantile": _list_sql("list_aggregate(@, 'quantile_cont', 0.9)"),
    "variance": _list_sql(_C(2)),
    "iqr": _list_sql("(list_aggregate(@, 'quantile_cont', 0.75) - list_aggregate(@, 'quantile_cont', 0.25))"),
    "aad": _list_sql(f"list_avg(list_transform(@, lambda v: abs(v - {_M})))"),
    "kurtosis": _list_sql(_BOTH(4)),
    "skewness": _list_sql(_BOTH(3)),
}
_STAT_NAMES = {
    "mean": "mov_avg", "harmonic": "mov_harm", "geometric": "mov_geo", "median": "mov_median", "quantile": "mov_quantile",
    "variance": "mov_var", "iqr": "mov_iqr", "aad": "mov_aad", "kurtosis": "mov_kurt", "skewness": "mov_skew",
}


def _moving(stat: str, spec: StreamSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = moving.moving(events(spark, sf_dir), spec, "value", stat, W, quantile=0.9)
    return out.select("event_id", "user_id", rounded())


for _stat, _name in _STAT_NAMES.items():
    query(_name, _STAT_SQL[_stat])(functools.partial(_moving, _stat, EVENTS))

query(
    "mov_avg_learn_first",
    f"""SELECT event_id, user_id, round(abs((s + value) / (n + 1) - s / n), 6) + 0.0 AS score
FROM (SELECT *, sum(value) OVER w AS s, count(*) OVER w AS n FROM events
  WINDOW w AS ({_EV} ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW))""",
)(functools.partial(_moving, "mean", StreamSpec(EVENTS.order, EVENTS.by, "learn_first")))


@query(
    "mov_growth",
    f"""SELECT event_id, user_id, round(CASE WHEN n <= 2 THEN 1.0 WHEN value > 0 THEN abs(pow(value / f, 1.0 / n) - pow(l / f, 1.0 / (n - 1))) END, 6) + 0.0 AS score
FROM (SELECT event_id, user_id, value, count(CASE WHEN value > 0 THEN 1 END) OVER p AS n,
  first(CASE WHEN value > 0 THEN value END IGNORE NULLS) OVER p AS f, last(CASE WHEN value > 0 THEN value END IGNORE NULLS) OVER p AS l
  FROM events WINDOW p AS ({_EV} ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING))""",
)
def mov_growth(spark, sf_dir):
    return moving.growth(events(spark, sf_dir), EVENTS, "value", W).select("event_id", "user_id", rounded())


# Two columns ---------------------------------------------------------------------------------

_LO = "PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"
_LW = f"WINDOW p AS ({_LO} ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING), b AS ({_LO} ROWS BETWEEN {W} PRECEDING AND CURRENT ROW)"
_LK = ", ".join(LINE_KEY)


@query("mov_cov", f"""SELECT {_LK}, round(CASE WHEN n = 0 THEN 0 ELSE abs(cb - CASE WHEN n < 2 THEN 0 ELSE cp END) END, 9) + 0.0 AS score
FROM (SELECT {_LK}, count(*) OVER p AS n, covar_pop(l_quantity, l_discount) OVER p AS cp, covar_pop(l_quantity, l_discount) OVER b AS cb FROM lineitem {_LW})""")  # fmt: skip
def mov_cov(spark, sf_dir):
    return moving.covariance(lines(spark, sf_dir), LINES, "l_quantity", "l_discount", W).select(*LINE_KEY, rounded(digits=9))


_CORR = lambda w: f"CASE WHEN coalesce(stddev_pop(l_quantity) OVER {w} * stddev_pop(l_extendedprice) OVER {w}, 0) = 0 THEN 0 ELSE covar_pop(l_quantity, l_extendedprice) OVER {w} / (stddev_pop(l_quantity) OVER {w} * stddev_pop(l_extendedprice) OVER {w}) END"


@query("mov_corr", f"SELECT {_LK}, round(abs({_CORR('b')} - {_CORR('p')}), 6) + 0.0 AS score FROM lineitem {_LW}")
def mov_corr(spark, sf_dir):
    return moving.correlation(lines(spark, sf_dir), LINES, "l_quantity", "l_extendedprice", W).select(*LINE_KEY, rounded())


@query("mahalanobis2", f"""SELECT {_LK}, round(CASE WHEN n < 3 THEN 0 ELSE coalesce(((vb + r) * dx * dx - 2 * c * dx * dy + (va + r) * dy * dy) / nullif((va + r) * (vb + r) - c * c, 0), 0) END, 7) + 0.0 AS score
FROM (SELECT *, CASE WHEN va * vb - c * c <= 1e-12 * va * vb THEN 1e-6 * (va + vb) / 2 ELSE 0 END AS r FROM (
  SELECT {_LK}, count(*) OVER p AS n, var_samp(l_quantity) OVER p AS va, var_samp(l_tax) OVER p AS vb, covar_samp(l_quantity, l_tax) OVER p AS c,
    l_quantity - avg(l_quantity) OVER p AS dx, l_tax - avg(l_tax) OVER p AS dy FROM lineitem {_LW}))""")  # fmt: skip
def mahalanobis2(spark, sf_dir):
    return moving.mahalanobis(lines(spark, sf_dir), LINES, "l_quantity", "l_tax", W).select(*LINE_KEY, rounded(digits=7))


# Simple models and transformers --------------------------------------------------------------


_M3 = ("l_quantity", "l_discount", "l_tax")
_M3_COV = ", ".join(f"covar_samp({a}, {b}) OVER p AS c{i}{j}" for i, a in enumerate(_M3) for j, b in enumerate(_M3) if i <= j)
_M3_GAP = ", ".join(f"{a} - avg({a}) OVER p AS d{i}" for i, a in enumerate(_M3))


@query("mahalanobis3", f"""SELECT {_LK}, round(CASE WHEN n < 5 OR det <= 1e-9 * c00 * c11 * c22 THEN 0 ELSE
  (d0 * d0 * (c11 * c22 - c12 * c12) + d1 * d1 * (c00 * c22 - c02 * c02) + d2 * d2 * (c00 * c11 - c01 * c01)
  + 2 * d0 * d1 * (c02 * c12 - c01 * c22) + 2 * d0 * d2 * (c01 * c12 - c02 * c11) + 2 * d1 * d2 * (c01 * c02 - c00 * c12)) / det END, 3) + 0.0 AS score
FROM (SELECT *, c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02) AS det
  FROM (SELECT {_LK}, count(*) OVER p AS n, {_M3_COV}, {_M3_GAP} FROM lineitem {_LW}))""")  # fmt: skip
def mahalanobis3(spark, sf_dir):
    """The operator's score, and 0 where the window has fewer than five rows or nearly no volume, where engines differ by rounding."""
    past = LINES.past(W)
    rows = lines(spark, sf_dir)
    rows = rows.withColumns({f"c{i}{j}": F.covar_samp(a, b).over(past) for i, a in enumerate(_M3) for j, b in enumerate(_M3) if i <= j})
    det = F.expr("c00 * (c11 * c22 - c12 * c12) - c01 * (c01 * c22 - c12 * c02) + c02 * (c01 * c12 - c11 * c02)")
    flat = (F.count("*").over(past) < 5) | (det <= 1e-9 * F.col("c00") * F.col("c11") * F.col("c22"))
    rows = moving.mahalanobis_all(rows.withColumn("flat", flat), LINES, list(_M3), W)
    return rows.withColumn("score", F.when(F.col("flat"), 0.0).otherwise(F.col("score"))).select(*LINE_KEY, rounded(digits=3))


@query("null_model", "SELECT event_id, 0.0::DOUBLE AS score FROM events")
def null_model(spark, sf_dir):
    return simple.null_scores(events(spark, sf_dir)).select("event_id", "score")


@query("random_model", "SELECT event_id, CAST('0x' || substr(md5('42:' || event_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS score FROM events")
def random_model(spark, sf_dir):
    return simple.random_scores(events(spark, sf_dir), "event_id", seed=42).select("event_id", "score")


@query("threshold", "SELECT event_id, CASE WHEN value > 40 OR value < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events")
def threshold(spark, sf_dir):
    return simple.threshold(events(spark, sf_dir), {"value": 40.0}, {"value": 2.0}).select("event_id", "score")


@query("quantile_threshold", f"""SELECT event_id, n AS n_scores, round(t, 6) AS threshold,
  round(CASE WHEN t IS NULL THEN 0 WHEN t <= 0 THEN CASE WHEN value > 0 THEN 1 ELSE 0 END WHEN value >= t THEN 1 ELSE value / t END, 6) + 0.0 AS flag
FROM (SELECT event_id, value, n, CASE WHEN n >= 10 THEN q END AS t FROM (
  SELECT event_id, value, count(value) OVER p AS n, quantile_cont(value, 0.95) OVER p AS q FROM events WINDOW p AS ({_EV} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)))""")  # fmt: skip
def quantile_threshold(spark, sf_dir):
    out = simple.quantile_threshold(events(spark, sf_dir), EVENTS, "value", 0.95, 50)
    return out.select("event_id", "n_scores", F.round("threshold", 6).alias("threshold"), rounded("flag"))


_PAST = f"WINDOW p AS ({_LO} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("minmax", f"""SELECT {_LK}, round(CASE WHEN lo IS NULL THEN NULL WHEN hi = lo THEN 0 ELSE (l_quantity - lo) / (hi - lo) END, 6) + 0.0 AS l_quantity_scaled
FROM (SELECT *, min(l_quantity) OVER p AS lo, max(l_quantity) OVER p AS hi FROM lineitem {_PAST})""")  # fmt: skip
def minmax(spark, sf_dir):
    return simple.min_max(lines(spark, sf_dir), LINES, "l_quantity").select(*LINE_KEY, rounded("l_quantity_scaled"))


@query("zscore", f"""SELECT {_LK}, round(CASE WHEN m IS NULL THEN NULL WHEN sd = 0 THEN 0 ELSE (l_extendedprice - m) / sd END, 5) + 0.0 AS l_extendedprice_scaled
FROM (SELECT *, avg(l_extendedprice) OVER p AS m, stddev_pop(l_extendedprice) OVER p AS sd FROM lineitem {_PAST})""")  # fmt: skip
def zscore(spark, sf_dir):
    return simple.standard(lines(spark, sf_dir), LINES, "l_extendedprice").select(*LINE_KEY, rounded("l_extendedprice_scaled", 5))


def _projection_sql(k: int) -> str:
    terms = [f"{float(w)!r} * embedding[{i + 1}]::DOUBLE" for i, w in enumerate(simple.projection_matrix(64, 3, 7)[:, k]) if w]
    return f"round({' + '.join(terms)}, 5) + 0.0 AS component_{k}"


@query("rand_proj", f"SELECT vec_id, {', '.join(map(_projection_sql, range(3)))} FROM embeddings")
def rand_proj(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    out = simple.random_projection(vectors, "embedding", 64, 3, seed=7)
    return out.select("vec_id", *[rounded(f"component_{k}", 5) for k in range(3)])


# Counts over time buckets --------------------------------------------------------------------

_T = "CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT)"
_OB = ", ".join(LINES_ORDER)
_PREV = f"ORDER BY {_OB} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_L = f"l AS (SELECT *, {_T} AS t, row_number() OVER (ORDER BY {_OB}) - 1 AS seq FROM lineitem)"


@query("midas", f"""WITH {_L},
c AS (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey, t {_PREV}) + 1 AS a, count(*) OVER (PARTITION BY l_partkey, l_suppkey {_PREV}) + 1 AS s,
  count(*) OVER (PARTITION BY l_partkey {_PREV}) + 1 AS u, count(*) OVER (PARTITION BY l_suppkey {_PREV}) + 1 AS d, t - min(t) OVER () + 1 AS bi FROM l),
e AS (SELECT *, s / bi AS e1, (u * d) / (seq + 1 + 1e-9) AS e2 FROM c)
SELECT {_LK}, round(CASE WHEN seq < 128 OR bi < 2 THEN 0 ELSE greatest((a - e1) * (a - e1) / (e1 + 1e-9), (a - e2) * (a - e2) / (e2 + 1e-9)) END, 4) + 0.0 AS score FROM e""")  # fmt: skip
def midas(spark, sf_dir):
    return counts.midas(lines(spark, sf_dir), "l_partkey", "l_suppkey", "t", LINES_ORDER).select(*LINE_KEY, rounded(digits=4))


def _decay_sql(name: str, keys: str, factor: float = 0.5) -> str:
    join = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", ")) if keys else "true"
    cols = f"{keys}, t" if keys else "t"
    x = ", ".join(f"x.{k}" for k in cols.split(", "))
    return f"""{name} AS (SELECT {x}, sum(CASE WHEN y.t < x.t THEN y.n * pow({factor}, x.t - y.t) ELSE 0 END) AS h
      FROM (SELECT {cols}, count(*) AS n FROM l GROUP BY ALL) x JOIN (SELECT {cols}, count(*) AS n FROM l GROUP BY ALL) y ON {join} AND y.t <= x.t GROUP BY {x})"""


@query("isconna", f"""WITH {_L}, {_decay_sql('he', 'l_partkey, l_suppkey')}, {_decay_sql('hu', 'l_partkey')}, {_decay_sql('hd', 'l_suppkey')}, {_decay_sql('hm', '')},
c AS (SELECT l.*, he.h + count(*) OVER (PARTITION BY l.l_partkey, l.l_suppkey, l.t {_PREV}) + 1 AS ce, hu.h + count(*) OVER (PARTITION BY l.l_partkey, l.t {_PREV}) + 1 AS cu,
  hd.h + count(*) OVER (PARTITION BY l.l_suppkey, l.t {_PREV}) + 1 AS cd, hm.h + count(*) OVER (PARTITION BY l.t {_PREV}) + 1 AS cm,
  count(*) OVER (PARTITION BY l.l_partkey, l.l_suppkey {_PREV}) + 1 AS te, count(*) OVER (PARTITION BY l.l_partkey {_PREV}) + 1 AS tu, count(*) OVER (PARTITION BY l.l_suppkey {_PREV}) + 1 AS td
  FROM l JOIN he USING (l_partkey, l_suppkey, t) JOIN hu USING (l_partkey, t) JOIN hd USING (l_suppkey, t) JOIN hm USING (t))
SELECT {_LK}, round(CASE WHEN seq < 64 THEN 0 ELSE (tu * td / (seq + 1) / (te + 1e-9) + 1 / (te + 1e-9)) * (ce + 1e-9) / (cu * cd / cm + 1e-9) END, 4) + 0.0 AS score FROM c""")  # fmt: skip
def isconna(spark, sf_dir):
    return counts.isconna(lines(spark, sf_dir), "l_partkey", "l_suppkey", "t", LINES_ORDER).select(*LINE_KEY, rounded(digits=4))


_VIEWS = [("l_discount",), ("l_quantity",), ("l_tax",), ("l_discount", "l_quantity"), ("l_discount", "l_tax"), ("l_quantity", "l_tax")]


@query("mstream", f"""WITH {_L},
v AS ({' UNION ALL '.join(f"SELECT seq, t, {i} AS view, concat_ws('|', {', '.join(v)}) AS key FROM l" for i, v in enumerate(_VIEWS))}),
n AS (SELECT view, key, t, count(*) AS n FROM v GROUP BY ALL),
h AS (SELECT x.view, x.key, x.t, sum(CASE WHEN y.t < x.t THEN y.n * pow(0.6, x.t - y.t - 1) ELSE 0 END) AS h
  FROM n x JOIN n y ON x.view = y.view AND x.key = y.key AND y.t <= x.t GROUP BY ALL),
c AS (SELECT v.seq, h.h, count(*) OVER (PARTITION BY v.view, v.key, v.t ORDER BY v.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS c
  FROM v JOIN h ON v.view = h.view AND v.key = h.key AND v.t = h.t),
s AS (SELECT seq, avg((c - h) * (c - h) / (h + 1e-6)) AS s FROM c GROUP BY seq)
SELECT {_LK}, round(CASE WHEN t - min(t) OVER () >= 1 THEN s ELSE 0 END, 4) + 0.0 AS score FROM l JOIN s USING (seq)""")  # fmt: skip
def mstream(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    out = counts.mstream(lines(spark, sf_dir), names, "t", LINES_ORDER, eps=1e-6)
    return out.select(*LINE_KEY, rounded(digits=4))


# Trees and histograms ------------------------------------------------------------------------

HST = {"n_trees": 4, "height": 4, "window": 1000, "seed": 3}
_UNIT = {"f_discount": "l_discount / 0.11", "f_quantity": "l_quantity / 51", "f_tax": "l_tax / 0.09"}


def unit_lines(spark, sf_dir):
    rows = arrival(lines(spark, sf_dir), "t", LINES_ORDER)
    return rows.withColumns({k: F.expr(v) for k, v in _UNIT.items()})


def _hst_sql() -> str:
    names, h, w = sorted(_UNIT), HST["height"], HST["window"]
    nodes = []
    for tree, (feature, cut) in enumerate(trees.half_space_trees(3, HST["n_trees"], h, HST["seed"])):
        nodes += [f"({tree}, {i + 1}, {f}, {c})" for i, (f, c) in enumerate(zip(feature, cut))]
    steps = [f"p0 AS (SELECT seq, x, tree, 1 AS node FROM l CROSS JOIN (SELECT DISTINCT tree FROM nodes))"]
    for d in range(1, h + 1):
        steps.append(f"p{d} AS (SELECT seq, x, p.tree, 2 * p.node + CASE WHEN x[f + 1] < cut THEN 0 ELSE 1 END AS node FROM p{d - 1} p JOIN nodes n ON p.tree = n.tree AND p.node = n.node)")
    every = " UNION ALL ".join(f"SELECT seq, seq // {w} AS block, tree, node, {2.0 ** (d - 1) + (2.0**h if d == h else 0)} AS weight FROM p{d}" for d in range(1, h + 1))
    full = HST["n_trees"] * (2.0 ** (h + 1) - 1)
    return f"""WITH {_L.replace(" FROM lineitem", f", [{', '.join(_UNIT[n] for n in names)}] AS x FROM lineitem")}, nodes(tree, node, f, cut) AS (VALUES {', '.join(nodes)}),
{', '.join(steps)}, a AS ({every}), m AS (SELECT block + 1 AS block, tree, node, count(*) AS m FROM a GROUP BY ALL),
r AS (SELECT a.seq, a.weight, coalesce(m.m, 0) AS m FROM a LEFT JOIN m USING (block, tree, node) WHERE a.block > 0
  UNION ALL SELECT seq, weight, count(*) OVER (PARTITION BY tree, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM a WHERE block = 0),
s AS (SELECT seq, sum(m * weight) AS s FROM r GROUP BY seq)
SELECT {_LK}, round(CASE WHEN seq = 0 THEN 0 ELSE 1 - s / (CASE WHEN seq < {w} THEN seq ELSE {w} END * {full}) END, 6) + 0.0 AS score FROM l JOIN s USING (seq)"""


@query("hst", _hst_sql())
def hst(spark, sf_dir):
    return trees.half_space(unit_lines(spark, sf_dir), list(_UNIT), "seq", **HST).select(*LINE_KEY, rounded())


LODA = {"n_projections": 6, "n_bins": 8, "warm_up": 256, "seed": 5}


def _loda_sql() -> str:
    names = sorted(_UNIT)
    matrix = trees.loda_matrix(3, LODA["n_projections"], LODA["seed"])
    z = [f"SELECT seq, {k} AS j, {' + '.join(['0.0::DOUBLE'] + [f'CAST({float(w)!r} AS DOUBLE) * ({_UNIT[f]})' for f, w in zip(names, row) if w])} AS z FROM l" for k, row in enumerate(matrix)]
    n, wu = LODA["n_bins"], LODA["warm_up"]
    return f"""WITH {_L}, z AS ({' UNION ALL '.join(z)}), e AS (SELECT j, min(z) AS lo, max(z) AS hi FROM z WHERE seq < {wu} GROUP BY j),
b AS (SELECT seq, j, (hi - lo) / {n} AS w, least(greatest(floor((z - lo) / ((hi - lo) / {n})), 0), {n - 1}) AS bin FROM z JOIN e USING (j)),
c AS (SELECT seq, w, count(*) OVER (PARTITION BY j, bin ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM b),
s AS (SELECT seq, greatest(avg(-ln((c + 1.0) / (seq + {float(n)}) / w + 1e-12)), 0) AS s FROM c GROUP BY seq)
SELECT {_LK}, round(CASE WHEN seq < {wu} THEN 0 ELSE s END, 5) + 0.0 AS score FROM l JOIN s USING (seq)"""


@query("loda", _loda_sql())
def loda(spark, sf_dir):
    return trees.loda(unit_lines(spark, sf_dir), list(_UNIT), "seq", "t", **LODA).select(*LINE_KEY, rounded(digits=5))


LODA_FADED = {"n_bins": 8, "warm_up": 64, "decay": 0.999}


def _loda_faded_sql() -> str:
    """A count that fades at each row is a running sum of powers, brought to the row's own power (a supplier's rows keep these finite)."""
    matrix, n, wu, d = trees.loda_matrix(3, 6, 5), LODA_FADED["n_bins"], LODA_FADED["warm_up"], LODA_FADED["decay"]
    exprs = list(_UNIT.values())
    z = [f"SELECT k, i, {j} AS j, {' + '.join(['0.0::DOUBLE'] + [f'CAST({float(w)!r} AS DOUBLE) * ({e})' for e, w in zip(('x0', 'x1', 'x2'), row) if w])} AS z FROM o" for j, row in enumerate(matrix)]
    past = "ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH o AS (SELECT *, l_suppkey AS k, row_number() OVER ({_LO}) - 1 AS i, {', '.join(f'({e})::DOUBLE AS x{c}' for c, e in enumerate(exprs))} FROM lineitem),
z AS ({' UNION ALL '.join(z)}), e0 AS (SELECT k, j, min(z) AS lo, max(z) AS hi FROM z WHERE i < {wu} GROUP BY k, j),
e AS (SELECT k, j, CASE WHEN hi - lo <= 1e-12 THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE hi - lo END / {n} AS w FROM e0),
b AS (SELECT k, i, j, w, least(greatest(floor((z - lo) / w), 0), {n - 1}) AS bin, pow({d}::DOUBLE, -greatest(i, {wu - 1})) AS p FROM z JOIN e USING (k, j)),
c AS (SELECT k, i, w, pow({d}::DOUBLE, i - 1) * coalesce(sum(p) OVER (PARTITION BY k, j, bin {past}), 0) AS c, pow({d}::DOUBLE, i - 1) * sum(p) OVER (PARTITION BY k, j {past}) AS t FROM b),
s AS (SELECT k, i, greatest(avg(-ln((c + 1) / (t + {float(n)}) / greatest(w, 1e-12) + 1e-12)), 0) AS s FROM c WHERE i >= {wu} GROUP BY k, i)
SELECT {_LK}, round(coalesce(s, 0), 5) + 0.0 AS score FROM o LEFT JOIN s USING (k, i)"""


@query("loda_decay", _loda_faded_sql())
def loda_decay(spark, sf_dir):
    rows = unit_features(spark, sf_dir).select(*LINES_ORDER, *_UNIT)
    matrix = trees.loda_matrix(3, 6, 5)
    return fold(rows, LINES, list(_UNIT), lambda: L.Loda(matrix, **LODA_FADED)).select(*LINE_KEY, rounded(digits=5))


# Neighbours ----------------------------------------------------------------------------------


def vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("b", F.expr("vec_id div 1000"))
    rows = arrival(rows, "b", ("vec_id",))
    return rows.withColumns({f"e{i}": F.col("embedding")[i].cast("double") for i in range(3)})


_V = "v AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings)"
_KNN = f"""WITH {_V},
d AS (SELECT q.seq, list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE - o.embedding[i]::DOUBLE, 2))) AS d
  FROM v q JOIN v o ON o.seq < q.seq AND o.seq >= q.seq - 100),
s AS (SELECT seq, list_avg(list_sort(list(d))[1:5]) AS s FROM d GROUP BY seq)
SELECT vec_id, label, CASE WHEN least(v.seq, 100) >= 50 THEN s ELSE 0 END AS score FROM v LEFT JOIN s USING (seq)"""


@query("knn", f"SELECT vec_id, round(score, 6) + 0.0 AS score FROM ({_KNN})")
def knn(spark, sf_dir):
    return neighbours.knn(vectors(spark, sf_dir), "embedding", "seq", 5, 100, 50).select("vec_id", rounded())


def _radius_sql(sub: bool) -> str:
    dims = range(1, 4)
    cell = lambda i: f"abs(floor(q.embedding[{i}]::DOUBLE / 0.1) - floor(o.embedding[{i}]::DOUBLE / 0.1)) <= 1"
    ub = "WHEN least(coalesce(f, 0), coalesce(u, 0)) < 5 THEN 1.0" if sub else ""
    return f"""WITH {_V},
c AS (SELECT q.seq, count(*) FILTER ({' + '.join(f'pow(q.embedding[{i}]::DOUBLE - o.embedding[{i}]::DOUBLE, 2)' for i in dims)} <= 0.1 * 0.1 + 1e-9) AS n,
  count(*) FILTER ({' AND '.join(map(cell, dims))}) AS f, count(*) FILTER ({cell(1)} AND {cell(3)}) AS u
  FROM v q JOIN v o ON o.seq < q.seq AND o.seq >= q.seq - 200 GROUP BY q.seq)
SELECT vec_id, round(CASE WHEN seq < 50 OR least(seq, 200) < 6 THEN 0.0 {ub} ELSE greatest(1 - coalesce(n, 0) / 5.0::DOUBLE, 0) END, 6) + 0.0 AS score FROM v LEFT JOIN c USING (seq)"""


@query("nets", _radius_sql(True))
def nets(spark, sf_dir):
    out = neighbours.radius_counts(vectors(spark, sf_dir), ["e0", "e1", "e2"], "seq", 5, 0.1, 200, 50, 1, ["e0", "e2"])
    return out.select("vec_id", rounded())


@query("stare", _radius_sql(False))
def stare(spark, sf_dir):
    out = neighbours.radius_counts(vectors(spark, sf_dir), ["e0", "e1", "e2"], "seq", 5, 0.1, 200, 50)
    return out.select("vec_id", rounded())


@query("nets_predict", f"SELECT vec_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM ({_radius_sql(True)})")
def nets_predict(spark, sf_dir):
    return simple.predict(nets(spark, sf_dir)).select("vec_id", "predicted")


_RANKED = f"k AS (SELECT vec_id, round(score, 6) AS s, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM ({_KNN}))"


def _labelled(spark, sf_dir):
    out = neighbours.knn(vectors(spark, sf_dir), "embedding", "seq", 5, 100, 50)
    return out.select(F.round("score", 6).alias("score"), (F.col("label") == 0).cast("int").alias("y"))


@query("pr_auc", f"""WITH {_RANKED}, t AS (SELECT s, sum(y) AS p, count(*) AS n FROM k GROUP BY s),
c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS a FROM t)
SELECT round(sum(p * tp / a) / sum(p), 6)::DOUBLE AS pr_auc FROM c""")  # fmt: skip
def pr(spark, sf_dir):
    return pr_auc(_labelled(spark, sf_dir), "score", "y").select(F.round("pr_auc", 6).alias("pr_auc"))


@query("roc_auc", f"""WITH {_RANKED} SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS roc_auc
FROM k a JOIN k b ON a.y = 1 AND b.y = 0""")  # fmt: skip
def roc(spark, sf_dir):
    return roc_auc(_labelled(spark, sf_dir), "score", "y").select(F.round("roc_auc", 6).alias("roc_auc"))


# Folds ---------------------------------------------------------------------------------------


def _events_fold(make, columns: list[str], spark, sf_dir):
    return fold(events(spark, sf_dir), EVENTS, ["value"], make).select("event_id", "user_id", *columns)


_PH = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, value, row_number() OVER ({_EV}) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS n, 0::DOUBLE AS m, 0::DOUBLE AS u, 0::DOUBLE AS d, 'inf'::DOUBLE AS lo, '-inf'::DOUBLE AS hi, false AS drift, 0::BIGINT AS k
    FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, i, event_id, n, m, u, d, lo, hi, n >= 30 AND (u - lo > 20 OR hi - d > 20), k + CASE WHEN n >= 30 AND (u - lo > 20 OR hi - d > 20) THEN 1 ELSE 0 END FROM (
    SELECT *, least(lo0, u) AS lo, greatest(hi0, d) AS hi FROM (
      SELECT *, 0.9999::DOUBLE * u0 + (value - m - 0.005::DOUBLE) AS u, 0.9999::DOUBLE * d0 + (value - m + 0.005::DOUBLE) AS d FROM (
        SELECT user_id, i, event_id, value, n, m0 + (value - m0) / n AS m, u0, d0, lo0, hi0, k FROM (
          SELECT f.user_id, o.i, o.event_id, o.value, CASE WHEN drift THEN 0 ELSE n END + 1 AS n, CASE WHEN drift THEN 0 ELSE m END AS m0, CASE WHEN drift THEN 0 ELSE u END AS u0,
            CASE WHEN drift THEN 0 ELSE d END AS d0, CASE WHEN drift THEN 'inf'::DOUBLE ELSE lo END AS lo0, CASE WHEN drift THEN '-inf'::DOUBLE ELSE hi END AS hi0, k
          FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)))))
SELECT event_id, user_id, drift, round(m, 6) + 0.0 AS mean, k AS n_detections FROM f WHERE i > 0"""


@query("page_hinkley", _PH)
def page_hinkley(spark, sf_dir):
    out = _events_fold(lambda: K.PageHinkley(threshold=20.0), ["drift", "mean", "n_detections"], spark, sf_dir)
    return out.withColumn("mean", F.round("mean", 6) + F.lit(0.0))


@query("adwin")
def adwin(spark, sf_dir):
    return _events_fold(K.Adwin, ["drift", "width", "estimation", "variance", "n_detections"], spark, sf_dir)


@query("kswin")
def kswin(spark, sf_dir):
    return _events_fold(lambda: K.Kswin(window_size=60, stat_size=20), ["drift", "p_value", "statistic", "n_detections"], spark, sf_dir)


@query("lof")
def lof(spark, sf_dir):
    return _events_fold(lambda: K.Lof(5, 30), ["score"], spark, sf_dir)


@query("srhf")
def srhf(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _UNIT.items()})
    return fold(rows.select(*LINES_ORDER, *_UNIT), LINES, list(_UNIT), lambda: K.RandomHistograms(3)).select(*LINE_KEY, "score")


def _gadget_sql() -> str:
    """Three nodes in a row, each with three weights and an offset, as one state that a row advances."""
    nodes, dims = range(3), range(3)
    state = [f"{v}{k}" for k in nodes for v in ("a", "b", "c", "r")]
    dot = lambda k: f"a{k} * x0 + b{k} * x1 + c{k} * x2"
    said = lambda k: f"(r{k} - ({dot(k)}))"
    reach = [" AND ".join(["true", *[f"{said(j)} > 0" for j in range(k)]]) for k in nodes]
    score = f"greatest(0.0, {', '.join(f'CASE WHEN {reach[k]} THEN {said(k)} ELSE 0.0 END' for k in nodes)})"
    steps, inner = [], "SELECT f.user_id AS k0, o.*, " + ", ".join(f"f.{v}" for v in state) + f" FROM f JOIN o ON o.l_suppkey = f.user_id AND o.i = f.i + 1"
    inner = f"SELECT *, {score} AS score, true AS on0 FROM ({inner})"
    for k in nodes:
        inside = f"CASE WHEN r{k} > {dot(k)} THEN 1 ELSE 0 END"
        moved = ", ".join(f"CASE WHEN on{k} THEN 0.9999::DOUBLE * {v}{k} + 0.01::DOUBLE * x{d} * {inside} ELSE {v}{k} END AS {v}{k}" for d, v in enumerate("abc"))
        inner = f"SELECT * REPLACE ({moved}, CASE WHEN on{k} THEN r{k} + 0.01::DOUBLE * (0.5::DOUBLE - {inside}) ELSE r{k} END AS r{k}) FROM ({inner})"
        if k < 2:
            inner = f"SELECT *, on{k} AND {said(k)} > 0 AS on{k + 1} FROM ({inner})"
    unit = ", ".join(f"({e})::DOUBLE AS x{d}" for d, e in enumerate(_UNIT.values()))
    return f"""WITH RECURSIVE o AS (SELECT l_suppkey, row_number() OVER ({_LO}) AS i, {unit} FROM lineitem),
f AS (SELECT l_suppkey AS user_id, 0::BIGINT AS i, 0.0::DOUBLE AS score, {', '.join(f'0::DOUBLE AS {v}' for v in state)} FROM (SELECT DISTINCT l_suppkey FROM lineitem)
  UNION ALL SELECT k0, i, score, {', '.join(state)} FROM ({inner}))
SELECT {_LK}, round(f.score, 7) + 0.0 AS score FROM (SELECT *, row_number() OVER ({_LO}) AS i FROM lineitem) l JOIN f ON f.user_id = l.l_suppkey AND f.i = l.i"""


@query("gadget", _gadget_sql())
def gadget(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _UNIT.items()})
    return fold(rows.select(*LINES_ORDER, *_UNIT), LINES, list(_UNIT), K.LinearSvm).select(*LINE_KEY, rounded(digits=7))


@query("ipca")
def ipca(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _UNIT.items()})
    out = fold(rows.select(*LINES_ORDER, *_UNIT), LINES, list(_UNIT), lambda: K.IncrementalPca(2, 20))
    return out.select(*LINE_KEY, "component_0", "component_1")


def _lines_fold(make, columns: list[str], spark, sf_dir):
    rows = unit_features(spark, sf_dir).select(*LINES_ORDER, *_UNIT)
    return fold(rows, LINES, list(_UNIT), make).select(*LINE_KEY, *columns)


def unit_features(spark, sf_dir):
    return lines(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _UNIT.items()})


_FOLDS = {
    "sdostream": lambda: L.SdoStream(32, 128, neighbours=4),
    "rshash": lambda: L.RsHash(3, components=8, hashes=2, bins=128),
    "xstream": lambda: L.XStream(tuple(_UNIT), k=8, chains=8, depth=6, window=64, init=64),
    "asd": lambda: T.AsdForest(10, 64),
    "autoencoder": lambda: L.Autoencoder(3, (8, 4, 8)),
    "lstm_autoencoder": lambda: L.LstmAutoencoder(3, 8, 4),
}
for _name, _make in _FOLDS.items():
    query(_name)(functools.partial(_lines_fold, _make, ["score"]))
query("kitnet")(functools.partial(_lines_fold, lambda: L.KitNet(2, 100, 100), ["score", "phase"]))
query("adaptive_svm")(functools.partial(_lines_fold, lambda: L.AdaptiveSvm(budget=30), ["score", "label"]))


@query("rcf")
def rcf(spark, sf_dir):
    out = forests.random_cut_forest(unit_features(spark, sf_dir), LINES, list(_UNIT), n_trees=4, sample_size=64)
    return out.select(*LINE_KEY, "score")


@query("rcf_shingle")
def rcf_shingle(spark, sf_dir):
    out = forests.random_cut_forest(unit_features(spark, sf_dir), LINES, list(_UNIT), n_trees=2, sample_size=32, shingle_size=3)
    return out.select(*LINE_KEY, "score")


@query("mondrian")
def mondrian(spark, sf_dir):
    out = forests.mondrian_forest(unit_features(spark, sf_dir), LINES, list(_UNIT), n_estimators=4)
    return out.select(*LINE_KEY, "score")


@query("online_iforest")
def online_iforest(spark, sf_dir):
    out = forests.online_forest(unit_features(spark, sf_dir), LINES, list(_UNIT), n_trees=4, max_leaf=16, window=256)
    return out.select(*LINE_KEY, "score")


@query("online_iforest_batch")
def online_iforest_batch(spark, sf_dir):
    """Months as batches: each is scored, then learned, as a whole."""
    rows = unit_features(spark, sf_dir)
    spec = StreamSpec(("t", *LINES_ORDER), ("l_suppkey",))
    out = forests.online_forest(rows, spec, list(_UNIT), n_trees=4, max_leaf=16, window=256, batch="t")
    return out.select(*LINE_KEY, "score")


def _timed(make, spark, sf_dir):
    """State that fades by days between rows."""
    rows = unit_features(spark, sf_dir).withColumn("day", F.unix_date(F.col("l_shipdate").cast("date")).cast("double"))
    return fold(rows.select(*LINES_ORDER, *_UNIT, "day"), LINES, [*_UNIT, "day"], make).select(*LINE_KEY, "score")


query("sdostream_time")(functools.partial(_timed, lambda: L.SdoStream(32, 128, neighbours=4, timed=True)))
query("rshash_time")(functools.partial(_timed, lambda: L.RsHash(3, components=8, hashes=2, bins=128, timed=True)))


@query("page_hinkley_reset", f"""WITH o AS (SELECT *, count(*) FILTER (event_type = 'error') OVER ({_EV}) AS life FROM events),
n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, life ORDER BY ts, event_id) AS i,
  avg(value) OVER (PARTITION BY user_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m FROM o)
SELECT event_id, user_id, round(m, 6) + 0.0 AS mean, i - 1 AS n_samples_seen FROM n""")  # fmt: skip
def page_hinkley_reset(spark, sf_dir):
    """The detector begins anew at each error of a user; a limit that nothing reaches leaves the mean since."""
    rows = table(spark, sf_dir, "events").withColumn("anew", F.col("event_type") == "error")
    out = fold(rows, EVENTS, ["value"], lambda: K.PageHinkley(threshold=1e18), reset="anew")
    return out.select("event_id", "user_id", rounded("mean"), "n_samples_seen")


@query("svm_info", "SELECT l_suppkey, count(*) AS n_samples_seen, count(*)::DOUBLE AS n_processed, least(count(*), 200)::DOUBLE AS buffered FROM lineitem GROUP BY l_suppkey")
def svm_info(spark, sf_dir):
    """What the states of the adaptive machines say of themselves at the end."""
    out = describe(unit_features(spark, sf_dir), LINES, list(_UNIT), lambda: L.AdaptiveSvm(budget=30))
    told = lambda k: F.element_at(F.element_at("info", k), 1)
    return out.select("l_suppkey", "n_samples_seen", told("n_samples_processed").alias("n_processed"), told("buffer_size").alias("buffered"))


@query("anoedge")
def anoedge(spark, sf_dir):
    """One chain of matrices for the whole stream."""
    rows = lines(spark, sf_dir).select(*LINES_ORDER, "t")
    return edges.anoedge(rows, StreamSpec(LINES_ORDER), ["l_partkey", "l_suppkey", "t"], lambda: L.AnoEdge(32, 32, 2, 1)).select(*LINE_KEY, "score")


@query("streamspot")
def streamspot(spark, sf_dir):
    """Graphs are users, edges successive event types; one set of clusters and of graphs for the whole stream."""
    types = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "scroll", "view")])
    code = F.coalesce(F.array_position(types, F.col("event_type")), F.lit(0)).cast("double")
    rows = table(spark, sf_dir, "events").withColumn("code", code)
    rows = rows.withColumn("next", F.lag("code", 1, 0.0).over(EVENTS.ordered()))
    rows = rows.select("event_id", "ts", F.col("user_id").cast("double").alias("graph"), "code", "next")
    spec = StreamSpec(EVENTS.order)
    return fold(rows, spec, ["graph", "code", "next"], lambda: L.StreamSpot(64, 2, 4, 4096, 4)).select("event_id", "score")


@query("pipe_minmax_hst")
def pipe_minmax_hst(spark, sf_dir):
    """Scaler and forest: rows are scored with what was scaled before them, and learned as scaled with them."""
    names = ["l_discount", "l_quantity", "l_tax"]
    return pipelines.scaled_half_space(lines(spark, sf_dir), names, LINES_ORDER, "t", **HST).select(*LINE_KEY, rounded())


_CHAINS = {
    "pipe_standard_lof": (["score"], lambda: X.StandardScaler(3), lambda: K.Lof(5, 30)),
    "pipe_standard_proj_sdo": (["score"], lambda: X.StandardScaler(3), lambda: X.RandomProjection(3, 2, 7), lambda: L.SdoStream(32, 128, neighbours=4)),
    "pipe_minmax_ipca": (["component_0", "component_1"], lambda: X.MinMaxScaler(3), lambda: K.IncrementalPca(2, 20)),
}


def _chain(columns: list[str], makers: list, spark, sf_dir):
    rows = unit_features(spark, sf_dir).select(*LINES_ORDER, *_UNIT)
    return pipelines.chain(rows, LINES, list(_UNIT), *makers).select(*LINE_KEY, *columns)


for _name, (_columns, *_makers) in _CHAINS.items():
    query(_name)(functools.partial(_chain, _columns, _makers))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["mov_avg"](spark, sf_dir)
