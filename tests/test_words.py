import random

import pytest

from wordwave.operators import dtw, sliders, words
from wordwave.operators.words import Param
from wordwave.sources.series import DAY

SCHEMA = "object_id string, band string, band_idx int, tus long, t double, value double, ord long"


def make(spark, points, object_id="a"):
    return spark.createDataFrame([(object_id, "b", 0, int(x * DAY), float(x), float(y), k) for k, (x, y) in enumerate(points)], SCHEMA)


def bags(spark, points, params, **more):
    out = [{} for _ in params]
    for r in words.bag(words.words(make(spark, points), params, **more)).collect():
        out[r.param_id][r.word] = r.tf
    return out


GOLDEN = list(zip([0, 1, 2, 4, 5, 7, 8, 11, 12, 13, 17, 18], [1, 3, 2, 8, 7, -1, 0, 5, 9, 4, 2, 6], strict=True))


def test_golden_vectors(spark):
    params = [Param(6, 1, ("min_max",)), Param(6, 1, ("trend", "min_max")), Param(6, 1, ("count",)), Param(14, 2, ("min_max",)), Param(14, 2, ("trend", "min_max"))]
    assert bags(spark, GOLDEN, params) == [{2: 4, 3: 2, 1: 1}, {14: 2, 7: 2, 3: 1, 15: 2, 6: 2, 9: 1, 11: 1}, {0: 2, 1: 1}, {17: 1, 13: 1, 3: 1}, {57: 1, 253: 1, 245: 1, 71: 1}]


def test_short_constant_and_wide(spark):
    p = [Param(6, 1, ("min_max",))]
    assert bags(spark, [(0, 1), (1, 2)], p) == [{}]
    assert bags(spark, [(i, 5) for i in range(8)], p) == [{3: 1}]  # all break points are equal
    assert bags(spark, [(i, i) for i in range(5)], [Param(900, 1, ("count",))])[0]
    assert words.bag(words.words(make(spark, []), p)).count() == 0


def walk_forward(t, win, tol):
    out, n = [], len(t)
    for i in range(n - 1):
        last = max(k for k in range(n) if t[k] <= t[i] + win)
        j = n if last == n - 1 else last
        if j - i > tol:
            out.append((i, j))
    return out


def walk_backward(t, win, tol):
    out = []
    for j in range(len(t) - 1, 1, -1):
        f = min(k for k in range(len(t)) if t[k] >= t[j] - win)
        i = f if f >= 2 else 0
        if j - i > tol:
            out.append((i, j + 1))
    return out


def test_windows_against_a_pointer_walk(spark):
    rng = random.Random(4)
    for _ in range(6):
        t = sorted(rng.choice(range(20)) for _ in range(rng.randint(1, 25)))  # with ties
        s = make(spark, [(x, 1) for x in t])
        for make_, walk in ((words.forward_windows, walk_forward), (words.backward_windows, walk_backward)):
            assert sorted((r.i, r.j) for r in make_(s, 5 * DAY, 2).collect()) == sorted(walk(t, 5, 2))


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(5)
    points = [(rng.random() * 40, rng.random()) for _ in range(60)]
    p = [Param(8, 1, ("min_max", "count")), Param(12, 3, ("max",))]
    one = bags(spark, points, p)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert bags(spark, points, p) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_exchange(spark):
    plan = words.bag(words.words(make(spark, GOLDEN), [Param(6, 1, ("min_max",))]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_dtw():
    a, b = [4, 4, 7, 9, 5, 2], [4, 7, 9, 9, 4, 2]
    assert dtw.dtw_matrix(a, b)[-1, -1] == pytest.approx(1.0)  # 5 and 4 meet, all else warps together
    path = dtw.dtw_path(a, b)
    assert path[0] == (0, 0) and path[-1] == (5, 5)
    assert dtw.irregular_dtw([(0, 1), None, (1, 2)], [(0, 1), (1, 2)]) == 0


def test_warped_pairs_match_one_by_one(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    a, b = ([list(rng.normal(size=rng.integers(0, 9))) for _ in range(3000)] for _ in range(2))
    got = dtw.warped(pa.array(a, pa.list_(pa.float64())), pa.array(b, pa.list_(pa.float64())))
    assert got.tolist() == pytest.approx([dtw.dtw_matrix(p, q)[-1, -1] for p, q in zip(a, b, strict=True)])
    segments = lambda s: [None if v < -1 else {"slope": v, "mean": v * v} for v in s]
    kind = pa.list_(pa.struct([("slope", pa.float64()), ("mean", pa.float64())]))
    got = dtw.warped(pa.array(map(segments, a), kind), pa.array(map(segments, b), kind))
    own = lambda s: [None if v < -1 else (v, v * v) for v in s]
    assert got.tolist() == pytest.approx([dtw.irregular_dtw(own(p), own(q)) for p, q in zip(a, b, strict=True)])


def test_warping_queries_meet_all_objects(spark, duck):
    from conftest import DATA
    from wordwave.plans import catalogue

    series = "SELECT DISTINCT user_id AS o, event_type AS band FROM events WHERE user_id IS NOT NULL"
    of = f"FROM ({series}) x JOIN ({series}) y USING (band) WHERE x.o % 50 = 0"
    got = catalogue.QUERIES["dtw_distance"](spark, str(DATA)).toPandas()
    assert len(got) == duck.sql(f"SELECT count(*) FROM (SELECT DISTINCT x.o, y.o {of})").fetchall()[0][0]
    assert (got.distance[got.a == got.b] == 0).sum() == got.a.nunique()
    got = catalogue.QUERIES["irregular_dtw"](spark, str(DATA)).toPandas()
    every = {int(x.object_id) for x in sliders.tumbling_time(catalogue._ev(spark, str(DATA)), 3 * DAY).select("object_id").distinct().collect()}
    assert set(got.other.astype(int)) == every and (got.distance[got.object_id == got.other] == 0).all()


@pytest.mark.parametrize("bounds", [(10_000, 8192, 1 << 21), (2, 7, 9)])
def test_every_distance_matches_pairs(spark, monkeypatch, bounds):
    """In blocks, tiles and parts of any size: null and no segments, bands that one side lacks."""
    for name, value in zip(("BROADCAST_SERIES", "TILE", "SENT"), bounds, strict=True):
        monkeypatch.setattr(dtw, name, value)
    rng = random.Random(6)
    series = {(f"o{i}", b): [None if rng.random() < 0.2 else (rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(0, 7))] for i in range(14) for b in "xyz" if rng.random() < 0.8}
    series |= {("o0", "own"): [(1.0, 2.0)], ("o13", "other"): [(1.0, 2.0)]}
    schema = "object_id string, band string, values array<struct<slope: double, mean: double>>"
    df = spark.createDataFrame([(o, b, v) for (o, b), v in series.items()], schema)
    asked = ["o0", "o3", "o4", "o7", "o9"]
    queries, references = df.where(df.object_id.isin(asked)), df.where("object_id <> 'o0'")
    want = {(o, p, b): dtw.irregular_dtw(v, w) for (o, b), v in series.items() if o in asked for (p, c), w in series.items() if b == c and p != "o0"}
    got = dtw.every_distance(queries, references).collect()
    assert len(got) == len(want) and {(r.a, r.b, r.band): r.distance for r in got} == pytest.approx(want)
    assert {0.0, float("inf")} < set(want.values())
    rounded = {(r.a, r.b, r.band): r.distance for r in dtw.every_distance(queries, references, digits=2).collect()}
    assert rounded == {k: round(v, 2) for k, v in want.items()}
    assert dtw.every_distance(queries.where("false"), references).collect() == []


def test_every_distance_of_plain_values(spark):
    df = spark.createDataFrame([("a", "x", [4.0, 4.0, 7.0, 9.0, 5.0, 2.0]), ("b", "x", [4.0, 7.0, 9.0, 9.0, 4.0, 2.0])], "object_id string, band string, values array<double>")
    assert sorted(map(tuple, dtw.every_distance(df, df).collect())) == [("a", "a", "x", 0.0), ("a", "b", "x", 1.0), ("b", "a", "x", 1.0), ("b", "b", "x", 0.0)]


def test_series_not_pairs_enter_python(spark, duck):
    """The segments of 810 million pairs at 60 times sf0.1 took too long to hand over: below the warping nothing is joined."""
    from conftest import DATA
    from wordwave.plans import catalogue

    plan = catalogue.QUERIES["irregular_dtw"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 1
    assert "Join" not in plan[plan.index("MapInArrow") :]
