import numpy as np
import pytest
from pyspark.sql import functions as F

from wordwave.functions import config
from wordwave.operators import classify, features, workflow
from wordwave.sources import sinks
from wordwave.sources import series as source


def long(spark, m):
    return spark.createDataFrame([(str(i), j, float(x)) for i, row in enumerate(m) for j, x in enumerate(row) if x], "object_id string, feature long, weight double")


def test_lsa_matches_svd(spark):
    m = np.random.default_rng(1).integers(0, 4, (12, 6)).astype(float)
    scores, loadings = features.lsa(long(spark, m), 3)
    got = np.zeros((12, 3))
    for r in scores.collect():
        got[int(r.object_id), r.component] = r.score
    v = np.linalg.svd(m, full_matrices=False)[2][:3].T
    v *= np.sign(v[np.abs(v).argmax(axis=0), np.arange(3)])
    assert np.allclose(got, m @ v)
    assert loadings.count() == 18


def test_manova_is_uncentred_r_squared(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 5, (20, 2)), rng.integers(0, 3, 20)
    bag = spark.createDataFrame([(str(i), "b", b, 0, 7, int(x[i, b])) for i in range(20) for b in range(2) if x[i, b]], "object_id string, band string, band_idx int, param_id int, word long, tf long")
    labels = spark.createDataFrame([(str(i), int(y[i])) for i in range(20)], "object_id string, label long")
    got = features.manova_scores(bag, labels, 2).collect()[0].score
    assert got == pytest.approx(y @ x @ np.linalg.solve(x.T @ x, x.T @ y) / (y @ y))


def test_k_nearest_and_scaling(spark):
    train = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 0.9])], "label int, features array<double>")
    q = spark.createDataFrame([("x", [0.9, 0.9]), ("y", [0.1, 0.0])], "object_id string, features array<double>")
    assert {r.object_id: r.pred for r in classify.k_nearest(q, train).collect()} == {"x": 1, "y": 0}
    assert {r.object_id: r.pred for r in classify.k_nearest(q, train, 3).collect()} == {"x": 1, "y": 1}
    z = np.array([r.features for r in classify.standardise(train).collect()])
    assert np.allclose(z.mean(axis=0), 0) and np.allclose(z.std(axis=0), 1)
    assert all(abs(np.linalg.norm(r.features) - 1) < 1e-9 or not any(r.features) for r in classify.normalise(train).collect())


def test_folds_keep_augmentations_together(spark):
    rows = [(i, i % 2, None) for i in range(20)] + [(100 + i, i % 2, i) for i in range(20)]
    f = {r.object_id: r.fold for r in workflow.stratified_folds(spark.createDataFrame(rows, "object_id int, label int, reference_object_id int"), 4).collect()}
    assert all(f[100 + i] == f[i] for i in range(20))
    assert sorted(f[i] for i in range(0, 20, 2)) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_greedy_stack_and_expansions():
    value = {"a": 0.5, "b": 0.4, "c": 0.1}
    stacks = workflow.greedy_stack(list(value), lambda s: sum(value[x] for x in s) - 0.35 * (len(s) - 1), top_k=2, most=3)
    assert stacks[0][0] == ("a", "b")
    assert workflow.fused_expansions([("a",), ("b",)], ["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert workflow.valid_representation(100, 5) and not workflow.valid_representation(100, 6)


def test_codes_and_config(tmp_path):
    assert config.quantities_of("(TrMm-MmMn)") == [["trend", "min_max"], ["min_max", "min"]]
    assert config.code_of(config.quantities_of("(TrMm-MmMn-Co)")) == "(TrMm-MmMn-Co)"
    assert config.scheme_code(*config.scheme_of("ltc")) == "ltc" and config.vocabulary_size(4, 3) == 125
    assert not config.is_new_combination([("a", "b")], ("b", "a"))
    c = config.Config(quantities=(("trend", "min_max"),), resolution=((110.4, 1), (7.0, 3)))
    c.save(str(tmp_path / "c.json"))
    assert config.Config.load(str(tmp_path / "c.json")) == c


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.txt").write_text("1\t0.5\t0.25\n2\t1\t2\n")
    assert [(r.label, r.time, r.value) for r in source.read_regular(spark, str(tmp_path / "r.txt")).orderBy("label", "time").collect()] == [(1, 0, 0.5), (1, 1, 0.25), (2, 0, 1.0), (2, 1, 2.0)]
    (tmp_path / "d.csv").write_text("object_id,mjd,passband,flux,detected\n1,10.5,3,1.0,1\n1,12.0,3,2.0,0\n1,11.0,2,9.0,1\n")
    (tmp_path / "m.csv").write_text("object_id,target\n1,90\n")
    assert [(r.time, r.target) for r in source.read_csv(spark, str(tmp_path / "d.csv"), str(tmp_path / "m.csv")).orderBy("time").collect()] == [(0.0, 90), (1.5, 90)]
    o = source.observations(spark.createDataFrame([(1, 1.0, 0, 2.0), (1, 2.0, 9, 2.0)], "object_id int, mjd double, passband int, flux double"))
    assert [(r.band, r.tus) for r in o.collect()] == [("g", source.DAY)]
    df = spark.range(3)
    path = sinks.write_features(df, str(tmp_path / "f.parquet"))
    assert sinks.write_features(df, path, overwrite=False) != path
    bag = df.select("id", F.lit("Mm").alias("quantity"), F.lit(1).alias("wl"), F.lit(9.0).alias("win"))
    sinks.write_bag(bag, str(tmp_path / "bag"))
    assert "PartitionFilters: [isnotnull(wl" in spark.read.parquet(str(tmp_path / "bag")).where("wl = 1")._jdf.queryExecution().toString()


def test_nan_columns(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None), (2.0, 1.0, 3)], "a double, b double, c int")
    kept, (out,) = workflow.drop_nan_columns(df)
    assert kept == ["a"] and out.columns == ["a"]


def numpy_cv(m, y, fold, k):
    out = []
    for f in range(k):
        train, test = fold != f, fold == f
        df = (m[train] > 0).sum(axis=0)
        idf = np.log((1 + train.sum()) / (1 + df)) + 1
        w = np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * idf
        w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        classes = np.unique(y[train])
        c = np.stack([w[train & (y == q)].mean(axis=0) for q in classes])
        d = np.round((c**2).sum(axis=1)[None] - 2 * w @ c.T, 9)
        pred = classes[d.argmin(axis=1)]
        out.append(np.mean([(pred[test & (y == q)] == q).mean() for q in np.unique(y[test])]))
    return out


def test_cross_validation_matches_numpy(spark):
    from wordwave.operators import search

    rng = np.random.default_rng(3)
    m = rng.poisson(0.8, (40, 7))
    m[3] = 0
    y, fold = rng.integers(0, 3, 40), np.arange(40) % 4
    m[y == 1, 2] += 2
    bag = spark.createDataFrame([(str(i), p, j, int(x)) for p in (0, 1) for i, row in enumerate(m) for j, x in enumerate(row) if x and (p == 0 or j < 5)], "object_id string, param_id int, feature long, tf long")
    folds = spark.createDataFrame([(str(i), int(y[i]), int(fold[i])) for i in range(40)], "object_id string, label int, fold int")
    got = {(r.param_id, r.fold): r.balanced_accuracy for r in search.cv_scores(bag, folds, 4).collect()}
    for p, cols in ((0, 7), (1, 5)):
        assert np.allclose([got[p, f] for f in range(4)], numpy_cv(m[:, :cols], y, fold, 4))


def test_grid_and_stack(spark):
    from wordwave.operators import search
    from wordwave.sources.series import DAY

    rows = [(str(o), "b", 0, k * DAY, float(k), float((k % (2 + o % 2)) * (1 + o % 2)), k) for o in range(12) for k in range(20)]
    s = spark.createDataFrame(rows, "object_id string, band string, band_idx int, tus long, t double, value double, ord long")
    folds = spark.createDataFrame([(str(o), o % 2, (o // 2) % 3) for o in range(12)], "object_id string, label int, fold int")
    params = search.grid([("min_max",), ("count",)], [5.0], [1])
    got = search.grid_search(s, folds, params, 1, k=3).orderBy("param_id").collect()
    assert [r.quantity for r in got] == ["(Mm)", "(Co)"] and all(r.valid_cv and r.dropped == 0 for r in got)
    stacks = search.stack_search(s, folds, params, 1, k=3, top_k=1, most=2)
    assert len(stacks) == 1 and 0 <= stacks[0][1] <= 1
    assert search.subtract_background(s, "median").groupBy().sum("value").first()[0] is not None


def test_boosted_trees_learn_every_class(spark, duck):
    from conftest import DATA
    from wordwave.plans import catalogue

    got = catalogue.QUERIES["gbt_classify"](spark, str(DATA)).toPandas()
    want = duck.sql("SELECT vec_id, label FROM embeddings WHERE vec_id % 5 = 0").fetchall()
    assert sorted((r.vec_id, int(r.label)) for r in got.itertuples()) == sorted(want)
    assert got.label.nunique() == 10 and got.pred.max() > 2


def test_neighbours_among_all_other_rows(spark):
    from wordwave.operators import classify

    rows = spark.createDataFrame([(i, i % 3, [float(i * i % 101), float(i % 7)]) for i in range(120)], "object_id long, label int, features array<double>")
    known = {r.object_id: r for r in rows.collect()}
    got = {r.object_id: r.pred for r in classify.k_nearest_others(rows.where("object_id % 50 = 0"), rows, k=3, block=16).collect()}
    for i in (0, 50, 100):
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(known[i].features, r.features, strict=True)) ** 0.5, 9), r.label) for j, r in known.items() if j != i)[:3]
        votes = {c: (-sum(x == c for _, x in near), min(d for d, x in near if x == c), c) for _, c in near}
        assert got[i] == min(votes, key=votes.get)
    assert sorted(got) == [0, 50, 100]
