"""Sources and sinks by round trips, searches with stand-in scores, classifiers, cross-validation and whole pipelines against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordwave.functions.config import Config
from wordwave.operators import classify, dtw, features, search, sliders, workflow
from wordwave.plans import catalogue, pipelines
from wordwave.sources import series, sinks


def test_regular_lines_are_objects_of_their_own(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\t1.5\t2.5\n1\t1.5\t2.5\n\n2\t7\n")
    (tmp_path / "b.txt").write_text("1\t1.5\t2.5\n")
    got = series.read_regular(spark, str(tmp_path)).collect()
    of = {}
    for r in got:
        of.setdefault(r.object_id, []).append((r.label, r.time, r.value))
    assert sorted(sorted(v) for v in of.values()) == [[(1, 0, 1.5), (1, 1, 2.5)]] * 3 + [[(2, 0, 7.0)]]
    again = {r.object_id for r in series.read_regular(spark, str(tmp_path)).collect()}
    assert again == set(of)


def test_arrays_to_long_form(spark):
    df = spark.createDataFrame([("a", 1, [5.0, 6.0], [0.5, 1.5]), ("b", 2, [], []), ("c", 3, [1.0], [0.0, 9.0]), ("d", 4, None, None)], "object_id string, label int, values array<double>, times array<double>")
    got = sorted(map(tuple, series.explode_arrays(df).collect()), key=str)
    assert got == [("a", 1, 0.5, 5.0), ("a", 1, 1.5, 6.0), ("c", 3, 0.0, 1.0), ("c", 3, 9.0, None)]


def test_bags_stand_side_by_side(spark, tmp_path):
    rows = [("x", 0, 1, "Mm", 1, 10.0), ("x", 3, 2, "Mm", 1, 10.0), ("x", 1, 5, "Tr", 1, 10.0), ("y", 0, 7, "Tr", 1, 20.0)]
    df = spark.createDataFrame(rows, "object_id string, feature long, tf long, quantity string, wl int, win double")
    path = str(tmp_path / "bag")
    sinks.write_bag(df, path)
    got = {(r.object_id, r.feature, r.tf) for r in series.read_bag(spark, path, ["Tr", "Mm"], [10.0], [1]).collect()}
    assert got == {("x", 1, 5), ("x", 2, 1), ("x", 5, 2)}
    assert "PartitionFilters: [" in series.read_bag(spark, path, ["Tr"])._jdf.queryExecution().executedPlan().toString()


def test_features_records_predictions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "object_id string, fea1 double")
    records = spark.createDataFrame([(3, 1.0), (5, 2.0), (7, 6.0)], "points long, seconds double")
    path = sinks.write_features(df, str(tmp_path / "f"), records=records)
    other = sinks.write_features(df, str(tmp_path / "f"), overwrite=False)
    assert other != path and spark.read.parquet(f"{path}_record_times").count() == 3
    parts = [series.read_features(spark, path, c, 3) for c in range(3)]
    assert sorted(r.object_id for p in parts for r in p.collect()) == ["a", "b", "c"]
    row = workflow.time_per_object(spark.read.parquet(f"{path}_record_times")).first()
    assert (row.objects, row.points, row["mean"]) == (3, 15, 3.0) and row["std"] == pytest.approx(np.std([1, 2, 6]))
    raw = sinks.write_raw_features(df, str(tmp_path), "train", "v1")
    assert raw.endswith("raw_v1_train") and spark.read.parquet(raw).count() == 3
    done = sinks.write_predictions(df, str(tmp_path), "test", "knn")
    assert done.endswith("predictions_test_knn") and spark.read.parquet(done).count() == 3
    sinks.write_dataset(df.withColumn("t", F.lit(1)), df.withColumn("ddf", F.lit(1)), df.where("fea1 > 1").select("object_id"), str(tmp_path / "ds"))
    assert series.read_metadata(spark, str(tmp_path / "ds"), survey=1).count() == 2 and series.read_metadata(spark, str(tmp_path / "ds"), survey=0).count() == 0


def test_results_of_many_files(spark, tmp_path):
    rows = spark.createDataFrame([("(Mm)", 10.0, 0.5)], "quantity string, win double, cv_mean double")
    for _ in range(2):
        sinks.append_results(rows, str(tmp_path / "run(Mm)_20240102-030405"))
    got = series.read_results(spark, str(tmp_path / "run(Mm)_20240102-030405" / "*.csv")).collect()
    assert len(got) == 2 and {r.cv_mean for r in got} == {0.5}


def test_zipped_pairs(spark, tmp_path):
    import gzip
    import zipfile

    data = "object_id,mjd,passband,flux,detected\n7,10.5,3,1.5,1\n7,12.5,3,2.5,0\n7,13,2,9,1\n8,1,3,4,1\n"
    meta = "object_id,ddf,target\n7,1,42\n8,0,90\n"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", data)
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write(data)
    (tmp_path / "m.csv").write_text(meta)
    want = [(7, 0.0, 1.5, 42), (7, 2.0, 2.5, 42), (8, 0.0, 4.0, 90)]
    for name in ("d.zip", "d.csv.gz"):
        got = series.read_csv(spark, str(tmp_path / name), str(tmp_path / "m.csv"))
        assert sorted((r.object_id, r.time, r.flux, r.target) for r in got.collect()) == want
    assert series.read_csv(spark, str(tmp_path / "d.zip"), str(tmp_path / "m.csv"), detected_only=True).count() == 2


def test_metadata_columns(spark):
    f = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 9.0)], "object_id string, fea1 double, z double")
    m = spark.createDataFrame([("a", 0.3, 1), ("c", 0.4, 0)], "object_id string, z double, ddf int")
    got = features.with_metadata(f, m, ["z", "ddf"])
    assert got.columns == ["object_id", "fea1", "z", "ddf"] and [tuple(r) for r in got.collect()] == [("a", 1.0, 0.3, 1)]
    assert features.without_metadata(got, ["z", "ddf", "none"]).columns == ["object_id", "fea1"]


def test_path_of_ties():
    assert dtw.dtw_path([0, 0], [0, 1]) == [(0, 0), (1, 0), (1, 1)]
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 3, rng.integers(1, 7)), rng.integers(0, 3, rng.integers(1, 7))
        d, path = dtw.dtw_matrix(a, b), dtw.dtw_path(a, b)
        assert path[-1] == (len(a) - 1, len(b) - 1) and all((p[0] <= q[0] <= p[0] + 1 and p[1] <= q[1] <= p[1] + 1) for p, q in zip(path, path[1:]))
        if path[0] == (0, 0):
            assert sum((a[i] - b[j]) ** 2 for i, j in path) == d[-1, -1]


def test_dependent_matrix_is_mirrored(spark):
    rng = np.random.default_rng(5)
    rows = {i: rng.integers(0, 9, 6).astype(float) for i in range(7)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "object_id long, features array<double>")
    got = {(r.a, r.b): r.distance for r in dtw.dependent_matrix(df.where("object_id < 3"), df, 3, 2).collect()}

    def plain(x, y):
        d = np.full((4, 4), np.inf)
        d[0, 0] = 0
        for i in range(3):
            for j in range(3):
                d[i + 1, j + 1] = ((x[2 * i : 2 * i + 2] - y[2 * j : 2 * j + 2]) ** 2).sum() + min(d[i, j], d[i + 1, j], d[i, j + 1])
        return math.sqrt(d[-1, -1])

    assert len(got) == 21 and all(v == pytest.approx(plain(rows[a], rows[b])) for (a, b), v in got.items())


def test_share_of_a_class_is_exact(spark, tmp_path):
    """0.7 of 90 is 63, though 90 * 0.7 is 62.99... as a double."""
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "customer.parquet")
    duckdb.sql(f"copy (select i as c_custkey, (i % 5)::int as c_nationkey, 0.0::double as c_acctbal from range(450) t(i)) to '{path}'")
    got = catalogue.QUERIES["strat_train_test"](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"create view customer as select * from '{path}'")
    assert sorted(map(tuple, got)) == sorted(c.sql(catalogue.ORACLE_SQL["strat_train_test"]).fetchall())
    assert sum(r.part == "train" for r in got) == 5 * 63


def test_erf_and_thresholds(spark):
    xs = [-9.0, -3.2, -3.0, -1.0, -1e-9, 0.0, 0.3, 2.9999, 3.0001, 5.0, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", workflow.erf(F.col("x")).alias("e")).collect()
    assert all(abs(r.e - math.erf(r.x)) < 1e-14 for r in got)
    o = spark.createDataFrame([(k, i, 1000.0, 1.0) for k in ("a", "b", "c") for i in range(3)], "object_id string, ord int, flux double, flux_error double")
    least = spark.createDataFrame([("a", 3), ("b", 4)], "object_id string, least int")
    assert {r.object_id: r.passes for r in workflow.detection_filter(o, originals=least).collect()} == {"a": True, "b": False, "c": True}


def test_gaps_against_numpy(spark):
    day = 86_400_000_000
    rows = [("o", "b", t * day, float(v), i) for i, (t, v) in enumerate([(0, 1), (1, 5), (9, 13), (9, 14), (21, 2)])]
    got = sliders.interpolate_gaps(spark.createDataFrame(rows, "object_id string, band string, tus long, value double, ord long"), 3 * day)
    made = sorted((r.tus // day, r.value) for r in got.collect() if r.interpolated)
    want = sorted((int(t), float(np.interp(t, [0, 1, 9, 9 + 1e-12, 21], [1, 5, 13, 14, 2]))) for k in (1, 2, 4, 5, 6) for t in np.linspace(3 * k, 3 * k + 3, 3))
    assert [t for t, _ in made] == [t for t, _ in want] and np.allclose([v for _, v in made], [v for _, v in want])


def test_classifier_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) + np.arange(60)[:, None] % 3 * 4
    rows = [(f"o{i}", *map(float, v), None if i == 7 else 1.0, float("nan") if i == 9 else 2.0) for i, v in enumerate(x)]
    f = spark.createDataFrame(rows, "object_id string, f1 double, f2 double, f3 double, bad double, worse double")
    labels = spark.createDataFrame([(f"o{i}", i % 3) for i in range(60)], "object_id string, label int")
    train, test = f.where("cast(substring(object_id, 2) as int) < 40"), f.where("cast(substring(object_id, 2) as int) >= 40")
    y = np.arange(60) % 3
    for flags in ((True, False, False), (False, False, False), (False, True, True), (False, False, True)):
        model = classify.KnnClassifier(*flags).fit(train, labels)
        assert model.columns == ["f1", "f2", "f3"] and ("prototype" in model.name) == flags[0]
        got = {r.object_id: (r.label, r.pred) for r in model.predict(test, labels).collect()}
        a, b = x[:40], x[40:]
        if not flags[0] and flags[1]:
            a, b = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (a, b))
        if not flags[0] and flags[2]:
            m, s = a.mean(axis=0), a.std(axis=0)
            a, b = (a - m) / s, (b - m) / s
        known, names = (np.stack([a[y[:40] == c].mean(axis=0) for c in range(3)]), np.arange(3)) if flags[0] else (a, y[:40])
        want = names[((b[:, None] - known[None]) ** 2).sum(axis=2).argmin(axis=1)]
        assert [got[f"o{i}"] for i in range(40, 60)] == [(y[i], want[i - 40]) for i in range(40, 60)]
        model.save(str(tmp_path / model.name))
        loaded = classify.KnnClassifier.load(spark, str(tmp_path / model.name))
        assert {r.object_id: r.pred for r in loaded.predict(test).collect()} == {k: p for k, (_, p) in got.items()}


def test_prototypes_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i, j, float((i * 7 + j * 3) % 5)) for i in range(6) for j in range(4)], "object_id long, feature long, weight double")
    protos = rows.where("object_id < 3").withColumnRenamed("object_id", "label")
    few = sorted(map(tuple, classify.nearest(rows, protos).collect()))
    monkeypatch.setattr(classify, "BROADCAST_PROTOTYPES", 0)
    assert sorted(map(tuple, classify.nearest(rows, protos).collect())) == few
    monkeypatch.setattr(classify, "BROADCAST_QUERIES", 2)
    dense = spark.createDataFrame([(i, [float(i), float(i % 2)]) for i in range(9)], "object_id long, features array<double>")
    got = {r.object_id: r.pred for r in classify.k_nearest(dense, dense.withColumn("label", F.col("object_id")), block=2).collect()}
    assert got == {i: i for i in range(9)}


def test_combinations_with_stand_in_scores():
    value = {"a": 0.3, "b": 0.25, "c": 0.005, "d": -0.1}
    score = lambda groups, lengths=None: sum(value[q] for g in groups for q in g)
    ranked = [(("a",), 0.3), (("b",), 0.25), (("c",), 0.005), (("d",), -0.1)]
    assert search.combine_independent(ranked, score, 4) == ([("a",), ("b",), ("c",)], pytest.approx(0.555))
    assert search.combine_independent(ranked, score, 2)[0] == [("a",), ("b",)]
    assert search.combine_independent(ranked[3:], score, 4) == ([("d",)], -0.1)
    found = search.search_quantities(score, list("abcd"), alphabet=4, power=8, keep=2)
    sizes = [s for s, *_ in found]
    assert sizes == sorted(sizes) and {1, 2, 3} == set(sizes)
    pairs = {frozenset(g[0]) for s, g, _ in found if s == 2 and len(g) == 1}
    assert pairs == {frozenset(x) for x in ("ab", "ac", "ad", "bc", "bd")}  # each holds one of the two best
    assert max(found, key=lambda x: x[2])[2] >= score([("a", "b", "c")])


def labelled(spark, n=24, seed=1):
    """Two classes of series that differ in their amplitude, two bands."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        for b in range(2):
            t = np.sort(rng.choice(np.arange(0, 4000), 30, replace=False)) / 100
            v = rng.normal(size=30) * (1 + 4 * (i % 2)) + np.where(i % 2, 6 * np.sin(t), t)
            rows += [(f"o{i}", "AB"[b], b, int(x * series.DAY), float(x), float(y), k) for k, (x, y) in enumerate(zip(t, v, strict=True))]
    s = spark.createDataFrame(rows, "object_id string, band string, band_idx int, tus long, t double, value double, ord long")
    meta = spark.createDataFrame([(f"o{i}", i % 2, None) for i in range(n)], "object_id string, label int, reference_object_id string")
    return s, meta


def test_pipelines_end_to_end(spark, tmp_path):
    s, meta = labelled(spark)
    config, score, ranking = pipelines.search_pipeline(s, meta, 2, ["min_max", "trend"], [10.0], k=3, word_lengths=((1,), (1,)), keep=1, top_k=1, most=2)
    assert score > 0.8 and config.quantities and config.resolution == ((10.0, 1),)
    assert ranking.columns == ["quantity", "groups", "cv_mean", "valid_cv"] and ranking.count() >= 3
    config.save(str(tmp_path / "c.json"))
    config = Config.load(str(tmp_path / "c.json"))
    other, _ = labelled(spark, 8, seed=2)
    for method in ("LSA", "MANOVA"):
        own = Config(quantities=config.quantities, resolution=config.resolution, method=method, budget=6)
        paths = pipelines.feature_pipeline(own, s, meta.select("object_id", "label"), {"test": other}, 2, str(tmp_path / method))
        got = {n: spark.read.parquet(p) for n, p in paths.items()}
        assert set(got) == {"train", "test"} and got["test"].select("object_id").distinct().count() == 8
        folds = workflow.stratified_folds(meta, 3)
        scores = search.cv_pipeline(pipelines.bag_of(s, own, 2), folds, 3, method, 6, 2).collect()
        assert sorted(r.fold for r in scores) == [0, 1, 2] and np.mean([r.balanced_accuracy for r in scores]) > 0.7
    by = search.search_config_by_survey(s, folds, meta.withColumn("ddf", F.lit(1)), config.quantities, 2, [10.0], (1,), k=3, top_k=1, most=1)
    assert list(by) == ["ddf"] and by["ddf"][0].resolution == ((10.0, 1),)


def test_cv_pipeline_against_numpy(spark):
    rng = np.random.default_rng(4)
    n, words_, bands = 18, 4, 2
    counts = rng.poisson(1.0, (n, words_, bands)) + (np.arange(n)[:, None, None] % 3 == np.arange(words_)[None, :, None]) * 2
    rows = [(f"o{i:02d}", 0, b, w, b * words_ + w, int(counts[i, w, b])) for i in range(n) for w in range(words_) for b in range(bands) if counts[i, w, b]]
    bag = spark.createDataFrame(rows, "object_id string, param_id int, band_idx int, word long, feature long, tf long")
    y = np.arange(n) % 3
    folds = spark.createDataFrame([(f"o{i:02d}", int(y[i]), (i // 3) % 3) for i in range(n)], "object_id string, label int, fold int")
    got = {r.fold: r.balanced_accuracy for r in search.cv_pipeline(bag, folds, 3, "MANOVA", budget=4, n_bands=bands).collect()}
    for f in range(3):
        test = (np.arange(n) // 3) % 3 == f
        x, t = counts[~test].astype(float), y[~test].astype(float)
        score = []
        for w in range(words_):
            a = x[:, w].T @ x[:, w]
            b = x[:, w].T @ t
            score.append(b @ np.linalg.solve(a, b) / (t @ t) if np.linalg.matrix_rank(a) == bands else 0.0)
        top = sorted(range(words_), key=lambda w: (-round(score[w], 9), -w))[:2]
        z = counts[:, top].reshape(n, -1).astype(float)
        df = (z[~test] > 0).sum(axis=0)
        z = np.where(z > 0, 1 + np.log(np.maximum(z, 1)), 0) * (np.log((1 + (~test).sum()) / (1 + df)) + 1) * (df > 0)
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        z = z / np.where(norm > 0, norm, 1)
        means = np.stack([z[~test & (y == c)].mean(axis=0) for c in range(3)])
        pred = np.round(np.linalg.norm(z[test][:, None] - means[None], axis=2), 9).argmin(axis=1)
        assert got[f] == pytest.approx(np.mean([(pred[y[test] == c] == c).mean() for c in range(3)]))


def test_boosted_trees_learn_classes(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    rows = [(i, float(i % 3), (rng.normal(size=4) * 0.3 + i % 3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label double, f array<double>").withColumn("features", array_to_vector("f"))
    model = classify.boosted_trees(df.where("vec_id < 60"), rounds=3)
    got = model.transform(df.where("vec_id >= 60")).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.9


def test_decomposition_of_many_features(spark, monkeypatch):
    """The distributed way gives the scores and loadings of the driver's, whatever the features' ids."""
    rng = np.random.default_rng(6)
    x = rng.random((20, 7)) * (rng.random((20, 7)) < 0.7)
    ids = [3, 10**12, 17, 2**40, 5, 999, 12345678901]
    rows = [(f"o{i}", ids[j], float(x[i, j])) for i in range(20) for j in range(7) if x[i, j]]
    w = spark.createDataFrame(rows, "object_id string, feature long, weight double")
    near = features.lsa(w, 3)
    monkeypatch.setattr(features, "DRIVER_FEATURES", 3)
    far = features.lsa(w, 3)
    for a, b in zip(near, far, strict=True):
        one, two = ({tuple(r)[:2]: r[2] for r in t.collect()} for t in (a, b))
        assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-6 for k in one)
    s = np.linalg.svd(x, compute_uv=False)[:3]
    got = {r.component: r.q for r in near[0].groupBy("component").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("q")).collect()}
    assert np.allclose([got[c] for c in range(3)], s)
    explained = features.explained(near[0]).orderBy("component").collect()
    var = (x @ np.linalg.svd(x)[2][:3].T).var(axis=0)
    assert np.allclose([r.variance for r in explained], var) and np.allclose([r.cumulative for r in explained], np.cumsum(var))
