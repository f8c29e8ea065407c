import random

import numpy as np
import pytest

from wordwave.operators import compact, features
from wordwave.sources.series import DAY


@pytest.fixture(scope="module")
def bag(spark):
    rng = random.Random(1)
    rows = [(f"o{i}", b, 0, w, b * 5 + w, rng.randint(1, 4)) for i in range(24) for b in range(2) for w in range(5) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "object_id string, band_idx int, param_id int, word long, feature long, tf long").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(f"o{i}", i % 3) for i in range(24)], "object_id string, label long")


def test_models_survive_saving(spark, bag, labels, tmp_path):
    for method in ("LSA", "MANOVA"):
        model = compact.CompactModel.fit(bag, labels, method, budget=5, n_bands=2)
        model.save(str(tmp_path / method))
        again = compact.CompactModel.load(spark, str(tmp_path / method))
        a, b = (sorted((r[0], r[1], round(r[2], 9)) for r in m.transform(bag).collect()) for m in (model, again))
        assert a == b and a
    assert compact.wide(compact.CompactModel.fit(bag, labels, "LSA", budget=4, n_bands=2).transform(bag), 3).columns == ["object_id", "fea1", "fea2", "fea3"]
    with pytest.raises(ValueError):
        compact.CompactModel.fit(bag, labels, "other")


def test_manova_keeps_words_in_all_bands(bag, labels):
    weights = compact.CompactModel.fit(bag, labels, "MANOVA", budget=4, n_bands=2).transform(bag)
    kept = {r.feature for r in weights.select("feature").distinct().collect()}
    assert len({f % 5 for f in kept}) == 2 and kept <= {f for w in {f % 5 for f in kept} for f in (w, w + 5)}
    norms = weights.groupBy("object_id").agg({"weight": "sum"}).count()
    assert norms <= 24 and features is not None


def older(t, v, win, wl, alphabet, quantity):
    """Pointer walk of the older builder, word length 1 or min_max with single segments."""
    n, tol, out = len(t), 2 * wl, []
    windows = []
    for i in range(n - 1):
        if t[i] + win <= t[-1]:
            j = sum(x <= t[i] + win for x in t)
            windows.append((i, j, t[i]))
    for j in range(n - 1, 1, -1):
        if t[j] - win >= t[0]:
            i = next(k for k in range(n) if t[k] >= t[j] - win)
            windows.append((i, j, t[j] - win))
    previous = None
    for i, j, _ in windows:
        if j - i <= tol:
            continue
        x = max(v[i:j]) - min(v[i:j]) if quantity == "min_max" else (np.mean(v[i:j]) - np.mean(v)) / np.std(v)
        if quantity == "min_max":
            points = [(max(v) - min(v)) * k / alphabet for k in range(1, alphabet)]
        else:
            from statistics import NormalDist

            points = [NormalDist().inv_cdf(k / alphabet) for k in range(1, alphabet)]
        word = sum(round(p, 9) <= round(x, 9) for p in points)
        if word != previous:
            out.append(word)
        previous = word
    return out


@pytest.mark.parametrize("quantity", ["min_max", "mean"])
def test_older_words(spark, quantity):
    rng = random.Random(2)
    t = sorted(rng.sample(range(60), 25))
    v = [rng.random() * 5 for _ in t]
    df = spark.createDataFrame([("a", "b", 0, x * DAY, float(x), y, k) for k, (x, y) in enumerate(zip(t, v, strict=True))], "object_id string, band string, band_idx int, tus long, t double, value double, ord long")
    got = [r.word for r in compact.older_words(df, 15 * DAY, 1, quantity).orderBy("dir", "pos").collect()]
    assert got == older(t, v, 15, 1, 4, quantity)
    assert compact.older_words(df, 15 * DAY, 2, "min_max", handler="").count() >= 0


def test_observed_windows_cross_batches(spark):
    """The pass over sorted points gives the fold's windows, wherever batches end."""
    import numpy as np

    from wordwave.operators import sliders

    rng = np.random.default_rng(3)
    rows = [(f"o{k}", "b", int(t), float(t % 7), i) for k, n in enumerate([1, 2, 3, 40, 200]) for i, t in enumerate(np.sort(rng.integers(0, 500, n)))]
    df = spark.createDataFrame(rows, "object_id string, band string, tus long, value double, ord long")
    want = {}
    for k in {r[0] for r in rows}:
        t = [r[2] for r in rows if r[0] == k]
        open_ = t[0]
        for x in t[:-1]:
            open_ = x if x > open_ + 20 else open_
            want[k, open_ - t[0]] = want.get((k, open_ - t[0]), 0) + 1
    want = {w: n for w, n in want.items() if n >= 2}
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.object_id, r.start): r.n for r in sliders.tumbling_observed(df, 20).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want
