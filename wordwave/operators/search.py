"""Cross-validated search over representations, with all parameters and folds as keys of one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import classify, compact, words, workflow
from .store import written
from .words import Param


def cv_scores(bag: DataFrame, folds: DataFrame, k: int, scheme: str = "ltc") -> DataFrame:
    """(param_id, fold, balanced_accuracy) of the class-prototype classifier.

    ``bag`` has (object_id, param_id, feature, tf), ``folds`` (object_id, label,
    fold).  For every fold the other objects give document frequencies and
    class means; the fold's objects are weighted by these and go to the nearest
    mean.  Objects without a word count as zero rows, in training and in test.
    Rows are dealt to the k-1 folds that train on them, so one plan serves
    every parameter and fold; class sizes are the broadcast sides, folds have a
    row for each object and are joined as Spark finds best.
    """
    tf = F.col("tf").cast("double")
    tf = 1.0 + F.log(tf) if scheme[0] == "l" else tf
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cv")
    dealt = bag.join(folds, "object_id").select("object_id", "param_id", "feature", "label", "fold", tf.alias("w"), every)
    members = folds.select("object_id", "label", "fold", every).withColumn("train", F.col("fold") != F.col("cv"))
    sizes = members.where("train").groupBy("cv").agg(F.count(F.lit(1)).alias("n"))
    class_sizes = members.where("train").groupBy("cv", "label").agg(F.count(F.lit(1)).alias("size"))
    by_feature = W.partitionBy("param_id", "cv", "feature")
    rows = dealt.withColumn("df", F.sum((F.col("fold") != F.col("cv")).cast("long")).over(by_feature)).join(F.broadcast(sizes), "cv")
    if scheme[1] == "t":
        rows = rows.withColumn("w", F.col("w") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    if scheme[2] == "c":
        rows = rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("param_id", "cv", "object_id"))))
    key = ["param_id", "cv", "feature"]
    sums = rows.where("fold <> cv").groupBy(*key, "label").agg(F.sum("w").alias("s"))
    means = sums.join(F.broadcast(class_sizes), ["cv", "label"]).select(*key, F.col("label").alias("pred"), (F.col("s") / F.col("size")).alias("c"))
    squares = means.groupBy("param_id", "cv", "pred").agg(F.sum(F.col("c") * F.col("c")).alias("pp"))
    test = rows.where("fold = cv")
    dots = test.join(means, key).groupBy("param_id", "cv", "object_id", "pred").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    params = bag.select("param_id").distinct()
    squares = params.crossJoin(F.broadcast(class_sizes.select("cv", F.col("label").alias("pred")))).join(squares, ["param_id", "cv", "pred"], "left").na.fill(0.0, ["pp"])
    options = squares.groupBy("param_id", "cv").agg(F.collect_list(F.struct("pred", "pp")).alias("options"))
    pairs = members.where("not train").select("object_id", "label", "cv").join(F.broadcast(options), "cv").select("param_id", "cv", "object_id", "label", F.explode("options").alias("o"))
    pairs = pairs.select("param_id", "cv", "object_id", "label", "o.pred", "o.pp").join(dots, ["param_id", "cv", "object_id", "pred"], "left")
    # the query's own norm is common to its distances
    distance = F.round(F.col("pp") - 2 * F.coalesce("dot", F.lit(0.0)), 9)
    best = pairs.groupBy("param_id", "cv", "object_id", "label").agg(F.min(F.struct(distance.alias("d"), "pred")).alias("b"))
    recall = best.groupBy("param_id", "cv", "label").agg(F.avg((F.col("label") == F.col("b.pred")).cast("double")).alias("r"))
    return recall.groupBy("param_id", F.col("cv").alias("fold")).agg(F.avg("r").alias("balanced_accuracy"))


def cv_pipeline(bag: DataFrame, folds: DataFrame, k: int, method: str = "LSA", budget: int = 100, n_bands: int = 6, scheme: str = "ltc") -> DataFrame:
    """(fold, balanced_accuracy) of a compact model, class means and the nearest of these, all fitted without the fold.

    "LSA": weights, projection, means; "MANOVA": best words, weights, means.
    ``bag`` has (object_id, param_id, band_idx, word, feature, tf).  Objects
    without a feature are zero rows, in training and in test.
    """
    bag = written(bag.join(folds.select("object_id", "label", "fold"), "object_id"))
    parts = []
    for f in range(k):
        train, test = workflow.fold_split(folds, f)
        labels = train.select("object_id", "label")
        model = compact.CompactModel.fit(bag.where(F.col("fold") != f).drop("label", "fold"), labels, method, budget, n_bands, scheme)
        rows = model.transform(bag.drop("label", "fold"))
        rows = rows.toDF("object_id", "feature", "weight")
        means = written(classify.centroids(rows, labels).select("label", F.col("feature").cast("long").alias("feature"), "weight"))
        asked = rows.join(test.select("object_id"), "object_id", "left_semi").select("object_id", F.col("feature").cast("long").alias("feature"), "weight")
        asked = asked.unionByName(test.select("object_id", F.lit(None).cast("long").alias("feature"), F.lit(0.0).alias("weight")))
        every = means.unionByName(labels.select("label").distinct().select("label", F.lit(None).cast("long").alias("feature"), F.lit(0.0).alias("weight")))
        found = classify.nearest(asked, every).join(test.select("object_id", "label"), "object_id")
        parts.append(classify.balanced_accuracy(found).select(F.lit(f).alias("fold"), "balanced_accuracy"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cv_summary(scores: DataFrame) -> DataFrame:
    """(param_id, cv_mean, cv_std): mean and population deviation over folds."""
    return scores.groupBy("param_id").agg(F.avg("balanced_accuracy").alias("cv_mean"), F.stddev_pop("balanced_accuracy").alias("cv_std"))


def grid(quantities: Sequence[Sequence[str]], widths: Sequence[float], word_lengths: Sequence[int], bins: int = 4) -> list[Param]:
    return [Param(w, wl, tuple(q), (bins,) * len(q)) for q in quantities for w in widths for wl in word_lengths]


def grid_search(series: DataFrame, folds: DataFrame, params: Sequence[Param], n_bands: int, k: int = 5, most_dropped: float = 0.05) -> DataFrame:
    """(param_id, quantity, win, wl, alpha, dropped, valid_cv, cv_mean, cv_std): one row for every parameter.

    A representation that leaves more than ``most_dropped`` of the objects
    without a word is not valid; its scores are kept all the same.
    """
    from ..functions.config import code_of

    bag = words.feature_ids(words.bag(words.words(series, params)), params, n_bands).select("object_id", "param_id", "feature", "tf")
    n = folds.count()
    used = bag.groupBy("param_id").agg(F.countDistinct("object_id").alias("used"))
    names = series.sparkSession.createDataFrame(
        [(i, code_of([list(p.quantities)]), float(p.days), p.word_length, p.bins[0]) for i, p in enumerate(params)], "param_id int, quantity string, win double, wl int, alpha int"
    )
    scored = cv_summary(cv_scores(bag, folds, k))
    rows = names.join(F.broadcast(used), "param_id", "left").join(F.broadcast(scored), "param_id", "left")
    rows = rows.withColumn("dropped", F.lit(n) - F.coalesce("used", F.lit(0)))
    return rows.select("param_id", "quantity", "win", "wl", "alpha", "dropped", (F.col("dropped") <= most_dropped * n).alias("valid_cv"), "cv_mean", "cv_std")


def stack_search(series: DataFrame, folds: DataFrame, params: Sequence[Param], n_bands: int, k: int = 5, top_k: int = 2, most: int = 3, gain: float = 0.01) -> list[tuple[tuple[Param, ...], float]]:
    """Greedy stacking of representations: their features side by side, scored together.

    The bag of every candidate is written once; an evaluation reads the
    partitions of its parameters alone.
    """
    bag = words.feature_ids(words.bag(words.words(series, params)), params, n_bands).select("object_id", "feature", "tf", "param_id")
    known = written(bag, by="param_id")

    def evaluate(stack: tuple[int, ...]) -> float:
        part = known.where(F.col("param_id").isin(*stack)).withColumn("param_id", F.lit(0))
        found = cv_summary(cv_scores(part, folds, k)).first()
        return found["cv_mean"] if found else 0.0

    stacks = workflow.greedy_stack(range(len(params)), evaluate, top_k, most, gain)
    return [(tuple(params[i] for i in stack), score) for stack, score in stacks]


def first_additions(series: DataFrame, folds: DataFrame, params: Sequence[Param], n_bands: int, k: int = 5, top_k: int = 2) -> DataFrame:
    """(base, win, wl, cv_mean, rise): every parameter added to each of the ``top_k`` best single ones, the first step of :func:`stack_search` in full."""
    bag = words.feature_ids(words.bag(words.words(series, params)), params, n_bands).select("object_id", "feature", "tf", "param_id")
    known = written(bag, by="param_id")
    scores: dict[tuple[int, ...], float] = {}

    def evaluate(stack: tuple[int, ...]) -> float:
        if stack not in scores:
            found = cv_summary(cv_scores(known.where(F.col("param_id").isin(*stack)).withColumn("param_id", F.lit(0)), folds, k)).first()
            scores[stack] = found["cv_mean"] if found else 0.0
        return scores[stack]

    workflow.greedy_stack(range(len(params)), evaluate, top_k, 2)
    rows = [(f"{params[s[0]].days}:{params[s[0]].word_length}", float(params[s[1]].days), params[s[1]].word_length, float(v), float(v - scores[s[:1]])) for s, v in scores.items() if len(s) == 2]
    return series.sparkSession.createDataFrame(rows, "base string, win double, wl int, cv_mean double, rise double")


def subtract_background(series: DataFrame, mode: str = "none") -> DataFrame:
    """Takes the median of each (object, band) from its values; "none" leaves them."""
    if mode == "none":
        return series
    if mode != "median":
        raise ValueError(f"unknown background: {mode}")
    level = series.groupBy("object_id", "band").agg(F.percentile("value", 0.5).alias("level"))
    return series.join(level, ["object_id", "band"]).withColumn("value", F.col("value") - F.col("level")).drop("level")


def resolution_scores(series: DataFrame, folds: DataFrame, groups: Sequence[Sequence[str]], widths: Sequence[float], word_lengths: Sequence[int], n_bands: int, k: int = 5, bins: int = 4, most_dropped: float = 0.05) -> DataFrame:
    """(win, wl, dropped, valid_cv, cv_mean, cv_std) of a representation at every resolution: the groups' features stand side by side."""
    params = grid(groups, widths, word_lengths, bins)
    places = list(dict.fromkeys((p.days, p.word_length) for p in params))
    bag = words.feature_ids(words.bag(words.words(series, params)), params, n_bands)
    place = F.get(F.array(*(F.lit(places.index((p.days, p.word_length))) for p in params)), F.col("param_id"))
    bag = written(bag.select("object_id", place.alias("param_id"), "feature", "tf"))
    n = folds.count()
    used = bag.groupBy("param_id").agg(F.countDistinct("object_id").alias("used"))
    names = series.sparkSession.createDataFrame([(i, float(w), wl) for i, (w, wl) in enumerate(places)], "param_id int, win double, wl int")
    rows = names.join(F.broadcast(used), "param_id", "left").join(F.broadcast(cv_summary(cv_scores(bag, folds, k))), "param_id", "left")
    rows = rows.withColumn("dropped", F.lit(n) - F.coalesce("used", F.lit(0)))
    return rows.select("win", "wl", "dropped", (F.col("dropped") <= most_dropped * n).alias("valid_cv"), "cv_mean", "cv_std")


def best_score(scores: DataFrame) -> float:
    """The best mean of valid resolutions; -1 without any."""
    row = scores.where("valid_cv").agg(F.max("cv_mean")).first()
    return -1.0 if row is None or row[0] is None else float(row[0])


def combine_independent(ranked: Sequence[tuple[tuple[str, ...], float]], evaluate: Callable[[list[tuple[str, ...]]], float], most: int, gain: float = 0.01) -> tuple[list[tuple[str, ...]], float]:
    """Adds groups to the best one while the score rises, each time the group that scores best; ends after a rise of less than ``gain``, which still counts.

    ``ranked`` holds (group, score), best first; ``evaluate`` scores a list of
    groups that stand side by side.
    """
    chosen, best = [ranked[0][0]], ranked[0][1]
    while len(chosen) < most:
        scored = [(evaluate([*chosen, g]), -i, g) for i, (g, _) in enumerate(ranked) if g not in chosen]
        if not scored:
            break
        score, _, group = max(scored)
        if score <= best:
            break
        rise, best = score - best, score
        chosen.append(group)
        if rise < gain:
            break
    return chosen, best


def search_quantities(evaluate: Callable[[list[tuple[str, ...]], Sequence[int]], float], singles: Sequence[str], alphabet: int = 4, power: int = 8, word_lengths: Sequence[Sequence[int]] = ((2, 3, 4, 5, 6), (1, 2, 3), (1, 2)), keep: int = 3) -> list[tuple[int, list[tuple[str, ...]], float]]:
    """Single quantities, then pairs and triples fused from the ``keep`` best, each level also combined side by side.

    Rows (size of the groups, groups, score), in the order of the search.
    ``evaluate`` scores groups over word lengths.  Combinations are bounded by a
    vocabulary of ``alphabet`` to the ``power``.
    """
    found: list[tuple[int, list[tuple[str, ...]], float]] = []
    selected: list[tuple[str, ...]] = []
    for size, lengths in enumerate(word_lengths, 1):
        groups = [(q,) for q in singles] if size == 1 else workflow.fused_expansions(selected, singles)
        if not groups:
            break
        ranked = sorted(((g, evaluate([g], lengths)) for g in groups), key=lambda x: -x[1])
        found += [(size, [g], score) for g, score in ranked]
        spare = power - (6 if size == 1 else len(lengths) * size)
        most = min(len(singles) if size == 1 else 6, int(alphabet**spare) if spare >= 0 else 1)
        chosen, best = combine_independent(ranked, lambda gs: evaluate(gs, lengths), most)  # noqa: B023
        if len(chosen) > 1:
            found.append((size, chosen, best))
        selected = [g for g, _ in ranked[:keep]]
    return found


def search_config(series: DataFrame, folds: DataFrame, groups: Sequence[Sequence[str]], n_bands: int, widths: Sequence[float], word_lengths: Sequence[int] = (1, 2, 3), method: str = "LSA", k: int = 5, top_k: int = 4, most: int = 4, budget: int = 100, alphabet: int = 4):
    """The best multi-resolution stack of a representation, as a configuration and its score."""
    from ..functions.config import Config

    params = grid(groups, widths, word_lengths, alphabet)
    places = list(dict.fromkeys((p.days, p.word_length) for p in params))
    of_place = [[i for i, p in enumerate(params) if (p.days, p.word_length) == place] for place in places]
    bag = words.feature_ids(words.bag(words.words(series, params)), params, n_bands).select("object_id", "feature", "tf", "param_id")
    known = written(bag, by="param_id")

    def evaluate(stack: tuple[int, ...]) -> float:
        part = known.where(F.col("param_id").isin(*(i for s in stack for i in of_place[s]))).withColumn("param_id", F.lit(0))
        row = cv_summary(cv_scores(part, folds, k)).first()
        return row["cv_mean"] if row else 0.0

    stack, score = max(workflow.greedy_stack(range(len(places)), evaluate, top_k, most), key=lambda x: x[1])
    resolution = tuple((float(places[s][0]), int(places[s][1])) for s in stack)
    return Config(alphabet=alphabet, quantities=tuple(tuple(g) for g in groups), resolution=resolution, budget=budget, method=method), score


def search_config_by_survey(series: DataFrame, folds: DataFrame, metadata: DataFrame, *args, **settings) -> dict:
    """A configuration for the deep objects (ddf = 1) and one for the wide ones: {survey: (configuration, score)}; a survey without objects has none."""
    out = {}
    for name, ddf in (("ddf", 1), ("wdf", 0)):
        own = metadata.where(F.col("ddf") == ddf).select("object_id")
        part = folds.join(own, "object_id", "left_semi")
        if not part.isEmpty():
            out[name] = search_config(series.join(own, "object_id", "left_semi"), part, *args, **settings)
    return out
