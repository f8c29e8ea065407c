"""The whole ways: from series to a configuration, and from a configuration to compact features of any dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Config
from ..operators import compact, search, words, workflow
from ..operators.words import Param
from ..sources import sinks


def params_of(config: Config) -> list[Param]:
    """The representation of a configuration: every quantity group at every resolution."""
    return [Param(w, wl, tuple(g), tuple(config.alphabet_of(q) for q in g)) for w, wl in config.resolution for g in config.quantities]


def bag_of(series: DataFrame, config: Config, n_bands: int) -> DataFrame:
    """(object_id, param_id, band_idx, word, feature, tf) of a configuration."""
    params = params_of(config)
    found = words.words(series, params, segmentation=config.segmentation, num_reduction=config.num_reduction)
    return words.feature_ids(words.bag(found), params, n_bands)


def search_pipeline(series: DataFrame, metadata: DataFrame, n_bands: int, singles: Sequence[str], widths: Sequence[float], k: int = 5, method: str = "LSA", alphabet: int = 4, power: int = 8, word_lengths: Sequence[Sequence[int]] = ((2, 3, 4, 5, 6), (1, 2, 3), (1, 2)), keep: int = 3, top_k: int = 4, most: int = 4) -> tuple[Config, float, DataFrame]:
    """Three stages: search of quantities, their ranking, search of resolutions for the best.

    Gives the configuration, its cross-validated score, and the ranking
    (quantity, groups, cv_mean, valid_cv).
    """
    if alphabet**power <= 4**6:
        raise ValueError("the power must allow more than 4^6 words")
    from ..functions.config import code_of

    folds = workflow.stratified_folds(metadata, k)
    evaluate = lambda groups, lengths: search.best_score(search.resolution_scores(series, folds, groups, widths, lengths, n_bands, k, alphabet))
    found = search.search_quantities(evaluate, singles, alphabet, power, word_lengths, keep)
    rows = [(code_of([list(g) for g in groups]), len(groups), float(score), score >= 0) for _, groups, score in found]
    ranking = series.sparkSession.createDataFrame(rows, "quantity string, groups int, cv_mean double, valid_cv boolean").orderBy(F.desc("cv_mean"), "quantity")
    _, groups, _ = max(found, key=lambda x: (x[2], -x[0]))
    config, score = search.search_config(series, folds, groups, n_bands, widths, word_lengths[-1], method, k, top_k, most, alphabet=alphabet)
    return config, score, ranking


def feature_pipeline(config: Config, fit: DataFrame, labels: DataFrame, others: Mapping[str, DataFrame], n_bands: int, folder: str, name: str = "train") -> dict[str, str]:
    """Four stages: bags of the fitted series and of the others, the compact model of the fitted one, its features of all.

    Bags, the model and features are written below ``folder``; gives the folder of each
    dataset's features.  The bag of an other dataset uses the fitted features alone.
    """
    series = {name: fit, **others}
    bags = {}
    for n, s in series.items():
        bags[n] = sinks.write_features(bag_of(s, config, n_bands), f"{folder}/bag_{n}")
    read = fit.sparkSession.read.parquet
    model = compact.CompactModel.fit(read(bags[name]), labels, config.method, config.budget, n_bands, config.scheme)
    model.save(f"{folder}/model")
    model = compact.CompactModel.load(fit.sparkSession, f"{folder}/model")
    return {n: sinks.write_features(model.transform(read(path)), f"{folder}/features_{n}") for n, path in bags.items()}
