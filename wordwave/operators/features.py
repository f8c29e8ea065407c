"""Weighting, selection and reduction of bag features (long sparse tables)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Features up to which their Gram matrix is decomposed on the driver.
DRIVER_FEATURES = 4096


def idf_table(counts: DataFrame, n_objects: int, doc: str = "object_id", feature: str = "feature") -> DataFrame:
    """(feature, df, idf): smooth inverse document frequency ln((1+N)/(1+df)) + 1."""
    return counts.groupBy(feature).agg(F.countDistinct(doc).alias("df")).withColumn("idf", F.log((1.0 + n_objects) / (1.0 + F.col("df"))) + 1.0)


def tfidf(counts: DataFrame, n_objects: int, scheme: str = "ltc", doc: str = "object_id", feature: str = "feature", idf: DataFrame | None = None) -> DataFrame:
    """(doc, feature, weight) by a SMART scheme: term l/n, document t/n, norm c/n.

    ``n_objects`` counts objects without words too.  The document frequency is
    a window count over the feature when no ``idf`` table is given.
    """
    tf = F.col("tf").cast("double")
    rows = counts.select(doc, feature, (1.0 + F.log(tf) if scheme[0] == "l" else tf).alias("w"))
    if scheme[1] == "t":
        rows = rows.join(idf if idf is not None else idf_table(counts, n_objects, doc, feature), feature).withColumn("w", F.col("w") * F.col("idf"))
    if scheme[2] == "c":
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(doc)))
        return rows.select(doc, feature, (F.col("w") / norm).alias("weight"))
    return rows.select(doc, feature, F.col("w").alias("weight"))


def class_sums(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, feature, tf): counts summed by class, for class-based weights."""
    return counts.join(labels, "object_id").groupBy("label", "feature").agg(F.sum("tf").alias("tf"))


def variances(counts: DataFrame, n_objects: int, value: str = "tf") -> DataFrame:
    """(feature, variance): population variance with the implicit zeros."""
    x = F.col(value).cast("double")
    sums = counts.groupBy("feature").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    return sums.select("feature", (F.col("q") / n_objects - (F.col("s") / n_objects) * (F.col("s") / n_objects)).alias("variance"))


def drop_zero_variance(counts: DataFrame, n_objects: int) -> DataFrame:
    return counts.join(variances(counts, n_objects).where("variance > 0").select("feature"), "feature", "left_semi")


def gram(bag: DataFrame, labels: DataFrame, n_bands: int) -> DataFrame:
    """(param_id, word, xx, xy): band cross-products and products with the numeric class, summed over objects.

    A pivot by conditional sums keeps it one aggregation per object and one per
    word; absent bands are zeros.
    """
    joined = bag.join(labels, "object_id")
    per = joined.groupBy("param_id", "word", "object_id").agg(F.max("label").cast("double").alias("y"), *(F.sum(F.when(F.col("band_idx") == b, F.col("tf")).otherwise(0)).cast("double").alias(f"x{b}") for b in range(n_bands)))
    pairs = [(i, j) for i in range(n_bands) for j in range(i, n_bands)]
    return per.groupBy("param_id", "word").agg(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"x{i}x{j}") for i, j in pairs), *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"x{i}y") for i in range(n_bands)))


def manova_scores(bag: DataFrame, labels: DataFrame, n_bands: int) -> DataFrame:
    """(param_id, word, score): Pillai's trace of each word's bands against the class, 0 where the bands are dependent.

    With a numeric class and no intercept it is the uncentred R squared
    y'Y (Y'Y)^-1 Y'y / y'y; the small systems are solved in batches.
    """
    yy = labels.agg(F.sum(F.col("label").cast("double") * F.col("label"))).first()[0] or 1.0
    table = gram(bag, labels, n_bands)
    pairs = [(i, j) for i in range(n_bands) for j in range(i, n_bands)]

    def solve(frames):
        for df in frames:
            n = len(df)
            a, b = np.zeros((n, n_bands, n_bands)), np.zeros((n, n_bands))
            for i, j in pairs:
                a[:, i, j] = a[:, j, i] = df[f"x{i}x{j}"]
            for i in range(n_bands):
                b[:, i] = df[f"x{i}y"]
            good = np.array([np.linalg.matrix_rank(m) == n_bands for m in a], dtype=bool) if n else np.zeros(0, bool)
            score = np.zeros(n)
            if good.any():
                score[good] = np.einsum("ij,ij->i", b[good], np.linalg.solve(a[good], b[good][..., None])[..., 0]) / yy
            yield df[["param_id", "word"]].assign(score=score)

    return table.mapInPandas(solve, "param_id int, word long, score double")


def select_top(bag: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The bag rows, in all bands, of the ``k`` best words; among equals (to nine digits) the later feature wins."""
    best = scores.orderBy(F.desc(F.round("score", 9)), F.desc("param_id"), F.desc("word")).limit(k)
    return bag.join(F.broadcast(best.select("param_id", "word")), ["param_id", "word"], "left_semi")


def anova_f(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(feature, f): one-way analysis of variance with the implicit zeros."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = labels.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    x = F.col("tf").cast("double")
    per = counts.join(labels, "object_id").groupBy("feature", "label").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q")).join(F.broadcast(sizes), "label")
    sums = per.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("size")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / float(total["n"])
    within = F.col("q") - F.col("b")
    return sums.select("feature", (between / (total["k"] - 1) / F.nullif(within / float(total["n"] - total["k"]), F.lit(0.0))).alias("f"))


def lsa(weights: DataFrame, k: int, doc: str = "object_id") -> tuple[DataFrame, DataFrame]:
    """Truncated, uncentred SVD: (doc, component, score) and (feature, component, loading).

    The Gram matrix of the features is aggregated by a self-join on the object
    (sparse rows), decomposed on the driver, and the projection is a join; the
    largest loading of a component is positive.  The driver holds a matrix of
    features x features up to DRIVER_FEATURES of them; beyond, the Gram matrix
    stays distributed and only its leading directions are found.
    """
    features = [r[0] for r in weights.select("feature").distinct().orderBy("feature").limit(DRIVER_FEATURES + 1).collect()]
    n = len(features)
    k = max(1, min(k, n - 1)) if n > 1 else 1
    if n > DRIVER_FEATURES:
        return _distributed_svd(weights, k, doc)
    per = weights.groupBy(doc).agg(F.collect_list(F.struct("feature", "weight")).alias("c"))
    cells = per.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b")).where("a.feature <= b.feature")
    gram_ = cells.groupBy(F.col("a.feature").alias("i"), F.col("b.feature").alias("j")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("g")).collect()
    place = {f: i for i, f in enumerate(features)}
    m = np.zeros((n, n))
    for r in gram_:
        m[place[r["i"]], place[r["j"]]] = m[place[r["j"]], place[r["i"]]] = r["g"]
    values, basis = np.linalg.eigh(m)
    basis = basis[:, np.argsort(-values)[:k]]
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    spark = weights.sparkSession
    loadings = spark.createDataFrame([(int(f), c, float(basis[i, c])) for f, i in place.items() for c in range(basis.shape[1])], "feature long, component int, loading double")
    return project(weights, loadings, doc), loadings


def project(weights: DataFrame, loadings: DataFrame, doc: str = "object_id") -> DataFrame:
    """(doc, component, score) of weights under fitted loadings; broadcast where Spark finds them small enough."""
    return weights.join(loadings, "feature").groupBy(doc, "component").agg(F.sum(F.col("weight") * F.col("loading")).alias("score"))


def _distributed_svd(weights: DataFrame, k: int, doc: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`lsa` for many features: these are numbered without gaps, so the matrix is as wide as there are features, whatever their ids."""
    from pyspark.mllib.linalg import Vectors as OldVectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark = weights.sparkSession
    places = written(weights.select("feature").distinct().select("feature", (F.row_number().over(W.orderBy("feature")) - 1).alias("place")))
    size = places.count()
    rows = weights.join(places, "feature").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("c"))
    matrix = RowMatrix(rows.select("c").rdd.map(lambda r: OldVectors.sparse(size, [(x["place"], x["weight"]) for x in r["c"]])), numCols=size)
    v = matrix.computeSVD(k).V.toArray()
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    table = spark.createDataFrame([(i, c, float(v[i, c])) for i in range(size) for c in range(v.shape[1])], "place int, component int, loading double")
    loadings = table.join(places, "place").select("feature", "component", "loading")
    return project(weights, loadings, doc), loadings


def explained_by_top(bag: DataFrame, scores: DataFrame, n_objects: int) -> DataFrame:
    """(k, explained, cumulative): for the k best words (of equal scores the later first), the share of the total variance that their columns hold in all bands, and the summed scores; both scaled to 0..1.

    The bag has (object_id, param_id, band_idx, word, tf); variances count the
    implicit zeros.  A word's variance is summed over its bands before words
    are ordered, so what is ordered is one row for each word.
    """
    x = F.col("tf").cast("double")
    cells = bag.groupBy("param_id", "word", "band_idx").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    own = cells.groupBy("param_id", "word").agg(F.sum(F.col("q") / n_objects - (F.col("s") / n_objects) * (F.col("s") / n_objects)).alias("variance"))
    order = W.partitionBy().orderBy(F.desc(F.round("score", 9)), F.desc("param_id"), F.desc("word"))
    run = order.rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()
    rows = scores.join(own, ["param_id", "word"]).select(F.row_number().over(order).cast("long").alias("k"), F.sum("variance").over(run).alias("e"), F.sum("score").over(run).alias("c"))
    scaled = lambda x: (F.col(x) - F.min(x).over(every)) / F.nullif(F.max(x).over(every) - F.min(x).over(every), F.lit(0.0))
    return rows.select("k", scaled("e").alias("explained"), scaled("c").alias("cumulative"))


def with_metadata(features: DataFrame, metadata: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``features`` (object_id, ...) with columns of ``metadata`` appended; objects without metadata are left out, columns of the same name are replaced."""
    kept = features.drop(*columns)
    return kept.join(metadata.select("object_id", *columns), "object_id")


def without_metadata(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``features`` without metadata columns; such as are absent are passed over."""
    return features.drop(*columns)


def take_ranked(weights: DataFrame, ranking: DataFrame, n: int) -> DataFrame:
    """(row, rank, weight): the ``n`` best columns of a row table (row, feature, weight) in the order of ``ranking`` (feature, score), best first; ties by feature."""
    order = W.partitionBy().orderBy(F.desc("score"), "feature")
    best = ranking.orderBy(F.desc("score"), "feature").limit(n).withColumn("rank", F.row_number().over(order) - 1)
    return weights.join(F.broadcast(best.select("feature", "rank")), "feature").select("row", "rank", "weight")


def explained(scores: DataFrame) -> DataFrame:
    """(component, variance, cumulative, normalised): variances of components, summed in order, and scaled to 0..1."""
    var = scores.groupBy("component").agg(F.var_pop("score").alias("variance"))
    order = W.orderBy("component")
    rows = var.withColumn("cumulative", F.sum("variance").over(order.rowsBetween(W.unboundedPreceding, 0)))
    every = W.partitionBy()
    low, high = F.min("cumulative").over(every), F.max("cumulative").over(every)
    return rows.withColumn("normalised", (F.col("cumulative") - low) / F.nullif(high - low, F.lit(0.0)))


def pca(features: DataFrame, k: int, column: str = "features"):
    """Centred principal components of a vector column (fitted pipeline: scaler, then PCA)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler

    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol=column, outputCol="centred"), PCA(k=k, inputCol="centred", outputCol="components")]).fit(features)

