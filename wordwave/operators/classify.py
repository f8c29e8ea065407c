"""Prototypes, neighbours, boosted trees and their evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Prototypes whose norms (two numbers each) are broadcast; and query rows (whole vectors) that are at a time.
BROADCAST_PROTOTYPES, BROADCAST_QUERIES = 100_000, 20_000
#: Classes whose boosted trees are fitted at the same time.
CLASSES_AT_ONCE = 4


def centroids(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, feature, weight): class means, over all objects of a class, with or without features."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sums = weights.join(labels, "object_id").groupBy("label", "feature").agg(F.sum("weight").alias("s"))
    return sums.join(F.broadcast(sizes), "label").select("label", "feature", (F.col("s") / F.col("size")).alias("weight"))


def distances(queries: DataFrame, prototypes: DataFrame, key: str) -> DataFrame:
    """(object_id, key, distance): Euclidean distances of sparse rows, from norms and one inner-product join on the feature.

    Pairs without a common feature have no product; they are completed from
    the norms.  The prototypes' norms are broadcast up to BROADCAST_PROTOTYPES
    of them; beyond, norms are paired in blocks of partitions.
    """
    product = queries.join(prototypes.select(key, "feature", F.col("weight").alias("w")), "feature").groupBy("object_id", key).agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    q = queries.groupBy("object_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("qq"))
    p = prototypes.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("pp"))
    few = p.count() <= BROADCAST_PROTOTYPES
    pairs = q.crossJoin(F.broadcast(p) if few else p)  # every query with every prototype: what a complete comparison asks for
    square = F.col("qq") + F.col("pp") - 2 * F.coalesce("dot", F.lit(0.0))
    return pairs.join(product, ["object_id", key], "left").select("object_id", key, F.sqrt(F.greatest(square, F.lit(0.0))).alias("distance"))


def nearest(queries: DataFrame, prototypes: DataFrame, key: str = "label", digits: int = 9) -> DataFrame:
    """(object_id, pred, distance): the nearest prototype; distances equal to ``digits`` digits are ties, the smaller key wins."""
    d = distances(queries, prototypes, key)
    best = d.groupBy("object_id").agg(F.min(F.struct(F.round("distance", digits).alias("distance"), F.col(key).alias("pred"))).alias("b"))
    return best.select("object_id", "b.pred", "b.distance")


def k_nearest(features: DataFrame, train: DataFrame, k: int = 1, block: int = 512, skip_own: bool = False) -> DataFrame:
    """(object_id, pred): majority label of the ``k`` nearest of all rows of ``train`` (label, features, and object_id if it has one), however many; ties by distance, then label.

    With ``skip_own`` a row of the object itself is no neighbour.  Both sides are
    dealt into blocks of about ``block`` rows by a hash of the id; every pair of
    blocks gives its ``k`` nearest rows of each object, and of these the nearest
    count.  Blocks of queries are broadcast up to BROADCAST_QUERIES rows at a time.
    """
    if "object_id" not in train.columns:
        train = train.withColumn("object_id", F.xxhash64("label", "features"))
    pieces = 4 * train.sparkSession.sparkContext.defaultParallelism
    n_queries = features.count()

    def blocks(df, name, n, *columns):
        dealt = df.withColumn("block", F.pmod(F.xxhash64("object_id"), F.lit(-(-n // block) or 1))).repartition(pieces, "block")
        return dealt.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))

    id_type, label_type = features.schema["object_id"].dataType.simpleString(), train.schema["label"].dataType.simpleString()

    @F.arrow_udf(f"array<struct<object_id: {id_type}, d: double, label: {label_type}>>")
    def top(queries: pa.Array, rows: pa.Array) -> pa.Array:
        return pa.array([_top(q.values, r.values, k, skip_own) for q, r in zip(queries, rows, strict=True)])

    known = blocks(train, "rows", train.count(), "object_id", "features", "label").select("rows")
    asked = blocks(features, "queries", n_queries, "object_id", "features")
    rounds = -(-n_queries // BROADCAST_QUERIES) or 1
    parts = [known.crossJoin(F.broadcast(asked.where(F.pmod("block", F.lit(rounds)) == r).select("queries"))) for r in range(rounds)]
    paired = reduce(DataFrame.unionByName, parts)
    near = paired.select(F.explode(top("queries", "rows")).alias("x")).groupBy("x.object_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("x.d", "x.label"))), 1, k).alias("near"))
    return _majority(near.select("object_id", F.explode("near").alias("x")))


def k_nearest_others(features: DataFrame, train: DataFrame, k: int = 1, block: int = 512) -> DataFrame:
    """As :func:`k_nearest`, among all rows but the object itself."""
    return k_nearest(features, train, k, block, skip_own=True)


def _top(queries: pa.StructArray, rows: pa.StructArray, k: int, skip_own: bool) -> list[dict]:
    """The ``k`` nearest ``rows`` of each of ``queries``; by distance to nine digits, then label."""
    ids, others, labels = queries.field(0).to_pylist(), np.array(rows.field(0).to_pylist(), dtype=object), rows.field(2).to_pylist()
    order = np.unique(np.array(labels), return_inverse=True)[1]
    x, y = (a.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) for a in (queries, rows))
    found = []
    for own, f in zip(ids, x, strict=True):
        d = np.round(np.sqrt(((y - f) ** 2).sum(axis=1)), 9)
        same = others == own if skip_own else np.zeros(len(others), dtype=bool)
        best = [i for i in np.lexsort((order, d))[: k + int(same.sum())] if not same[i]][:k]
        found += [{"object_id": own, "d": float(d[i]), "label": labels[i]} for i in best]
    return found


def _majority(near: DataFrame) -> DataFrame:
    """(object_id, pred) from (object_id, x: d and label): the most frequent label; ties by distance, then label."""
    rows = near.groupBy("object_id", "x.label").agg(F.count(F.lit(1)).alias("votes"), F.min("x.d").alias("d"))
    best = rows.groupBy("object_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "d", "label")).alias("b"))
    return best.select("object_id", F.col("b.label").alias("pred"))


def column_moments(features: DataFrame) -> DataFrame:
    """One row: ``stats``, an array of (m, s), mean and population deviation of every place of dense arrays."""
    long = features.select(F.posexplode("features").alias("p", "v"))
    stats = long.groupBy("p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m", "s"))), lambda x: F.struct(x["m"].alias("m"), x["s"].alias("s"))).alias("stats"))


def standardise(features: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Dense arrays with each place centred and divided by its population deviation (0 stays 0), by their own moments or given ones."""
    out = features.crossJoin(F.broadcast(column_moments(features) if stats is None else stats))  # one row
    return out.withColumn("features", F.zip_with("features", "stats", lambda x, s: F.when(s["s"] > 0, (x - s["m"]) / s["s"]).otherwise(x - s["m"]))).drop("stats")


def normalise(features: DataFrame) -> DataFrame:
    """Dense arrays of unit length (zero rows stay)."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    return features.withColumn("norm", norm).withColumn("features", F.when(F.col("norm") > 0, F.transform("features", lambda x: x / F.col("norm"))).otherwise(F.col("features"))).drop("norm")


def confusion(predictions: DataFrame, known_below: int | None = None) -> DataFrame:
    """(label, pred, n, share): counts and row shares rounded to two digits; unknown true labels can be left out."""
    rows = predictions if known_below is None else predictions.where(F.col("label") < known_below)
    counts = rows.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("label")), 2))


def balanced_accuracy(predictions: DataFrame) -> DataFrame:
    """(balanced_accuracy): mean recall over the true classes."""
    recall = predictions.groupBy("label").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("r"))
    return recall.agg(F.avg("r").alias("balanced_accuracy"))


def boosted_trees(train: DataFrame, weight: str | None = None, rounds: int = 10, depth: int = 3, seed: int = 1):
    """One-against-rest gradient boosted trees on (features vector, label), optionally weighted; classes are fitted side by side."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest

    tree = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed)
    model = OneVsRest(classifier=tree, featuresCol="features", labelCol="label", parallelism=CLASSES_AT_ONCE)
    return model.setWeightCol(weight).fit(train) if weight else model.fit(train)


def class_weights(labels: DataFrame, mode: str = "flat") -> DataFrame:
    """(label, weight): the same for all rows ("none"), or the same total for every class ("flat")."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if mode == "none":
        return counts.select("label", F.lit(1.0).alias("weight"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return counts.join(F.broadcast(total), how="cross").select("label", (F.col("total") / F.col("k") / F.col("n")).alias("weight"))


def redshift_weights(metadata: DataFrame, bins: int = 10, low: float = 0.1, high: float = 3.0, least: int = 100) -> DataFrame:
    """(object_id, weight): inverse of the size of the object's redshift bin (evenly spaced in the logarithm), by survey; bins count ``least`` at least."""
    z = F.least(F.greatest(F.col("redshift"), F.lit(low)), F.lit(high))
    place = F.least(F.width_bucket(F.log(z), F.log(F.lit(low)), F.log(F.lit(high)), F.lit(bins)), F.lit(bins).cast("long"))
    rows = metadata.withColumn("bin", F.coalesce(place, F.lit(0).cast("long")))
    n = F.count(F.lit(1)).over(W.partitionBy("ddf", "bin"))
    return rows.select("object_id", (F.count(F.lit(1)).over(W.partitionBy("ddf")) / F.greatest(n, F.lit(least))).alias("weight"))


class KnnClassifier:
    """Nearest class mean, or nearest rows with unit length and scaling on request.

    Features are wide tables (object_id and numeric columns).  ``fit`` learns
    which columns hold a null or NaN and leaves these out, here and in
    ``predict``; scaling uses the moments of the training rows.
    """

    def __init__(self, prototype: bool = True, normalizer: bool = False, scaler: bool = False, k: int = 1):
        self.prototype, self.normalizer, self.scaler, self.k = prototype, normalizer, scaler, k
        self.columns: list[str] = []
        self.known: DataFrame | None = None
        self.stats: DataFrame | None = None

    @property
    def name(self) -> str:
        return "knn" + "".join(f"_{n}" for n in ("prototype", "normalizer", "scaler") if getattr(self, n))

    def _dense(self, features: DataFrame) -> DataFrame:
        rows = features.select("object_id", F.array(*(F.col(c).cast("double") for c in self.columns)).alias("features"))
        if self.prototype:
            return rows
        rows = normalise(rows) if self.normalizer else rows
        return standardise(rows, self.stats) if self.scaler and self.stats is not None else rows

    def fit(self, features: DataFrame, labels: DataFrame) -> KnnClassifier:
        """``labels`` has (object_id, label); objects without a label are left out."""
        from .workflow import drop_nan_columns

        labels = labels.select("object_id", "label")
        self.columns, self.stats = drop_nan_columns(features.drop("object_id"))[0], None
        known = self._dense(features).join(labels, "object_id")  # one array column: wide rows do not meet the join
        if self.prototype:
            long = known.select("label", F.posexplode("features").alias("p", "v")).groupBy("label", "p").agg(F.avg("v").alias("v"))
            known = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias("features"))
            known = known.select(F.col("label").cast("string").alias("object_id"), "label", "features")
        elif self.scaler:
            self.stats = column_moments(known)
            known = standardise(known, self.stats)
        self.known = known.select("object_id", "label", "features")
        return self

    def predict(self, features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """(object_id, pred), and the true label if ``labels`` are given."""
        rows = self._dense(features)
        known = self.known.withColumn("object_id", F.col("object_id").cast("string"))
        found = k_nearest(rows, known, 1 if self.prototype else self.k)
        return found if labels is None else labels.select("object_id", "label").join(found, "object_id")

    def save(self, path: str) -> None:
        """The fitted rows, with columns and settings beside each."""
        setting = F.lit(f"{self.prototype},{self.normalizer},{self.scaler},{self.k}")
        self.known.withColumn("columns", F.array(*(F.lit(c) for c in self.columns))).withColumn("setting", setting).write.mode("overwrite").parquet(f"{path}/known")
        if self.stats is not None:
            self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KnnClassifier:
        known = spark.read.parquet(f"{path}/known")
        row = known.select("columns", "setting").first()
        prototype, normalizer, scaler, k = row["setting"].split(",")
        out = KnnClassifier(prototype == "True", normalizer == "True", scaler == "True", int(k))
        out.columns, out.known = list(row["columns"]), known.select("object_id", "label", "features")
        out.stats = spark.read.parquet(f"{path}/stats") if out.scaler and not out.prototype else None
        return out
