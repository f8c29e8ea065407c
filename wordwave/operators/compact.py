"""Compact models: fitted tables that turn a bag into few features, and the older word builder."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import features
from .words import _moment, _trend, _variance, digitize, indexed, reduce_numerosity, single_segments


@dataclass
class CompactModel:
    """Weights and projection of a bag (object_id, param_id, band_idx, word, feature, tf).

    "LSA" drops features without variance, weights the rest and projects them
    on the leading singular directions; "MANOVA" keeps the best words in all
    bands and weights them.  What is fitted are tables; applying them are
    joins.
    """

    method: str
    scheme: str
    n_objects: int
    idf: DataFrame
    loadings: DataFrame | None = None

    @staticmethod
    def fit(bag: DataFrame, labels: DataFrame, method: str = "LSA", budget: int = 100, n_bands: int = 6, scheme: str = "ltc") -> CompactModel:
        n = labels.count()
        train = bag.join(labels.select("object_id"), "object_id", "left_semi")
        if method == "MANOVA":
            scores = features.manova_scores(train, labels, n_bands)
            kept = features.select_top(train, scores, max(1, budget // n_bands))
            return CompactModel(method, scheme, n, features.idf_table(kept, n))
        if method != "LSA":
            raise ValueError(f"unknown method: {method}")
        counts = features.drop_zero_variance(train.select("object_id", "feature", "tf"), n)
        idf = features.idf_table(counts, n)
        _, loadings = features.lsa(features.tfidf(counts, n, scheme, idf=idf), budget - 1)
        return CompactModel(method, scheme, n, idf, loadings)

    def transform(self, bag: DataFrame) -> DataFrame:
        """(object_id, component, score) for LSA, (object_id, feature, weight) for MANOVA.  Features that the fit left out are ignored."""
        known = bag.join(self.idf.select("feature"), "feature", "left_semi").select("object_id", "feature", "tf")
        weights = features.tfidf(known, self.n_objects, self.scheme, idf=self.idf)
        return features.project(weights, self.loadings) if self.loadings is not None else weights

    def save(self, path: str) -> None:
        self.idf.withColumn("method", F.lit(self.method)).withColumn("scheme", F.lit(self.scheme)).withColumn("n_objects", F.lit(self.n_objects)).write.mode("overwrite").parquet(f"{path}/idf")
        if self.loadings is not None:
            self.loadings.write.mode("overwrite").parquet(f"{path}/loadings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CompactModel:
        idf = spark.read.parquet(f"{path}/idf")
        row = idf.select("method", "scheme", "n_objects").first()
        loadings = spark.read.parquet(f"{path}/loadings") if row["method"] == "LSA" else None
        return CompactModel(row["method"], row["scheme"], row["n_objects"], idf.drop("method", "scheme", "n_objects"), loadings)


def wide(rows: DataFrame, n: int, prefix: str = "fea") -> DataFrame:
    """(object_id, fea1..feaN): one column for every component; absent ones are 0."""
    cells = (F.coalesce(F.max(F.when(F.col("component") == k, F.col("score"))), F.lit(0.0)).alias(f"{prefix}{k + 1}") for k in range(n))
    return rows.groupBy("object_id").agg(*cells)


def older_words(series: DataFrame, micros: int, wl: int, quantity: str, alphabet: int = 4, tol: int | None = None, threshold: int | None = None, handler: str = "#", normal: bool = True, num_reduction: bool = True) -> DataFrame:
    """(object_id, band, dir, pos, word): words of the older sliders and segmentator.

    One quantity (mean, trend, std or min_max).  For word length 1 moments and
    break points are those of the series, else of the window; mean break
    points are quantiles of a standard normal, or equal steps between the
    extremes.  Windows with more than ``word length - threshold`` empty segments
    are dropped (the default threshold is the word length).  With the handler
    "#" a segment that is empty or too short is a special character and the
    base is alphabet + 1; without one such windows are dropped.  Words of
    special characters alone count too.
    """
    tol = 2 * wl if tol is None else tol
    threshold = wl if threshold is None else threshold
    own = W.partitionBy("object_id", "band")
    point = F.struct("i", "tus", "value")
    rows = indexed(series).select(
        "*",
        F.min("tus").over(own).alias("t0"),
        F.max("tus").over(own).alias("t1"),
        *(f("value").over(own).alias(n) for n, f in (("low", F.min), ("high", F.max), ("mu", F.avg), ("sigma", F.stddev_pop))),
        F.collect_list(point).over(own.orderBy("tus").rangeBetween(0, micros)).alias("ahead"),
        F.collect_list(point).over(own.orderBy("tus").rangeBetween(-micros, 0)).alias("behind"),
    )
    # every row brings the slices of its own windows: no series is joined to its windows
    forward = F.when((F.col("i") < F.col("n") - 1) & (F.col("tus") + micros <= F.col("t1")), F.filter("ahead", lambda p: p["i"] >= F.col("i")))
    backward = F.when((F.col("i") > 1) & (F.col("tus") - micros >= F.col("t0")), F.filter("behind", lambda p: p["i"] < F.col("i")))
    windows = F.array(
        F.struct(F.lit(0).alias("dir"), F.col("i").alias("pos"), F.col("tus").alias("start"), forward.alias("p")),
        F.struct(F.lit(1).alias("dir"), (-F.col("i")).alias("pos"), (F.col("tus") - micros).alias("start"), backward.alias("p")),
    )
    rows = rows.select("object_id", "band", "low", "high", "mu", "sigma", F.explode(windows).alias("w")).where(F.size("w.p") > tol)
    rows = rows.select("object_id", "band", "w.dir", "w.pos", "w.start", F.transform("w.p", lambda x: x["tus"]).alias("ts"), F.transform("w.p", lambda x: x["value"]).alias("vs"), "low", "high", "mu", "sigma")
    rows = rows.withColumn("seg", single_segments(F.col("ts"), F.col("start"), micros, wl) if wl > 1 else F.array(F.struct(F.lit(0).alias("b"), F.size("ts").alias("e"))))
    if wl > 1:
        vs, n = F.col("vs"), F.size("vs").cast("double")
        rows = rows.withColumns({"low": F.array_min(vs), "high": F.array_max(vs), "mu": _moment(vs, lambda v: v) / n, "sigma": F.sqrt(_variance(vs))})
    rows = rows.where(F.size(F.filter("seg", lambda s: s["b"] < 0)) <= wl - threshold)
    points = _older_breaks(quantity, alphabet, normal)
    chars = F.transform("seg", lambda s: _older_character(s, quantity, points, alphabet))
    rows = rows.select("object_id", "band", "dir", "pos", chars.alias("chars"))
    if handler != "#":
        rows = rows.where(~F.exists("chars", lambda c: c == alphabet))
    base = float(alphabet + (handler == "#"))
    word = F.aggregate(F.transform("chars", lambda c, k: c.cast("long") * F.pow(F.lit(base), k).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    rows = rows.select("object_id", "band", F.lit(0).alias("param_id"), "dir", "pos", word.alias("word"))
    return (reduce_numerosity(rows) if num_reduction else rows).drop("param_id")


def _older_breaks(quantity: str, alphabet: int, normal: bool) -> list[Column]:
    steps = range(1, alphabet)
    if quantity == "mean" and normal:
        return [F.lit(NormalDist().inv_cdf(k / alphabet)) for k in steps]
    low, high = {
        "mean": (F.col("low"), F.col("high")),
        "trend": (F.lit(-1.5707963267948966), F.lit(1.5707963267948966)),
        "std": (F.lit(0.0), (F.col("high") - F.col("low")) / 2),
        "min_max": (F.lit(0.0), F.col("high") - F.col("low")),
    }[quantity]
    return [low + (high - low) * k / alphabet for k in steps]


def _older_character(s: Column, quantity: str, points: list[Column], alphabet: int) -> Column:
    ts, vs = F.slice("ts", s["b"] + 1, s["e"] - s["b"]), F.slice("vs", s["b"] + 1, s["e"] - s["b"])
    mean = lambda: _moment(vs, lambda v: v) / F.size(vs)
    x = {
        "mean": lambda: F.when(F.col("sigma") > 0, (mean() - F.col("mu")) / F.col("sigma")).otherwise(F.lit(0.0)),
        "trend": lambda: F.when(F.array_max(vs) > F.array_min(vs), _trend(ts, vs)).otherwise(F.lit(0.0)),
        "std": lambda: F.sqrt(_variance(vs)),
        "min_max": lambda: F.array_max(vs) - F.array_min(vs),
    }[quantity]()
    least = 1 if quantity == "mean" else 2
    digit = F.get(F.transform(F.array(F.round(x, 9)), lambda v: digitize(v, [F.round(b, 9) for b in points])), F.lit(0))
    return F.when((s["b"] >= 0) & (s["e"] - s["b"] >= least), digit).otherwise(F.lit(alphabet))
