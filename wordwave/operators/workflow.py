"""Folds, samples, augmentation caps, dataset profiles and search summaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(*parts: Column | str, seed: int = 1) -> Column:
    """A number in [0, 1) from an md5 of the seed and the parts: the same on every engine and partitioning."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def stratified_folds(metadata: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """(object_id, label, fold): objects without a reference are dealt out by class; the others take their reference's fold."""
    own = W.partitionBy("label").orderBy(uniform("object_id", seed=seed), "object_id")
    base = metadata.where("reference_object_id is null").select("object_id", "label", ((F.row_number().over(own) - 1) % k).alias("fold"))
    source = base.select(F.col("object_id").alias("source"), "fold")
    keyed = metadata.withColumn("source", F.coalesce("reference_object_id", "object_id"))
    return keyed.join(source, "source", "left").select("object_id", "label", "fold")


def fold_split(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a fold."""
    return folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)


def train_test(metadata: DataFrame, share: float | Decimal, seed: int = 1) -> DataFrame:
    """(object_id, label, part): the first ``share`` of every class, in hashed order, is "train".

    A Decimal is an exact share; that of a float can fall just below a whole
    number (0.7 of 90 is 62.99...), and floors to one less.
    """
    own = W.partitionBy("label").orderBy(uniform("object_id", seed=seed), "object_id")
    size = F.count(F.lit(1)).over(W.partitionBy("label"))
    return metadata.select("object_id", "label", F.when(F.row_number().over(own) <= F.floor(size * share), "train").otherwise("test").alias("part"))


def two_stage_split(metadata: DataFrame, n_train: int, n_test: int, seed: int = 1) -> DataFrame:
    """(object_id, label, part): a stratified draw of about ``n_train + n_test`` objects, split by class into "train" and "test".

    The first stage is passed over where that would take all but a few objects
    (fewer left than classes).  Shares of a class are floored.
    """
    n, classes = metadata.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    drawn = metadata
    if n_train + n_test < n - classes:
        drawn = metadata.join(train_test(metadata, (n_train + n_test) / n, seed).where("part = 'train'").select("object_id"), "object_id", "left_semi")
    return train_test(drawn, n_train / (n_train + n_test), seed + 1)


def generated_sets(metadata: DataFrame, detections: DataFrame, least: int, sizes: Sequence[float], seed: int = 1) -> DataFrame:
    """(object_id, label, size): nested stratified training sets, one for every share in ``sizes``, of the originals with more than ``least`` detections.

    An object is in every set whose floored share of its class reaches its hashed place.
    """
    rows = metadata.join(detections, "object_id", "left").where((F.coalesce("detections", F.lit(0)) > least) & F.col("reference_object_id").isNull())
    own = W.partitionBy("label").orderBy(uniform("object_id", seed=seed), "object_id")
    rows = rows.select("object_id", "label", F.row_number().over(own).alias("place"), F.count(F.lit(1)).over(W.partitionBy("label")).alias("n"))
    every = F.explode(F.array(*(F.lit(float(s)) for s in sizes)))
    return rows.withColumn("size", every).where(F.col("place") <= F.floor(F.col("n") * F.col("size"))).select("object_id", "label", "size")


def best_increments(results: DataFrame, score: str = "cv_mean") -> DataFrame:
    """(wl, win, score, top): the best window of every word length (ties: the smaller), and whether no other word length does better."""
    order = W.partitionBy("wl").orderBy(F.desc(score), "win")
    best = results.withColumn("r", F.row_number().over(order)).where("r = 1").select("wl", "win", F.col(score).alias("score"))
    return best.withColumn("top", F.col("score") == F.max("score").over(W.partitionBy()))


def time_per_object(records: DataFrame) -> DataFrame:
    """(objects, points, mean, std): of (points, seconds) of every object, mean and population deviation of the seconds."""
    return records.agg(F.count(F.lit(1)).alias("objects"), F.sum("points").alias("points"), F.avg("seconds").alias("mean"), F.stddev_pop("seconds").alias("std"))


def sample_per_class(metadata: DataFrame, n: int, seed: int = 1, label: str = "label") -> DataFrame:
    """``n`` objects of every class, in hashed order, without replacement."""
    own = W.partitionBy(label).orderBy(uniform("object_id", seed=seed), "object_id")
    return metadata.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= n).drop("rank")


def cap_augmentations(metadata: DataFrame, detections: DataFrame, least: int, cap: int) -> DataFrame:
    """Originals, and up to ``cap`` augmentations of each reference, that have more than ``least`` detections (originals stay)."""
    rows = metadata.join(detections, "object_id", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))
    original = F.col("reference_object_id").isNull()
    rows = rows.where(original | (F.col("detections") > least))
    order = W.partitionBy("reference_object_id").orderBy("object_id")
    return rows.withColumn("rank", F.when(original, 0).otherwise(F.row_number().over(order))).where(F.col("rank") <= cap).drop("rank")


def cap_by_class(metadata: DataFrame, detections: DataFrame, least: int, total: int) -> DataFrame:
    """As :func:`cap_augmentations`, originals filtered too, with a cap of ``total // selected originals`` for each class."""
    rows = metadata.join(detections, "object_id", "left").where(F.coalesce("detections", F.lit(0)) > least)
    caps = rows.where("reference_object_id is null").groupBy("label").agg(F.floor(F.lit(total) / F.count(F.lit(1))).alias("cap"))
    known = rows.where("reference_object_id is null").select(F.col("object_id").alias("reference_object_id"))
    order = W.partitionBy("reference_object_id").orderBy("object_id")
    added = rows.join(known, "reference_object_id", "left_semi").withColumn("rank", F.row_number().over(order)).join(F.broadcast(caps), "label").where("rank <= cap").drop("rank", "cap")
    return rows.where("reference_object_id is null").unionByName(added.select(*rows.columns))


def bias_filter(metadata: DataFrame, biased: int = 90, inverse: bool = False, seed: int = 1) -> DataFrame:
    """Keeps augmentations of the biased class with probability exp(-z) (or exp(z) - 1), and all other rows."""
    chance = F.exp(F.col("redshift")) - 1 if inverse else F.exp(-F.col("redshift"))
    return metadata.where((F.col("label") != biased) | F.col("reference_object_id").isNull() | (uniform("object_id", seed=seed) < chance))


def erf(x: Column) -> Column:
    """The error function: its series within 3, the continued fraction of the complement beyond (1e-14 and better)."""
    y = F.least(F.abs(x), F.lit(7.0))
    term, total = y, y
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(term.alias("term"), total.alias("total")),
        lambda acc, n: F.struct((acc["term"] * 2 * y * y / (2 * n + 1)).alias("term"), (acc["total"] + acc["term"] * 2 * y * y / (2 * n + 1)).alias("total")),
        lambda acc: acc["total"] * F.exp(-y * y) * (2 / math.sqrt(math.pi)),
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), y, lambda acc, n: y + n / (2 * acc))
    value = F.when(y < 3, series).otherwise(1 - F.exp(-y * y) / math.sqrt(math.pi) / fraction)
    return F.when(x < 0, -value).otherwise(value)


def detection_filter(observations: DataFrame, least: int = 2, seed: int = 1, originals: DataFrame | None = None) -> DataFrame:
    """(object_id, detections, passes): simulated detections against the survey's efficiency curve.

    A point is detected when a hashed uniform falls below
    (erf((|flux| / error - 5.5) / 2) + 1) / 2.  ``least`` is the threshold; with
    ``originals`` (object_id, least) that of an object is its original's own
    count, ``least`` where it has none.
    """
    chance = (erf((F.abs("flux") / F.col("flux_error") - 5.5) / 2) + 1) / 2
    rows = observations.withColumn("hit", uniform("object_id", "ord", seed=seed) < chance)
    got = rows.groupBy("object_id").agg(F.sum(F.col("hit").cast("long")).alias("detections"))
    if originals is None:
        return got.withColumn("passes", F.col("detections") >= least)
    own = originals.select("object_id", F.col("least").alias("own_least"))
    return got.join(own, "object_id", "left").withColumn("passes", F.col("detections") >= F.coalesce("own_least", F.lit(least))).drop("own_least")


def profile(series: DataFrame) -> DataFrame:
    """(object_id, n, duration, mean, std) of every object."""
    return series.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("duration"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def dataset_scalars(series: DataFrame) -> DataFrame:
    """One row: twice the mean length (floored), mean and deviation of durations, and the widest window (mean plus deviation)."""
    p = profile(series)
    out = p.agg(F.floor(F.avg(2 * F.col("n"))).alias("budget"), F.avg("duration").alias("mean_duration"), F.stddev_pop("duration").alias("std_duration"))
    return out.withColumn("max_window", F.col("mean_duration") + F.col("std_duration"))


def intervals(series: DataFrame) -> DataFrame:
    """(object_id, band, ord, gap): days since the point before."""
    order = W.partitionBy("object_id", "band").orderBy("tus", "ord")
    return series.withColumn("gap", (F.col("tus") - F.lag("tus").over(order)) / 86_400_000_000.0).where("gap is not null").select("object_id", "band", "ord", "gap")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, n): equal bins; the upper edge belongs to the last bin, values outside are left out."""
    x = F.col(column)
    bucket = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where((x >= low) & (x <= high)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, low, q1, median, q3, high) with linear interpolation."""
    p = F.percentile(column, F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(key).agg(p.alias("p")).select(key, *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))


def increasing_times(series: DataFrame) -> DataFrame:
    """(object_id, band, increasing): whether times strictly increase."""
    order = W.partitionBy("object_id", "band").orderBy("tus", "ord")
    rows = series.withColumn("step", F.col("tus") - F.lag("tus").over(order))
    return rows.groupBy("object_id", "band").agg((~F.max(F.coalesce(F.col("step") <= 0, F.lit(False)))).alias("increasing"))


def drop_nan_columns(train: DataFrame, others: Sequence[DataFrame] = ()) -> tuple[list[str], list[DataFrame]]:
    """Columns without a null or NaN in ``train``, and the tables reduced to them."""
    numeric = {f.name for f in train.schema.fields if f.dataType.typeName() in ("double", "float")}
    bad = train.agg(*(F.max((F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False))).cast("int")).alias(c) for c in train.columns)).first()
    kept = [c for c in train.columns if not bad[c]]
    return kept, [df.select(*kept) for df in (train, *others)]


def best_per_quantity(results: DataFrame, top: int | None = None) -> DataFrame:
    """The row with the highest cv_mean for every quantity (ties: smaller win, then wl), best first."""
    order = W.partitionBy("quantity").orderBy(F.desc("cv_mean"), "win", "wl")
    best = results.where("valid_cv").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").orderBy(F.desc("cv_mean"), "quantity")
    return best.limit(top) if top else best


def best_per_size(results: DataFrame) -> DataFrame:
    """The best row for every number of fused groups, but for the largest number."""
    rows = results.where("valid_cv").withColumn("count_qs", F.size(F.split("quantity", "-")))
    order = W.partitionBy("count_qs").orderBy(F.desc("cv_mean"), "quantity", "win", "wl")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") == 1).withColumn("last", F.max("count_qs").over(W.partitionBy())).where("count_qs < last").drop("r", "last")


def group_max(df: DataFrame, key: str, column: str) -> DataFrame:
    """All rows that reach their group's maximum (ties stay)."""
    return df.withColumn("top", F.max(column).over(W.partitionBy(key))).where(F.col(column) == F.col("top")).drop("top")


def valid_representation(n_objects: int, n_dropped: int, most: float = 0.05) -> bool:
    """Whether few enough objects are without any word."""
    return n_objects > 0 and n_dropped / n_objects <= most


def greedy_stack(candidates: Sequence, evaluate: Callable[[tuple], float], top_k: int = 4, most: int = 4, gain: float = 0.01) -> list[tuple[tuple, float]]:
    """Forward search: from each of the ``top_k`` best single candidates, adds the one that scores best while that gains ``gain``.

    ``evaluate`` scores a tuple of candidates (a Spark job over a cached bag);
    the loop itself only handles scores.
    """
    singles = sorted(((evaluate((c,)), i, c) for i, c in enumerate(candidates)), key=lambda x: (-x[0], x[1]))
    found = []
    for score, _, first in singles[:top_k]:
        stack, best = (first,), score
        while len(stack) < most:
            scored = [(evaluate((*stack, c)), -i, c) for i, c in enumerate(candidates) if c not in stack]
            if not scored:
                break
            new, _, c = max(scored, key=lambda x: x[:2])
            if new - best < gain:
                break
            stack, best = (*stack, c), new
        found.append((stack, best))
    return found


def fused_expansions(selected: Sequence[tuple[str, ...]], singles: Sequence[str]) -> list[tuple[str, ...]]:
    """Every selected group with one more quantity, without repeats in any order."""
    seen: set[frozenset] = set()
    out = []
    for group in selected:
        for q in singles:
            key = frozenset((*group, q))
            if q not in group and key not in seen:
                seen.add(key)
                out.append((*group, q))
    return out
