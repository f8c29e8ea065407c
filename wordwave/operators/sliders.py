"""The older window sliders, segmentators and time aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.series import DAY
from .words import indexed


def two_way(series: DataFrame, micros: int, tol: int) -> DataFrame:
    """(object_id, band, dir, i, j): windows that fit inside the series; the forward ones keep their last point, the backward ones leave out their end."""
    own = W.partitionBy("object_id", "band")
    rows = indexed(series).select("*", F.min("tus").over(own).alias("t0"), F.max("tus").over(own).alias("t1"))
    timed = own.orderBy("tus")
    rows = rows.select("*", (F.max("i").over(timed.rangeBetween(0, micros)) + 1).alias("ahead"), F.min("i").over(timed.rangeBetween(-micros, 0)).alias("behind"))
    options = F.array(
        F.when((F.col("i") < F.col("n") - 1) & (F.col("tus") + micros <= F.col("t1")), F.struct(F.lit(0).alias("dir"), F.col("i").alias("i"), F.col("ahead").alias("j"))),
        F.when((F.col("i") > 1) & (F.col("tus") - micros >= F.col("t0")), F.struct(F.lit(1).alias("dir"), F.col("behind").alias("i"), F.col("i").alias("j"))),
    )
    return rows.select("object_id", "band", F.explode(options).alias("w")).where("w is not null").select("object_id", "band", "w.dir", "w.i", "w.j").where(F.col("j") - F.col("i") > tol)


def fixed_step(series: DataFrame, micros: int, step: int | None = None, overlapping: bool = True) -> DataFrame:
    """(object_id, band, k, i, j): windows at fixed steps of time; (-1, -1) where a window is empty.

    Without a step every point but the last starts a window (overlapping) or
    windows follow each other; with one, overlapping windows step by step plus
    width.
    """
    if step is None and overlapping:
        rows = indexed(series)
        ahead = W.partitionBy("object_id", "band").orderBy("tus").rangeBetween(0, micros)
        first = W.partitionBy("object_id", "band").orderBy("tus").rangeBetween(0, 0)
        return rows.select("object_id", "band", "n", F.col("i").alias("k"), F.min("i").over(first).alias("i"), (F.max("i").over(ahead) + 1).alias("j")).where("k < n - 1").drop("n")
    step = micros if step is None else step + micros if overlapping else step
    ends = series.groupBy("object_id", "band").agg(F.array_sort(F.collect_list("tus")).alias("ts"))
    first = F.get("ts", F.lit(0))
    count = F.floor((F.element_at("ts", -1) - first) / step).cast("int")
    starts = ends.where(count > 0).select("object_id", "band", "ts", F.explode(F.sequence(F.lit(0), count - 1)).alias("k")).withColumn("start", F.get("ts", F.lit(0)) + F.col("k").cast("long") * step)
    i = F.size(F.filter("ts", lambda t: t < F.col("start")))
    j = F.size(F.filter("ts", lambda t: t <= F.col("start") + micros))
    return starts.select("object_id", "band", F.col("k").cast("long").alias("k"), F.when(i >= j, -1).otherwise(i).cast("long").alias("i"), F.when(i >= j, -1).otherwise(j).cast("long").alias("j"))


def by_index(series: DataFrame, width: int, step: int = 1) -> DataFrame:
    """(object_id, band, k, i, j): windows of ``width`` points at every ``step``-th place; ends are not clipped."""
    n = F.floor(F.count(F.lit(1)) / step).cast("int")
    counts = series.groupBy("object_id", "band").agg(n.alias("n")).where("n > 0")
    return counts.select("object_id", "band", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select("object_id", "band", F.col("k").cast("long").alias("k"), (F.col("k") * step).cast("long").alias("i"), (F.col("k") * step + width).cast("long").alias("j"))


def index_segments(windows: DataFrame, k: int) -> DataFrame:
    """Splits windows [i, j) into ``k`` segments of equal size; the rest of the division is left out."""
    size = F.lit(1) if k < 1 else F.floor((F.col("j") - F.col("i")) / k)
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("i").alias("b"), F.col("j").alias("e")))
    parts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.struct(s.alias("s"), (F.col("i") + s * size).alias("b"), (F.col("i") + (s + 1) * size).alias("e")))
    return windows.select("*", F.explode(whole if k == 1 else parts).alias("p")).select(*windows.columns, F.col("p.s").cast("long").alias("segment"), F.col("p.b").cast("long").alias("b"), F.col("p.e").cast("long").alias("e"))


def tumbling_time(series: DataFrame, micros: int) -> DataFrame:
    """(object_id, band, bucket, n, mean, slope): tumbling buckets of time from the first observation; gaps keep their row with n = 0.

    Slopes are per day, 0 for a single point or unvarying time.
    """
    start = F.min("tus").over(W.partitionBy("object_id", "band"))
    rows = series.withColumn("rel", F.col("tus") - start).withColumn("bucket", F.floor(F.col("rel") / micros))
    days = F.col("rel").cast("double") / float(DAY)
    got = rows.groupBy("object_id", "band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.regr_slope("value", days), F.lit(0.0)).alias("slope"))
    last = rows.groupBy("object_id", "band").agg(F.max("rel").alias("last"))
    # a bucket is opened while it begins before the last observation
    every = last.where("last > 0").select("object_id", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / micros))).alias("bucket"))
    return every.join(got, ["object_id", "band", "bucket"], "left").select("object_id", "band", "bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean", "slope")


def tumbling_observed(series: DataFrame, micros: int, threshold: int = 2) -> DataFrame:
    """(object_id, band, start, n, mean, slope): tumbling windows that open at an observation.

    The first opens at the first observation; each closes before the first
    point later than start + width, where the next opens.  The series' last
    point belongs to no window; windows with fewer than ``threshold`` points are
    not reported.  Every window depends on the one before it, so the openings
    are found in one pass over sorted points, which holds a batch at a time and
    never a whole series.
    """
    rows = series.select("object_id", "band", "tus", "ord", "value").repartition("object_id", "band").sortWithinPartitions("object_id", "band", "tus", "ord")

    def opened(batches):
        held = None  # the last row so far, which counts only if its series goes on
        zero = open_ = 0
        for batch in batches:
            frame = batch.to_pandas()
            goes_on = held is not None
            if goes_on:
                frame = pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            keys = frame[["object_id", "band"]]
            cuts = [0, *np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())[1:], len(frame)]
            t, begin = frame["tus"].to_numpy(), np.empty(len(frame), dtype=np.int64)
            zeros, ends = np.empty(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=bool)
            for a, b in zip(cuts, cuts[1:]):
                if a or not goes_on:
                    zero = open_ = int(t[a])
                zeros[a:b], ends[b - 1], at = zero, True, a
                while at < b:
                    to = int(np.searchsorted(t[at:b], open_ + micros, side="right")) + at
                    begin[at:to] = open_
                    at = to
                    if at < b - (b == len(frame)):
                        open_ = int(t[at])
                    elif at < b:  # the held row opens its window when it comes again
                        break
            held = frame.iloc[len(frame) - 1 :]
            keep = np.flatnonzero(~ends)
            yield pa.RecordBatch.from_pydict(
                {
                    "object_id": pa.array(frame["object_id"].to_numpy()[keep], pa.string()),
                    "band": pa.array(frame["band"].to_numpy()[keep], pa.string()),
                    "start": begin[keep] - zeros[keep],
                    "days": (t[keep] - zeros[keep]) / float(DAY),
                    "value": frame["value"].to_numpy()[keep],
                }
            )

    points = rows.mapInArrow(opened, "object_id string, band string, start long, days double, value double")
    got = points.groupBy("object_id", "band", "start").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.regr_slope("value", "days"), F.lit(0.0)).alias("slope"))
    return got.where(F.col("n") >= threshold)


def interpolate_gaps(series: DataFrame, micros: int) -> DataFrame:
    """Adds three evenly spaced, linearly interpolated points to every empty tumbling bucket between two observations.

    ``interpolated`` marks them.  A bucket is empty where a point and the next
    one lie more than a bucket apart, so both ends are at hand in one row.
    """
    own = W.partitionBy("object_id", "band")
    order = own.orderBy("tus", "ord")
    zero = F.min("tus").over(own)
    rows = series.select("object_id", "band", "tus", "value", zero.alias("zero"), F.lead("tus").over(order).alias("t2"), F.lead("value").over(order).alias("v2"))
    bucket = lambda t: F.floor((F.col(t) - F.col("zero")) / micros)
    between = rows.where("t2 is not null").withColumns({"b": bucket("tus"), "b2": bucket("t2")}).where("b2 > b + 1")
    made = between.withColumn("k", F.explode(F.sequence(F.col("b") + 1, F.col("b2") - 1))).withColumn("part", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0)))))
    at = (F.col("zero") + ((F.col("k") + F.col("part")) * micros).cast("long")).alias("tus")
    made = made.select("object_id", "band", at, (F.col("value") + (F.col("v2") - F.col("value")) * (at - F.col("tus")) / (F.col("t2") - F.col("tus"))).alias("value"), F.lit(True).alias("interpolated"))
    return series.select("object_id", "band", "tus", "value", F.lit(False).alias("interpolated")).unionByName(made)
