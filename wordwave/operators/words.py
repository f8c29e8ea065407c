"""Windows, segments, quantities, words and bags.

One shuffle does it all: rows are clustered by (object, band); window frames
hand every row its forward and backward slices; array functions segment and
summarise each slice; the numerosity filter and the bag count use keys that
begin with (object, band), so they need no further exchange.

Slices are 0-based ``[i, j)`` over the series sorted by (time, ord).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.series import DAY

#: Interior break points of a standard normal for 4 and 6 bins (fixed values).
NORMAL_BREAKS = {4: (-0.67, 0.0, 0.67), 6: (-0.967, -0.43, 0.0, 0.43, 0.967)}

#: Quantities whose sums depend on their order: rounded to nine digits, as their break points are, before they are digitized.
TIED = ("mean", "trend", "std", "var")


@dataclass(frozen=True)
class Param:
    """One representation: a window of ``days``, a word length and a fused group of quantities."""

    days: float
    word_length: int
    quantities: tuple[str, ...]
    alphabets: tuple[int, ...] = ()

    @property
    def micros(self) -> int:
        return round(self.days * DAY)

    @property
    def bins(self) -> tuple[int, ...]:
        return self.alphabets or (4,) * len(self.quantities)

    @property
    def tol(self) -> int:
        return 2 * self.word_length

    @property
    def characters(self) -> int:
        """Characters without the special one."""
        return math.prod(self.bins)

    @property
    def words(self) -> int:
        return (self.characters + 1) ** self.word_length


def indexed(series: DataFrame) -> DataFrame:
    """Adds ``i`` (0-based place) and ``n`` (length) within (object, band)."""
    own = W.partitionBy("object_id", "band")
    return series.withColumn("i", (F.row_number().over(own.orderBy("tus", "ord")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(own).cast("long"))


def forward_windows(series: DataFrame, micros: int, tol: int) -> DataFrame:
    """(object_id, band, i, j): for every start i the points within the window, the last one left out unless the series ends there."""
    ahead = W.partitionBy("object_id", "band").orderBy("tus").rangeBetween(0, micros)
    last = F.max("i").over(ahead)
    rows = indexed(series).withColumn("last", last).where("i <= n - 2")
    return rows.select("object_id", "band", "i", F.when(F.col("last") == F.col("n") - 1, F.col("n")).otherwise(F.col("last")).alias("j")).where(F.col("j") - F.col("i") > tol)


def backward_windows(series: DataFrame, micros: int, tol: int) -> DataFrame:
    """(object_id, band, i, j): for every end point the points within the window before it; place 0 joins when place 1 is the first."""
    behind = W.partitionBy("object_id", "band").orderBy("tus").rangeBetween(-micros, 0)
    rows = indexed(series).withColumn("f", F.min("i").over(behind)).where("i >= 2")
    rows = rows.select("object_id", "band", F.when(F.col("f") >= 2, F.col("f")).otherwise(F.lit(0)).cast("long").alias("b"), F.col("i").alias("e"))
    return rows.where(F.col("e") - F.col("b") > tol).select("object_id", "band", F.col("b").alias("i"), (F.col("e") + 1).alias("j"))


#: Running sums that a point carries: of values, squares, times, squared times and products (shifted to the series' begin and lowest value).
_SUMS = ("sv", "svv", "st", "stt", "stv")


def _points(series: DataFrame, widths: Sequence[int], sums: bool = False) -> DataFrame:
    """Per row, per window width: struct of forward and backward slices (arrays of points), and the series' extremes."""
    own = W.partitionBy("object_id", "band")
    rows = indexed(series)
    if sums:
        run = own.orderBy("i").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("v_", F.col("value") - F.min("value").over(own)).withColumn("t_", (F.col("tus") - F.min("tus").over(own)).cast("double") / float(DAY))
        v, t = F.col("v_"), F.col("t_")
        rows = rows.withColumns({n: F.sum(x).over(run) for n, x in zip(_SUMS, (v, v * v, t, t * t, t * v), strict=True)})
    carried = ("v_", "t_", *_SUMS) if sums else ()
    point = F.struct("tus", "value", "i", *carried)
    rows = rows.select("object_id", "band", "band_idx", "tus", "value", "i", "n", *carried, F.min("value").over(own).alias("low"), F.max("value").over(own).alias("high"), F.min(F.struct("i", point.alias("p"))).over(own).getField("p").alias("origin"))
    columns = []
    for k, width in enumerate(widths):
        ahead, behind = own.orderBy("tus").rangeBetween(0, width), own.orderBy("tus").rangeBetween(-width, 0)
        columns += [F.collect_list(point).over(ahead).alias(f"ahead{k}"), F.collect_list(point).over(behind).alias(f"behind{k}")]
    rows = rows.select("*", *columns)
    for k in range(len(widths)):
        rest = F.filter(F.col(f"ahead{k}"), lambda p: p["i"] >= F.col("i"))
        ends = F.element_at(rest, -1)["i"] == F.col("n") - 1
        forward = F.when(F.col("i") <= F.col("n") - 2, F.when(ends, rest).otherwise(F.slice(rest, F.lit(1), F.greatest(F.size(rest) - 1, F.lit(0)))))
        mine = F.filter(F.col(f"behind{k}"), lambda p: p["i"] <= F.col("i"))
        backward = F.when(F.col("i") >= 2, F.when(F.get(mine, F.lit(0))["i"] == 1, F.concat(F.array("origin"), mine)).otherwise(mine))
        rows = rows.withColumn(f"slices{k}", F.array(F.struct(F.lit(0).alias("dir"), forward.alias("s")), F.struct(F.lit(1).alias("dir"), backward.alias("s"))))
    return rows.drop(*(f"{x}{k}" for k in range(len(widths)) for x in ("ahead", "behind")), "origin", "tus", "value", *carried)


def windows(series: DataFrame, params: Sequence[Param]) -> DataFrame:
    """(object_id, band, band_idx, res_id, wl, micros, dir, pos, i, j, w_end, ts, vs, len, low, high): kept windows of every (days, word length).

    ``dir`` 0 is forward, 1 backward; ``pos`` orders windows (forward by start,
    then backward by end, descending); ``ts`` and ``vs`` hold the slice's points;
    ``len``, ``low`` and ``high`` are the length and extremes that break points
    use: of the series for word length 1, else of the slice.  Parameters that share a window share it here
    too: ``res_id`` is the place of (days, word length) among the distinct ones.
    """
    widths = sorted({p.micros for p in params})
    resolutions = list(dict.fromkeys((p.micros, p.word_length) for p in params))
    rows = _points(series, widths, sums=any(q in TIED for p in params for q in p.quantities))
    options = F.array(*(F.struct(F.lit(r).alias("res_id"), F.lit(wl).alias("wl"), F.lit(m).alias("micros"), F.col(f"slices{widths.index(m)}").alias("slices")) for r, (m, wl) in enumerate(resolutions)))
    rows = rows.select("object_id", "band", "band_idx", "i", "n", "low", "high", F.explode(options).alias("o"))
    rows = rows.select("object_id", "band", "band_idx", F.col("i").alias("at"), "n", "low", "high", "o.res_id", "o.wl", "o.micros", F.explode("o.slices").alias("w"))
    size = F.size("w.s")
    # a backward window is kept by the points before its end
    rows = rows.where(F.col("w.s").isNotNull() & (size - F.col("w.dir") > 2 * F.col("wl")))
    values = F.transform("w.s", lambda p: p["value"])
    return rows.select(
        "object_id",
        "band",
        "band_idx",
        "res_id",
        "wl",
        "micros",
        F.col("w.dir").alias("dir"),
        F.when(F.col("w.dir") == 0, F.col("at")).otherwise(-F.col("at")).alias("pos"),
        F.get("w.s", F.lit(0))["i"].alias("i"),
        (F.get("w.s", F.lit(0))["i"] + size).alias("j"),
        F.when(F.col("w.dir") == 0, F.get("w.s", F.lit(0))["tus"] + F.col("micros")).otherwise(F.element_at("w.s", -1)["tus"]).alias("w_end"),
        F.transform("w.s", lambda p: p["tus"]).alias("ts"),
        values.alias("vs"),
        F.col("w.s").alias("ps"),
        F.when(F.col("wl") == 1, F.col("n")).otherwise(size).cast("double").alias("len"),
        F.when(F.col("wl") == 1, F.col("low")).otherwise(F.array_min(values)).alias("low"),
        F.when(F.col("wl") == 1, F.col("high")).otherwise(F.array_max(values)).alias("high"),
    )


def _below(ts: Column, bound: Column) -> Column:
    return F.size(F.filter(ts, lambda t: t < bound))


def _up_to(ts: Column, bound: Column) -> Column:
    return F.size(F.filter(ts, lambda t: t <= bound))


def backward_bounds(ts: Column, end: Column, micros: int, wl: int) -> Column:
    """array<struct<g, h>>: for every sub-window, latest first, the points before its begin and up to its end."""
    sub = float(micros) / wl
    return F.array(*(F.struct(_below(ts, end.cast("double") - (k + 1) * sub).alias("g"), _up_to(ts, end.cast("double") - k * sub).alias("h")) for k in range(wl)))


def backward_segments(ts: Column, end: Column, micros: int, wl: int, bounds: Column) -> Column:
    """array<struct<b, e>>: sub-windows of a backward window, latest first; (-1, -1) where empty.

    ``bounds`` is the column of :func:`backward_bounds`, computed in a
    projection of its own, so that each count is made once.
    """
    sub, last, out = float(micros) / wl, F.size(ts) - 1, []
    begins = [F.greatest(bounds[k]["g"], F.lit(1)) for k in range(wl)]
    for k in range(wl):
        a, b = end.cast("double") - (k + 1) * sub, end.cast("double") - k * sub
        stop = F.greatest(F.lit(1), F.least(bounds[k]["h"] - 1, begins[k - 1] if k else last))
        first, edge = F.get(ts, begins[k]), F.get(ts, stop)
        valid = F.coalesce((b > first) & (first >= a) & (b >= edge) & (edge > a), F.lit(False))
        out.append(F.when(valid, F.struct(begins[k].alias("b"), stop.alias("e"))).otherwise(F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("e"))))
    return F.array(*out)


def single_segments(ts: Column, start: Column, micros: int, wl: int) -> Column:
    """Sub-windows of a window that begins at ``start``, earliest first: the single segmentator."""
    sub, m = float(micros) / wl, F.size(ts)
    previous, best, out = F.lit(0), F.lit(0), []
    for k in range(wl):
        a, b = start.cast("double") + k * sub, start.cast("double") + (k + 1) * sub
        g, h = _below(ts, a), _up_to(ts, b) - 1
        begin = F.when(previous == m, previous).otherwise(F.greatest(previous, F.least(g, m - 1)))
        stop = F.greatest(best, h + 1)
        empty = (begin == m) | F.coalesce(F.get(ts, begin) >= b, F.lit(True)) | F.coalesce(F.get(ts, stop - 1) < a, F.lit(True))
        out.append(F.when(empty, F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("e"))).otherwise(F.struct(begin.alias("b"), stop.alias("e"))))
        previous = best = stop
    return F.array(*out)


def _moment(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v))


def _trend(ts: Column, vs: Column) -> Column:
    """Angle of the least-squares slope per day; a right angle where time does not vary.

    One fold over the points sums deviations from the first point.
    """
    t0, v0, n = F.get(ts, F.lit(0)), F.get(vs, F.lit(0)), F.size(vs).cast("double")
    pairs = F.arrays_zip(ts.alias("t"), vs.alias("v"))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("t", "v", "tt", "tv")))

    def add(acc, x):
        t, v = (x["t"] - t0).cast("double") / float(DAY), x["v"] - v0
        return F.struct((acc["t"] + t).alias("t"), (acc["v"] + v).alias("v"), (acc["tt"] + t * t).alias("tt"), (acc["tv"] + t * v).alias("tv"))

    def finish(acc):
        spread = n * acc["tt"] - acc["t"] * acc["t"]
        return F.when(F.element_at(ts, -1) > t0, F.atan((n * acc["tv"] - acc["t"] * acc["v"]) / spread)).otherwise(F.lit(math.pi / 2))

    return F.aggregate(pairs, zero, add, finish)


def _variance(vs: Column) -> Column:
    """Population variance by one fold over deviations from the first value."""
    v0, n = F.get(vs, F.lit(0)), F.size(vs).cast("double")
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("vv"))
    add = lambda acc, x: F.struct((acc["v"] + (x - v0)).alias("v"), (acc["vv"] + (x - v0) * (x - v0)).alias("vv"))
    return F.aggregate(vs, zero, add, lambda acc: F.greatest(acc["vv"] / n - (acc["v"] / n) * (acc["v"] / n), F.lit(0.0)))


def _mean(vs: Column, whole: Column, sigma: str) -> Column:
    n = F.size(whole).cast("double")
    zero = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("vv"))
    add = lambda acc, x: F.struct((acc["v"] + x).alias("v"), (acc["vv"] + x * x).alias("vv"))

    def finish(acc):
        mu, square = acc["v"] / n, acc["vv"] / n
        spread = F.sqrt(F.abs(square * square - mu * mu)) if sigma == "coded" else F.sqrt(F.abs(square - mu * mu))
        return F.when(spread > 0, (_moment(vs, lambda v: v) / F.size(vs) - mu) / spread).otherwise(F.lit(0.0))

    return F.aggregate(whole, zero, add, finish)


def quantity(name: str, ts: Column, vs: Column, whole: Column, sigma: str = "coded") -> Column:
    """Value of a quantity on a segment (``ts``, ``vs``) of the window with values ``whole``.  At least two points are assumed."""
    return {
        "mean": lambda: _mean(vs, whole, sigma),
        "min": lambda: F.array_min(vs),
        "max": lambda: F.array_max(vs),
        "count": lambda: F.size(vs).cast("double"),
        "trend": lambda: _trend(ts, vs),
        "std": lambda: F.sqrt(_variance(vs)),
        "var": lambda: _variance(vs),
        "min_max": lambda: F.array_max(vs) - F.array_min(vs),
    }[name]()


def breaks(name: str, bins: int, low: Column, high: Column, length: Column, wl: int) -> list[Column]:
    """The interior break points of a quantity."""
    if name in ("mean", "min", "max") and bins in NORMAL_BREAKS:
        return [F.lit(x) for x in NORMAL_BREAKS[bins]]
    a, b = {
        "mean": (low, high),
        "min": (low, high),
        "max": (low, high),
        "trend": (F.lit(-math.pi / 2), F.lit(math.pi / 2)),
        "std": (F.lit(0.0), (high - low) / 2),
        "var": (F.lit(0.0), high - low),
        "min_max": (F.lit(0.0), high - low),
        "count": (F.lit(0.0), 2.0 * length / wl),
    }[name]
    return [a + (b - a) * k / bins for k in range(1, bins)]


def digitize(x: Column, points: list[Column]) -> Column:
    """Number of break points that do not exceed ``x``."""
    return F.size(F.filter(F.array(*points), lambda b: b <= x)) if points else F.lit(0)


def _digit(x: Column, points: list[Column]) -> Column:
    """:func:`digitize` with ``x`` computed once."""
    return F.get(F.transform(F.array(x), lambda v: digitize(v, points)), F.lit(0))


def words(series: DataFrame, params: Sequence[Param], segmentation: str = "effective", sigma: str = "coded", num_reduction: bool = True) -> DataFrame:
    """(object_id, band, band_idx, param_id, dir, pos, word): the counted words of every series.

    ``segmentation``: "effective" drops forward windows of two or more
    characters, "two_way" segments them with the single segmentator.
    ``num_reduction`` leaves out a word equal to the one before it.  Only the
    kept columns travel; series shorter than the tolerance have no words.
    """
    rows = windows(series, params)
    resolutions = list(dict.fromkeys((p.micros, p.word_length) for p in params))
    options = []
    for r, (micros, wl) in enumerate(resolutions):
        mine = [(k, p) for k, p in enumerate(params) if (p.micros, p.word_length) == (micros, wl)]
        part = rows.where(F.col("res_id") == r) if len(resolutions) > 1 else rows
        if wl == 1:
            part = part.withColumn("seg", F.array(F.struct(F.lit(0).alias("b"), F.size("ts").alias("e"))))
        else:
            part = part.withColumn("bounds", backward_bounds(F.col("ts"), F.col("w_end"), micros, wl))
            back = backward_segments(F.col("ts"), F.col("w_end"), micros, wl, F.col("bounds"))
            if segmentation == "two_way":
                part = part.withColumn("seg", F.when(F.col("dir") == 1, back).otherwise(single_segments(F.col("ts"), F.get("ts", F.lit(0)), micros, wl)))
            else:
                part = part.where("dir = 1").withColumn("seg", back)
        # characters first, in a projection of their own: words use them twice
        part = part.select("object_id", "band", "band_idx", "dir", "pos", *(_characters(p, sigma).alias(f"chars{k}") for k, p in mine))
        found = [F.struct(F.lit(k).alias("param_id"), _word(F.col(f"chars{k}"), p).alias("word")) for k, p in mine]
        options.append(part.select("object_id", "band", "band_idx", "dir", "pos", F.explode(F.array(*found)).alias("o")).select("object_id", "band", "band_idx", "o.param_id", "dir", "pos", "o.word"))
    out = options[0]
    for o in options[1:]:
        out = out.unionByName(o)
    out = out.where("word is not null")
    return reduce_numerosity(out) if num_reduction else out


def _characters(p: Param, sigma: str) -> Column:
    """Characters of a window's segments ``seg``; the special one for segments of too few points.

    Null where a segment is empty: a filter instead would be pushed below the
    segments' projection and make them twice.
    """
    least = max(1, p.tol // p.word_length)
    chars = F.transform("seg", lambda s: F.when(s["e"] - s["b"] >= least, _character(s["b"], s["e"], p, sigma)).otherwise(F.lit(p.characters)))
    return F.when(~F.exists("seg", lambda s: s["b"] < 0), chars)


def _word(chars: Column, p: Param) -> Column:
    """The word of a window's characters; null where every one is special."""
    base = float(p.characters + 1)
    placed = F.transform(chars, lambda c, k: c.cast("long") * F.pow(F.lit(base), k).cast("long"))
    return F.when(F.exists(chars, lambda c: c != p.characters), F.aggregate(placed, F.lit(0).cast("long"), lambda acc, x: acc + x))


def _character(b: Column, e: Column, p: Param, sigma: str) -> Column:
    char = F.lit(0)
    for name, bins in zip(p.quantities, p.bins, strict=True):
        x = _by_sums(name, b, e, sigma) if name in TIED else quantity(name, F.col("ts"), F.slice("vs", b + 1, e - b), F.col("vs"), sigma)
        points = breaks(name, bins, F.col("low"), F.col("high"), F.col("len"), p.word_length)
        if name in TIED:
            x, points = F.round(x, 9), [F.round(q, 9) for q in points]
        char = char * bins + _digit(x, points)
    return char


def _by_sums(name: str, b: Column, e: Column, sigma: str) -> Column:
    """A quantity of the segment [b, e) of a window from running sums, without a pass over its points."""
    first, last, n = F.get("ps", b), F.get("ps", e - 1), (e - b).cast("double")
    own = {"sv": first["v_"], "svv": first["v_"] * first["v_"], "st": first["t_"], "stt": first["t_"] * first["t_"], "stv": first["t_"] * first["v_"]}
    of = lambda k: last[k] - first[k] + own[k]
    if name == "trend":
        spread = n * of("stt") - of("st") * of("st")
        return F.when(last["tus"] > first["tus"], F.atan((n * of("stv") - of("st") * of("sv")) / F.nullif(spread, F.lit(0.0)))).otherwise(F.lit(math.pi / 2))
    if name in ("var", "std"):
        var = F.greatest(F.round(of("svv") / n - (of("sv") / n) * (of("sv") / n), 12), F.lit(0.0))
        return var if name == "var" else F.sqrt(var)
    # the mean of the segment within the window: (mean - mu) / sigma, moments shifted back by the lowest value
    begin, end, m = F.get("ps", F.lit(0)), F.element_at("ps", -1), F.size("ps").cast("double")
    shift = begin["value"] - begin["v_"]
    s1 = (end["sv"] - begin["sv"] + begin["v_"]) / m
    s2 = (end["svv"] - begin["svv"] + begin["v_"] * begin["v_"]) / m
    mu, square = s1 + shift, s2 + 2 * shift * s1 + shift * shift
    spread = F.sqrt(F.abs(square * square - mu * mu)) if sigma == "coded" else F.sqrt(F.abs(square - mu * mu))
    return F.when(spread > 0, (of("sv") / n - s1) / spread).otherwise(F.lit(0.0))


def reduce_numerosity(words_: DataFrame) -> DataFrame:
    """Leaves out a word that equals the one before it, per (object, band, parameter)."""
    order = W.partitionBy("object_id", "band", "param_id").orderBy("dir", "pos")
    return words_.withColumn("before", F.lag("word").over(order)).where("not (word <=> before)").drop("before")


def bag(words_: DataFrame, by: Sequence[str] = ("object_id", "band", "band_idx", "param_id", "word")) -> DataFrame:
    """(object_id, band, band_idx, param_id, word, tf): word counts."""
    return words_.groupBy(*by).agg(F.count(F.lit(1)).alias("tf"))


def feature_ids(bag_: DataFrame, params: Sequence[Param], n_bands: int, layout: str = "blocks") -> DataFrame:
    """Adds ``feature``: blocks by parameter, then band, then word; or the older layout with bands interleaved."""
    offsets, at = [], 0
    for p in params:
        offsets.append(at)
        at += p.words * n_bands
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in offsets)), F.col("param_id"))
    size = F.get(F.array(*(F.lit(p.words).cast("long") for p in params)), F.col("param_id"))
    inner = F.col("band_idx") * size + F.col("word") if layout == "blocks" else F.col("word") * n_bands + F.col("band_idx")
    return bag_.withColumn("feature", offset + inner)


def decode_word(word: Column, param: Param) -> Column:
    """array<array<int>>: the digits of each character (null for the special character), first character first."""
    base = param.characters + 1

    def digits(c):
        out, div = [], param.characters
        for b in param.bins:
            div //= b
            out.append(F.floor(c / div).cast("int") % b)
        return F.when(c != param.characters, F.array(*out))

    return F.transform(F.sequence(F.lit(0), F.lit(param.word_length - 1)), lambda k: digits((F.floor(word / F.pow(F.lit(float(base)), k)).cast("long") % base)))


def dropped_objects(objects: DataFrame, bag_: DataFrame) -> DataFrame:
    """Objects without any word."""
    return objects.select("object_id").distinct().join(bag_.select("object_id"), "object_id", "left_anti")
