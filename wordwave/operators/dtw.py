"""Dynamic time warping: recurrences over pairs of short sequences, in vectorised functions.

Each cell depends on three neighbours, which no set operation expresses; a
cell is computed for many pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS = 1024  # that are warped at a time
BROADCAST_SERIES = 10_000  # of query objects in a block
TILE = 8192  # pairs of :func:`matrix` whose cells are computed at a time: their lines fit a core's cache
SENT = 1 << 21  # distances in a batch that leaves Python


def dtw_matrix(a, b) -> np.ndarray:
    """Accumulated squared costs with infinite borders; the distance is the last cell (no root)."""
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = (x - y) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d


def dtw_path(a, b) -> list[tuple[int, int]]:
    """The warping path, first pair first.  Of equal neighbours the one above wins, then the one on the left; if all three are equal, the diagonal."""
    d = dtw_matrix(a, b)
    i, j, path = len(a), len(b), []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        above, left, corner = d[i - 1, j], d[i, j - 1], d[i - 1, j - 1]
        if above == left == corner or corner < min(above, left):
            i, j = i - 1, j - 1
        elif above <= left:
            i -= 1
        else:
            j -= 1
    return path[::-1]


def irregular_dtw(a, b) -> float:
    """Warping of (slope, mean) segments, cost their squared differences; segments without values (None) are passed over on either axis."""
    a, b = [x for x in a if x is not None], [x for x in b if x is not None]
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0.0
    for i, (s, m) in enumerate(a, 1):
        for j, (t, n) in enumerate(b, 1):
            d[i, j] = (s - t) ** 2 + (m - n) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return float(d[-1, -1])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of an array of lists (one row each, a column per field) without null structs, and the lists' lengths."""
    flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if not pa.types.is_struct(flat.type):
        return flat.to_numpy(zero_copy_only=False).astype(float)[:, None], sizes
    valid = flat.is_valid()
    owner = np.repeat(np.arange(len(sizes)), sizes)[valid.to_numpy(zero_copy_only=False)]
    fields = [x.to_numpy(zero_copy_only=False).astype(float) for x in flat.filter(valid).flatten()]
    return np.stack(fields, axis=1), np.bincount(owner, minlength=len(sizes))


def warped(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Distances of the pairs of two arrays of lists: the last cells of their matrices, row by row, pairs of similar lengths together."""
    (x, nx), (y, ny) = _flat(a), _flat(b)
    x_at, y_at = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    out, order = np.full(len(nx), np.inf), np.lexsort((ny, nx))

    def padded(values, starts, most):
        return values[np.minimum(starts + np.arange(most)[:, None], len(values) - 1)]

    for at in range(0, len(order), PAIRS):
        rows = order[at : at + PAIRS]
        p, q = nx[rows], ny[rows]
        above = np.full((q.max() + 1, len(rows)), np.inf)
        above[0] = 0.0
        out[rows[(p == 0) & (q == 0)]] = 0.0
        if not p.max() or not q.max():
            continue
        left, right = padded(x, x_at[rows], p.max()), padded(y, y_at[rows], q.max())
        for i in range(len(left)):
            cost = ((left[i] - right) ** 2).sum(axis=-1)
            here = np.full_like(above, np.inf)
            for j in range(len(right)):
                here[j + 1] = cost[j] + np.minimum(np.minimum(above[j + 1], here[j]), above[j])
            ends = np.flatnonzero(p == i + 1)
            out[rows[ends]] = here[q[ends], ends]
            above = here
    return out


def _padded(values: np.ndarray, starts: np.ndarray, most: int) -> list[list[np.ndarray]]:
    """By place and variable, that value of every series that starts there; beyond a series' end any value."""
    at = np.minimum(starts + np.arange(most)[:, None], len(values) - 1)
    return [[np.ascontiguousarray(v[k]) for v in values.T] for k in at]


def matrix(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distances of every series of y (rows) to every one of x, both as of :func:`_flat` and sorted by length.

    Many pairs go through a cell at once.  Three neighbours and the cost decide
    it, so a pair's distance, the cell at its lengths, does not see the padding
    behind.  Of the matrix one line is held, its buffers taking turns.
    """
    (x, nx), (y, ny) = x, y
    x_at, y_at = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    out = np.full((len(ny), len(nx)), np.inf)
    out[np.ix_(ny == 0, nx == 0)] = 0.0
    if not len(x) or not len(y):
        return out
    right, m = _padded(y, y_at, ny[-1]), int(ny[-1])
    wide = max(1, TILE // len(ny))
    buffers = np.empty((m + 4, wide, len(ny)))
    lengths = [(q, *np.searchsorted(ny, (q, q + 1))) for q in np.unique(ny[ny > 0])]
    for at in range(0, len(nx), wide):
        p = nx[at : at + wide]
        cost, part, *free = (b[: len(p)] for b in buffers[:4])
        line = [b[: len(p)] for b in buffers[4:]]
        for i, here in enumerate(_padded(x, x_at[at : at + wide], p[-1])):
            here, corner = [v[:, None] for v in here], None
            for j, there in enumerate(right):
                np.subtract(here[0], there[0], out=cost)
                np.multiply(cost, cost, out=cost)
                for v, w in zip(here[1:], there[1:], strict=True):
                    np.subtract(v, w, out=part)
                    np.multiply(part, part, out=part)
                    np.add(cost, part, out=cost)
                cell = free.pop()
                if i and j:
                    np.minimum(line[j], line[j - 1], out=part)
                    np.minimum(part, corner, out=part)
                    np.add(cost, part, out=cell)
                elif i or j:
                    np.add(cost, line[0] if i else line[j - 1], out=cell)
                else:
                    np.copyto(cell, cost)
                if corner is not None:
                    free.append(corner)
                line[j], corner = cell, line[j]
            free.append(corner)
            a, b = np.searchsorted(p, (i + 1, i + 2))
            for q, c, d in lengths if a < b else ():
                out[c:d, at + a : at + b] = line[q - 1][a:b, c:d].T
    return out


def dtw(a: Column, b: Column) -> Column:
    """Distance of two array columns."""

    @F.arrow_udf("double")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(warped(x, y), pa.float64())

    return distance(a, b)


def segment_dtw(a: Column, b: Column) -> Column:
    """Irregular distance of two array columns of structs (slope, mean); null elements are invalid segments."""
    return dtw(a, b)


def dependent_dtw(a: Column, b: Column) -> Column:
    """Warping of two array columns of structs (one field for each variable): all variables warp together, the distance is the root of the summed squares."""
    return F.sqrt(dtw(a, b))


def as_steps(features: Column, steps: int, variables: int) -> Column:
    """A flat array of steps x variables as an array of structs of the variables."""
    values = lambda k: F.slice(features, k * variables + 1, variables)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct(*(F.get(values(k), F.lit(v)).cast("double").alias(f"v{v}") for v in range(variables))))


def dependent_matrix(queries: DataFrame, references: DataFrame, steps: int, variables: int) -> DataFrame:
    """(a, b, distance): dependent warping distances of rows (object_id, features: a flat array) to every other row and themselves (0).

    The matrix is symmetric: of two queries each pair is warped once and given twice.
    """
    own = queries.select(F.col("object_id").alias("b"), F.lit(True).alias("asked"))
    x = queries.select("object_id", F.lit("all").alias("band"), as_steps(F.col("features"), steps, variables).alias("values"))
    y = references.select("object_id", F.lit("all").alias("band"), as_steps(F.col("features"), steps, variables).alias("values"))
    pairs = paired(x, y).join(own, "b", "left")
    both = F.coalesce("asked", F.lit(False))
    half = pairs.where(~both | (F.col("a") <= F.col("b"))).select("a", "b", both.alias("both"), dependent_dtw(F.col("p"), F.col("q")).alias("distance"))
    mirrored = F.when(F.col("both") & (F.col("a") < F.col("b")), F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b")))
    return half.select(F.explode(mirrored).alias("x"), "distance").select("x.a", "x.b", "distance")


def sequences(series: DataFrame) -> DataFrame:
    """(object_id, band, values): each series' values in order."""
    return series.groupBy("object_id", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("tus", "ord", "value"))), lambda x: x["value"]).alias("values"))


def paired(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(a, b, band, p, q): every query series (object_id, band, values) with every reference series of its band.

    Queries are the few: they are broadcast in blocks of objects to the
    references, which are dealt evenly and never gathered by band.
    """
    x = queries.select(F.col("object_id").alias("a"), "band", F.col("values").alias("p"))
    y = references.select(F.col("object_id").alias("b"), "band", F.col("values").alias("q"))
    y = y.repartition(4 * references.sparkSession.sparkContext.defaultParallelism, "b", "band")
    blocks = -(-x.select("a").distinct().count() // BROADCAST_SERIES) or 1
    block = F.pmod(F.xxhash64("a"), F.lit(blocks))
    parts = [y.join(F.broadcast(x.where(block == k) if blocks > 1 else x), "band") for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts).select("a", "b", "band", "p", "q")


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_flat` of the lists sorted by their lengths, and their order."""
    values, sizes = _flat(lists)
    order = np.argsort(sizes, kind="stable")
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(values))
    return values[at], sizes, order


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 up, rounded; halves go up."""
    x = x * 10.0**digits
    low = np.floor(x)
    with np.errstate(invalid="ignore"):  # of infinite ones
        return (low + (x - low >= 0.5)) / 10.0**digits


def every_distance(queries: DataFrame, references: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, band, distance): warping distances of every query series (object_id, band, values) to every reference series of its band, rounded if asked.

    A pair is a row only in the result.  Queries are the few: they are sent in
    blocks of objects with the function, so that every series enters Python
    once; a reference comes back with its distances to all queries of its band,
    which the JVM spreads.  References are dealt evenly and never gathered by band.
    """
    x = queries.select(F.col("object_id").alias("a"), "band", "values")
    y = references.select(F.col("object_id").alias("b"), "band", "values")
    y = y.repartition(4 * references.sparkSession.sparkContext.defaultParallelism, "b", "band").sortWithinPartitions("band")
    blocks = -(-x.select("a").distinct().count() // BROADCAST_SERIES) or 1
    block = F.pmod(F.xxhash64("a"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_block_distances(x.where(block == k) if blocks > 1 else x, y, digits) for k in range(blocks)])


def _block_distances(x: DataFrame, y: DataFrame, digits: int | None) -> DataFrame:
    spark, got = y.sparkSession, x.where("band is not null").toArrow()
    asked, names = {}, {}
    for band in pc.unique(got["band"]).to_pylist():
        own = got.filter(pc.equal(got["band"], band)).combine_chunks()
        values, sizes, order = _lists(own["values"].combine_chunks())
        asked[band], names[band] = (values, sizes), own["a"].take(pa.array(order)).to_pylist()
    sent = spark.sparkContext.broadcast(asked)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, own in sent.value.items():
                rows = batch.filter(pc.equal(batch["band"], band))
                step = max(1, SENT // len(own[1]))
                values, sizes, order = _lists(rows["values"])
                starts = np.cumsum(sizes) - sizes
                for at in range(0, len(order), min(step, TILE)):
                    n = sizes[at : at + min(step, TILE)]
                    found = matrix(own, (values[starts[at] : starts[at] + n.sum()], n))
                    found = found if digits is None else _rounded(found, digits)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(own[1]), pa.int32()), pa.array(found.ravel()))
                    part = rows.take(pa.array(order[at : at + len(n)]))
                    yield pa.RecordBatch.from_arrays([part["b"], part["band"], lists], ["b", "band", "d"])

    kind = {f.name: f.dataType.simpleString() for f in [*x.schema, *y.schema]}
    found = y.mapInArrow(distances, f"b {kind['b']}, band {kind['band']}, d array<double>")
    known = spark.createDataFrame(list(names.items()), f"band {kind['band']}, names array<{kind['a']}>")
    rows = found.join(F.broadcast(known), "band").select("names", "b", "band", F.posexplode("d").alias("k", "distance"))
    return rows.select(F.get("names", F.col("k")).alias("a"), "b", "band", "distance")


def distance_matrix(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(a, b, distance): warping distances of every query object to every reference object, summed over their common bands."""
    pairs = paired(queries, references).select("a", "b", dtw(F.col("p"), F.col("q")).alias("d"))
    return pairs.groupBy("a", "b").agg(F.sum("d").alias("distance"))
