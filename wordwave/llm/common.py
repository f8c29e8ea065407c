"""Shared helpers: word hashing over Arrow batches, shared-folder tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into arrays at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 19

_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def session_for(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches, so that long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that setting is missing (tests on one machine) a folder under
    the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{base.rstrip('/')}/wordwave-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what :func:`materialise` wrote for tables that nothing reads any more: what was made of them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Ids up to this count may be broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids`` (one column); rows with a null id stay, columns unchanged.

    The ids to drop are written and counted first: few are broadcast, so that
    texts are not shuffled.
    """
    dropped = materialise(ids.toDF("__dropped").where("__dropped is not null").distinct())
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return docs.join(side, docs[id_col] == side["__dropped"], "left_anti")


def hash_sample(df: DataFrame, rows: int, *keys) -> DataFrame:
    """All rows of ``df``, or about nine tenths of ``rows`` of them, chosen by a hash of ``keys`` below a rate.

    One count and a filter: nothing is sorted or gathered, and the choice does
    not depend on partitions.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(0.9 * rows / n * (1 << 30)))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += np.uint64(32)
    values = mix((codes + np.uint64(1)) * _MULTIPLIER) | np.uint64(1)
    values[_SEPARATORS] = 0
    return values


_LOWER, _PLAIN = _byte_values(True), _byte_values(False)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("p", int(_MULTIPLIER)), ("i", pow(int(_MULTIPLIER), -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of several texts.

    ``data`` holds the UTF-8 bytes of all texts, ``offsets`` their borders.
    Returns the words' hashes in order and the position of each text's first
    word (one more entry than texts).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = _SEPARATORS[data]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = gap[:-1]
    inner = offsets[(offsets < n)]
    first[inner] = True
    starts = np.flatnonzero(first & ~gap)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    power, inverse = _power_tables(n)
    with np.errstate(over="ignore"):
        hashes = mix(np.add.reduceat((_LOWER if lower else _PLAIN)[data] * power[:n], starts) * inverse[starts])
    return hashes, np.searchsorted(starts, offsets)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, raw, values = column.buffers()
    offsets = np.frombuffer(raw, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_hashes(words: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and each text's first run.

    A text with fewer words gives its whole sequence as one run; without
    words, none.
    """
    counts = np.diff(begins)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_begins = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(int(out_begins[-1]), dtype=np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        full = np.zeros(0, np.uint64)
        if len(words) >= width:
            full = words[: len(words) - width + 1].copy()
            for k in range(1, width):
                full = full * step + words[k : len(words) - width + 1 + k]
            full = mix(full + np.uint64(width))
        long = counts >= width
        # first word of each run: texts' begin plus the place within the text
        owner = np.repeat(np.arange(len(counts)), runs)
        place = np.arange(len(out)) - out_begins[owner] + begins[owner]
        pick = long[owner]
        out[pick] = full[place[pick]]
        for n in range(1, width):
            at = np.flatnonzero(counts == n)
            if len(at):
                h = words[begins[at]].copy()
                for k in range(1, n):
                    h = h * step + words[begins[at] + k]
                out[out_begins[at]] = mix(h + np.uint64(n))
    return out, out_begins


_worker_states: dict = {}


def worker_state(key, make: Callable):
    """What this worker process keeps between tasks under ``key``; one key at a time."""
    if key not in _worker_states:
        release_worker_state()
        _worker_states[key] = make()
    return _worker_states[key]


def release_worker_state() -> None:
    """Gives back what another operator has kept in this worker process, and freed memory that the allocators hold."""
    if _worker_states:
        _worker_states.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, function: Callable, schema: str, keeps_state: bool = False) -> DataFrame:
    """mapInArrow with a function from one record batch to lists of columns by name."""

    def over(batches):
        if not keeps_state:
            release_worker_state()
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(over, schema)
