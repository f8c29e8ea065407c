"""Sources: every input becomes the canonical series table.

``series(object_id, band, band_idx, tus, t, value, ord)``: one row per
measurement; ``tus`` is the time in microseconds (long), ``t`` in days
(double), ``band_idx`` the place of the band among the bands, ``ord`` breaks
ties of time.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000
BANDS = ("g", "i", "r", "u", "y", "z")
EVENT_BANDS = ("click", "error", "purchase", "signup", "view")
LINE_BANDS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone (session zone UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def canonical(df: DataFrame, object_id: Column, band: Column, tus: Column, value: Column, ord_: Column, bands: Sequence[str]) -> DataFrame:
    """Projects ``df`` to the series table; rows of other bands or without time or value are left out."""
    names = F.array(*(F.lit(b) for b in bands))
    out = df.select(
        object_id.cast("string").alias("object_id"),
        band.cast("string").alias("band"),
        (F.array_position(names, band.cast("string")) - 1).cast("int").alias("band_idx"),
        tus.cast("long").alias("tus"),
        (tus.cast("long").cast("double") / float(DAY)).alias("t"),
        value.cast("double").alias("value"),
        ord_.cast("long").alias("ord"),
    )
    return out.where("band_idx >= 0 and tus is not null and value is not null")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return canonical(df, F.col("user_id"), F.col("event_type"), micros("ts") - 1_704_067_200_000_000, F.col("value"), F.col("event_id"), EVENT_BANDS)


def line_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return canonical(df, F.col("l_suppkey"), F.col("l_returnflag"), micros("l_shipdate") - 788_918_400_000_000, F.col("l_quantity"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), LINE_BANDS)


def observations(df: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """From (object_id, time or mjd in days, band or passband, flux): aliases are renamed, a passband number is a place in ``bands``."""
    names = {"mjd": "time", "passband": "band"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})
    number = F.array_position(F.array(*(F.lit(str(i)) for i in range(len(bands)))), F.col("band").cast("string"))
    letter = F.regexp_replace(F.col("band").cast("string"), "^lsst", "")
    band = F.when(number > 0, F.get(F.array(*(F.lit(b) for b in bands)), (number - 1).cast("int"))).otherwise(letter)
    return canonical(df, F.col("object_id"), band, F.round(F.col("time") * float(DAY)), F.col("flux"), F.xxhash64("object_id", "band", "time", "flux"), bands)


def read_csv(spark: SparkSession, data: str, meta: str, passband: int = 3, detected_only: bool = False) -> DataFrame:
    """A CSV pair (plain, gz or zip) as one-band series joined with their metadata, times rebased to the first observation."""
    rows = _csv(spark, data).where(F.col("passband") == passband)
    if detected_only:
        rows = rows.where("detected = 1")
    first = F.min("mjd").over(W.partitionBy("object_id"))
    rows = rows.withColumn("time", F.col("mjd") - first)
    return rows.join(_csv(spark, meta), "object_id")


#: Columns of zipped CSV files that are whole numbers; others are doubles.
WHOLE = ("object_id", "passband", "detected", "ddf", "target", "class")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header.  Members of a zip file are unpacked by the task that reads it, line by line."""
    if not path.endswith(".zip"):
        return spark.read.csv(path, header=True, inferSchema=True)
    files = spark.read.format("binaryFile").load(path).select("content")

    def lines(batches):
        for batch in batches:
            for raw in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            text = io.TextIOWrapper(f, "utf-8")
                            header = next(text, "").strip()
                            while part := list(islice(text, 10_000)):
                                yield pa.RecordBatch.from_pydict({"header": [header] * len(part), "line": [x.rstrip("\r\n") for x in part]})

    rows = files.mapInArrow(lines, "header string, line string").where("line <> ''")
    first = rows.select("header").first()
    names = [n.strip() for n in (first["header"] if first else "object_id").split(",")]
    kinds = ", ".join(f"`{n}` {'long' if n in WHOLE else 'double'}" for n in names)
    return rows.select(F.from_csv("line", kinds).alias("r")).select("r.*")


def read_regular(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Lines ``label<sep>v1<sep>v2...``: (object_id, label, time = position, value); every line is an object, equal ones too.

    Ids come from file, block and the line's place among equal lines there, so
    reading again gives the same ones.
    """
    lines = spark.read.text(path).where("length(trim(value)) > 0").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    again = F.row_number().over(W.partitionBy("file", "block", F.xxhash64("value")).orderBy("value"))
    parts = lines.withColumn("k", again).select(F.xxhash64("value", "file", "block", "k").alias("object_id"), F.split("value", sep).alias("p"))
    return parts.select("object_id", F.get("p", F.lit(0)).cast("double").cast("int").alias("label"), F.posexplode(F.slice("p", F.lit(2), F.size("p") - 1)).alias("time", "v")).select(
        "object_id", "label", "time", F.col("v").cast("double").alias("value")
    )


def explode_arrays(df: DataFrame) -> DataFrame:
    """(object_id, label, values array, times array) -> long form (object_id, label, time, value); places that only one array has give a null, empty arrays no rows."""
    pairs = F.arrays_zip(F.col("times").alias("t"), F.col("values").alias("v"))
    return df.select("object_id", "label", F.explode(F.transform(pairs, lambda p: F.struct(p["t"].alias("time"), p["v"].alias("value")))).alias("p")).select("object_id", "label", "p.time", "p.value")


def read_metadata(spark: SparkSession, path: str, survey: int | None = None) -> DataFrame:
    """The metadata of a dataset that :func:`wordwave.sources.sinks.write_dataset` wrote, without its observations; of one survey (ddf) if asked."""
    df = spark.read.parquet(f"{path.rstrip('/')}/metadata")
    return df if survey is None else df.where(F.col("ddf") == survey)


def read_bag(spark: SparkSession, path: str, quantities: Sequence[str], widths: Sequence[float] | None = None, word_lengths: Sequence[int] | None = None) -> DataFrame:
    """The bags of some quantities from a folder of :func:`wordwave.sources.sinks.write_bag`, side by side: features of the k-th quantity follow those before it.

    Only the folders of the asked quantities, widths and word lengths are read.
    """
    df = spark.read.parquet(path).where(F.col("quantity").isin(*quantities))
    df = df if widths is None else df.where(F.col("win").isin(*(float(w) for w in widths)))
    df = df if word_lengths is None else df.where(F.col("wl").isin(*word_lengths))
    place = F.array_position(F.array(*(F.lit(q) for q in quantities)), F.col("quantity").cast("string"))
    sizes = df.groupBy(place.alias("k")).agg((F.max("feature") + 1).alias("size"))
    offsets = sizes.select("k", F.coalesce(F.sum("size").over(W.partitionBy().orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return df.join(F.broadcast(offsets), place == F.col("k")).withColumn("feature", F.col("feature") + F.col("offset")).drop("k", "offset")


def read_features(spark: SparkSession, path: str, chunk: int | None = None, num_chunks: int = 1) -> DataFrame:
    """A feature table of :func:`wordwave.sources.sinks.write_features`, whole or one chunk of its objects."""
    df = spark.read.parquet(path)
    return df if chunk is None else read_chunk(df, chunk, num_chunks)


def read_chunk(df: DataFrame, chunk: int, num_chunks: int, key: str = "object_id") -> DataFrame:
    """The objects of one chunk; kept for callers that page, a cluster reads all partitions at once."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(num_chunks)) == chunk)


def read_results(spark: SparkSession, glob: str) -> DataFrame:
    """Search results of many CSV files, with the quantity code and timestamp of their names."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    raw = spark.read.csv(glob, header=True, inferSchema=True)
    return raw.select("*", F.regexp_extract(name, r"\(([^)]*)\)", 0).alias("q_code"), F.regexp_extract(name, r"(\d{8}-\d{6})", 1).alias("stamp"))
