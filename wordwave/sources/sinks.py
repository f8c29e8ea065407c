"""Sinks: features, predictions, search results, models and new datasets."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def free_name(spark: SparkSession, path: str) -> str:
    """``path``, or with a time stamp before its suffix where it is taken."""
    if not _exists(spark, path):
        return path
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S-%f")
    head, dot, tail = path.rpartition(".")
    return f"{head}-{stamp}.{tail}" if dot and "/" not in tail else f"{path}-{stamp}"


def write_features(df: DataFrame, path: str, overwrite: bool = True, records: DataFrame | None = None) -> str:
    """Writes a feature table; without ``overwrite`` a taken name gets a time stamp.

    ``records`` (points and seconds of each object, say) go to a table of the
    same name that ends in ``_record_times``.
    """
    target = path if overwrite else free_name(df.sparkSession, path)
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).parquet(target)
    if records is not None:
        records.write.mode(mode).parquet(f"{target}_record_times")
    return target


def write_raw_features(df: DataFrame, folder: str, dataset: str, tag: str, records: DataFrame | None = None) -> str:
    """Writes extracted features under their version and dataset: ``<folder>/raw_<tag>_<dataset>``."""
    return write_features(df, f"{folder.rstrip('/')}/raw_{tag}_{dataset}", True, records)


def write_predictions(df: DataFrame, folder: str, dataset: str, classifier: str | None = None) -> str:
    """Writes (object_id, class, pred) to :func:`predictions_path`; a second run replaces it."""
    path = predictions_path(folder, dataset, classifier)
    df.write.mode("overwrite").parquet(path)
    return path


def write_bag(df: DataFrame, path: str) -> None:
    """A bag table partitioned by its parameters, so that readers prune by quantity, window and word length."""
    df.write.mode("overwrite").partitionBy("quantity", "wl", "win").parquet(path)


def predictions_path(folder: str, dataset: str, classifier: str | None = None) -> str:
    return f"{folder.rstrip('/')}/predictions_{dataset}" + (f"_{classifier}" if classifier else "")


def append_results(df: DataFrame, path: str) -> None:
    """Appends search rows as CSV with a header."""
    df.coalesce(1).write.mode("append").csv(path, header=True)


def write_dataset(observations: DataFrame, metadata: DataFrame, keep: DataFrame, path: str) -> None:
    """A new dataset of the objects in ``keep`` (object_id): observations and metadata."""
    observations.join(keep, "object_id", "left_semi").write.mode("overwrite").parquet(f"{path}/observations")
    metadata.join(keep, "object_id", "left_semi").write.mode("overwrite").parquet(f"{path}/metadata")
