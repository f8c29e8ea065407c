"""Bags over a stream.

A series ends when its observations stop; a micro-batch of complete series
gives the same bag as a table of them.  :func:`write_bags` therefore runs the
batch plan on each micro-batch of (object, band) series and appends the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import words


def write_bags(series_stream: DataFrame, params: Sequence[words.Param], path: str, checkpoint: str):
    """Starts a query that appends (object_id, band, band_idx, param_id, word, tf, batch) for every micro-batch.

    ``series_stream`` has the series columns; each (object, band) must arrive
    within one micro-batch, as a source that delivers whole files does.  A
    batch that is run again after a failure replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        words.bag(words.words(batch, params)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return series_stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
