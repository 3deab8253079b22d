"""Row-wise operators on streams.

The batch operators that work row by row run unchanged on a streaming DataFrame; what follows are the few that need a state
or a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import parse_decimal
from ..operators.table_prep import normalise


def normalised_stream(stream: DataFrame) -> DataFrame:
    """Cells of a stream of tables, cleaned as in batch."""
    return normalise(stream)


def quality_by_window(stream: DataFrame, time: str, value: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Cells and valid numbers per time window; events later than ``late`` are dropped and their state freed."""
    number = parse_decimal(F.col(value))
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"))
        .agg(F.count("*").alias("n_cells"), F.count(number).alias("n_numbers"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_cells", "n_numbers")
    )


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within ``late``: the stream's version of distinct records."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until all available input is read; goes on from the checkpoint after a failure."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
