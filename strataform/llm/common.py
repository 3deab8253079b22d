"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset and all runs in this one process (tests), a temporary folder; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="strataform-")


def no_reserved(df: DataFrame) -> DataFrame:
    """``df``, if no name begins with ``__`` (operators keep such names for themselves); else an error."""
    taken = [c for c in df.columns if c.startswith("__")]
    if taken:
        raise ValueError(f"column names that begin with __ are reserved: {', '.join(taken)}")
    return df


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Results are read from these tables when an action runs, so they stay until ``drop_written``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    # Spark drops the shuffle files of earlier jobs once the driver's JVM collects their plans; a driver with little to do may not for hours
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` has made and nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 2)[-2] for f in df.inputFiles()}:
        for path in [p for p in _WRITTEN if p.rsplit("/", 1)[-1] == name]:
            _WRITTEN.remove(path)
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that ``written`` has made in this process, after the results that need them are saved; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Apply ``fn`` (columns in as lists, columns out as lists) to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))
