"""Delimited tables in three shapes: plain DataFrames, numbered columns, and cells.

* wide: one column per table column, named by the header; every value a string, missing cells ``""``.
* numbered: physical columns ``c0 .. cN`` and ``row``, with the names in a catalogue (names may repeat or be empty).
* cells: ``table_id, row, col, kind, value``, one row per cell.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TEXT = {"quote": '"', "escape": '"', "multiLine": "true", "inferSchema": "false", "encoding": "UTF-8", "nullValue": "\u0001", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str | Sequence[str], **options: str) -> DataFrame:
    """A file with a header row, all text; missing cells are ``""``. Other suffixes than .csv and .tsv raise an error."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not p.lower().rstrip("/").endswith((".csv", ".tsv", ".csv.gz", ".tsv.gz")) and "*" not in p:
            raise ValueError(f"not a delimited file: {p}")
    tab = {"sep": "\t"} if all(".tsv" in p.lower() for p in paths) else {}
    return spark.read.options(**(_TEXT | tab | options)).csv(paths, header=True).na.fill("")


def read_raw_cells(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """Cells of files without any header: table_id (the file), row, col, kind ``content``, value; blank cells are ``""``, blank lines are no rows.

    A row's number comes from its place in the file, so each file is parsed whole, by one task; files are spread over tasks. Rows are filled up to
    the widest of their file.
    """
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).select(F.col("_metadata.file_path").alias("table_id"), "value")
    kinds = {"table_id": pa.string(), "row": pa.int32(), "col": pa.int32(), "kind": pa.string(), "value": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
                wide = max(map(len, rows), default=0)
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    cells = [(name, at + i, j, "content", r[j] if j < len(r) else "") for i, r in enumerate(part) for j in range(wide)]
                    columns = zip(*cells, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return files.mapInArrow(run, "table_id string, row int, col int, kind string, value string")


def pick_table(cells: DataFrame, index: int) -> DataFrame:
    """The cells of the table with ordinal ``index`` by table_id."""
    ids = cells.select("table_id").distinct().orderBy("table_id").offset(index).limit(1)
    return cells.join(F.broadcast(ids), "table_id", "left_semi")  # one row


def read_column_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Cells of serialised columnar tables: files of {table: {table_id, columns: [{index, name, values}]}}."""
    schema = "version int, table struct<version int, table_id string, columns array<struct<index int, name string, values array<string>>>>"
    raw = spark.read.schema(schema).json(path if isinstance(path, str) else list(path), multiLine=True)
    each = raw.select(F.col("table.table_id").alias("table_id"), F.explode("table.columns").alias("c"))
    return each.select("table_id", F.col("c.index").alias("col"), F.col("c.name").alias("name"), F.posexplode("c.values").alias("row", "value")).select(
        "table_id", "row", "col", "name", F.coalesce("value", F.lit("")).alias("value")
    )


def rows_to_cells(df: DataFrame, table_id: str | Column, order: Sequence[str | Column]) -> DataFrame:
    """Cells (with the column's name) of a wide table; ``order`` gives the row numbers, so it has to be total within the table."""
    names = df.columns
    tid = F.lit(table_id) if isinstance(table_id, str) else table_id
    row = F.row_number().over(Window.partitionBy("table_id").orderBy(*order)) - 1
    items = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)))
    placed = df.withColumn("table_id", tid).withColumn("row", row)
    return placed.select("table_id", "row", F.inline(items)).select("table_id", "row", "col", "name", F.coalesce("value", F.lit("")).alias("value"))


def table_key(project: Column, table: Column, name: Column) -> Column:
    """The id of an interactive table: ``p{project}---t:{id}---{name}``."""
    return F.format_string("p%s---t:%s---%s", project.cast("string"), table.cast("string"), name)


def with_row_index(df: DataFrame, order: Sequence[str], partition: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Number rows from 0 by ``order`` within ``partition``."""
    window = (Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("long") - 1)


def files_of(df: DataFrame) -> DataFrame:
    """Add ``source_file``, the path each row was read from: one output per input of a glob."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One CSV file with a header, in the given order. For results that a person opens; not for bulk output."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").options(quote='"', escape='"', header="true", emptyValue="").csv(path)


def write_records(df: DataFrame, path: str, partitions: int | None = None, compress: bool = False) -> None:
    """JSON lines, with null fields left out; ``partitions`` deals the rows anew, ``compress`` gives gzip files."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode("overwrite").options(compression="gzip" if compress else "none", ignoreNullFields="true").json(path)


def write_store(df: DataFrame, path: str, key: str, buckets: int = 16) -> None:
    """A keyed store: Parquet dealt and sorted by ``key``, so a lookup reads a few row groups."""
    df.repartition(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def open_store(spark: SparkSession, path: str, key: str, defaults: DataFrame | None = None, stored_first: bool = True) -> DataFrame:
    """A keyed store with ``defaults`` for the keys that it lacks (or, not ``stored_first``, over the keys that it has)."""
    stored = spark.read.parquet(path)
    if defaults is None:
        return stored
    return with_defaults(stored, defaults, key) if stored_first else with_defaults(defaults, stored, key)


def with_defaults(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The rows of ``first``, and those of ``second`` whose key ``first`` lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"), allowMissingColumns=True)
