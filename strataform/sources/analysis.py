"""Tables found in documents by a layout service: its JSON results, from files, to cells and named tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table_prep import fill_spans, merge_headers, promote_headers

SCHEMA = "tables array<struct<row_count:int,column_count:int,cells:array<struct<kind:string,row_index:int,column_index:int,row_span:int,column_span:int,content:string>>>>"


def read_analysis(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Spans of all tables in result files: table_id is the file's stem, the first eight digits of its content's hash, and the table's ordinal."""
    raw = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[A-Za-z]+)?$", 1)
    rows = raw.select(stem.alias("stem"), F.substring(F.sha2("value", 256), 1, 8).alias("print"), F.from_json("value", SCHEMA).alias("j"))
    tables = rows.select("stem", "print", F.posexplode("j.tables").alias("k", "t"))
    cells = tables.select(F.concat_ws("_", "stem", "print", F.col("k").cast("string")).alias("table_id"), F.posexplode("t.cells").alias("pos", "x"))
    return cells.select(
        "table_id", "pos", F.col("x.row_index").alias("row"), F.col("x.column_index").alias("col"), F.coalesce("x.row_span", F.lit(1)).alias("row_span"), F.coalesce("x.column_span", F.lit(1)).alias("col_span"),
        F.coalesce("x.kind", F.lit("content")).alias("kind"), F.coalesce("x.content", F.lit("")).alias("content"),
    )


def analysed_tables(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, body) of the tables: spans filled, header rows merged, the first row's texts as names."""
    return promote_headers(merge_headers(fill_spans(spans)), 1)


def analysis_json(spans: DataFrame) -> DataFrame:
    """stem and value: each document's results as one JSON text, from rows (stem, table, pos, row, col, row_span, col_span, kind, content)."""
    cell = F.struct(
        F.col("kind"), F.col("row").alias("row_index"), F.col("col").alias("column_index"), F.col("row_span"), F.col("col_span").alias("column_span"), F.col("content")
    )
    tables = spans.groupBy("stem", "table").agg(
        (F.max("row") + 1).alias("row_count"), (F.max("col") + 1).alias("column_count"), F.array_sort(F.collect_list(F.struct("pos", cell.alias("cell")))).alias("c")
    )
    each = tables.select("stem", F.struct("table", F.struct("row_count", "column_count", F.transform("c", lambda x: x["cell"]).alias("cells")).alias("t")).alias("t"))
    return each.groupBy("stem").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["t"]).alias("tables"))).alias("value"))


def write_analysis(spans: DataFrame, path: str) -> None:
    """Raw results as ``read_analysis`` takes them: a folder for each document, its JSON in one file."""
    analysis_json(spans).write.mode("overwrite").partitionBy("stem").text(path)
