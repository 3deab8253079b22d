"""Labelled columns: chunked training files, example catalogues, and one-column corpora."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import escape_newlines

#: Fixed values of the format.
DIVIDER, JOINT, MARK = "-" * 20, "---", "::"
MOST_VALUES, SEED = 100, 54


def parse_training(texts: DataFrame, text: str = "value") -> DataFrame:
    """class, prop, chunk, table, column, pos, value of training texts.

    The first line of a text is ``class---prop``; chunks are parted by twenty dashes. A chunk is ``::table::``, the column's
    name, an empty line and the values. A chunk that lacks the first line is kept with a null table, its first line as the name.
    """
    head = F.trim(F.substring_index(F.col(text), "\n", 1))
    body = F.split(F.substring(F.col(text), F.length(F.substring_index(F.col(text), "\n", 1)) + 1, 1 << 30), rf"(?m)^{DIVIDER}\s*$")
    chunks = texts.select(F.substring_index(head, JOINT, 1).alias("class"), F.substring_index(head, JOINT, -1).alias("prop"), F.posexplode(body).alias("chunk", "__text"))
    lines = F.split(F.regexp_replace("__text", r"^\n+|\n+$", ""), "\n", -1)
    chunks = chunks.where(F.trim(F.replace("__text", F.lit("\n"), F.lit(""))) != "").withColumn("__lines", lines)
    marked = F.col("__lines")[0].rlike(f"^{MARK}.*{MARK}$")
    skip = F.when(marked, 1).otherwise(0)
    named = chunks.select(
        "class", "prop", "chunk", F.when(marked, F.regexp_extract(F.col("__lines")[0], f"^{MARK}(.*){MARK}$", 1)).alias("table"),
        F.try_element_at("__lines", skip + 1).alias("column"), F.slice("__lines", skip + 3, F.greatest(F.size("__lines"), F.lit(1))).alias("__values"),
    )
    return named.select("class", "prop", "chunk", "table", "column", F.posexplode("__values").alias("pos", "value"))


def read_training(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``parse_training`` of files."""
    return parse_training(spark.read.text(path if isinstance(path, str) else list(path), wholetext=True))


def sample_values(values: DataFrame, by: Sequence[str], value: str = "value", most: int = MOST_VALUES, seed: int = SEED) -> DataFrame:
    """At most ``most`` non-blank values of each group, chosen by a hash, so every run takes the same ones."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *by, value), value)
    kept = values.where(F.trim(F.coalesce(value, F.lit(""))) != "").withColumn("__n", F.row_number().over(order))
    return kept.where(F.col("__n") <= most).drop("__n")


def training_texts(labelled: DataFrame) -> DataFrame:
    """class, prop and text: what a training file holds, from rows (class, prop, table, column, value), sampled."""
    chosen = sample_values(labelled, ["class", "prop", "table", "column"])
    lines = chosen.groupBy("class", "prop", "table", "column").agg(F.array_sort(F.collect_list(escape_newlines(F.col("value")))).alias("v"))
    chunk = F.concat(F.lit(MARK), "table", F.lit(MARK + "\n"), escape_newlines(F.col("column")), F.lit("\n\n"), F.array_join("v", "\n"))
    each = lines.select("class", "prop", chunk.alias("chunk")).groupBy("class", "prop").agg(F.array_sort(F.collect_list("chunk")).alias("c"))
    return each.select("class", "prop", F.concat("class", F.lit(JOINT), "prop", F.lit("\n\n"), F.array_join("c", f"\n\n{DIVIDER}\n")).alias("text"))


def write_training(labelled: DataFrame, path: str) -> None:
    """One text per (class, prop), in folders by class and prop."""
    training_texts(labelled).write.mode("overwrite").partitionBy("class", "prop").text(path)


def read_examples(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """id, aliases, values of example catalogues; files that lack aliases or values have empty lists."""
    raw = spark.read.schema("id string, aliases array<string>, values array<string>").json(path if isinstance(path, str) else list(path), multiLine=True)
    empty = F.expr("cast(array() as array<string>)")
    return raw.select("id", F.coalesce("aliases", empty).alias("aliases"), F.coalesce("values", empty).alias("values"))


def read_column_corpus(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """stem, column, pos, value of one-column text files: the first line is the name."""
    files = spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[A-Za-z]+)?$", 1)
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1)
    rows = files.select(stem.alias("stem"), lines.alias("__lines"))
    return rows.select("stem", F.col("__lines")[0].alias("column"), F.posexplode(F.slice("__lines", 2, F.greatest(F.size("__lines"), F.lit(1)))).alias("pos", "value"))


def dataset_files(spark: SparkSession, path: str) -> DataFrame:
    """name and text of the files two and three levels down a folder, or of the members of a zip file."""
    if not path.lower().endswith(".zip"):
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"((?:tables|descriptions)/.*)$", 1).alias("name"), F.col("value").alias("text")).where("name <> ''")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive.read(name).decode("utf-8")])], names=["name", "text"])

    every = spark.read.format("binaryFile").load(path).select("content").mapInArrow(members, "name string, text string")
    return every.select(F.regexp_extract("name", r"((?:tables|descriptions)/.*)$", 1).alias("name"), "text").where("name <> ''")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """stem, table and description: the texts of each labelled table of a folder or zip, paired by name.

    Tables lie in ``tables``; the description in ``descriptions`` is a file of the table's name, or the last file by name in a folder of its name. Tables
    without a description, and the reverse, are left out.
    """
    files = dataset_files(spark, path)
    parts = F.split("name", "/")
    stem = F.regexp_extract(parts[1], r"^(.*?)(\.[A-Za-z]+)*$", 1)
    own = files.select(parts[0].alias("kind"), stem.alias("stem"), "name", "text")
    tables = own.where("kind = 'tables'").select("stem", F.col("text").alias("table"))
    said = own.where("kind = 'descriptions'").groupBy("stem").agg(F.max_by("text", "name").alias("description"))
    return tables.join(said, "stem")


def table_cells(dataset: DataFrame) -> DataFrame:
    """stem, row, col, column, value of the tables of ``read_dataset``: delimited text whose first row has the names. Short rows are filled up with ``""``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, *rows = csv.reader(io.StringIO(text, newline="")) if text else [[]]
                cells = [(stem, i, j, name, row[j] if j < len(row) else "") for i, row in enumerate(rows) for j, name in enumerate(names)]
                columns = list(zip(*cells, strict=True)) if cells else [[]] * 5
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["stem", "row", "col", "column", "value"])

    return dataset.select("stem", "table").mapInArrow(run, "stem string, row int, col int, column string, value string")
