"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``. Null texts count as empty,
repeated rows stay repeated unless a stage says otherwise, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.common import fold, read_table, written
from strataform.llm.line_dedup import dedup_lines
from strataform.llm.packing import pack_documents
from strataform.llm.quality import fit_quality, score_quality
from strataform.llm.secret_scan import redact, scan_secrets
from strataform.llm.simhash import similar_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents scored 0.5 or more. Labels of the held-out fold (crc32 of the id modulo 3 is 1) are not learned from."""
    learn = F.coalesce(fold("doc_id", 3) != 1, F.lit(False))
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"), learn)
    return score_quality(docs, model, out="__score").where("__score >= 0.5").drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out the lines of three-line windows that occur before; documents of which nothing but white space is left by that go."""
    done = dedup_lines(docs, report="__fact")
    emptied = (F.col("__fact.removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return _counted(done.where(~F.coalesce(emptied, F.lit(False))).drop("__fact"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group alike in shingles of five words, by 0.8 or more.

    Rows without an id stay. Rows that repeat an id are one document: they stay together, or go together if any of them is alike to a document with a smaller id.
    """
    groups = similar_documents(docs, words=5, similarity=0.8).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind in brackets."""
    found = scan_secrets(docs, out="__spans")
    return _counted(found.withColumn("text", redact("text", "__spans")).drop("__spans"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, each with its sequence and place."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: SQL can express neither the classifier nor the fingerprints; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; every stage's result is a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
