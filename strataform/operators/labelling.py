"""Semantic types of columns: features by similarity to labelled columns, and a classifier on them.

Every feature comes from joins and aggregates, so columns are scored set against set. The classifier is one of Spark ML's, trained on pairs
(column, label) with the share of agreement as features; predictions are types (class, prop) with a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_answer, levenshtein_similarity
from ..functions.values import parse_decimal
from .ranking import top_types

#: Labelled columns, or labels with embeddings, at most: each is compared with every column. More raise an error.
LABELLED = 100_000
FEATURES = ["name_similarity", "value_overlap", "token_overlap", "numeric_gap", "share_gap"]
SCORE_OF_ANSWER = 0.9


def profiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """One row per column: its name, share of numbers, and the mean and deviation of their signed logarithms."""
    number = parse_decimal(F.col("value"))
    level = F.signum(number) * F.log1p(F.abs(number))
    return cells.where(F.trim("value") != "").groupBy(*by).agg(
        F.min("column").alias("column"), F.avg(F.when(number.isNotNull(), 1.0).otherwise(0.0)).alias("numbers"), F.avg(level).alias("level"), F.stddev_pop(level).alias("spread")
    )


def overlaps(a: DataFrame, b: DataFrame, a_by: list[str], b_by: list[str], item: Column, name: str) -> DataFrame:
    """Jaccard overlap of the item sets of groups that share an item (others have none)."""
    left = a.select(*a_by, item.alias("i")).where("i <> ''").distinct()
    right = b.select(*b_by, item.alias("i")).where("i <> ''").distinct()
    na, nb = left.groupBy(*a_by).agg(F.count("*").alias("na")), right.groupBy(*b_by).agg(F.count("*").alias("nb"))
    both = left.join(right, "i").groupBy(*a_by, *b_by).agg(F.count("*").alias("n")).join(na, a_by).join(nb, b_by)
    return both.select(*a_by, *b_by, (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias(name))


def few(df: DataFrame, what: str) -> DataFrame:
    """``df`` to be broadcast, if it has ``LABELLED`` rows at most; else an error."""
    if df.limit(LABELLED + 1).count() > LABELLED:
        raise ValueError(f"over {LABELLED} {what}")
    return F.broadcast(df)


def features(cells: DataFrame, training: DataFrame) -> DataFrame:
    """(table_id, col_index, class, prop) with FEATURES for every column and every label in training: the best over its columns.

    ``cells`` has table_id, col_index, column, value; ``training`` class, prop, tcol (id of the labelled column), column, value. Every column
    is scored for every labelled column, of which there are ``LABELLED`` at most; that is checked before they are broadcast.
    """
    mine, theirs = ["table_id", "col_index"], ["class", "prop", "tcol"]
    a, b = profiles(cells, mine), profiles(training, theirs)
    pairs = a.select(*mine, F.lower("column").alias("an"), "numbers", "level", "spread").crossJoin(
        few(b.select(*theirs, F.lower("column").alias("bn"), F.col("numbers").alias("bnum"), F.col("level").alias("bl"), F.col("spread").alias("bs")), "labelled columns")
    )
    value = F.lower(F.trim("value"))
    values = overlaps(cells, training, mine, theirs, value, "value_overlap")
    words = overlaps(cells.withColumn("value", F.explode(F.split(value, r"[^\p{L}\p{N}]+"))), training.withColumn("value", F.explode(F.split(value, r"[^\p{L}\p{N}]+"))), mine, theirs, F.col("value"), "token_overlap")
    joined = pairs.join(values, [*mine, *theirs], "left").join(words, [*mine, *theirs], "left")
    gap = F.when(F.col("level").isNotNull() & F.col("bl").isNotNull(), F.exp(-F.abs(F.col("level") - F.col("bl")) - F.abs(F.coalesce("spread", F.lit(0.0)) - F.coalesce("bs", F.lit(0.0)))))
    out = joined.select(
        *mine, "class", "prop", levenshtein_similarity(F.col("an"), F.col("bn")).alias("name_similarity"), F.coalesce("value_overlap", F.lit(0.0)).alias("value_overlap"),
        F.coalesce("token_overlap", F.lit(0.0)).alias("token_overlap"), F.coalesce(gap, F.lit(0.0)).alias("numeric_gap"), (1 - F.abs(F.col("numbers") - F.col("bnum"))).alias("share_gap"),
    )
    return out.groupBy(*mine, "class", "prop").agg(*(F.max(c).alias(c) for c in FEATURES))


def fit_labeller(pairs: DataFrame, model: str = "logistic-regression", seed: int = 42) -> PipelineModel:
    """Fit on FEATURES and ``label`` (1.0 where the pair's type is the column's). ``random-forest-100`` is the other model."""
    kinds = {
        "logistic-regression": lambda: LogisticRegression(maxIter=50, regParam=1e-3),
        "random-forest-100": lambda: RandomForestClassifier(numTrees=100, maxDepth=6, seed=seed),
    }
    if model not in kinds:
        raise ValueError(f"unknown model: {model}")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), kinds[model]()]).fit(pairs)


def predict_types(model: PipelineModel, pairs: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` best types of each column: table_id, col_index, class, prop, score, rank."""
    scored = model.transform(pairs).withColumn("score", vector_to_array("probability")[1])
    return top_types(scored.select("table_id", "col_index", "class", "prop", "score"), n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null for a zero vector or arrays of unlike length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def embedding_types(columns: DataFrame, labels: DataFrame, n: int = 2) -> DataFrame:
    """Types by the cosine of column and label embeddings; ``labels`` has class, prop, embedding, and ``LABELLED`` rows at most."""
    right = labels.select("class", "prop", F.col("embedding").alias("__e"))
    scored = columns.crossJoin(few(right, "labels")).withColumn("score", cosine(F.col("embedding"), F.col("__e"))).where("score is not null")
    return top_types(scored.select("table_id", "col_index", "class", "prop", "score"), n)


def prompt_labels(properties: DataFrame, examples: DataFrame, similar: DataFrame) -> DataFrame:
    """prop and text: a property's label with its aliases and the examples most like the table's cells (``most_similar``'s result)."""
    best = similar.groupBy(F.col("label").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
    rows = properties.join(examples.select("id", F.col("aliases").alias("__a")), "id", "left").join(best, "id", "left")
    names = F.when(F.size("__a") > 0, F.concat(F.lit(" (also: "), F.array_join("__a", ", "), F.lit(")"))).otherwise(F.lit(""))
    said = F.when(F.col("v").isNotNull(), F.concat(F.lit(" e.g. "), F.array_join(F.transform("v", lambda x: x["value"]), ", "))).otherwise(F.lit(""))
    return rows.select(F.col("id").alias("prop"), F.concat("label", names, said).alias("text"))


def ask_types(columns: DataFrame, ask: Callable[[str, list[str]], str | None], schema: DataFrame, score: float = SCORE_OF_ANSWER) -> DataFrame:
    """Types by a question for each column: ``ask(name, values)`` returns a property or None; others than the schema's don't count.

    ``columns`` has table_id, col_index, column, values (array). The callable runs on executors; without a network give it a local model.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [ask(name, list(values)) for name, values in zip(frame["column"], frame["values"], strict=True)]
            yield pd.DataFrame({"table_id": frame["table_id"], "col_index": frame["col_index"], "prop": answers})

    said = columns.select("table_id", "col_index", "column", "values").mapInPandas(run, "table_id string, col_index int, prop string")
    return said.join(schema.select("class", "prop"), "prop").withColumn("score", F.lit(score)).select("table_id", "col_index", "class", "prop", "score")


def ask_literals(tables: DataFrame, ask: Callable[[str, dict[str, list[str]]], str], questions: dict[str, str]) -> DataFrame:
    """Answers about whole tables, such as a unit that no column holds: table_id, name, answer (null for not available).

    ``tables`` has table_id and ``columns`` (map of a column's name to sampled values); ``questions`` maps a name to its text; ``ask(question, columns)``
    returns the raw answer, from which the earliest quoted span counts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(t, name, ask(question, {k: list(v) for k, v in dict(columns).items()})) for t, columns in zip(frame["table_id"], frame["columns"], strict=True) for name, question in questions.items()]
            yield pd.DataFrame(rows, columns=["table_id", "name", "raw"])

    raw = tables.select("table_id", "columns").mapInPandas(run, "table_id string, name string, raw string")
    return raw.select("table_id", "name", extract_answer(F.col("raw")).alias("answer"))
