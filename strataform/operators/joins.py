"""Joins of tables, of labels with catalogues, and of graph edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import levenshtein_similarity


def natural_column(source: Sequence[str], target: Sequence[str]) -> str:
    """The common column that is leftmost in ``source``; an error if there is none."""
    common = set(source) & set(target)
    for name in source:
        if name in common:
            return name
    raise ValueError("the tables have no column in common")


def disambiguate(source: Sequence[str], target: Sequence[str], key: str) -> list[str]:
    """Names for the target's columns: those that clash with the source's get their index, ``name (index)``."""
    taken = set(source)
    out = [name if name == key or name not in taken else f"{name} ({i})" for i, name in enumerate(target)]
    rest = [n for n in out if n != key]
    if len({*source, *rest}) != len(set(source)) + len(rest):
        raise ValueError(f"names still clash: {out}")
    return out


def join_tables(source: DataFrame, target: DataFrame, source_column: str | None = None, target_column: str | None = None) -> DataFrame:
    """Inner join of two tables on equal text: the source's columns, then the target's without its join column.

    Without columns the natural one is used. Empty texts match each other; nulls match nothing. Rows that
    match several fan out; rows that match none drop. Catalyst chooses the strategy.
    """
    if source_column is None:
        source_column = target_column = natural_column(source.columns, target.columns)
    target_column = target_column or source_column
    names = disambiguate(source.columns, target.columns, target_column)
    right = target.toDF(*("__key" if old == target_column else new for old, new in zip(target.columns, names, strict=True)))
    return source.join(right, source[f"`{source_column}`"] == right["__key"], "inner").drop("__key")


def with_fallback(rows: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of each row's key from ``first``, else from ``second``, else null. Both have one row per key."""
    a, b = first.select(key, F.col(value).alias("__a")), second.select(key, F.col(value).alias("__b"))
    return rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def trusted_lookup(rows: DataFrame, trusted: DataFrame, text: str, key: str = "value", strict: bool = True) -> DataFrame:
    """``trusted``'s columns by exact text. A text that isn't there raises an error, or not ``strict`` gets nulls."""
    dim = trusted.withColumnRenamed(key, "__text").withColumn("__hit", F.lit(True))
    joined = rows.join(dim, rows[text] == dim["__text"], "left").drop("__text")
    if not strict:
        return joined.drop("__hit")
    sure = F.when(F.col("__hit").isNull(), F.raise_error(F.concat(F.lit("not trusted: "), F.coalesce(F.col(text), F.lit("null")))).cast("string")).otherwise(F.col(text))
    return joined.withColumn(text, sure).drop("__hit")


def having(subjects: DataFrame, triples: DataFrame, predicate: str, negate: bool = False, subject: str = "s") -> DataFrame:
    """The subjects that have (or ``negate``: lack) a triple with ``predicate``."""
    held = triples.where(F.col("p") == predicate).select(F.col("s").alias(subject))
    return subjects.join(held, subject, "left_anti" if negate else "left_semi")


def leave_one_out(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Training rows: all but those of the held-out ids."""
    return rows.join(held.select(key), key, "left_anti")


def two_hops(edges: DataFrame) -> DataFrame:
    """Paths of two edges: table_id, src, mid, dst, first and second key, score (the sum)."""
    a = edges.select("table_id", F.col("src"), F.col("dst").alias("mid"), F.col("key").alias("key1"), F.col("score").alias("__a"))
    b = edges.select("table_id", F.col("src").alias("mid"), F.col("dst"), F.col("key").alias("key2"), F.col("score").alias("__b"))
    return a.join(b, ["table_id", "mid"]).select("table_id", "src", "mid", "dst", "key1", "key2", (F.col("__a") + F.col("__b")).alias("score"))


def most_similar(catalogue: DataFrame, cells: DataFrame, k: int = 10, least: float = 0.0, by: Sequence[str] = ("label",)) -> DataFrame:
    """The ``k`` catalogue values of each label that are most similar to some cell: label, pos, value, similarity, rank.

    ``catalogue`` has label, pos, value; ``cells`` a column value. Ties keep the catalogue's order. Cells and values are made distinct before they
    are compared, and pairs whose lengths alone rule out ``least`` never are: they meet by length, a join by key. Its work grows with distinct
    values times distinct cells of like length.
    """
    distinct = cells.select(F.col("value").alias("__cell")).where(F.trim("value") != "").distinct()
    similarity = levenshtein_similarity(F.col("value"), F.col("__cell"))
    lengths = distinct.groupBy(F.length("__cell").alias("__n")).agg(F.lit(1).alias("__one"))
    values = catalogue.select("value").where("value is not null").distinct()
    # the lengths that occur, for each length of a value: one row for each pair of lengths
    own = values.groupBy(F.length("value").alias("__l")).agg(F.lit(1).alias("__two"))
    meet = own.join(lengths, F.abs(F.col("__l") - F.col("__n")) <= (1 - least) * F.greatest("__l", "__n")).select("__l", F.col("__n").alias("__to"))
    asked = values.join(meet, F.length("value") == F.col("__l")).drop("__l")
    pairs = asked.join(distinct, F.col("__to") == F.length("__cell")).withColumn("similarity", similarity)
    top = pairs.groupBy("value").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= least)
    best = catalogue.select(*by, "pos", "value").distinct().join(top, "value").select(*by, "pos", "value", "similarity")
    order = Window.partitionBy(*by).orderBy(F.desc("similarity"), "pos")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def align(columns: Sequence[DataFrame], row: str = "row_index") -> DataFrame:
    """Columns in long form (row, value) side by side: every one aligned to the first by row."""
    out, *rest = columns
    for other in rest:
        out = out.join(other, row, "left")
    return out


def same_text(a: Column, b: Column) -> Column:
    """Equality in which nulls count as the empty string."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
