"""Ranking: top-n with total orders, best types, last writers, ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uris import NAMESPACES

UNKNOWN = NAMESPACES["mnr"] + "Unknown"

#: Rows of the sample for each range of ``text_ordinals``.
PER_RANGE = 20


def top_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column | str], rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` has to be total. Spark cuts groups before the shuffle."""
    out = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n)
    return out.withColumnRenamed("__rank", rank) if rank else out.drop("__rank")


def top_types(types: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` best (class, prop) types of each column: score falling, then by name; ``rank`` from 1."""
    return top_n(types, n, ["table_id", "col_index"], [F.desc("score"), "class", "prop"], "rank")


def drop_unknown(ranked: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Types of the columns whose best type isn't the unknown class. Columns keep their index."""
    best = F.first("class").over(Window.partitionBy("table_id", "col_index").orderBy("rank"))
    return ranked.withColumn("__best", best).where(F.col("__best") != unknown).drop("__best")


def type_lists(labels: DataFrame) -> DataFrame:
    """table_id, col_index, types: each column's (label, score), best first, ties by name."""
    entry = F.struct((-F.col("score")).alias("o"), F.col("label"), F.col("score"))
    lists = labels.groupBy("table_id", "col_index").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return lists.select("table_id", "col_index", F.transform("t", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("types"))


def top_connections(conns: DataFrame, k: int, by: Sequence[str]) -> DataFrame:
    """The ``k`` connections of each group with the highest inherited frequency; ties by property, qualifier, types."""
    return top_n(conns, k, by, [F.desc("inherit_freq"), "prop", "qual", "source_type", F.asc_nulls_first("target_type")])


def argmax_kind(scores: DataFrame, by: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """The best row of each group by score; ties go to the kind that comes first in ``kinds``, then to the smaller id."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    return top_n(scores.withColumn("__p", place), 1, by, [F.desc("score"), "__p", "id"]).drop("__p")


def last_of_kind(rows: DataFrame, by: Sequence[str], position: str, value: Sequence[str]) -> DataFrame:
    """The last writer wins: of each group the row with the highest ``position``."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*value), F.col(position)).alias("__v")).select(*by, "__v.*")


def ordinals(df: DataFrame, order: Sequence[str], by: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Number rows from 0 by ``order`` (total) within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


def text_ordinals(df: DataFrame, text: str, tie: str, name: str = "ordinal") -> DataFrame:
    """Number all rows from 0 by ``text``, then ``tie``, without a task that holds them all.

    Rows are dealt to ranges, as many as there are shuffle partitions, whose ends come from a bounded sample; ranks within a range and the sizes of those
    before it give the number. Ranges cut rows of one text, too, by their ``tie``. ``df`` is read three times.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct(F.col(text), F.col(tie))
    some = sorted(df.select(own.alias("k")).orderBy(F.xxhash64(text, tie)).limit(PER_RANGE * parts).collect(), key=lambda r: tuple((v is not None, v) for v in r.k))
    ends = some[PER_RANGE :: PER_RANGE]
    kind = df.select(own.alias("k")).schema["k"].dataType
    cuts = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r.k, kind.fields))) for r in ends)) if ends else None
    number = F.size(F.filter(cuts, lambda c: c <= own)) if ends else F.lit(0)
    ranged = df.withColumn("__range", number)
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(len(ends) + 1):
        before.append(F.lit(total).cast("long"))
        total += sizes.get(k, 0)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(text, tie))
    return ranged.withColumn("__rank", rank).withColumn(name, F.element_at(F.array(*before), F.col("__range") + 1) + F.col("__rank") - 1).drop("__range", "__rank")


def best_path(paths: DataFrame, by: Sequence[str] = ("table_id", "dst")) -> DataFrame:
    """The path with the highest score of each group; ties by source and keys."""
    return top_n(paths, 1, by, [F.desc("score"), "src", "mid", "key1", "key2"])
