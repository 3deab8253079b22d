"""Aggregations: resources from triples, best scores, merging of records, measures of agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uris import RDF_TYPE


def resources(triples: DataFrame, drop_blank: bool = False) -> DataFrame:
    """One row per subject: ``s``, ``types``, ``props`` (map of predicate to its sorted objects)."""
    rows = triples.where(F.col("o_kind") != "bnode") if drop_blank else triples
    each = rows.groupBy("s", "p").agg(F.array_sort(F.collect_list("o")).alias("o"))
    props = F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o"))))
    out = each.groupBy("s").agg(props.alias("props"))
    none = F.expr("cast(array() as array<string>)")
    return out.select("s", F.coalesce(F.element_at("props", F.lit(RDF_TYPE)), none).alias("types"), "props")


def best_labels(types: DataFrame, by: Sequence[str] = ("table_id", "col_index")) -> DataFrame:
    """The best score of each class and each property in each column: by, label, score. A type is (class, prop, score)."""
    each = types.select(*by, F.explode(F.array("class", "prop")).alias("label"), "score")
    return each.groupBy(*by, "label").agg(F.max("score").alias("score"))


def with_total(df: DataFrame, value: str, by: Sequence[str], name: str = "total_freq") -> DataFrame:
    """Add the sum of ``value`` over rows equal in ``by``."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def distinct_cells(cells: DataFrame) -> DataFrame:
    """The distinct values of each table."""
    return cells.select("table_id", "value").distinct()


def class_nodes(types: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Nodes of a candidate graph: table_id, class, n (0 ..): as many of a class as columns may belong to it, or its limit.

    ``types`` has table_id, col_index, class; ``limits`` has class, most.
    """
    counts = types.groupBy("table_id", "class").agg(F.count_distinct("col_index").cast("int").alias("__n"))
    if limits is not None:
        counts = counts.join(limits.select("class", "most"), "class", "left").withColumn("__n", F.least("__n", "most"))
    return counts.select("table_id", "class", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("n"))


def merge_records(records: DataFrame, key: str, same: Sequence[str], join: str, strict: bool = True, allow: bool = True) -> DataFrame:
    """One record per ``key``: the arrays of ``join`` concatenated, the columns ``same`` as they are.

    Records of a key that differ in ``same`` are an error; not ``strict``, they get ``consistent`` false and the least values.
    Not ``allow``: a key that repeats is an error. Arrays are put together in their own order, so the result doesn't depend on the
    order of rows.
    """
    print_ = F.sha2(F.to_json(F.struct(*same), {"ignoreNullFields": "false"}), 256)
    work = records.withColumn("__print", print_).withColumn("__order", F.sha2(F.to_json(F.struct(join)), 256))
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__order", F.col(join).alias("v")))), lambda x: x["v"]))
    first = F.min_by(F.struct(*same), F.col("__print"))
    out = work.groupBy(key).agg(first.alias("__same"), lists.alias(join), F.count_distinct("__print").alias("__n"), F.count("*").alias("__rows"))
    consistent = F.col("__n") == 1
    if strict:
        consistent = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("records differ: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    if not allow:
        consistent = F.when(F.col("__rows") > 1, F.raise_error(F.concat(F.lit("repeated record: "), F.col(key).cast("string"))).cast("boolean")).otherwise(consistent)
    return out.select(key, "__same.*", join, consistent.alias("consistent"))


def all_distinct(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by`` and ``unique``: whether no value of ``column`` repeats."""
    return df.groupBy(*by).agg((F.count(column) == F.count_distinct(column)).alias("unique"))


def exactly_one(triples: DataFrame, predicate: str, strict: bool = True) -> DataFrame:
    """(s, o) of the only object of ``predicate``; a second one is an error, or not ``strict`` leaves the subject out."""
    found = triples.where(F.col("p") == predicate).groupBy("s").agg(F.min("o").alias("o"), F.count("*").alias("n"))
    if not strict:
        return found.where("n = 1").select("s", "o")
    sure = F.when(F.col("n") == 1, F.col("o")).otherwise(F.raise_error(F.concat(F.lit("not exactly one: "), "s")).cast("string"))
    return found.select("s", sure.alias("o"))


def precision_recall(gold: DataFrame, predicted: DataFrame, by: Sequence[str], item: Sequence[str]) -> DataFrame:
    """precision, recall, f1 of each group, over distinct items; a measure without a base is 0."""
    g, p = (x.select(*by, *item).distinct() for x in (gold, predicted))
    both = g.withColumn("__g", F.lit(1)).join(p.withColumn("__p", F.lit(1)), [*by, *item], "full")
    sums = both.groupBy(*by).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("__g"), "gold"), (F.col("__p"), "predicted"), (F.col("__g") * F.col("__p"), "hits"))))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = sums.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "gold"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def macro_average(scores: DataFrame) -> DataFrame:
    """The mean precision, recall and f1 over groups."""
    return scores.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def confusion(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """(gold, predicted) label pairs by key: a gold edge that wasn't predicted is left out, an extra one has gold ``""``."""
    g, p = gold.select(*keys, F.col(label).alias("gold")), predicted.select(*keys, F.col(label).alias("predicted"))
    return p.join(g, list(keys), "left").select(*keys, F.coalesce("gold", F.lit("")).alias("gold"), "predicted")


def agreement(active: Column, agreeing: Column) -> Column:
    """Confidence of an extraction: the share of active backends that agree; null without any."""
    return F.when(active > 0, agreeing / active)


def evidence_confidence(quote: Column, box: Column, page: Column) -> Column:
    """Confidence by what anchors a value in its source: a quote with its box, a quote with its page, a quote, or nothing."""
    quoted = quote.isNotNull()
    return F.when(quoted & box.isNotNull(), F.lit(0.95)).when(quoted & page.isNotNull(), F.lit(0.80)).when(quoted, F.lit(0.55)).otherwise(F.lit(0.30))


def average_weight(weight: Column, edges: Column) -> Column:
    """The weight of a tree over its edges (one at least)."""
    return weight / F.greatest(edges, F.lit(1))
