"""Linking observed names to entities: candidates, units and commodities, trusted links.

The label catalogue is a DataFrame (kind, id, label): kinds are ``unit``, ``commodity`` and ``commodity_form``, forms also
have the ``commodity`` they belong to. Scores: 1.0 for an equal label (folded case and accents), else the Levenshtein similarity if it
reaches ``LEAST``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, levenshtein_similarity, unit_tokens
from ..functions.uris import strip_namespace
from .joins import trusted_lookup
from .ranking import argmax_kind, last_of_kind

KINDS = ("unit", "commodity", "commodity_form")
LEAST, SURE = 0.75, 0.99
CANDIDATE = "struct<normalized_uri:string,observed_name:string,confidence:double,source:string>"
SOURCE = "SAND"


def folded(c: Column) -> Column:
    return F.lower(ascii_fold(F.trim(c)))


def link_names(names: DataFrame, labels: DataFrame, name: str = "name", least: float = LEAST) -> DataFrame:
    """(name, kind, id, score): the labels that each distinct name is equal or similar to.

    Equal names join by key. Only names without an equal label are compared with labels, those of every length that ``least`` allows: the shorter
    is at least ``least`` of the longer. That is a join by key too, and leaves no label out; its work grows with names times labels of like length.
    """
    asked = names.select(F.col(name).alias("name")).distinct().where("name is not null").withColumn("__f", folded(F.col("name")))
    known = labels.withColumn("__l", folded(F.col("label")))
    equal = asked.join(known, asked["__f"] == known["__l"]).select("name", "kind", "id", F.lit(1.0).alias("score"))
    rest = asked.join(equal.select("name"), "name", "left_anti").withColumn("__a", F.length("__f"))
    size = F.length("__l")
    lengths = F.sequence(F.ceil(size * least - 1e-9).cast("int"), F.floor(size / least + 1e-9).cast("int"))
    near = rest.join(known.withColumn("__b", F.explode(lengths)), F.col("__a") == F.col("__b"))
    near = near.withColumn("score", levenshtein_similarity(F.col("__f"), F.col("__l"))).where(F.col("score") >= least)
    return equal.unionByName(near.select("name", "kind", "id", "score")).groupBy("name", "kind", "id").agg(F.max("score").alias("score"))


def link_units(texts: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Unit, commodity and commodity form of each distinct text, with observed names and scores.

    Each token goes to its best kind; of tokens of one kind the last counts. A text with a form alone gets the form's commodity, with the
    form's score. Texts without any link have nulls and scores of 0.
    """
    asked = texts.select(F.col(text).alias("value")).where("value is not null").distinct()
    tokens = asked.select("value", F.posexplode(unit_tokens(F.col("value"))).alias("pos", "token"))
    best = argmax_kind(link_names(tokens, labels, "token"), ["name"], KINDS).withColumnRenamed("name", "token")
    last = last_of_kind(tokens.join(best, "token"), ["value", "kind"], "pos", ["token", "id", "score"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = last.groupBy("value").agg(
        *(pick(k, c).alias(f"{k}{s}") for k in KINDS for c, s in (("token", "_observed_value"), ("id", ""), ("score", "_score")))
    )
    forms = labels.where(F.col("kind") == "commodity_form").groupBy(F.col("id").alias("commodity_form")).agg(F.min("commodity").alias("__own"))
    done = asked.join(wide, "value", "left").join(forms, "commodity_form", "left")
    only = F.col("commodity").isNull() & F.col("__own").isNotNull()
    done = done.withColumn("commodity_score", F.when(only, F.col("commodity_form_score")).otherwise(F.col("commodity_score"))).withColumn(
        "commodity", F.coalesce("commodity", "__own")
    )
    zero = lambda k: F.coalesce(F.col(f"{k}_score"), F.lit(0.0)).alias(f"{k}_score")
    return done.select("value", *(f"{k}_observed_value" for k in KINDS), *KINDS, *map(zero, KINDS))


def explain_links(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``explanation``: the entities with their labels and scores, in words."""
    out = links
    parts = []
    for k in KINDS:
        names = labels.where(F.col("kind") == k).groupBy(F.col("id").alias(k)).agg(F.min("label").alias(f"__{k}"))
        out = out.join(names, k, "left")
        said = F.format_string(f"{k}: %s (%s) %.3f", F.col(f"__{k}"), strip_namespace(F.col(k)), F.col(f"{k}_score"))
        parts.append(F.when(F.col(k).isNotNull(), said))
    return out.select(*links.columns, F.concat_ws("; ", *parts).alias("explanation"))


def trusted_links(texts: DataFrame, trusted: DataFrame, labels: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Links by the trusted table; without ``labels`` a text that isn't there is an error, with them it is linked anew.

    New links have ``trusted`` false; ``texts`` is read twice then.
    """
    asked = texts.select(F.col(text).alias("__asked")).where("__asked is not null").distinct()
    if labels is None:
        return trusted_lookup(asked, trusted, "__asked").withColumnRenamed("__asked", "value").withColumn("trusted", F.lit(True))
    known = trusted.join(asked, trusted["value"] == asked["__asked"], "left_semi").withColumn("trusted", F.lit(True))
    new = asked.join(trusted.select(F.col("value").alias("__asked")), "__asked", "left_anti")
    return known.unionByName(link_units(new, labels, "__asked").withColumn("trusted", F.lit(False)), allowMissingColumns=True)


def grow_trusted(trusted: DataFrame, links: DataFrame) -> DataFrame:
    """The trusted table with new links appended; a value that is there stays as it is. Write it to a new place."""
    return trusted.unionByName(links.drop("trusted").join(trusted.select("value"), "value", "left_anti"), allowMissingColumns=True)


def candidate(value: Column, is_uri: Column, linked: Column | None = None, score: Column | None = None, prelinked: Column | None = None, confidence: Column | None = None) -> Column:
    """A candidate struct; null for a null value.

    A URI is its own answer, with confidence 0.99. A literal keeps its observed name, trimmed, with confidence 0, unless it is
    prelinked (0.99 by default) or was linked with a score.
    """
    none = F.lit(None).cast("string")
    link = F.coalesce(*(x for x in (prelinked, linked, none) if x is not None))
    sure = F.when(prelinked.isNotNull(), F.coalesce(confidence if confidence is not None else F.lit(SURE), F.lit(SURE))) if prelinked is not None else F.lit(None).cast("double")
    how = F.coalesce(sure, F.when(linked.isNotNull(), score) if linked is not None else F.lit(None).cast("double"), F.lit(0.0))
    literal = F.struct(link.alias("normalized_uri"), F.trim(value).alias("observed_name"), how.cast("double").alias("confidence"), F.lit(SOURCE).alias("source"))
    uri = F.struct(value.alias("normalized_uri"), none.alias("observed_name"), F.lit(SURE).alias("confidence"), F.lit(SOURCE).alias("source"))
    return F.when(value.isNull(), F.lit(None).cast(CANDIDATE)).when(is_uri, uri.cast(CANDIDATE)).otherwise(literal.cast(CANDIDATE))
