"""Ontologies and entities from triples: classes, properties, entities, defaults, connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uris import NAMESPACES, to_rel_uri
from ..operators.aggregates import resources

OWL, RDFS, SKOS, XSD, MNR = (NAMESPACES[x] for x in ("owl", "rdfs", "skos", "xsd", "mnr"))
#: What marks a property whose objects are entities, and the defaults every ontology has.
ANY_URI = XSD + "anyURI"
PROPERTY_TYPES = (OWL + "DatatypeProperty", OWL + "ObjectProperty")
UNKNOWN_CLASS, UNKNOWN_PROP, RESOURCE = MNR + "Unknown", MNR + "unknown", RDFS + "Resource"


def _values(predicate: str) -> Column:
    return F.coalesce(F.element_at("props", F.lit(predicate)), F.expr("cast(array() as array<string>)"))


def _first(predicate: str) -> Column:
    return F.try_element_at(_values(predicate), F.lit(1))


def read_classes(triples: DataFrame) -> DataFrame:
    """uri, id, label, description, aliases, parents of the classes."""
    rows = resources(triples, drop_blank=True).where(F.array_contains("types", OWL + "Class"))
    return rows.select(
        F.col("s").alias("uri"), to_rel_uri(F.col("s")).alias("id"), F.coalesce(_first(RDFS + "label"), F.lit("")).alias("label"),
        F.coalesce(_first(RDFS + "comment"), F.lit("")).alias("description"), _values(SKOS + "altLabel").alias("aliases"), _values(RDFS + "subClassOf").alias("parents"),
    )


def property_datatype(ranges: Column) -> Column:
    """The XSD range (it has to be the only one), anyURI for other ranges, ``""`` without a range."""
    literal = F.exists(ranges, lambda r: r.startswith(XSD))
    one = F.when(F.size(ranges) == 1, ranges[0]).otherwise(F.raise_error(F.lit("a data property with several ranges")).cast("string"))
    return F.when(F.size(ranges) == 0, F.lit("")).when(literal, one).otherwise(F.lit(ANY_URI))


def read_properties(triples: DataFrame) -> DataFrame:
    """uri, id, label, description, aliases, domains, ranges, datatype of the data and object properties."""
    rows = resources(triples, drop_blank=True).where(F.arrays_overlap("types", F.array(*map(F.lit, PROPERTY_TYPES))))
    return rows.select(
        F.col("s").alias("uri"), to_rel_uri(F.col("s")).alias("id"), F.coalesce(_first(RDFS + "label"), F.lit("")).alias("label"),
        F.coalesce(_first(RDFS + "comment"), F.lit("")).alias("description"), _values(SKOS + "altLabel").alias("aliases"),
        _values(RDFS + "domain").alias("domains"), _values(RDFS + "range").alias("ranges"), property_datatype(_values(RDFS + "range")).alias("datatype"),
    )


def read_entities(triples: DataFrame) -> DataFrame:
    """uri, label (an entity has to have one), description, aliases and props of all subjects that are resources."""
    rows = resources(triples, drop_blank=False).where(~F.col("s").startswith("_:"))
    label = F.coalesce(_first(RDFS + "label"), F.raise_error(F.concat(F.lit("no label: "), "s")).cast("string"))
    aliases = F.concat(_values(SKOS + "altLabel"), _values(NAMESPACES["mno"] + "aliases"))
    return rows.select(F.col("s").alias("uri"), label.alias("label"), F.coalesce(_first(RDFS + "comment"), F.lit("")).alias("description"), aliases.alias("aliases"), "props")


def labels(entities: DataFrame) -> DataFrame:
    """(id, label) of entities, classes or properties."""
    return entities.select(F.col("uri").alias("id"), "label")


def entity_metadata(entities: DataFrame) -> DataFrame:
    """What a search over entities needs: id, label, aliases, description, as one struct per row."""
    return entities.select(F.col("uri").alias("id"), F.struct("label", "aliases", "description").alias("metadata"))


def default_classes(spark: SparkSession) -> DataFrame:
    """The classes that exist in every project."""
    rows = [(UNKNOWN_CLASS, "Unknown"), (RESOURCE, "Resource")]
    empty = F.expr("cast(array() as array<string>)")
    return spark.createDataFrame(rows, "uri string, label string").select("uri", to_rel_uri(F.col("uri")).alias("id"), "label", F.lit("").alias("description"), empty.alias("aliases"), empty.alias("parents"))


def default_properties(spark: SparkSession) -> DataFrame:
    """The properties that exist in every project: ``unknown``, and a label."""
    empty = F.expr("cast(array() as array<string>)")
    rows = [(UNKNOWN_PROP, "unknown", ""), (RDFS + "label", "label", XSD + "string")]
    return spark.createDataFrame(rows, "uri string, label string, datatype string").select(
        "uri", to_rel_uri(F.col("uri")).alias("id"), "label", F.lit("").alias("description"), empty.alias("aliases"), empty.alias("domains"), empty.alias("ranges"), "datatype"
    )


def ancestors(classes: DataFrame, most: int = 32) -> DataFrame:
    """class, ancestor, distance: the transitive parents. Each round extends paths by one; ``most`` bounds the depth."""
    up = classes.select(F.col("uri").alias("class"), F.explode("parents").alias("ancestor")).distinct()
    every, last = up.withColumn("distance", F.lit(1)), up
    for k in range(2, most + 1):
        step = last.select("class", F.col("ancestor").alias("mid")).join(up.select(F.col("class").alias("mid"), "ancestor"), "mid").select("class", "ancestor").distinct()
        step = step.join(every, ["class", "ancestor"], "left_anti")
        if step.isEmpty():
            break
        every, last = every.unionByName(step.withColumn("distance", F.lit(k))), step
    return every


def connections(properties: DataFrame) -> DataFrame:
    """prop, qual, source_type, target_type, freq: one connection per property, from its only domain to its first range.

    XSD ranges count as no target (a literal). A property without exactly one domain raises an error.
    """
    domain = F.when(F.size("domains") == 1, F.col("domains")[0]).otherwise(F.raise_error(F.concat(F.lit("not exactly one domain: "), "uri")).cast("string"))
    target = F.try_element_at("ranges", F.lit(1))
    literal = target.isNull() | target.startswith(XSD)
    return properties.select(
        F.col("uri").alias("prop"), F.col("uri").alias("qual"), domain.alias("source_type"), F.when(~literal, target).alias("target_type"), F.lit(1.0).alias("freq")
    )


def property_type(properties: DataFrame) -> DataFrame:
    """prop -> (class, property) type: the first domain of each property."""
    return properties.select(F.col("uri").alias("prop"), F.try_element_at("domains", F.lit(1)).alias("class"))


def expand_meta(metas: DataFrame) -> DataFrame:
    """The target type of meta-properties: ``edges`` is an array of (source, property, target), one target being ``[target]``.

    The type is the source's class and the property of that edge; a meta-property without such an edge raises an error.
    """
    hits = F.filter("edges", lambda e: e["target"] == "[target]")
    edge = F.when(F.size(hits) > 0, hits[0]).otherwise(F.raise_error(F.concat(F.lit("no target edge: "), "id")).cast("struct<source:string,prop:string,target:string>"))
    return metas.withColumn("__e", edge).select("id", F.col("__e.source").alias("source"), F.col("__e.prop").alias("prop"))


def equivalent_property(metas: DataFrame) -> DataFrame:
    """The property that a meta-property of one edge from ``[source]`` to ``[target]`` stands for; null for longer ones."""
    edge = F.col("edges")[0]
    return metas.select("id", F.when((F.size("edges") == 1) & (edge["source"] == "[source]") & (edge["target"] == "[target]"), edge["prop"]).alias("prop"))


def entity_views(entities: DataFrame) -> DataFrame:
    """Entities as a search or an editor shows them: prefixed ids, and for each property its values as structs (kind, value)."""
    wrap = lambda v: F.struct(F.when(v.rlike("^https?://"), "entity").otherwise("string").alias("kind"), F.coalesce(to_rel_uri(v), v).alias("value"))
    props = F.map_from_entries(F.transform(F.map_entries("props"), lambda e: F.struct(F.coalesce(to_rel_uri(e["key"]), e["key"]).alias("key"), F.transform(e["value"], wrap).alias("value"))))
    return entities.select(F.coalesce(to_rel_uri(F.col("uri")), F.col("uri")).alias("id"), "label", "description", "aliases", props.alias("props"))


def property_views(properties: DataFrame) -> DataFrame:
    """Properties with the datatype's name in an editor; others than the known ones are ``unknown``."""
    names = {ANY_URI: "entity", XSD + "string": "string", XSD + "decimal": "decimal-number", XSD + "float": "decimal-number", XSD + "double": "decimal-number", XSD + "int": "integer-number", XSD + "integer": "integer-number"}
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return properties.select("id", "uri", "label", "aliases", F.coalesce(F.try_element_at(known, F.col("datatype")), F.lit("unknown")).alias("datatype"))
