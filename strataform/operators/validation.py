"""Validation: constraints on triples, as rows of what breaks them.

Rules are data. Property rules (rows shape, class, path, kind, arg, severity, message) come from a SHACL graph or from code and are evaluated
together in a few joins, whatever their number. Cross-property rules are listed in ``CROSS_RULES``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uris import NAMESPACES, RDF_TYPE, expand
from ..functions.values import FLOATS, DECIMALS, INTEGERS, parse_decimal, parse_integer

SH, XSD = "http://www.w3.org/ns/shacl#", NAMESPACES["xsd"]
RULE = "shape string, class string, path string, kind string, arg string, severity string, message string"
#: As many rules at most are broadcast; shapes of an ontology are far fewer.
RULES = 10_000
KINDS = ("datatype", "minCount", "maxCount", "minInclusive", "maxInclusive", "class", "nodeKind")
#: Rules over several properties: (class, kind, properties, severity, message).
CROSS_RULES = [
    ("gemo:MineralResourcePaper", "any", ("gemo:paper_title", "gemo:paper_doi"), "Warning", "A paper needs a title or a DOI"),
    ("gemo:Sample", "any", ("gemo:sample_id", "gemo:sample_name"), "Warning", "A sample needs an id or a name"),
    ("gemo:Sample", "together", ("gemo:top_depth_m", "gemo:bottom_depth_m"), "Warning", "Top and bottom depth belong together"),
    ("gemo:Analysis", "any", ("gemo:element", "gemo:isotope"), "Warning", "An analysis needs an element or an isotope"),
    ("gemo:Element", "implies", ("gemo:detection_limit", "gemo:detection_limit_unit"), "Warning", "A detection limit needs its unit"),
    ("gemo:Element", "implies", ("gemo:grade", "gemo:grade_unit"), "Warning", "A grade needs its unit"),
    ("mno:LocationInfo", "point", ("mno:location",), "Violation", "A point has to lie in the physical range"),
    ("mno:Reference", "exclusive", ("mno:page_info", "gemo:artifact_info"), "Warning", "Page and artifact locators exclude each other"),
    ("gemo:TableArtifactInfo", "together", ("gemo:table_row", "gemo:table_col"), "Warning", "Row and column belong together"),
]


def point_in_range(wkt: Column) -> Column:
    """False for a POINT whose coordinates are out of range or cannot be read; true for points in range; null for other geometries."""
    rx = r"^POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$"
    lon, lat = (parse_decimal(F.regexp_extract(wkt, rx, i)) for i in (1, 2))
    return F.when(wkt.rlike(r"^POINT\s*\("), F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)))


def read_rules(triples: DataFrame) -> DataFrame:
    """Property rules of the SHACL shapes in ``triples``. A rule's own severity and message stand, else Violation and its kind."""
    at = lambda p, kind=SH: triples.where(F.col("p") == kind + p)
    targets = at("targetClass").select(F.col("s").alias("shape"), F.col("o").alias("class"))
    properties = at("property").select(F.col("s").alias("shape"), F.col("o").alias("b"))
    each = triples.where(F.col("p").startswith(SH)).groupBy(F.col("s").alias("b"), F.replace("p", F.lit(SH), F.lit("")).alias("k")).agg(F.min("o").alias("v"))
    facts = each.groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("f"))
    rules = properties.join(targets, "shape").join(facts, "b").where(F.col("f")["path"].isNotNull())
    severity = F.coalesce(F.replace(F.col("f")["severity"], F.lit(SH), F.lit("")), F.lit("Violation"))
    each = rules.select("shape", "class", F.col("f")["path"].alias("path"), severity.alias("severity"), F.col("f")["message"].alias("m"), F.explode("f").alias("kind", "arg"))
    return each.where(F.col("kind").isin(*KINDS)).select("shape", "class", "path", "kind", "arg", "severity", F.coalesce("m", F.concat_ws(" ", "kind", "arg")).alias("message"))


def rules_of(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Rules written in code, with prefixed names: (class, path, kind, arg, severity)."""
    return spark.createDataFrame([(expand(c) + "#shape", expand(c), expand(p), k, expand(str(a)), s, f"{k} {a}") for c, p, k, a, s in rows], RULE)


def _literal_fits(value: Column, datatype: Column) -> Column:
    local = F.replace(datatype, F.lit(XSD), F.lit(""))
    return (
        F.when(local.isin(*FLOATS, *DECIMALS), parse_decimal(value).isNotNull())
        .when(local.isin(*INTEGERS), parse_integer(value).isNotNull())
        .when(local == "boolean", value.isin("true", "false", "1", "0"))
        .when(local == "anyURI", ~value.contains(" "))
        .when(local == "date", value.rlike(r"^-?\d{4,}-\d{2}-\d{2}"))
        .otherwise(F.lit(True))
    )


def check_properties(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """focus, path, rule, severity, message of every broken property rule.

    Sizes of exploded triples are estimated far too low, and those of rules from code far too high, so joins get their strategies here: rules are
    counted and broadcast, all that grows with the triples is merged.
    """
    few = rules.limit(RULES + 1).count() <= RULES
    rules = F.broadcast(rules) if few else rules.hint("merge")
    typed = triples.where(F.col("p") == RDF_TYPE).select(F.col("s").alias("focus"), F.col("o").alias("class")).distinct()
    scoped = typed.join(rules, "class")
    values = triples.select(F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "datatype")
    counted = scoped.where(F.col("kind").isin("minCount", "maxCount"))
    counts = counted.join(values.groupBy("focus", "path").agg(F.count("*").alias("n")).hint("merge"), ["focus", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    number = F.col("arg").try_cast("double")
    by_count = counts.where(((F.col("kind") == "minCount") & (F.col("n") < number)) | ((F.col("kind") == "maxCount") & (F.col("n") > number)))
    valued = scoped.where(~F.col("kind").isin("minCount", "maxCount")).join(values.hint("merge"), ["focus", "path"])
    typed_as = F.coalesce("datatype", F.lit(XSD + "string"))
    real = parse_decimal(F.col("o"))
    wrong = (
        F.when(F.col("kind") == "datatype", (F.col("o_kind") != "literal") | (typed_as != F.col("arg")) | ~_literal_fits(F.col("o"), F.col("arg")))
        .when(F.col("kind") == "minInclusive", real.isNull() | (real < number))
        .when(F.col("kind") == "maxInclusive", real.isNull() | (real > number))
        .when(F.col("kind") == "nodeKind", (F.col("arg") == SH + "IRI") & (F.col("o_kind") != "uri"))
        .otherwise(F.lit(False))
    )
    by_value = valued.where(wrong)
    by_class = valued.where(F.col("kind") == "class").join(typed.select(F.col("focus").alias("o"), F.col("class").alias("arg")).hint("merge"), ["o", "arg"], "left_anti")
    out = [F.col("focus"), F.col("path"), F.col("kind").alias("rule"), F.col("severity"), F.col("message")]
    return by_count.select(*out).unionByName(by_value.select(*out)).unionByName(by_class.select(*out))


def check_cross(triples: DataFrame, rules: Sequence[tuple] = tuple(CROSS_RULES)) -> DataFrame:
    """The same rows for rules over several properties. One pass: each focus node's properties are gathered once."""
    used = sorted({expand(p) for _, _, props, _, _ in rules for p in props})
    mine = triples.where(F.col("p").isin(RDF_TYPE, *used))
    nodes = mine.groupBy(F.col("s").alias("focus")).agg(
        F.collect_set(F.when(F.col("p") == RDF_TYPE, F.col("o"))).alias("types"), F.collect_set(F.when(F.col("p") != RDF_TYPE, F.col("p"))).alias("has"),
        F.collect_set(F.when(F.col("p") == expand("mno:location"), F.col("o"))).alias("places"),
    )
    checks = []
    for klass, kind, props, severity, message in rules:
        has = [F.array_contains("has", expand(p)) for p in props]
        broken = {
            "any": lambda h=has: ~(h[0] | h[1]),
            "together": lambda h=has: h[0] != h[1],
            "implies": lambda h=has: h[0] & ~h[1],
            "exclusive": lambda h=has: h[0] & h[1],
            "point": lambda: F.exists("places", lambda w: F.coalesce(~point_in_range(w), F.lit(False))),
        }[kind]()
        found = F.struct(F.lit(expand(props[0])).alias("path"), F.lit(kind).alias("rule"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
        checks.append(F.when(F.array_contains("types", expand(klass)) & broken, found))
    return nodes.select("focus", F.inline(F.array(*checks))).where("rule is not null")


def validate(triples: DataFrame, rules: DataFrame) -> DataFrame:
    """All broken rules of both kinds."""
    return check_properties(triples, rules).unionByName(check_cross(triples))


def collapse_locations(sites: DataFrame) -> DataFrame:
    """Sites with an array ``location_info`` of candidates, reduced to the selected one; rejected or missing selections give null.

    A candidate has location (latitude, longitude), country, state_or_province (arrays of names), source, confidence and
    metadata (observed_name, normalized_uri, is_selected, rejected). Names become candidates with its source and confidence; the gazetteer's own
    address goes to the description, as it names a place record and not a country.
    """
    chosen = F.try_element_at(F.filter("location_info", lambda c: F.coalesce(c["metadata"]["is_selected"], F.lit(False))), F.lit(1))
    work = sites.withColumn("__c", chosen)
    c = F.col("__c")
    named = lambda names: F.transform(names, lambda n: F.struct(n.alias("observed_name"), c["source"].alias("source"), c["confidence"].alias("confidence")))
    place = c["location"]
    wkt = F.when(place["latitude"].isNotNull() & place["longitude"].isNotNull(), F.concat(F.lit("POINT ("), place["longitude"].cast("string"), F.lit(" "), place["latitude"].cast("string"), F.lit(")")))
    described = F.when(c["metadata"]["normalized_uri"].isNotNull(), F.format_string("%s (%s)", c["metadata"]["observed_name"], c["metadata"]["normalized_uri"])).otherwise(c["metadata"]["observed_name"])
    info = F.struct(wkt.alias("location"), named(c["country"]).alias("country"), named(c["state_or_province"]).alias("state_or_province"), c["source"].alias("location_source"), described.alias("location_description"))
    sound = c.isNotNull() & ~F.coalesce(c["metadata"]["rejected"], F.lit(False))
    return work.withColumn("location_info", F.when(sound, info)).drop("__c")
