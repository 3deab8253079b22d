"""Export: a table and its semantic description to triples, and triples to nested records.

A description becomes the structure of one projection: every model edge is one triple per row, exploded in place, so a wide table goes to
triples without a join. Records are aggregated from triples by subject.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug, split_plus
from ..functions.uris import NAMESPACES, RDF_TYPE, RDFS_LABEL, document_uri
from ..functions.values import parse_coordinate, parse_decimal, parse_integer, point, valid_literal
from ..sources.models import Model
from .aggregates import merge_records
from .linking import CANDIDATE, candidate
from .ranking import text_ordinals

MOS, MNR, XSD, GEO = NAMESPACES["mos"], NAMESPACES["mnr"], NAMESPACES["xsd"], NAMESPACES["geo"]
#: The reference system of coordinates unless said otherwise, and the categories of resources and reserves.
CRS, CRS_CONFIDENCE = MNR + "Q701", 0.8
RESOURCE, RESERVE = ("Inferred", "Indicated", "Measured"), ("Proven", "Probable")
MEASURE = f"struct<value:double,unit:{CANDIDATE}>"
INVENTORY = f"struct<commodity:{CANDIDATE},date:string,ore:{MEASURE},grade:{MEASURE},category:array<{CANDIDATE}>>"
TRIPLE_ITEM = "struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>"


def datatype_of(model: Model, node: int, datatypes: Mapping[str, str]) -> str | None:
    """The only datatype that the properties into a data node have; None if they have none or several."""
    found = {datatypes.get(e.uri) for e in model.edges if e.target == node} - {None, ""}
    return found.pop() if len(found) == 1 else None


def transformed(value: Column, datatype: str | None) -> Column:
    """A cell as its datatype has it: WKT points, integers and decimals are parsed, with the raw text kept where that fails."""
    if datatype == GEO + "wktLiteral":
        return F.coalesce(parse_coordinate(value), value)
    if datatype in (XSD + "int", XSD + "integer"):
        return F.coalesce(parse_integer(value).cast("string"), value)
    if datatype == XSD + "decimal":
        return F.when(parse_decimal(value).isNotNull(), F.trim(value)).otherwise(value)
    return value


def to_triples(df: DataFrame, model: Model, row: str = "row_index", columns: Sequence[str] | None = None, datatypes: Mapping[str, str] | None = None, subjects: Mapping[int, Column] | None = None, missing: Sequence[str] = ("",)) -> DataFrame:
    """The triples of every row of ``df`` under ``model``.

    A class node is a blank node per model node and row (two inventories in a row are two nodes), unless ``subjects`` gives its URI; a row
    whose URI is null lacks that node. Cells in ``missing`` give no triple. A class node gets its type; one without any value but its type
    is kept, as the row exists. ``columns`` names the table's columns by index (all of ``df`` but ``row``, unless given).
    """
    names = list(columns or [c for c in df.columns if c != row])
    datatypes, subjects = datatypes or {}, subjects or {}
    null = F.lit(None).cast("string")

    def name_of(id: int) -> Column:
        return subjects.get(id, F.concat(F.lit(f"_:n{id}_"), F.col(f"`{row}`").cast("string")))

    def triple(s: Column, p: str, o: Column, kind: Column, datatype: str | None) -> Column:
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), kind.alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), null.alias("lang"))

    items = []
    for node in model.nodes:
        if node.kind == "class":
            items.append(triple(name_of(node.id), RDF_TYPE, F.lit(node.uri), F.lit("uri"), None))
    for e in model.edges:
        target, subject = model.node(e.target), name_of(e.source)
        if target.kind == "class":
            items.append(triple(subject, e.uri, name_of(target.id), F.lit("uri" if target.id in subjects else "bnode"), None))
        elif target.kind == "literal":
            is_entity = target.datatype == "entity-id"
            items.append(triple(subject, e.uri, F.lit(target.value), F.lit("uri" if is_entity else "literal"), None))
        else:
            kind = datatype_of(model, target.id, datatypes)
            cell = F.col(f"`{names[target.col_index]}`").cast("string")
            is_uri = kind == XSD + "anyURI"
            value = F.when(cell.isNotNull() & ~cell.isin(*missing), transformed(cell, kind))
            items.append(triple(subject, e.uri, value, F.lit("uri" if is_uri else "literal"), None if is_uri else kind))
    every = F.array(*(i.cast(TRIPLE_ITEM) for i in items))
    return df.select(F.inline(every)).where("s is not null and o is not null")


def described(triples: DataFrame) -> DataFrame:
    """One row per subject: ``s`` and ``props``, a map of predicate to its sorted values (o, o_kind, datatype).

    One exchange by subject, in one column, so every use of it in a plan can share that exchange.
    """
    value = F.struct("o", "o_kind", "datatype")
    each = triples.select("s", "p", value.alias("v")).repartition(F.col("s")).groupBy("s", "p").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return each.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("props"))


def _values(predicate: str) -> Column:
    return F.coalesce(F.element_at("props", F.lit(predicate)), F.expr("cast(array() as array<struct<o:string,o_kind:string,datatype:string>>)"))


def _wide(subjects: DataFrame, klass: str, single: Mapping[str, str], many: Mapping[str, str]) -> DataFrame:
    """Described subjects of a class with one column per property: the first value and the number of them, or all values."""
    typed = subjects.where(F.exists(_values(RDF_TYPE), lambda v: v["o"] == MOS + klass))
    return typed.select(
        "s", "props", *(F.try_element_at(_values(MOS + p), F.lit(1)).alias(name) for name, p in single.items()),
        *(F.size(_values(MOS + p)).alias(f"__n_{name}") for name, p in single.items()), *(_values(MOS + p).alias(name) for name, p in many.items()),
    )


def documents(triples: DataFrame) -> DataFrame:
    """s, document (uri, title, doi, authors), record_type of each document; a document needs a DOI, a URL or a title."""
    return _documents(described(triples))


def _documents(subjects: DataFrame) -> DataFrame:
    rows = _wide(subjects, "Document", {"title": "title", "doi": "doi", "url": "url", "kind": "record_type"}, {"authors": "author"})
    uri = document_uri(F.col("doi.o"), F.col("url.o"), F.col("title.o"))
    sure = F.coalesce(uri, F.raise_error(F.concat(F.lit("a document without title, DOI or URL: "), "s")).cast("string"))
    doc = F.struct(sure.alias("uri"), F.col("title.o").alias("title"), F.col("doi.o").alias("doi"), F.transform("authors", lambda a: a["o"]).alias("authors"))
    return rows.select("s", doc.alias("document"), F.col("kind.o").alias("record_type"))


def _link(value: Column, links: Column | None) -> Column:
    """A candidate of a triple's object struct; ``links`` is a struct (id, score) found for it, or None."""
    linked = links["id"] if links is not None else None
    score = links["score"] if links is not None else None
    return candidate(value["o"], value["o_kind"] == "uri", linked, score)


def _measure(value: Column, unit: Column, unit_link: Column | None) -> Column:
    return F.struct(parse_decimal(value["o"]).alias("value"), F.when(unit.isNotNull(), _link(unit, unit_link)).alias("unit")).cast(MEASURE)


def inventories(triples: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """s, inventory: one row per record of each inventory node (none without a commodity).

    With a valid tonnage one record, with ore, categories (``A+B`` parted) and a valid grade. Otherwise a resource record and a reserve record by
    their own tonnages, or a bare one. ``links`` has (kind, name, id, score): kinds commodity, unit, category. A grade that isn't valid is left
    out everywhere.
    """
    return _inventories(described(triples), links)


def _inventories(subjects: DataFrame, links: DataFrame | None) -> DataFrame:
    props = ("commodity", "date", "tonnage", "tonnage_unit", "grade", "grade_unit", *(f"{k}_{p}" for k in ("resource", "reserve") for p in ("tonnage", "tonnage_unit", "grade", "grade_unit")))
    rows = _wide(subjects, "MineralInventory", {p: p for p in props}, {"category": "category"})
    rows = rows.where("commodity is not null").drop("props")
    found: dict[str, Column] = {}
    units = [p for p in props if p.endswith("unit")]
    if links is not None:
        each = links.groupBy("kind", "name").agg(F.max_by(F.struct("id", "score"), F.struct("score", "id")).alias("link"))
        for p in ("commodity", *units):
            kind = "unit" if p in units else "commodity"
            side = each.where(F.col("kind") == kind).select(F.col("name").alias(f"__k_{p}"), F.col("link").alias(f"__l_{p}"))
            rows = rows.join(side, F.trim(F.col(f"{p}.o")) == F.col(f"__k_{p}"), "left")
            found[p] = F.col(f"__l_{p}")
    valid = lambda p: F.col(p).isNotNull() & F.coalesce(valid_literal(F.col(p)["o"], F.coalesce(F.col(p)["datatype"], F.lit(XSD + "double"))), F.lit(False))
    measure = lambda p: F.when(valid(p), _measure(F.col(p), F.col(f"{p}_unit"), found.get(f"{p}_unit")))
    none, no_list = F.lit(None).cast(MEASURE), F.lit(None).cast(f"array<{CANDIDATE}>")
    parts = F.flatten(F.transform("category", lambda c: F.transform(F.when(c["o_kind"] == "uri", F.array(c["o"])).otherwise(split_plus(c["o"])), lambda x: candidate(x, c["o_kind"] == "uri"))))
    own = F.when(F.size("category") > 0, parts)
    fixed = lambda names: F.array(*(candidate(F.lit(MNR + n), F.lit(True)) for n in names))

    def record(ore: Column, grade: Column, category: Column) -> Column:
        return F.struct(_link(F.col("commodity"), found.get("commodity")).alias("commodity"), F.col("date.o").alias("date"), ore.alias("ore"), grade.alias("grade"), category.alias("category")).cast(INVENTORY)

    split = F.filter(
        F.array(
            F.when(valid("resource_tonnage"), record(measure("resource_tonnage"), measure("resource_grade"), fixed(RESOURCE))),
            F.when(valid("reserve_tonnage"), record(measure("reserve_tonnage"), measure("reserve_grade"), fixed(RESERVE))),
        ),
        lambda x: x.isNotNull(),
    )
    bare = F.array(record(none, none, no_list))
    every = F.when(valid("tonnage"), F.array(record(measure("tonnage"), measure("grade"), own))).when(F.size(split) > 0, split).otherwise(bare)
    return rows.select("s", F.explode(every).alias("inventory"))


def record_ids(sites: DataFrame, record_type: Column | None = None) -> DataFrame:
    """Add record_id to sites (s, name, row_index, record_id as given, country).

    By row index; else the given id; else the name's slug if names are unique or the document has several rows per site; else, for a document
    of one row per site, name, country and the site's ordinal by (name, s); else an error.
    """
    kind = record_type if record_type is not None else F.lit(None).cast("string")
    unique = sites.agg((F.count("name") == F.count_distinct("name")).alias("__unique"))
    placed = text_ordinals(sites.select("s", "name"), "name", "s", "__ordinal")
    name = slug(F.col("name"))
    row = F.concat_ws("__", name, slug(F.col("country")), F.col("__ordinal").cast("string"))
    chosen = (
        F.when(F.col("row_index").isNotNull(), F.concat_ws("__", name, F.col("row_index").cast("string")))
        .when(F.col("record_id").isNotNull(), F.col("record_id"))
        .when(F.col("__unique") | (kind == "multirow"), name)
        .when(kind == "row", row)
        .otherwise(F.raise_error(F.concat(F.lit("no record id: "), "s")).cast("string"))
    )
    joined = sites.join(placed.select("s", "__ordinal"), "s").crossJoin(F.broadcast(unique))
    return joined.withColumn("record_id", chosen).drop("__ordinal", "__unique")


def location_info(country: Column, state: Column, location: Column, latitude: Column, longitude: Column, crs: Column) -> Column:
    """A site's location: its candidates, a given location or else the point of its coordinates (both or an error), and the reference system."""
    lone = latitude.isNotNull() & longitude.isNull()
    at = F.when(lone, F.raise_error(F.lit("a latitude without longitude")).cast("string")).otherwise(point(longitude, latitude))
    default = F.struct(F.lit(CRS).alias("normalized_uri"), F.lit(None).cast("string").alias("observed_name"), F.lit(CRS_CONFIDENCE).alias("confidence"), F.lit("SAND").alias("source")).cast(CANDIDATE)
    return F.struct(country.alias("country"), state.alias("state_or_province"), F.coalesce(location, at).alias("location"), F.coalesce(crs, default).alias("crs"))


def deposit_types(triples: DataFrame) -> DataFrame:
    """s, deposit_type_candidate: literals as candidates; nodes by their label, prelinked to their normalized_uri and confidence."""
    return _deposit_types(described(triples))


def _deposit_types(subjects: DataFrame) -> DataFrame:
    given = subjects.select("s", F.explode(_values(MOS + "deposit_type")).alias("v"))
    of = lambda p: F.try_element_at(_values(p), F.lit(1))["o"]
    about = subjects.select(F.col("s").alias("o"), of(RDFS_LABEL).alias("label"), of(MOS + "normalized_uri").alias("uri"), parse_decimal(of(MOS + "confidence")).alias("confidence"))
    nodes = given.where(F.col("v.o_kind") != "literal").select("s", F.col("v.o").alias("o")).join(about, "o")
    nodes = nodes.select("s", candidate(F.col("label"), F.lit(False), prelinked=F.col("uri"), confidence=F.col("confidence")).alias("c"))
    plain = given.where(F.col("v.o_kind") == "literal").select("s", candidate(F.col("v.o"), F.lit(False)).alias("c"))
    return plain.unionByName(nodes).groupBy("s").agg(F.array_sort(F.collect_list("c")).alias("deposit_type_candidate"))


def to_records(triples: DataFrame, created_by: str, links: DataFrame | None = None, merge: bool = True, strict: bool = True) -> DataFrame:
    """One nested record per site: record_id, source_id, name, location_info, deposit types, inventories, reference, provenance.

    All sites refer to the first document by node, or without any to the first ``source_id``; neither is an error. Sites that share a record id
    become one if ``merge`` (they have to agree in all but inventories), else they are an error. ``created_by`` starts with
    ``s/``, ``u/`` or ``a/``.
    """
    if created_by[:2] not in ("s/", "u/", "a/"):
        raise ValueError("created_by has to start with s/, u/ or a/")
    single = {p: p for p in ("name", "row_index", "record_id", "location", "latitude", "longitude", "crs", "site_type")}
    subjects = described(triples)
    sites = _wide(subjects, "MineralSite", single, {"country": "country", "state": "state_or_province"})
    if strict:
        name = F.when(F.col("__n_name") == 1, F.col("name.o")).otherwise(F.raise_error(F.concat(F.lit("not exactly one name: "), "s")).cast("string"))
    else:
        sites, name = sites.where("__n_name = 1"), F.col("name.o")
    by_source = triples.where(F.col("p") == MOS + "source_id").agg(F.min("o").alias("__source"))
    doc = _documents(subjects).agg(F.min_by(F.struct("document", "record_type"), "s").alias("__d"))
    context = doc.crossJoin(by_source).select(
        F.coalesce("__d.document", F.struct(F.coalesce("__source", F.raise_error(F.lit("neither a document nor a source id")).cast("string")).alias("uri"), *(F.lit(None).cast(k).alias(n) for n, k in (("title", "string"), ("doi", "string"), ("authors", "array<string>"))))).alias("__doc"),
        F.col("__d.record_type").alias("__kind"),
    )
    flat = sites.select(
        "s", name.alias("name"), parse_integer(F.col("row_index.o")).alias("row_index"), F.col("record_id.o").alias("record_id"), F.try_element_at("country", F.lit(1))["o"].alias("country"),
        location_info(
            F.transform("country", lambda c: _link(c, None)), F.transform("state", lambda c: _link(c, None)), F.col("location.o"), parse_decimal(F.col("latitude.o")), parse_decimal(F.col("longitude.o")),
            F.when(F.col("crs").isNotNull(), _link(F.col("crs"), None)),
        ).alias("location_info"),
        F.col("site_type.o").alias("site_type"),
    ).crossJoin(F.broadcast(context))
    named = record_ids(flat, F.col("__kind"))
    edges = sites.select("s", F.explode(F.transform(_values(MOS + "mineral_inventory"), lambda v: v["o"])).alias("__inv"))
    held = edges.join(_inventories(subjects, links).withColumnRenamed("s", "__inv"), "__inv").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("__inv", "inventory"))).alias("v"))
    held = held.select("s", F.transform("v", lambda x: x["inventory"]).alias("mineral_inventory"))
    full = named.join(_deposit_types(subjects), "s", "left").join(held, "s", "left")
    full = full.withColumn("mineral_inventory", F.coalesce("mineral_inventory", F.expr(f"cast(array() as array<{INVENTORY}>)")))
    full = full.withColumn("deposit_type_candidate", F.coalesce("deposit_type_candidate", F.expr(f"cast(array() as array<{CANDIDATE}>)")))
    same = ["name", "location_info", "deposit_type_candidate", "site_type", "__doc"]
    one = merge_records(full, "record_id", same, "mineral_inventory", strict=strict, allow=merge)
    none = F.expr("cast(array() as array<string>)")
    return one.select(
        F.col("__doc.uri").alias("source_id"), "record_id", "name", "location_info", "deposit_type_candidate", "mineral_inventory",
        F.array(F.struct(F.col("__doc").alias("document"), none.alias("page_info"))).alias("reference"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified_at"), F.lit(created_by).alias("created_by"), "site_type",
    )
