"""Prefixes, absolute and relative URIs, and URIs of documents and resources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

#: Prefix -> namespace.
NAMESPACES = {
    "mnr": "https://minmod.isi.edu/resource/",
    "mno": "https://minmod.isi.edu/ontology/",
    "mos": "https://minmod.isi.edu/ontology-simple/",
    "geokb": "https://geokb.wikibase.cloud/entity/",
    "gemr": "https://geochemistry.isi.edu/resource/",
    "gemo": "https://geochemistry.isi.edu/ontology/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "drepr": "http://purl.org/drepr/1.0/",
}
#: Namespaces whose terms are entities of the knowledge graph itself.
MAIN = ("mno", "mos", "mnr", "gemr", "gemo", "geokb", "rdf", "rdfs", "xsd", "owl", "drepr")
RDF_TYPE = NAMESPACES["rdf"] + "type"
RDFS_LABEL = NAMESPACES["rdfs"] + "label"


def expand(term: str) -> str:
    """The absolute URI of a prefixed name (Python side); other strings come back unchanged."""
    prefix, _, rest = term.partition(":")
    return NAMESPACES[prefix] + rest if prefix in NAMESPACES and not rest.startswith("//") else term


def shorten(uri: str) -> str:
    """The prefixed name of an absolute URI (Python side), by the longest namespace; unknown URIs come back unchanged."""
    hits = [(len(ns), p) for p, ns in NAMESPACES.items() if uri.startswith(ns)]
    return f"{max(hits)[1]}:{uri[max(hits)[0]:]}" if hits else uri


def to_abs_uri(c: Column) -> Column:
    """Prefixed names made absolute. Null for an unknown prefix; absolute URIs pass."""
    spaces = F.create_map(*(F.lit(x) for pair in NAMESPACES.items() for x in pair))
    local = F.substring_index(c, ":", 1)
    named = F.concat(F.element_at(spaces, local), F.substring(c, F.length(local) + 2, F.length(c)))
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), c).otherwise(named)


def to_rel_uri(c: Column) -> Column:
    """Absolute URIs as prefixed names, by the longest namespace that fits. Null where none does."""
    out = F.lit(None).cast("string")
    for prefix, ns in sorted(NAMESPACES.items(), key=lambda x: len(x[1])):
        out = F.when(c.startswith(F.lit(ns)), F.concat(F.lit(prefix + ":"), F.substring(c, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def strip_namespace(c: Column, prefix: str = "mnr") -> Column:
    """The local name of resources in ``prefix``'s namespace; other values pass."""
    ns = NAMESPACES[prefix]
    return F.when(c.startswith(F.lit(ns)), F.substring(c, len(ns) + 1, 1 << 30)).otherwise(c)


def document_uri(doi: Column, url: Column, title: Column) -> Column:
    """A document's URI: by its DOI, else its URL, else a slug of its title."""
    return F.coalesce(F.concat(F.lit("https://doi.org/"), doi), url, F.concat(F.lit("http://minmod.isi.edu/papers/"), slug(title)))


def wrap_value(c: Column) -> Column:
    """struct(kind, value): entities of the main namespaces by prefixed name, other URIs as they are, the rest as strings."""
    main = F.lit(False)
    for prefix in MAIN:
        main = main | c.startswith(F.lit(NAMESPACES[prefix]))
    is_uri = c.rlike(r"^https?://")
    return F.struct(
        F.when(is_uri, F.lit("entity")).otherwise(F.lit("string")).alias("kind"), F.when(is_uri & main, to_rel_uri(c)).otherwise(c).alias("value")
    )
