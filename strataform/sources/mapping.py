"""Declarative mappings in YAML: attributes by column, and class nodes with properties, static values and links.

The form that is read: ``attributes`` maps a name to a column index or a list of them (and its missing values); ``semantic_model`` maps a node
``mos:Class:1`` to ``properties`` (predicate, attribute, optional datatype and flag), ``static_properties`` (predicate, value, datatype) and ``links``
(predicate, node). A property ``drepr:uri`` gives the node's URI, ``drepr:blank`` a keyed blank node. Code blocks in mapping files are not run: pass Column
expressions for derived attributes instead.
"""

from __future__ import annotations

from collections.abc import Mapping

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uris import RDF_TYPE, expand

ITEM = "struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>"


class MappingError(ValueError):
    """The mapping names an attribute or a node that isn't there."""


def map_rows(df: DataFrame, text: str, derived: Mapping[str, Column] | None = None, row: str = "row_index") -> DataFrame:
    """Triples of every row under a mapping. A node whose URI or key is null is left out, with its links.

    An attribute of several columns gives a triple for each value. Values that are missing give none.
    """
    spec = yaml.safe_load(text)
    names = [c for c in df.columns if c != row]
    prefixes = spec.get("prefixes", {})

    def uri(name: str) -> str:
        prefix, _, local = name.partition(":")
        return prefixes[prefix] + local if prefix in prefixes else expand(name)

    values: dict[str, Column] = {}
    for name, a in spec.get("attributes", {}).items():
        a = a if isinstance(a, dict) else {"columns": a}
        columns, missing = a["columns"] if isinstance(a["columns"], list) else [a["columns"]], [str(m) for m in a.get("missing_values", [""])]
        cells = F.array(*(F.col(f"`{names[i]}`").cast("string") for i in columns))
        values[name] = F.filter(cells, lambda x: x.isNotNull() & ~x.isin(*missing))
    for name, c in (derived or {}).items():
        values[name] = F.filter(F.array(c.cast("string")), lambda x: x.isNotNull())

    def attribute(name: str) -> Column:
        if name not in values:
            raise MappingError(f"no attribute {name!r}")
        return values[name]

    nodes = spec["semantic_model"]
    subject, kinds = {}, {}
    for node, d in nodes.items():
        special = {p[0]: p[1] for p in d.get("properties", []) if p[0] in ("drepr:uri", "drepr:blank")}
        plain = F.concat(F.lit(f"_:{node.replace(':', '_')}_"), F.col(f"`{row}`").cast("string"))
        if "drepr:uri" in special:
            subject[node], kinds[node] = F.try_element_at(attribute(special["drepr:uri"]), F.lit(1)), "uri"
        elif "drepr:blank" in special:
            key = F.try_element_at(attribute(special["drepr:blank"]), F.lit(1))
            subject[node], kinds[node] = F.concat(F.lit(f"_:{node.replace(':', '_')}_"), F.substring(F.sha2(key, 256), 1, 16)), "bnode"
        else:
            subject[node], kinds[node] = plain, "bnode"
    null = F.lit(None).cast("string")
    item = lambda s, p, o, kind, datatype: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), null.alias("lang")).cast(ITEM)
    lists = []
    for node, d in nodes.items():
        s = subject[node]
        lists.append(F.array(item(s, RDF_TYPE, F.lit(uri(node.rpartition(":")[0] if node.rpartition(":")[2].isdigit() else node)), "uri", None)))
        for p in d.get("properties", []):
            if p[0] in ("drepr:uri", "drepr:blank"):
                continue
            datatype = uri(p[2]) if len(p) > 2 and isinstance(p[2], str) else None
            kind = "uri" if datatype and datatype.endswith("anyURI") else "literal"
            lists.append(_each(attribute(p[1]), lambda o, s=s, p=p, kind=kind, datatype=datatype: item(s, uri(p[0]), o, kind, None if kind == "uri" else datatype)))
        for p in d.get("static_properties", []):
            lists.append(F.array(item(s, uri(p[0]), F.lit(str(p[1])), "literal", uri(p[2]) if len(p) > 2 else None)))
        for p in d.get("links", []):
            if p[1] not in subject:
                raise MappingError(f"no node {p[1]!r}")
            lists.append(F.array(item(s, uri(p[0]), subject[p[1]], kinds[p[1]], None)))
    return df.select(F.inline(F.flatten(F.array(*lists)))).where("s is not null and o is not null").distinct()


def _each(values: Column, make) -> Column:
    return F.transform(values, lambda o: make(o))
