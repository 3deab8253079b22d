"""Semantic descriptions: YAML trees, JSON graphs, and declarative mappings; as small Python models on the driver.

A model becomes the *structure* of a query (which column goes to which property), so it is Python data: a few dozen nodes and edges.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.uris import expand, shorten


@dataclass(frozen=True)
class Node:
    """A class (``uri``), a data node (``col_index``, ``label``) or a literal (``value``)."""

    id: int
    kind: str
    uri: str | None = None
    col_index: int | None = None
    label: str | None = None
    value: str | None = None
    datatype: str | None = None
    in_context: bool = False
    approximation: bool = False


@dataclass(frozen=True)
class Link:
    source: int
    target: int
    uri: str
    approximation: bool = False


@dataclass
class Model:
    """A semantic description: nodes and the edges between them."""

    nodes: list[Node] = field(default_factory=list)
    edges: list[Link] = field(default_factory=list)

    def add(self, kind: str, **values) -> int:
        self.nodes.append(Node(len(self.nodes), kind, **values))
        return len(self.nodes) - 1

    def node(self, id: int) -> Node:
        return next(n for n in self.nodes if n.id == id)

    def out(self, id: int) -> list[Link]:
        return [e for e in self.edges if e.source == id]

    def roots(self) -> list[Node]:
        targets = {e.target for e in self.edges}
        return [n for n in self.nodes if n.kind == "class" and n.id not in targets]


class DescriptionError(ValueError):
    """A description names a column that isn't there, or isn't of a known form."""


def read_description(text: str, columns: Sequence[str]) -> Model:
    """A ``simple-tree-1`` YAML description. Values are a column's name or ``{column: index}``, a list of these, ``{literal-string: text}``, or nested types.

    A name that repeats among ``columns`` means the first. ``Column N`` means column N where no column has that name.
    """
    spec = yaml.safe_load(text)
    if spec.get("version") != "simple-tree-1":
        raise DescriptionError(f"unknown version: {spec.get('version')}")
    prefixes = spec.get("prefixes", {})

    def uri(name: str) -> str:
        prefix, _, local = name.partition(":")
        return prefixes[prefix] + local if prefix in prefixes else expand(name)

    model, seen = Model(), {}

    def column(index: int) -> int:
        if not 0 <= index < len(columns):
            raise DescriptionError(f"no column {index}")
        if index not in seen:
            seen[index] = model.add("data", col_index=index, label=columns[index])
        return seen[index]

    def by_name(name: str) -> int:
        if name in columns:
            return column(list(columns).index(name))
        if name.startswith("Column ") and name[7:].isdigit():
            return column(int(name[7:]))
        raise DescriptionError(f"no column {name!r}")

    def values(value) -> list[int]:
        if isinstance(value, list):
            return [i for v in value for i in values(v)]
        if isinstance(value, dict):
            if "type" in value:
                return [tree(value)]
            if "column" in value:
                return [column(value["column"])]
            if "literal-string" in value:
                return [model.add("literal", value=str(value["literal-string"]), datatype="string")]
            raise DescriptionError(f"unknown value: {value}")
        return [by_name(str(value))]

    def tree(node: dict) -> int:
        me = model.add("class", uri=uri(node["type"]))
        for prop, value in node.get("props", {}).items():
            model.edges += [Link(me, target, uri(prop)) for target in values(value)]
        return me

    for node in spec["model"]:
        tree(node)
    return model


def write_description(model: Model, columns: Sequence[str]) -> str:
    """The YAML of a model; columns whose name repeats are written by index."""

    def value(id: int):
        n = model.node(id)
        if n.kind == "class":
            return tree(n)
        if n.kind == "literal":
            return {"literal-string": n.value}
        name = columns[n.col_index]
        return name if list(columns).count(name) == 1 else {"column": n.col_index}

    def tree(n: Node) -> dict:
        props: dict = {}
        for e in model.out(n.id):
            props.setdefault(shorten(e.uri), []).append(value(e.target))
        return {"type": shorten(n.uri), "props": {k: v[0] if len(v) == 1 else v for k, v in props.items()}}

    names = sorted({shorten(x).partition(":")[0] for x in [*(n.uri for n in model.nodes if n.uri), *(e.uri for e in model.edges)] if shorten(x) != x})
    out = {"version": "simple-tree-1", "model": [tree(n) for n in model.roots()], "prefixes": {p: expand(f"{p}:") for p in names}}
    return yaml.safe_dump(out, sort_keys=False, allow_unicode=True)


def model_from_json(obj: dict) -> Model:
    """A model of the interactive tool's JSON: nodes of three kinds told apart by their fields; approximation defaults to false."""
    model = Model()
    for n in obj["nodes"]:
        if "abs_uri" in n:
            model.nodes.append(Node(n["id"], "class", uri=n["abs_uri"], label=n.get("readable_label"), approximation=n.get("approximation") or False))
        elif "col_index" in n:
            model.nodes.append(Node(n["id"], "data", col_index=n["col_index"], label=n.get("label")))
        else:
            model.nodes.append(Node(n["id"], "literal", value=n["value"], datatype=n.get("datatype"), in_context=n.get("is_in_context") or False, label=n.get("readable_label")))
    model.edges = [Link(e["source"], e["target"], e["abs_uri"], e.get("approximation") or False) for e in obj["edges"]]
    return model


def model_to_json(model: Model) -> dict:
    """The JSON of a model, as ``model_from_json`` reads it."""
    nodes = []
    for n in model.nodes:
        if n.kind == "class":
            nodes.append({"id": n.id, "abs_uri": n.uri, "rel_uri": shorten(n.uri), "approximation": n.approximation, "readable_label": n.label})
        elif n.kind == "data":
            nodes.append({"id": n.id, "col_index": n.col_index, "label": n.label})
        else:
            nodes.append({"id": n.id, "value": n.value, "datatype": n.datatype, "is_in_context": n.in_context, "readable_label": n.label})
    edges = [{"id": i, "source": e.source, "target": e.target, "abs_uri": e.uri, "rel_uri": shorten(e.uri), "approximation": e.approximation, "readable_label": None} for i, e in enumerate(model.edges)]
    return {"version": 1, "nodes": nodes, "edges": edges}


def read_model_json(path: str) -> Model:
    """The latest version in a JSON file of model versions."""
    with open(path, encoding="utf-8") as f:
        versions = json.load(f)
    return model_from_json(max(versions, key=lambda v: v["version"]))


def models_to_frames(spark: SparkSession, models: dict[str, Model]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) DataFrames of models by table id."""
    nodes = [(t, n.id, n.kind, n.uri, n.col_index, n.label, n.value, n.datatype, n.in_context) for t, m in models.items() for n in m.nodes]
    edges = [(t, e.source, e.target, e.uri, e.approximation) for t, m in models.items() for e in m.edges]
    return (
        spark.createDataFrame(nodes, "table_id string, id int, kind string, uri string, col_index int, label string, value string, datatype string, in_context boolean"),
        spark.createDataFrame(edges, "table_id string, source int, target int, uri string, approximation boolean"),
    )
