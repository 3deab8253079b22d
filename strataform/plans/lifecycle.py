"""Whole runs: label a table's columns, infer its model, export it; map files of triples; build entity stores.

Each step returns DataFrames, so only what is asked for is computed. The one thing that is collected is a table's model, a few dozen
nodes, because it becomes the structure of the export.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.export import to_records, to_triples
from ..operators.graph import edge_probabilities, simple_graph
from ..operators.labelling import features, predict_types
from ..operators.ranking import drop_unknown
from ..operators.steiner import steiner_trees, tree_to_model
from ..operators.table_prep import drop_blank
from ..sources.models import Link, Model, Node
from ..sources.ontology import labels, read_classes, read_entities, read_properties
from ..sources.tables import write_records, write_store
from ..sources.turtle import read_turtle, write_turtle


def label_columns(cells: DataFrame, training: DataFrame, model: PipelineModel, n: int = 2) -> DataFrame:
    """The best types of each column: blank cells don't count, and columns whose best type is unknown are left out."""
    return drop_unknown(predict_types(model, features(drop_blank(cells), training), n))


def infer_models(types: DataFrame, schema: DataFrame, limits: DataFrame | None = None, columns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each table's model: candidate graph, probabilities, the best tree."""
    nodes, edges = simple_graph(types, schema, limits)
    scored = edges.withColumn("st", F.when(F.col("source") == "from_stype_model", F.col("score"))).withColumn("kg", F.when(F.col("source") != "from_stype_model", F.col("score")))
    none = nodes.select("table_id", "node_id", F.lit(1.0).alias("prob")).limit(0)
    tree = steiner_trees(nodes, edge_probabilities(scored, none))
    return tree_to_model(tree, nodes, columns)


def collect_model(nodes: DataFrame, edges: DataFrame, table_id: str) -> Model:
    """One table's model as Python data."""
    own = lambda df: df.where(F.col("table_id") == table_id).collect()
    label = "label" in nodes.columns
    return Model(
        [Node(r.id, r.kind, uri=r.uri, col_index=r.col_index, label=r.label if label else None) for r in sorted(own(nodes), key=lambda r: r.id)],
        [Link(r.source, r.target, r.uri) for r in own(edges)],
    )


def export_table(df: DataFrame, model: Model, outdir: str, created_by: str, row: str = "row_index", datatypes: Mapping[str, str] | None = None, links: DataFrame | None = None, subjects: Mapping[int, Column] | None = None) -> DataFrame:
    """Write ``data.ttl`` and ``data.json`` (folders) of a table, and return its records."""
    triples = to_triples(df, model, row=row, datatypes=datatypes, subjects=subjects)
    write_turtle(triples, f"{outdir}/data.ttl")
    records = to_records(triples, created_by, links)
    write_records(records, f"{outdir}/data.json")
    return records


def map_files(spark: SparkSession, pattern: str, outdir: str, created_by: str, links: DataFrame | None = None, merge: bool = False) -> list[str]:
    """Records of each Turtle file that ``pattern`` matches, in a folder of its own name; the folders, in order. Each file is read once, by jobs of its own."""
    files = spark.read.format("binaryFile").load(pattern).select("path")  # names only: contents aren't read
    out = []
    for (name,) in sorted(map(tuple, files.collect())):
        folder = f"{outdir}/{name.rsplit('/', 1)[-1].rsplit('.', 1)[0]}"
        write_records(to_records(read_turtle(spark, name).drop("source_file"), created_by, links, merge), folder)
        out.append(folder)
    return out


def build_stores(spark: SparkSession, ontology: str, entities: str | None, outdir: str, buckets: int = 4) -> None:
    """Keyed stores of classes, properties, entities and entity labels from Turtle files."""
    triples = read_turtle(spark, ontology).drop("source_file")
    write_store(read_classes(triples), f"{outdir}/classes", "uri", buckets)
    write_store(read_properties(triples), f"{outdir}/props", "uri", buckets)
    if entities:
        found = read_entities(read_turtle(spark, entities).drop("source_file"))
        write_store(found, f"{outdir}/entities", "uri", buckets)
        write_store(labels(found), f"{outdir}/entity_labels", "id", buckets)
