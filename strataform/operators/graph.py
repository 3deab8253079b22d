"""Candidate graphs: schema statistics, nodes, edges, probabilities, pruning. All as DataFrames keyed by table_id.

Nodes: table_id, node_id, kind (class, column, entity, literal, statement), col_index, uri. Edges: table_id, src, dst, key, score, source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import class_nodes, with_total
from .ranking import top_connections

#: The floor under which an edge is not worth keeping.
FLOOR = 1e-7
FROM_TYPES, FROM_GRAPH = "from_stype_model", "from_kg_mining"


def inherited(conns: DataFrame, ancestors: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Add inherit_freq: a connection's own frequency, and those of the connections that it specialises.

    ``conns`` has prop, qual, source_type, target_type, freq; ``ancestors`` class, ancestor. Within one (prop, qual) a connection inherits
    from those whose source is an ancestor of its own, if both have no target or that one's target is an ancestor of its target.
    Descendants are drawn from classes in ``used`` (all unless given), ancestors from all connections.
    """
    own = conns
    if used is not None:
        u = used.select(F.col("class").alias("__u")).distinct()
        own = own.join(u, own["source_type"] == u["__u"], "left_semi")
        own = own.join(u, own["target_type"] == u["__u"], "left_semi").unionByName(own.where("target_type is null"))
    up = ancestors.select("class", "ancestor").distinct()
    above = conns.select(F.col("prop").alias("p"), F.col("qual").alias("q"), F.col("source_type").alias("s"), F.col("target_type").alias("t"), F.col("freq").alias("f"))
    by_source = own.join(up.toDF("c", "a"), F.col("source_type") == F.col("c")).join(
        above, (F.col("prop") == F.col("p")) & F.col("qual").eqNullSafe(F.col("q")) & (F.col("a") == F.col("s"))
    )
    literal = by_source.where("target_type is null and t is null")
    linked = by_source.where("target_type is not null and t is not null").join(up.toDF("tc", "ta"), (F.col("target_type") == F.col("tc")) & (F.col("t") == F.col("ta")), "left_semi")
    keys = ["prop", "qual", "source_type", "target_type"]
    gained = literal.select(*keys, "f").unionByName(linked.select(*keys, "f")).groupBy(*keys).agg(F.sum("f").alias("__g"))
    gained = gained.toDF(*(f"__{k}" for k in keys), "__g")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return own.join(gained, same, "left").select(*keys, "freq", (F.col("freq") + F.coalesce("__g", F.lit(0.0))).alias("inherit_freq"))


def schema_graph(conns: DataFrame, ancestors: DataFrame, props: DataFrame, classes: DataFrame, top_data: int = 5, top_object: int = 5) -> tuple[DataFrame, DataFrame]:
    """(data, object) connections with inherit_freq, total_freq: those of used properties and classes, the best few per key.

    Totals are taken before the cut: over the qualifier for data connections, over (source, target) for object connections.
    """
    used = conns.join(props.select("prop").distinct(), "prop", "left_semi")
    rows = inherited(used.select("prop", "qual", "source_type", "target_type", "freq"), ancestors, classes)
    data = with_total(rows.where("target_type is null"), "inherit_freq", ["qual"])
    objects = with_total(rows.where("target_type is not null"), "freq", ["source_type", "target_type"])
    return top_connections(data, top_data, ["prop", "qual"]), top_connections(objects, top_object, ["source_type", "target_type"])


def gold_schema(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, props) that occur in semantic models."""
    return nodes.where(F.col("kind") == "class").select(F.col("uri").alias("class")).distinct(), edges.select(F.col("uri").alias("prop")).distinct()


def column_node(index: Column) -> Column:
    return F.concat(F.lit("column:"), index.cast("string"))


def class_node(uri: Column, n: Column) -> Column:
    return F.concat_ws(":", F.lit("class"), uri, n.cast("string"))


def simple_graph(types: DataFrame, schema: DataFrame, limits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from types (table_id, col_index, class, prop, score) and schema edges (source_type, prop, target_type, score).

    Nodes: the columns, and for each class as many nodes as columns may belong to it, or its limit. Edges: from every node of a type's class
    to the column, with the type's score; and between all nodes of classes that the schema links.
    """
    classes = class_nodes(types, limits).withColumn("node_id", class_node(F.col("class"), F.col("n")))
    columns = types.select("table_id", "col_index").distinct()
    none = F.lit(None)
    nodes = classes.select("table_id", "node_id", F.lit("class").alias("kind"), none.cast("int").alias("col_index"), F.col("class").alias("uri")).unionByName(
        columns.select("table_id", column_node(F.col("col_index")).alias("node_id"), F.lit("column").alias("kind"), "col_index", none.cast("string").alias("uri"))
    )
    typed = types.join(classes, ["table_id", "class"]).select(
        "table_id", F.col("node_id").alias("src"), column_node(F.col("col_index")).alias("dst"), F.col("prop").alias("key"), "score", F.lit(FROM_TYPES).alias("source")
    )
    a = classes.select("table_id", F.col("node_id").alias("src"), F.col("class").alias("source_type"))
    b = classes.select("table_id", F.col("node_id").alias("dst"), F.col("class").alias("target_type"))
    linked = a.join(schema, "source_type").join(b, ["table_id", "target_type"]).where("src <> dst").select(
        "table_id", "src", "dst", F.col("prop").alias("key"), "score", F.lit(FROM_GRAPH).alias("source")
    )
    return nodes, typed.unionByName(linked)


def statement_graph(types: DataFrame, data: DataFrame, objects: DataFrame, entity_columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a statement node between a source and its values, from schema statistics.

    A column's class types make it an entity column: a class node of its own stands for it. A source links to a statement for each
    (source, property), and the statement to the target: the literal column whose type has that qualifier, or the class node of an entity
    column of the target type. ``data`` and ``objects`` are what ``schema_graph`` returns; scores of object edges are their
    share of the total.
    """
    entity = types.join(entity_columns.select("table_id", "col_index"), ["table_id", "col_index"], "left_semi")
    sources = entity.select("table_id", "col_index", "class", "score").distinct().withColumn("src", F.concat_ws(":", F.lit("entity"), F.col("col_index").cast("string"), "class"))
    literal = types.join(entity_columns.select("table_id", "col_index"), ["table_id", "col_index"], "left_anti")
    to_literal = sources.select("table_id", "src", F.col("class").alias("source_type")).join(data, "source_type").join(
        literal.select("table_id", F.col("col_index").alias("target"), F.col("prop").alias("qual"), F.col("score").alias("__s")), ["table_id", "qual"]
    ).select("table_id", "src", "prop", "qual", column_node(F.col("target")).alias("dst"), F.col("__s").alias("score"), F.lit(FROM_TYPES).alias("source"))
    ends = sources.select("table_id", F.col("src").alias("dst"), F.col("class").alias("target_type"))
    to_entity = sources.select("table_id", "src", F.col("class").alias("source_type")).join(objects, "source_type").join(ends, ["table_id", "target_type"]).where("src <> dst").select(
        "table_id", "src", "prop", "qual", "dst", (F.col("inherit_freq") / F.col("total_freq")).alias("score"), F.lit(FROM_GRAPH).alias("source")
    )
    links = to_literal.unionByName(to_entity).withColumn("stmt", F.concat_ws("|", F.lit("statement"), "src", "prop"))
    into = links.groupBy("table_id", "src", F.col("stmt").alias("dst"), F.col("prop").alias("key")).agg(F.max("score").alias("score"), F.min("source").alias("source"))
    out = links.groupBy("table_id", F.col("stmt").alias("src"), "dst", F.col("qual").alias("key")).agg(F.max("score").alias("score"), F.max_by("source", "score").alias("source"))
    own = sources.select("table_id", "src", column_node(F.col("col_index")).alias("dst"), F.lit("rdfs:label").alias("key"), "score", F.lit(FROM_TYPES).alias("source"))
    edges = into.unionByName(out).unionByName(own)
    ids = edges.select("table_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    head = F.substring_index(F.regexp_replace("node_id", r"\|", ":"), ":", 1)
    kind = F.when(head == "entity", F.lit("class")).otherwise(head)
    nodes = ids.select(
        "table_id", "node_id", kind.alias("kind"), F.when(kind == "column", F.substring_index("node_id", ":", -1).cast("int")).alias("col_index"),
        F.when(head == "entity", F.regexp_replace("node_id", r"^entity:[0-9]+:", "")).alias("uri"),
    )
    return nodes, edges


def edge_probabilities(edges: DataFrame, node_probs: DataFrame, weights: tuple[float, float] = (1.0, 1.0), add: bool = False) -> DataFrame:
    """Add ``prob``: the edge's score times its ends' probabilities.

    ``edges`` may carry two scores, ``st`` by types and ``kg`` by the graph: the first one that exists counts, or with ``add`` their sum.
    Edges to columns count the source's probability alone. An edge into a statement is as probable as the best edge out of it.
    Node probabilities default to 1; the best (src, dst) pair of several counts.
    """
    st, kg = (F.col(c) * w for c, w in zip(("st", "kg"), weights, strict=True))
    score = F.coalesce(st, F.lit(0.0)) + F.coalesce(kg, F.lit(0.0)) if add else F.coalesce(st, kg, F.lit(0.0))
    p = node_probs.select("table_id", "node_id", "prob")
    a, b = p.toDF("table_id", "src", "__ps"), p.toDF("table_id", "dst", "__pd")
    joined = edges.join(a, ["table_id", "src"], "left").join(b, ["table_id", "dst"], "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    target = F.when(F.col("dst").startswith("column:"), F.lit(1.0)).otherwise(one("__pd"))
    raw = joined.groupBy("table_id", "src", "dst", "key").agg(F.max(score * one("__ps") * target).alias("prob"))
    best_out = raw.where(F.col("src").startswith("statement")).groupBy("table_id", F.col("src").alias("dst")).agg(F.max("prob").alias("__out"))
    return raw.join(best_out, ["table_id", "dst"], "left").select("table_id", "src", "dst", "key", F.coalesce("__out", "prob").alias("prob"))


def prune(edges: DataFrame, floor: float = FLOOR, score: str = "score") -> DataFrame:
    """Edges that reach ``floor``; never those of 0, as weights are reciprocal."""
    return edges.where((F.col(score) >= floor) & (F.col(score) > 0))


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without statement nodes that lack edges in or out, and without the edges at them. One pass, not repeated."""
    have_in, have_out = edges.select("table_id", F.col("dst").alias("node_id")).distinct(), edges.select("table_id", F.col("src").alias("node_id")).distinct()
    statements = nodes.where(F.col("kind") == "statement")
    whole = statements.join(have_in, ["table_id", "node_id"], "left_semi").join(have_out, ["table_id", "node_id"], "left_semi")
    bad = statements.join(whole, ["table_id", "node_id"], "left_anti").select("table_id", "node_id")
    kept = nodes.join(bad, ["table_id", "node_id"], "left_anti")
    left = edges.join(bad.withColumnRenamed("node_id", "src"), ["table_id", "src"], "left_anti").join(bad.withColumnRenamed("node_id", "dst"), ["table_id", "dst"], "left_anti")
    return kept, left


def drop_standalone(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have an edge."""
    touched = edges.select("table_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(touched, ["table_id", "node_id"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """table_id, node_id, in_degree, out_degree."""
    ends = edges.select("table_id", F.explode(F.array(F.struct(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("table_id", F.col("e.n").alias("node_id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def common_roots(edges: DataFrame, terminals: DataFrame, nodes: DataFrame, most: int = 12) -> DataFrame:
    """table_id, root: the nodes, no statements, that reach every terminal. Paths are followed backwards up to ``most`` edges."""
    reached = terminals.select("table_id", F.col("node_id").alias("terminal"), "node_id")
    back = edges.select("table_id", F.col("dst").alias("node_id"), F.col("src").alias("up")).distinct()
    last = reached
    for _ in range(most):
        last = last.join(back, ["table_id", "node_id"]).select("table_id", "terminal", F.col("up").alias("node_id")).distinct().join(reached, ["table_id", "terminal", "node_id"], "left_anti")
        if last.isEmpty():
            break
        reached = reached.unionByName(last)
    wanted = terminals.groupBy("table_id").agg(F.count("*").alias("__n"))
    hits = reached.groupBy("table_id", F.col("node_id").alias("root")).agg(F.count("*").alias("__h")).join(wanted, "table_id").where("__h = __n")
    allowed = nodes.where(F.col("kind") != "statement").select("table_id", F.col("node_id").alias("root"))
    return hits.select("table_id", "root").join(allowed, ["table_id", "root"], "left_semi")


def split_unit_property(edges: DataFrame, both: str, commodity: str, unit: str) -> DataFrame:
    """Model edges in which ``both`` (a commodity that is also the grade's unit) becomes two edges to the same column."""
    uris = F.when(F.col("uri") == both, F.array(F.lit(commodity), F.lit(unit))).otherwise(F.array("uri"))
    return edges.withColumn("uri", F.explode(uris))


def add_literals(nodes: DataFrame, edges: DataFrame, klass: str, values: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Literal nodes for the properties in ``values`` that nodes of ``klass`` lack. Ids go on after each table's highest."""
    owners = nodes.where((F.col("kind") == "class") & (F.col("uri") == klass)).select("table_id", F.col("id").alias("source"))
    pairs = owners.select("table_id", "source", F.explode(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))).alias("uri", "value"))
    lacking = pairs.join(edges.select("table_id", "source", "uri"), ["table_id", "source", "uri"], "left_anti")
    top = nodes.groupBy("table_id").agg(F.max("id").alias("__top"))
    number = F.row_number().over(Window.partitionBy("table_id").orderBy("source", "uri"))
    new = lacking.join(top, "table_id").withColumn("id", F.col("__top") + number)
    more_nodes = new.select("table_id", "id", F.lit("literal").alias("kind"), "value")
    more_edges = new.select("table_id", "source", F.col("id").alias("target"), "uri")
    return nodes.unionByName(more_nodes, allowMissingColumns=True), edges.unionByName(more_edges, allowMissingColumns=True)
