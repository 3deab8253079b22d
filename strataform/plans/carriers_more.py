"""More queries over the carrier tables: graph statistics, models, ontologies, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import uris as U
from ..functions import values as V
from ..operators import aggregates as A
from ..operators import export as X
from ..operators import graph as G
from ..operators import joins as J
from ..operators import linking as L
from ..operators import ranking as R
from ..operators import steiner as S
from ..operators import table_prep as P
from ..operators import validation as C
from ..sources import ontology as O
from ..sources import tables as T
from ..sources import training
from .carriers import _MOS, _TYPE, _connections, _graph, _triples, _types, _TYPES, _TRIPLES, col, lit, query, t


@query("SELECT p_partkey, p_brand, p_size FROM part")
def p9_remove_columns(spark, sf):
    part = t(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return P.remove_columns(part, [1, 3, 99])


@query("SELECT c_mktsegment, c_nationkey FROM customer")
def p10_keep_columns(spark, sf):
    return P.keep_columns(t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), [2, 1])


@query("""
SELECT CAST(l_suppkey AS VARCHAR) AS table_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS "row", l_returnflag AS c0, CAST(l_linenumber AS VARCHAR) AS c1
FROM lineitem""")
def s9_rows_to_cells(spark, sf):
    li = t(spark, sf, "lineitem")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    flat = li.select(col("l_suppkey").cast("string").alias("sup"), k.alias("k"), "l_returnflag", "l_linenumber")
    cells = T.rows_to_cells(flat.select("l_returnflag", "l_linenumber", "sup", "k"), col("sup"), ["k"])
    return P.spread(cells.where("col < 2"), 2)


@query("""
SELECT c_custkey AS row_index, c_name AS name, n_name AS nation, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def j4_align(spark, sf):
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation")
    key = col("c_custkey").alias("row_index")
    names = c.select(key, col("c_name").alias("name"))
    nations = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(key, col("n_name").alias("nation"))
    return J.align([names, nations, c.where("c_acctbal > 0").select(key, col("c_acctbal").alias("balance"))])


@query("SELECT o_orderstatus, o_custkey, sum(n) OVER (PARTITION BY o_orderstatus) AS total_freq FROM (SELECT o_orderstatus, o_custkey, count(*) * 1.0::DOUBLE AS n FROM orders GROUP BY 1, 2)")
def a3_with_total(spark, sf):
    n = t(spark, sf, "orders").groupBy("o_orderstatus", "o_custkey").agg((F.count("*") * 1.0).alias("n"))
    return A.with_total(n, "n", ["o_orderstatus"]).drop("n")


@query("SELECT DISTINCT l_returnflag AS table_id, l_shipmode AS value FROM (SELECT l_returnflag, CAST(l_linenumber AS VARCHAR) AS l_shipmode FROM lineitem)")
def a5_distinct_cells(spark, sf):
    return A.distinct_cells(t(spark, sf, "lineitem").select(col("l_returnflag").alias("table_id"), col("l_linenumber").cast("string").alias("value")))


@query(f"""WITH {_TYPES}, s AS (SELECT DISTINCT class AS uri, 'class' AS kind FROM types UNION SELECT DISTINCT prop, 'prop' FROM types) SELECT * FROM s""")
def a4_gold_schema(spark, sf):
    ty = _types(spark, sf)
    nodes = ty.select(col("class").alias("uri"), lit("class").alias("kind")).unionByName(ty.select(lit(None).cast("string").alias("uri"), lit("data").alias("kind")))
    classes, props = G.gold_schema(nodes, ty.select(col("prop").alias("uri")))
    return classes.select(col("class").alias("uri"), lit("class").alias("kind")).unionByName(props.select(col("prop").alias("uri"), lit("prop").alias("kind")))


@query("""
WITH p AS (SELECT 'g' AS table_id, 'n' || n_nationkey AS dst, 'c' || c_custkey AS src, c_acctbal AS score FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT table_id, dst, src, score FROM (SELECT *, row_number() OVER (PARTITION BY table_id, dst ORDER BY score DESC, src) AS k FROM p) WHERE k = 1""")
def w6_best_path(spark, sf):
    p = t(spark, sf, "customer").select(lit("g").alias("table_id"), F.concat(lit("n"), "c_nationkey").alias("dst"), F.concat(lit("c"), "c_custkey").alias("src"), lit("m").alias("mid"), lit("a").alias("key1"), lit("b").alias("key2"), col("c_acctbal").alias("score"))
    return R.best_path(p).select("table_id", "dst", "src", "score")


@query("""
WITH c AS (SELECT c_mktsegment AS prop, c_mktsegment AS qual, CAST(c_nationkey AS VARCHAR) AS source_type, CAST(count(*) AS DOUBLE) AS inherit_freq FROM customer GROUP BY 1, 3)
SELECT prop, source_type, inherit_freq FROM (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY inherit_freq DESC, source_type) AS k FROM c) WHERE k <= 5""")
def w4_top_connections(spark, sf):
    c = t(spark, sf, "customer").groupBy(col("c_mktsegment").alias("prop"), col("c_nationkey").cast("string").alias("source_type")).agg(F.count("*").cast("double").alias("inherit_freq"))
    return R.top_connections(c.withColumn("qual", col("prop")).withColumn("target_type", lit(None).cast("string")), 5, ["prop"]).select("prop", "source_type", "inherit_freq")


@query(f"""
SELECT prop, source_type, target_type, inherit_freq, freq FROM (
  SELECT c_mktsegment AS prop, n_name AS source_type, r_name AS target_type, CAST(sum(c_custkey) AS DOUBLE) AS freq, CAST(sum(c_custkey) AS DOUBLE) AS inherit_freq FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)""")
def g12_object_connections(spark, sf):
    conns, ancestors = _connections(spark, sf)
    return G.inherited(conns.where("target_type is not null"), ancestors).select("prop", "source_type", "target_type", "inherit_freq", "freq")


@query("""
WITH s AS (SELECT CAST(o_custkey % 5 AS VARCHAR) AS table_id, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1, 2), top AS (SELECT table_id, 0 AS col_index FROM s GROUP BY 1)
SELECT table_id, 'entity:0:Site' AS src, 'statement|entity:0:Site|p' || c AS dst, 'p' || c AS key, 0.5::DOUBLE AS score FROM s
UNION ALL SELECT table_id, 'statement|entity:0:Site|p' || c, 'column:' || (ascii(c) % 10 + 1), 'p' || c, 0.5::DOUBLE FROM s UNION ALL SELECT table_id, 'entity:0:Site', 'column:0', 'rdfs:label', 0.9::DOUBLE FROM top""")
def g8_statement_graph(spark, sf):
    s = t(spark, sf, "orders").select((col("o_custkey") % 5).cast("string").alias("table_id"), col("o_orderstatus").alias("c")).distinct()
    literal = s.select("table_id", (F.ascii("c") % 10 + 1).cast("int").alias("col_index"), lit("Site").alias("class"), F.concat(lit("p"), "c").alias("prop"), lit(0.5).alias("score"))
    entity = s.select("table_id").distinct().select("table_id", lit(0).alias("col_index"), lit("Site").alias("class"), lit("label").alias("prop"), lit(0.9).alias("score"))
    props = s.select(F.concat(lit("p"), "c").alias("prop")).distinct()
    data = props.select("prop", col("prop").alias("qual"), lit("Site").alias("source_type"), lit(None).cast("string").alias("target_type"), lit(1.0).alias("freq"), lit(1.0).alias("inherit_freq"), lit(1.0).alias("total_freq"))
    return G.statement_graph(literal.unionByName(entity), data, data.limit(0), entity.select("table_id", "col_index"))[1].drop("source")


@query()
def g22_tree_to_model(spark, sf):
    nodes, edges = _graph(spark, sf)
    scored = edges.withColumn("prob", F.least(col("score") / 200000, lit(1.0)))
    return S.tree_to_model(S.steiner_trees(nodes, scored), nodes)[1]


@query("""
SELECT 'http://p/' || n_name AS prop, 'http://c/' || n_regionkey AS source_type, CASE WHEN n_nationkey % 2 = 0 THEN 'http://c/' || (n_regionkey + 1) END AS target_type, CASE WHEN n_nationkey % 2 = 0 THEN 'entity' ELSE 'decimal-number' END AS datatype FROM nation""")
def g11_connections(spark, sf):
    n = t(spark, sf, "nation")
    s, none = F.concat(lit("http://p/"), "n_name").alias("s"), lit(None).cast("string")
    fact = lambda p, o: n.select(s, lit(p).alias("p"), o.alias("o"), lit("uri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    even = col("n_nationkey") % 2 == 0
    target = F.when(even, F.concat(lit("http://c/"), col("n_regionkey") + 1)).otherwise(lit(V.XSD + "decimal"))
    triples = fact(_TYPE, lit(O.PROPERTY_TYPES[0])).unionByName(fact(O.RDFS + "domain", F.concat(lit("http://c/"), "n_regionkey"))).unionByName(fact(O.RDFS + "range", target))
    props = O.read_properties(triples)
    return O.connections(props).join(O.property_views(props).select(col("uri").alias("prop"), "datatype"), "prop").select("prop", "source_type", "target_type", "datatype")


@query("SELECT 'n' || n_nationkey AS class, 'r' || n_regionkey AS ancestor, 1 AS distance FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world', 1 FROM region UNION ALL SELECT 'n' || n_nationkey, 'world', 2 FROM nation")
def g27_ancestors(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    classes = n.select(F.concat(lit("n"), "n_nationkey").alias("uri"), F.array(F.concat(lit("r"), "n_regionkey")).alias("parents")).unionByName(r.select(F.concat(lit("r"), "r_regionkey").alias("uri"), F.array(lit("world")).alias("parents")))
    return O.ancestors(classes)


@query("""
SELECT 'http://n/' || n_nationkey AS id, n_name AS label FROM nation""")
def m16_entity_labels(spark, sf):
    n, none = t(spark, sf, "nation"), lit(None).cast("string")
    row = lambda p, o, kind: n.select(F.concat(lit("http://n/"), "n_nationkey").alias("s"), lit(p).alias("p"), o.alias("o"), lit(kind).alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    return O.labels(O.read_entities(row(U.RDFS_LABEL, col("n_name"), "literal").unionByName(row("http://in", F.concat(lit("http://r/"), "n_regionkey"), "uri"))))


@query("""
SELECT 'http://d/' || s_suppkey AS s, CASE WHEN s_suppkey % 3 = 0 THEN 'https://doi.org/10.5/' || s_suppkey WHEN s_suppkey % 3 = 1 THEN 'http://u/' || s_suppkey ELSE 'http://minmod.isi.edu/papers/' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') END AS uri, s_name AS title, 2 AS n_authors FROM supplier""")
def m7_documents(spark, sf):
    s, none = t(spark, sf, "supplier"), lit(None).cast("string")
    k = col("s_suppkey")
    fact = lambda p, o: F.struct(lit(p if p == _TYPE else _MOS + p).alias("p"), o.alias("o"))
    items = F.array(
        fact(_TYPE, lit(_MOS + "Document")), fact("title", col("s_name")), fact("doi", F.when(k % 3 == 0, F.concat(lit("10.5/"), k))), fact("url", F.when(k % 3 < 2, F.concat(lit("http://u/"), k))), fact("author", lit("B")), fact("author", lit("A"))
    )
    triples = s.select(F.concat(lit("http://d/"), k).alias("s"), F.inline(items)).where("o is not null").select("s", "p", "o", lit("literal").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    return X.documents(triples).select("s", "document.uri", "document.title", F.size("document.authors").alias("n_authors"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'POINT(1 2)' WHEN c_custkey % 3 = 1 THEN printf('POINT(%.5f %.5f)', c_acctbal / 60, c_acctbal / 120) END AS location, CASE WHEN c_custkey % 2 = 0 THEN 'EPSG' ELSE 'https://minmod.isi.edu/resource/Q701' END AS crs, CASE WHEN c_custkey % 2 = 0 THEN 0.99 ELSE 0.8 END::DOUBLE AS confidence FROM customer""")
def m9_location_info(spark, sf):
    k = col("c_custkey")
    none = F.expr(f"cast(null as array<{L.CANDIDATE}>)")
    there = k % 3 == 1
    info = X.location_info(
        none, none, F.when(k % 3 == 0, "POINT(1 2)"), F.when(there, col("c_acctbal") / 120), F.when(there, col("c_acctbal") / 60), F.when(k % 2 == 0, L.candidate(lit("EPSG"), lit(True)))
    )
    rows = t(spark, sf, "customer").select("c_custkey", info.alias("i"))
    return rows.select("c_custkey", "i.location", col("i.crs.normalized_uri").alias("crs"), col("i.crs.confidence").alias("confidence"))


@query(f"""WITH {_TRIPLES} SELECT s, string_agg(o, '|' ORDER BY o) AS names FROM tr WHERE p = '{_MOS}deposit_type' GROUP BY s""")
def m11_deposit_types(spark, sf):
    return X.deposit_types(_triples(spark, sf)).select("s", F.array_join(F.array_sort(F.transform("deposit_type_candidate", lambda c: c["observed_name"])), "|").alias("names"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'POINT(' || printf('%.5f', CAST(p_size AS DOUBLE)) || ' ' || printf('%.5f', CAST(p_size AS DOUBLE)) || ')' ELSE p_name END AS wkt, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS whole FROM part""")
def m3_transformed(spark, sf):
    k = col("p_partkey")
    wkt = F.when(k % 3 == 0, F.concat(col("p_size"), lit("N "), col("p_size"), lit("E"))).otherwise(col("p_name"))
    whole = F.when(k % 2 == 0, F.concat(lit(" +"), "p_size")).otherwise(col("p_brand"))
    return t(spark, sf, "part").select("p_partkey", X.transformed(wkt, X.GEO + "wktLiteral").alias("wkt"), X.transformed(whole, V.XSD + "integer").alias("whole"))


@query("""
SELECT DISTINCT brand AS value, CASE WHEN brand = 'Copper' THEN 'commodity: Copper (Q3) 1.000' ELSE '' END AS explanation FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Copper' ELSE 'qqqq' END AS brand FROM part)""")
def m14_explain_links(spark, sf):
    labels = spark.createDataFrame([("commodity", U.NAMESPACES["mnr"] + "Q3", "Copper", None)], "kind string, id string, label string, commodity string")
    texts = t(spark, sf, "part").select(F.when(col("p_partkey") % 2 == 0, "Copper").otherwise("qqqq").alias("text"))
    return L.explain_links(L.link_units(texts, labels), labels).select("value", "explanation")


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS site, CASE WHEN c_custkey % 3 = 0 THEN 'POINT (2.5 1.5)' END AS location, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS country, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' (http://g/' || c_nationkey || ')' END AS description FROM customer""")
def v15_collapse_locations(spark, sf):
    k = col("c_custkey")
    one = lambda chosen, rejected: F.struct(
        F.struct(lit(1.5).alias("latitude"), lit(2.5).alias("longitude")).alias("location"), F.array("c_mktsegment").alias("country"), F.array(lit("x")).alias("state_or_province"), lit("mindat").alias("source"), lit(0.9).alias("confidence"),
        F.struct(col("c_name").alias("observed_name"), F.concat(lit("http://g/"), "c_nationkey").alias("normalized_uri"), chosen.alias("is_selected"), rejected.alias("rejected")).alias("metadata"),
    )
    sites = t(spark, sf, "customer").select(k.cast("string").alias("site"), F.array(one(lit(False), lit(False)), one(k % 3 < 2, k % 3 == 1)).alias("location_info"))
    i = "location_info"
    return C.collapse_locations(sites).select("site", col(f"{i}.location").alias("location"), F.try_element_at(col(f"{i}.country"), lit(1))["observed_name"].alias("country"), col(f"{i}.location_description").alias("description"))


@query("""
SELECT 'C' || n_regionkey AS class, 'p' AS prop, 'C' || n_regionkey || '---p' || chr(10) || chr(10) || '::t::' || chr(10) || 'name' || chr(10) || chr(10) || string_agg(n_name, chr(10) ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey""")
def k6_training_texts(spark, sf):
    return training.training_texts(t(spark, sf, "nation").select(F.concat(lit("C"), "n_regionkey").alias("class"), lit("p").alias("prop"), lit("t").alias("table"), lit("name").alias("column"), col("n_name").alias("value")))


@query("""
WITH a AS (SELECT 'Q' || n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey % 2 = 0) SELECT id, label FROM a UNION ALL SELECT 'Q' || r_regionkey, r_name FROM region WHERE 'Q' || r_regionkey NOT IN (SELECT id FROM a)""")
def s17_store_with_defaults(spark, sf):
    stored = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(lit("Q"), "n_nationkey").alias("id"), col("n_name").alias("label"))
    return T.with_defaults(stored, t(spark, sf, "region").select(F.concat(lit("Q"), "r_regionkey").alias("id"), col("r_name").alias("label")), "id")
