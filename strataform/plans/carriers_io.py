"""Queries that write and read the library's formats, and the rules and labellers one by one, with SQL for what should come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import uris as U
from ..functions import values as V
from ..operators import aggregates as A
from ..operators import labelling as B
from ..operators import linking as L
from ..operators import table_prep as P
from ..operators import validation as C
from ..operators.steiner import steiner_trees
from ..session import shared_folder
from ..sources import analysis as N
from ..sources import models as M
from ..sources import ontology as O
from ..sources import tables as T
from ..sources import training as E
from ..sources.models import read_description
from ..sources.turtle import read_turtle, write_turtle
from .carriers import _DESCRIPTION, _GEMO, _LABELS, _MOS, _TRIPLES, _TYPE, QUERIES, SQL, _triples, col, lit, money, query, t
from .lifecycle import build_stores, collect_model, export_table, infer_models, map_files


def folder(spark, name: str) -> str:
    """A new folder for one run's files."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- tables ---------------------------------------------------------------------------------------------------------

_NOTES = """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name || ', "' || s_nationkey || '"' AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'two' || chr(10) || 'lines' ELSE '' END AS note FROM supplier"""


def _notes(spark, sf):
    odd = F.when(col("s_suppkey") % 2 == 0, "two\nlines")
    return t(spark, sf, "supplier").select(col("s_suppkey").cast("string").alias("id"), F.concat("s_name", lit(', "'), "s_nationkey", lit('"')).alias("name"), odd.alias("note"))


@query(_NOTES)
def s3_csv_round_trip(spark, sf):
    path = folder(spark, "csv")
    T.write_csv(_notes(spark, sf), path)
    return T.read_csv(spark, f"{path}/*.csv")


@query(f"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY CAST(id AS BIGINT)) AS r FROM ({_NOTES})), c AS (SELECT r AS "row", unnest([0, 1, 2]) AS col, unnest([id, name, note]) AS value FROM n UNION ALL SELECT 0, unnest([0, 1, 2]), unnest(['id', 'name', 'note']))
SELECT CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, 'content' AS kind, value FROM c""")
def s1_raw_cells(spark, sf):
    path = folder(spark, "raw")
    T.write_csv(_notes(spark, sf).withColumn("k", col("id").cast("long")).sort("k").drop("k"), path)
    return T.read_raw_cells(spark, f"{path}/*.csv").drop("table_id")


@query("""
WITH n AS (SELECT r_name AS table_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS "row", n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT table_id, CAST("row" AS INTEGER) AS "row", 0 AS col, 'n_name' AS name, value FROM n WHERE table_id = (SELECT r_name FROM region ORDER BY 1 LIMIT 1 OFFSET 2)""")
def s2_pick_table(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name", "n_nationkey")
    cells = T.rows_to_cells(rows, col("r_name"), ["n_nationkey"])
    return T.pick_table(cells.where("col = 0"), 2)


@query("SELECT CAST(c_nationkey AS INTEGER) AS k, count(*) AS n, count(DISTINCT c_custkey) AS customers FROM customer GROUP BY 1")
def s8_files_of_a_glob(spark, sf):
    path = folder(spark, "glob")
    t(spark, sf, "customer").select("c_custkey", col("c_nationkey").alias("k")).write.partitionBy("k").json(path)
    rows = T.files_of(spark.read.schema("c_custkey long").json(f"{path}/*/*.json"))
    return rows.groupBy(F.regexp_extract("source_file", "k=([0-9]+)", 1).cast("int").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("customers"))


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, [c_mktsegment, CAST(c_nationkey AS VARCHAR)][1] AS first FROM customer")
def k3_records_round_trip(spark, sf):
    path = folder(spark, "records")
    rows = t(spark, sf, "customer").select("c_custkey", "c_name", F.when(col("c_acctbal") > 0, col("c_acctbal")).alias("balance"), F.array("c_mktsegment", col("c_nationkey").cast("string")).alias("both"))
    T.write_records(rows, path)
    return spark.read.schema(rows.schema).json(path).select("c_custkey", "c_name", "balance", col("both")[0].alias("first"))


@query("SELECT o_orderkey, o_orderstatus, CAST(3 AS BIGINT) AS files FROM orders")
def k4_compressed_partitions(spark, sf):
    path = folder(spark, "gz")
    T.write_records(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path, 3, compress=True)
    back = T.files_of(spark.read.schema("o_orderkey long, o_orderstatus string").json(f"{path}/*.json.gz"))
    files = back.select("source_file").distinct().groupBy().agg(F.count("*").alias("files"))
    return back.drop("source_file").join(F.broadcast(files))  # one row


@query("SELECT 'c' || c_custkey AS id, c_name AS label FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'c' || c_custkey, 'unnamed' FROM customer WHERE c_custkey % 3 = 0")
def k5_keyed_store(spark, sf):
    path = folder(spark, "store")
    c = t(spark, sf, "customer").select(F.concat(lit("c"), "c_custkey").alias("id"), col("c_name").alias("label"), "c_custkey")
    T.write_store(c.where("c_custkey % 3 > 0").drop("c_custkey"), path, "id")
    return T.open_store(spark, path, "id", c.select("id", lit("unnamed").alias("label")))


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_index FROM customer")
def w10_row_index(spark, sf):
    return T.with_row_index(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"], ["c_nationkey"])


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 6")
def p17_shorten_on_overflow(spark, sf):
    def attempt(df):
        if df.count() > 6:
            raise OverflowError
        return df

    return P.shorten_until(t(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], attempt, 36)


@query("""
WITH v AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation)
SELECT r_name AS table_id, CAST(0 AS INTEGER) AS col, 'key' AS name, CAST(r AS INTEGER) AS "row", CAST(n_nationkey AS VARCHAR) AS value FROM v JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 1, 'name', CAST(r AS INTEGER), CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END FROM v JOIN region ON n_regionkey = r_regionkey""")
def s9_column_json(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.when(col("n_nationkey") % 3 > 0, col("n_name")).alias("n")))).alias("v"))
    own = lambda i, name, values: F.struct(lit(i).alias("index"), lit(name).alias("name"), values.alias("values"))
    columns = F.array(own(0, "key", F.transform("v", lambda x: x["n_nationkey"].cast("string"))), own(1, "name", F.transform("v", lambda x: x["n"])))
    one = lists.join(r, lists["n_regionkey"] == r["r_regionkey"]).select(F.struct(lit(1).alias("version"), F.struct(lit(1).alias("version"), col("r_name").alias("table_id"), columns.alias("columns")).alias("table")).alias("x"))
    path = folder(spark, "columns")
    one.groupBy().agg(F.to_json(F.collect_list("x"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return T.read_column_json(spark, path).select("table_id", "col", "name", "row", "value")


@query("""
WITH b AS (SELECT c_custkey AS r, CAST(c_nationkey AS VARCHAR) AS a, c_mktsegment AS b FROM customer WHERE c_mktsegment <> '')
SELECT 't' AS table_id, CAST(r AS INTEGER) AS "row", CAST(0 AS INTEGER) AS range, CAST(1 AS INTEGER) AS col, 'Nation' AS top, 'id' AS sub, a AS value FROM b UNION ALL SELECT 't', CAST(r AS INTEGER), 0, 2, 'Segment', 'name', b FROM b""")
def p4_headers_to_rows(spark, sf):
    c = t(spark, sf, "customer")
    body = c.select((col("c_custkey") + 2).cast("int").alias("row"), F.posexplode(F.array(col("c_custkey").cast("string"), col("c_nationkey").cast("string"), col("c_mktsegment"))).alias("col", "value"))
    heads = spark.createDataFrame([(0, 0, ""), (0, 1, "Nation"), (0, 2, "Segment"), (1, 0, "key"), (1, 1, "id"), (1, 2, "name")], "row int, col int, value string")
    cells = heads.unionByName(body).select(lit("t").alias("table_id"), "row", "col", lit("content").alias("kind"), "value")
    out = P.headers_to_rows(cells, [{"row": 0, "cols": (1, 2)}, {"row": 1, "cols": (1, 2)}], 2)
    return out.select("table_id", "row", "range", "col", col("attributes")["row0"].alias("top"), col("attributes")["row1"].alias("sub"), "value")


@query("SELECT round(avg(c_acctbal), 6) AS precision, round(avg(c_nationkey), 6) AS recall, CAST(round(avg(c_custkey), 6) AS DOUBLE) AS f1 FROM customer")
def a12_macro_average(spark, sf):
    scores = t(spark, sf, "customer").select(col("c_acctbal").alias("precision"), col("c_nationkey").alias("recall"), col("c_custkey").alias("f1"))
    done = A.macro_average(scores)
    return done.select(*(F.round(c, 6).alias(c) for c in done.columns))


# ---- documents with layouts -----------------------------------------------------------------------------------------


def _layout(spark, sf):
    """One document for each region: a table of its nations, with a header over two columns."""
    from pyspark.sql import Window

    n = t(spark, sf, "nation").withColumn("row", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    cell = lambda row, c, wide, kind, text: F.struct(row.cast("int").alias("row"), lit(c).alias("col"), lit(1).alias("row_span"), lit(wide).alias("col_span"), lit(kind).alias("kind"), text.alias("content"))
    body = n.select(F.concat(lit("r"), "n_regionkey").alias("stem"), F.inline(F.array(cell(col("row"), 0, 1, "content", col("n_name")), cell(col("row"), 1, 1, "content", col("n_nationkey").cast("string")))))
    head = n.select("n_regionkey").distinct().select(F.concat(lit("r"), "n_regionkey").alias("stem"), F.inline(F.array(cell(lit(0), 0, 2, "columnHeader", lit("Nation")))))
    return body.unionByName(head).withColumn("table", lit(0)).withColumn("pos", col("row") * 2 + col("col"))


@query("""
WITH n AS (SELECT 'r' || n_regionkey AS stem, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_name, n_nationkey FROM nation)
SELECT 0 AS tbl, CAST(r AS INTEGER) AS "row", CAST(0 AS INTEGER) AS col, 1 AS col_span, 'content' AS kind, n_name AS content FROM n UNION ALL SELECT 0, CAST(r AS INTEGER), 1, 1, 'content', CAST(n_nationkey AS VARCHAR) FROM n
UNION ALL SELECT 0, 0, 0, 2, 'columnHeader', 'Nation' FROM n GROUP BY stem""")
def k8_analysis_round_trip(spark, sf):
    path = folder(spark, "analysis")
    N.write_analysis(_layout(spark, sf), path)
    return N.read_analysis(spark, f"{path}/*/*.txt").select(F.substring_index("table_id", "_", -1).cast("int").alias("tbl"), "row", "col", "col_span", "kind", "content")


@query("""
WITH n AS (SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r, n_name, CAST(n_nationkey AS VARCHAR) AS k FROM nation)
SELECT CAST(r AS INTEGER) AS "row", CAST(0 AS INTEGER) AS col, n_name AS value FROM n UNION ALL SELECT CAST(r AS INTEGER), 1, k FROM n""")
def s6_analysed_tables(spark, sf):
    path = folder(spark, "layouts")
    N.write_analysis(_layout(spark, sf), path)
    body = N.analysed_tables(N.read_analysis(spark, f"{path}/*/*.txt"))[1]
    return body.select(col("row").cast("int").alias("row"), col("col").cast("int").alias("col"), "value")


# ---- graphs and ontologies ------------------------------------------------------------------------------------------

_XSD, _RDFS, _OWL = V.XSD, O.RDFS, O.OWL


def _facts(df, s, *items):
    """Triples from (predicate, object, kind, datatype, lang); null objects give none."""
    none = lit(None).cast("string")
    own = [F.struct(lit(p).alias("p"), o.alias("o"), lit(kind).alias("o_kind"), lit(d).cast("string").alias("datatype"), lit(g).cast("string").alias("lang")) for p, o, kind, d, g in items]
    return df.select(s.alias("s"), F.inline(F.array(*own))).where(col("o").isNotNull()).select("s", "p", "o", "o_kind", F.coalesce("datatype", none).alias("datatype"), F.coalesce("lang", none).alias("lang"))


@query(f"""
SELECT 'http://n/' || n_nationkey AS s, '{_RDFS}label' AS p, n_name || ' "' || chr(10) || '\\' AS o, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS datatype, 'en' AS lang FROM nation
UNION ALL SELECT 'http://n/' || n_nationkey, 'http://p/in', 'http://r/' || n_regionkey, 'uri', NULL, NULL FROM nation
UNION ALL SELECT 'http://n/' || n_nationkey, 'http://p/size', CAST(n_nationkey AS VARCHAR) || '.50', 'literal', '{_XSD}decimal', NULL FROM nation""")
def s7_turtle_round_trip(spark, sf):
    path, k = folder(spark, "ttl"), col("n_nationkey")
    items = [
        (_RDFS + "label", F.concat("n_name", lit(' "\n\\')), "literal", None, "en"), ("http://p/in", F.concat(lit("http://r/"), "n_regionkey"), "uri", None, None),
        ("http://p/size", F.concat(k.cast("string"), lit(".50")), "literal", _XSD + "decimal", None),
    ]
    write_turtle(_facts(t(spark, sf, "nation"), F.concat(lit("http://n/"), k), *items), path)
    return read_turtle(spark, path).drop("source_file")


def _ontology(spark, sf, path):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    uri, world = lambda p, k: F.concat(lit(p), k), lit("http://o/World")
    classes = _facts(r, uri("http://o/R", col("r_regionkey")), (_TYPE, lit(_OWL + "Class"), "uri", None, None), (_RDFS + "label", col("r_name"), "literal", None, None), (_RDFS + "subClassOf", world, "uri", None, None))
    more = _facts(n, uri("http://o/N", col("n_nationkey")), (_TYPE, lit(_OWL + "Class"), "uri", None, None), (_RDFS + "label", col("n_name"), "literal", None, None), (_RDFS + "subClassOf", uri("http://o/R", col("n_regionkey")), "uri", None, None))
    even = col("n_nationkey") % 2 == 0
    props = _facts(
        n, uri("http://o/p", col("n_nationkey")), (_TYPE, F.when(even, O.PROPERTY_TYPES[0]).otherwise(O.PROPERTY_TYPES[1]), "uri", None, None), (_RDFS + "label", F.concat(lit("has "), "n_name"), "literal", None, None),
        (_RDFS + "domain", uri("http://o/N", col("n_nationkey")), "uri", None, None), (_RDFS + "range", F.when(even, _XSD + "string").otherwise(uri("http://o/R", col("n_regionkey"))), "uri", None, None),
    )
    write_turtle(classes.unionByName(more).unionByName(props), path)
    return path


@query("""
SELECT 'http://o/R' || r_regionkey AS uri, r_name AS label, 'http://o/World' AS parent FROM region UNION ALL SELECT 'http://o/N' || n_nationkey, n_name, 'http://o/R' || n_regionkey FROM nation""")
def s10_classes_of_a_file(spark, sf):
    triples = read_turtle(spark, _ontology(spark, sf, folder(spark, "classes"))).drop("source_file")
    return O.read_classes(triples).select("uri", "label", col("parents")[0].alias("parent"))


@query(f"""
SELECT 'http://o/p' || n_nationkey AS uri, 'has ' || n_name AS label, 'http://o/N' || n_nationkey AS domain, CASE WHEN n_nationkey % 2 = 0 THEN '{_XSD}string' ELSE '{O.ANY_URI}' END AS datatype FROM nation""")
def s10_properties_of_a_store(spark, sf):
    out = folder(spark, "stores")
    build_stores(spark, _ontology(spark, sf, folder(spark, "props")), None, out)
    return T.open_store(spark, f"{out}/props", "uri").select("uri", "label", col("domains")[0].alias("domain"), "datatype")


@query(f"SELECT * FROM (VALUES ('{O.UNKNOWN_PROP}', 'unknown', ''), ('{_RDFS}label', 'label', '{_XSD}string')) v(uri, label, datatype)")
def g26_default_properties(spark, sf):
    return O.default_properties(spark).select("uri", "label", "datatype")


@query("SELECT 'http://n/' || n_nationkey AS id, n_name AS label, CAST(1 AS INTEGER) AS n_aliases, 'about ' || n_name AS description FROM nation")
def m17_entity_metadata(spark, sf):
    items = [(_RDFS + "label", col("n_name"), "literal", None, None), (_RDFS + "comment", F.concat(lit("about "), "n_name"), "literal", None, None), (O.SKOS + "altLabel", F.lower("n_name"), "literal", None, None)]
    found = O.entity_metadata(O.read_entities(_facts(t(spark, sf, "nation"), F.concat(lit("http://n/"), "n_nationkey"), *items)))
    return found.select("id", "metadata.label", F.size("metadata.aliases").alias("n_aliases"), "metadata.description")


@query("""
WITH s AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'entity' ELSE 'decimal-number' END AS datatype, count(*) AS n FROM nation GROUP BY 1) SELECT * FROM s""")
def m17_property_views(spark, sf):
    n = t(spark, sf, "nation")
    kind = F.when(col("n_nationkey") % 2 == 0, O.ANY_URI).otherwise(_XSD + "double")
    rows = n.select(F.concat(lit("p"), "n_nationkey").alias("id"), col("n_name").alias("uri"), col("n_name").alias("label"), F.array().cast("array<string>").alias("aliases"), kind.alias("datatype"))
    return O.property_views(rows).groupBy("datatype").agg(F.count("*").alias("n"))


# ---- training data and labellers ------------------------------------------------------------------------------------


@query("SELECT 'http://r/' || r_regionkey AS id, lower(r_name) AS alias, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n_values FROM region")
def s12_example_catalogue(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    lists = n.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("values"))
    one = r.join(lists, r["r_regionkey"] == lists["n_regionkey"]).select(F.struct(F.concat(lit("http://r/"), "r_regionkey").alias("id"), F.array(F.lower("r_name")).alias("aliases"), "values").alias("x"))
    path = folder(spark, "examples")
    one.groupBy().agg(F.to_json(F.collect_list("x")).alias("value")).write.text(path)
    return E.read_examples(spark, path).select("id", col("aliases")[0].alias("alias"), F.size("values").cast("long").alias("n_values"))


@query("SELECT 'nation' || c_nationkey AS \"column\", CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS pos, c_name AS value FROM customer")
def s13_column_corpus(spark, sf):
    path = folder(spark, "corpus")
    lists = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("v"))
    text = F.concat(lit("nation"), "c_nationkey", lit("\n"), F.array_join(F.transform("v", lambda x: x["c_name"]), "\n"))
    lists.select("c_nationkey", text.alias("value")).write.partitionBy("c_nationkey").text(path)
    return E.read_column_corpus(spark, f"{path}/*/*.txt").drop("stem")


@query("""
WITH r AS (SELECT n_regionkey, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS r FROM nation WHERE n_regionkey > 0)
SELECT 'model ' || n_regionkey AS description, CAST(r AS INTEGER) AS "row", unnest(['key', 'full, name']) AS "column", unnest([CAST(n_nationkey AS VARCHAR), n_name]) AS value FROM r""")
def s13_labelled_dataset(spark, sf):
    path, n = folder(spark, "dataset"), t(spark, sf, "nation")
    line = F.concat(col("n_nationkey").cast("string"), lit(","), "n_name")
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("v"))
    tables = lists.select(F.concat(lit("t"), "n_regionkey").alias("stem"), F.concat(lit('key,"full, name"\n'), F.array_join(F.transform("v", lambda x: x["line"]), "\n")).alias("value"))
    tables.write.partitionBy("stem").text(f"{path}/tables")
    said = lists.where("n_regionkey > 0").select(F.concat(lit("t"), "n_regionkey").alias("stem"), F.concat(lit("model "), "n_regionkey").alias("value"))
    said.write.partitionBy("stem").text(f"{path}/descriptions")
    pairs = E.read_dataset(spark, path)
    return E.table_cells(pairs).join(pairs.select("stem", F.trim(F.replace("description", lit("\n"), lit(""))).alias("description")), "stem").select("description", "row", "column", "value")


@query("SELECT 'C' || n_regionkey AS class, 'p' AS prop, 't' AS \"table\", 'name' AS \"column\", n_name AS value FROM nation")
def k6_training_files(spark, sf):
    path = folder(spark, "training")
    E.write_training(t(spark, sf, "nation").select(F.concat(lit("C"), "n_regionkey").alias("class"), lit("p").alias("prop"), lit("t").alias("table"), lit("name").alias("column"), col("n_name").alias("value")), path)
    return E.read_training(spark, f"{path}/*/*/*.txt").where("value <> ''").select("class", "prop", "table", "column", "value")


@query("""
WITH l AS (SELECT 'c' || r_regionkey AS class, 'p' AS prop, CAST(r_regionkey AS DOUBLE) AS a, CAST(r_regionkey + 3 AS DOUBLE) AS b FROM region), c AS (SELECT c_custkey, CAST(c_nationkey + 1 AS DOUBLE) AS a, CAST(c_custkey % 7 AS DOUBLE) AS b FROM customer),
s AS (SELECT 't' AS table_id, CAST(c_custkey AS INTEGER) AS col_index, class, prop, (c.a * l.a + c.b * l.b) / (sqrt(c.a * c.a + c.b * c.b) * sqrt(l.a * l.a + l.b * l.b)) AS score FROM c, l)
SELECT table_id, col_index, class, prop, round(score, 9) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY col_index ORDER BY score DESC, class, prop) AS k FROM s) WHERE k <= 2""")
def g3_embedding_types(spark, sf):
    labels = t(spark, sf, "region").select(F.concat(lit("c"), "r_regionkey").alias("class"), lit("p").alias("prop"), F.array(col("r_regionkey").cast("double"), (col("r_regionkey") + 3).cast("double")).alias("embedding"))
    columns = t(spark, sf, "customer").select(lit("t").alias("table_id"), col("c_custkey").cast("int").alias("col_index"), F.array((col("c_nationkey") + 1).cast("double"), (col("c_custkey") % 7).cast("double")).alias("embedding"))
    return B.embedding_types(columns, labels).withColumn("score", F.round("score", 9))


@query("""
WITH a AS (SELECT CAST(s_nationkey AS VARCHAR) AS table_id, CAST(s_suppkey AS INTEGER) AS col_index, CASE WHEN s_suppkey % 3 = 0 THEN 'name' WHEN s_suppkey % 3 = 1 THEN 'size' END AS prop FROM supplier)
SELECT table_id, col_index, CASE prop WHEN 'name' THEN 'Site' ELSE 'Ore' END AS class, prop, 0.9::DOUBLE AS score FROM a WHERE prop IS NOT NULL""")
def g4_asked_types(spark, sf):
    columns = t(spark, sf, "supplier").select(col("s_nationkey").cast("string").alias("table_id"), col("s_suppkey").cast("int").alias("col_index"), F.concat(lit("c"), (col("s_suppkey") % 3).cast("string")).alias("column"), F.array("s_name").alias("values"))
    schema = spark.createDataFrame([("Site", "name"), ("Ore", "size")], "class string, prop string")
    return B.ask_types(columns, lambda name, values: {"c0": "name", "c1": "size", "c2": "no property of the schema"}[name], schema)


@query("""
SELECT CAST(s_nationkey AS VARCHAR) AS table_id, 'unit' AS name, CASE WHEN min(s_suppkey) % 2 = 0 THEN 'g/t' END AS answer FROM supplier GROUP BY s_nationkey""")
def g5_asked_literals(spark, sf):
    tables = t(spark, sf, "supplier").groupBy(col("s_nationkey").cast("string").alias("table_id")).agg(F.create_map(lit("key"), F.array(F.min("s_suppkey").cast("string"))).alias("columns"))
    return B.ask_literals(tables, lambda question, columns: 'It is "g/t", not "%"' if int(columns["key"][0]) % 2 == 0 else '"N/A"', {"unit": "Which unit?"})


@query("""
WITH s AS (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS v FROM nation GROUP BY 1)
SELECT 'r' || r_regionkey AS prop, r_name || ' (also: ' || lower(r_name) || ')' || ' e.g. ' || v AS text FROM region JOIN s ON n_regionkey = r_regionkey""")
def g6_prompt_context(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    key = F.concat(lit("r"), "r_regionkey")
    similar = n.select(F.concat(lit("r"), "n_regionkey").alias("label"), col("n_nationkey").alias("rank"), col("n_name").alias("value"))
    return B.prompt_labels(r.select(key.alias("id"), col("r_name").alias("label")), r.select(key.alias("id"), F.array(F.lower("r_name")).alias("aliases")), similar)


@query("""
WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS table_id, 0 AS col_index, lower(trim(c_mktsegment)) AS v FROM customer GROUP BY 1, 2, 3), l AS (SELECT 'C' || (c_custkey % 4) AS class, lower(trim(c_mktsegment)) AS v FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1, 2),
nc AS (SELECT table_id, col_index, count(*) AS n FROM c GROUP BY 1, 2), nl AS (SELECT class, count(*) AS n FROM l GROUP BY 1), b AS (SELECT table_id, col_index, class, count(*) AS n FROM c JOIN l USING (v) GROUP BY 1, 2, 3)
SELECT nc.table_id, CAST(nc.col_index AS INTEGER) AS col_index, nl.class, 'p' AS prop, round(1 - levenshtein('seg', 'segment') / 7.0::DOUBLE, 9) AS name_similarity, round(COALESCE(b.n / CAST(nc.n + nl.n - b.n AS DOUBLE), 0), 9) AS value_overlap, 1.0::DOUBLE AS share_gap
FROM nc CROSS JOIN nl LEFT JOIN b ON b.table_id = nc.table_id AND b.col_index = nc.col_index AND b.class = nl.class""")
def g1_column_features(spark, sf):
    c = t(spark, sf, "customer")
    cells = c.select(col("c_nationkey").cast("string").alias("table_id"), lit(0).alias("col_index"), lit("Seg").alias("column"), col("c_mktsegment").alias("value"))
    label = F.concat(lit("C"), (col("c_custkey") % 4).cast("string"))
    training = c.where("c_custkey % 4 < 3").select(label.alias("class"), lit("p").alias("prop"), label.alias("tcol"), lit("segment").alias("column"), col("c_mktsegment").alias("value"))
    rounded = lambda x: F.round(x, 9).alias(x)
    return B.features(cells, training).select("table_id", "col_index", "class", "prop", rounded("name_similarity"), rounded("value_overlap"), "share_gap")


# ---- links, trees, models -------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT DISTINCT CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN '%copper' WHEN 1 THEN 'Gold%' ELSE 'zzzz' END AS value FROM part)
SELECT value, CASE WHEN value <> 'zzzz' THEN 'Q1' END AS unit, CASE value WHEN '%copper' THEN 'trusted' WHEN 'Gold%' THEN 'Q5' END AS commodity FROM v""")
def m13_trusted_links_grow(spark, sf):
    labels = spark.createDataFrame(_LABELS, "kind string, id string, label string, commodity string")
    texts = t(spark, sf, "part").select(F.element_at(F.array(*map(lit, ("%copper", "Gold%", "zzzz"))), (col("p_partkey") % 3 + 1).cast("int")).alias("text"))
    trusted = L.link_units(texts.where("text = '%copper'"), labels).withColumn("commodity", lit("trusted"))
    return L.grow_trusted(trusted, L.trusted_links(texts, trusted, labels)).select("value", "unit", "commodity")


@query("SELECT o_custkey, sum(o_orderkey) / CAST(greatest(count(*) - 1, 1) AS DOUBLE) AS average FROM orders GROUP BY 1")
def a14_average_weight(spark, sf):
    trees = t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_orderkey").alias("w"), (F.count("*") - 1).alias("n"))
    return trees.select("o_custkey", A.average_weight(col("w"), col("n")).alias("average"))


@query("""
WITH e AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS table_id, 'class:' || o_orderpriority AS src, 'column:' || o_orderstatus AS dst, 'p' || (o_orderkey % 3) AS key, max(floor(o_totalprice)) / 1e6::DOUBLE AS prob FROM orders GROUP BY 1, 2, 3, 4),
b AS (SELECT table_id, src, dst, max(prob) AS prob, arg_max(key, prob) AS key FROM e GROUP BY 1, 2, 3), n AS (SELECT table_id, count(DISTINCT dst) AS n FROM e GROUP BY 1),
r AS (SELECT table_id, src, sum(1.0 / prob) AS cost FROM b JOIN n USING (table_id) GROUP BY table_id, src, n HAVING count(*) = n), best AS (SELECT table_id, arg_min(src, cost) AS src FROM r GROUP BY 1)
SELECT b.table_id, b.src, b.dst, b.key, b.prob FROM b JOIN best ON b.table_id = best.table_id AND b.src = best.src""")
def g17_best_roots(spark, sf):
    o = t(spark, sf, "orders")
    edges = o.groupBy((col("o_custkey") % 20).cast("string").alias("table_id"), F.concat(lit("class:"), "o_orderpriority").alias("src"), F.concat(lit("column:"), "o_orderstatus").alias("dst"), F.concat(lit("p"), col("o_orderkey") % 3).alias("key"))
    edges = edges.agg((F.max(F.floor("o_totalprice")) / 1e6).alias("prob"))
    nodes = edges.select("table_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("kind", F.substring_index("node_id", ":", 1))
    return steiner_trees(nodes, edges).drop("weight")


def _model(source: str | None = None):
    said = _DESCRIPTION.replace("      mos:name: name\n", f"      mos:name: name\n      mos:source_id: {{literal-string: {source!r}}}\n") if source else _DESCRIPTION
    return read_description(said, ["name", "segment", "country", "balance"])


_MODEL = f"""
SELECT * FROM (VALUES ('class', '{_MOS}MineralSite', CAST(NULL AS INTEGER), 4), ('class', '{_MOS}MineralInventory', NULL, 2), ('data', NULL, 0, 0), ('data', NULL, 1, 0), ('data', NULL, 2, 0), ('data', NULL, 3, 0), ('literal', NULL, NULL, 0)) v(kind, uri, col_index, n_props)"""


def _described(spark, model):
    nodes, edges = M.models_to_frames(spark, {"t": model})
    n = edges.groupBy(col("source").alias("id")).agg(F.countDistinct("uri").cast("int").alias("n_props"))
    return nodes.join(n, "id", "left").select("kind", "uri", "col_index", F.coalesce("n_props", lit(0)).alias("n_props"))


@query(_MODEL)
def k7_description_round_trip(spark, sf):
    columns = ["name", "segment", "country", "balance"]
    return _described(spark, read_description(M.write_description(_model(), columns), columns))


@query(_MODEL)
def x1_model_json_round_trip(spark, sf):
    return _described(spark, M.model_from_json(M.model_to_json(_model())))


@query(f"""WITH {_TRIPLES}, a AS (SELECT p, o_kind, o FROM tr UNION ALL SELECT '{_MOS}source_id', 'literal', 'http://doc' FROM c)
SELECT p, o_kind, CASE WHEN o_kind = 'bnode' THEN '' ELSE o END AS o, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def k10_exported_turtle(spark, sf):
    path = folder(spark, "export")
    c = t(spark, sf, "customer").select(
        col("c_custkey").alias("row_index"), col("c_name").alias("name"), col("c_mktsegment").alias("segment"), F.when(col("c_nationkey") % 4 > 0, col("c_nationkey").cast("string")).otherwise(lit("")).alias("country"),
        F.when(col("c_custkey") % 5 > 0, money("c_acctbal")).otherwise(lit("-")).alias("balance"),
    )
    export_table(c, _model("http://doc"), path, "s/carrier")
    back = read_turtle(spark, f"{path}/data.ttl")
    return back.groupBy("p", "o_kind", F.when(col("o_kind") == "bnode", "").otherwise(col("o")).alias("o")).agg(F.count("*").alias("n"))


@query("SELECT CAST(c_custkey % 3 AS INTEGER) AS part, c_name AS name FROM customer")
def m15_mapped_files(spark, sf):
    path, out = folder(spark, "files"), folder(spark, "mapped")
    k = col("row_index") % 3
    triples = _triples(spark, sf).withColumn("row_index", F.regexp_extract("s", "_([0-9]+)$", 1).cast("long"))
    source = spark.createDataFrame([("_:doc", _MOS + "source_id", "http://doc", "literal", None, None)], "s string, p string, o string, o_kind string, datatype string, lang string")
    for part in range(3):
        write_turtle(triples.where(k == part).drop("row_index").unionByName(source).coalesce(1), f"{path}/part{part}.ttl")
    names = []
    for part in range(3):
        mapped = map_files(spark, f"{path}/part{part}.ttl/*.txt", f"{out}/{part}", "s/carrier")
        names.append(spark.read.schema("name string").json(mapped).where("name is not null").select(lit(part).alias("part"), "name"))
    return names[0].unionByName(names[1]).unionByName(names[2])


@query("SELECT c_name AS name, CASE WHEN c_nationkey % 4 > 0 THEN 'c' || c_nationkey END AS country, 'http://doc' AS source_id, 's/carrier' AS created_by FROM customer")
def main_path(spark, sf):
    """From a file to records: read, normalise, number, infer the model from types of columns, export."""
    path = folder(spark, "main")
    c = t(spark, sf, "customer")
    own = c.select(col("c_name").alias("Name "), F.when(col("c_nationkey") % 4 > 0, F.concat(lit("c"), "c_nationkey")).alias("Country"), lit("http://doc").alias("Source"), col("c_custkey").alias("Key"))
    T.write_csv(own, f"{path}/in")
    table = P.normalise(T.read_csv(spark, f"{path}/in/*.csv"))
    rows = T.with_row_index(table.withColumn("__k", col("Key").cast("long")), ["__k"]).drop("__k")
    site = _MOS + "MineralSite"
    types = spark.createDataFrame([("t", i, site, _MOS + p, 0.9 - 0.1 * i) for i, p in enumerate(("name", "country", "source_id"))] + [("t", 0, site, _MOS + "site_type", 0.2)], "table_id string, col_index int, class string, prop string, score double")
    none = spark.createDataFrame([], "source_type string, prop string, target_type string, score double")
    names = spark.createDataFrame([("t", i, n) for i, n in enumerate(table.columns)], "table_id string, col_index int, name string")
    model = collect_model(*infer_models(types, none, columns=names), "t")
    records = export_table(rows, model, f"{path}/out", "s/carrier")
    back = spark.read.schema(records.schema).json(f"{path}/out/data.json")
    return back.select("name", F.try_element_at("location_info.country", lit(1))["observed_name"].alias("country"), "source_id", "created_by")


# ---- rules one by one -----------------------------------------------------------------------------------------------

_POINT = "CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN 'POINT(190 10)' WHEN 1 THEN 'POINT (-20.5 -91)' WHEN 2 THEN 'POINT(a b)' WHEN 3 THEN 'POINT(180 -90)' ELSE 'LINESTRING(0 0, 500 0)' END"
_BROKEN = {"any": "NOT a AND NOT b", "together": "a <> b", "implies": "a AND NOT b", "exclusive": "a AND b", "point": "o_orderkey % 5 < 3"}


def _cross_rule(rule):
    klass, kind, props, severity, _ = rule
    path = U.expand(props[0])

    def run(spark, sf):
        k = col("o_orderkey")
        items = [(_TYPE, lit(U.expand(klass)), "uri", None, None)]
        if kind == "point":
            items.append((path, F.expr(_POINT.replace("VARCHAR", "STRING").replace("INTEGER", "INT")), "literal", None, None))
        else:
            items += [(U.expand(p), F.when(k % m > 0, k.cast("string")), "literal", None, None) for p, m in zip(props, (3, 5))]
        own = _facts(t(spark, sf, "orders"), F.concat(lit("http://x/"), k), *items)
        other = _facts(t(spark, sf, "orders"), F.concat(lit("http://y/"), k), (_TYPE, lit("http://other"), "uri", None, None), *items[1:])
        return C.check_cross(own.unionByName(other), [rule]).drop("message")

    sql = f"""SELECT 'http://x/' || o_orderkey AS focus, '{path}' AS path, '{kind}' AS rule, '{severity}' AS severity FROM (SELECT o_orderkey, o_orderkey % 3 > 0 AS a, o_orderkey % 5 > 0 AS b FROM orders) WHERE {_BROKEN[kind]}"""
    return run, sql


for _i, _rule in enumerate(C.CROSS_RULES, 1):
    _name = f"v{_i}_{_rule[0].split(':')[1].lower()}_{_rule[1]}_{_rule[2][0].split(':')[1].lower()}"
    QUERIES[_name], SQL[_name] = _cross_rule(_rule)

#: Rule -> (argument, which orders break it).
_PROPERTY = {
    "v10_datatype": ("xsd:integer", "k % 13 = 0"), "v11_minCount": (1, "k % 7 = 0"), "v11_maxCount": (1, "k % 7 > 0 AND k % 2 = 0"), "v12_minInclusive": (1000, "k % 7 > 0 AND (k % 13 = 0 OR k % 3000 < 1000)"),
    "v12_maxInclusive": (2000, "k % 7 > 0 AND (k % 13 = 0 OR k % 3000 > 2000)"), "v13_class": ("gemo:Sample", None), "v14_nodeKind": (C.SH + "IRI", None),
}


def _property_rule(kind, arg, broken):
    path = "gemo:year"

    def run(spark, sf):
        k = col("o_orderkey")
        year = F.when(k % 7 > 0, F.when(k % 13 == 0, "soon").otherwise((k % 3000).cast("string")))
        items = [(_TYPE, lit(_GEMO + "Sample"), "uri", None, None), (_GEMO + "year", year, "literal", _XSD + "integer", None), (_GEMO + "note", F.when(k % 2 == 0, "x"), "literal", None, None)]
        if kind == "maxCount":
            items.append((_GEMO + "year", F.when((k % 7 > 0) & (k % 2 == 0), "1999"), "literal", _XSD + "integer", None))
        if kind in ("class", "nodeKind"):
            items[1] = (_GEMO + "year", F.when(k % 3 == 0, F.concat(lit("http://x/"), k)).otherwise(F.concat(lit("http://z/"), k)), "uri" if kind == "class" else "literal", None, None)
        triples = _facts(t(spark, sf, "orders"), F.concat(lit("http://x/"), k), *items)
        return C.check_properties(triples, C.rules_of(spark, [("gemo:Sample", path, kind, arg, "Violation")])).drop("message")

    where = broken or ("k % 3 <> 0" if kind == "class" else "true")
    if kind == "datatype":
        where = f"k % 7 > 0 AND {where}"
    return run, f"SELECT 'http://x/' || k AS focus, '{_GEMO}year' AS path, '{kind}' AS rule, 'Violation' AS severity FROM (SELECT o_orderkey AS k FROM orders) WHERE {where}"


for _name, (_arg, _where) in _PROPERTY.items():
    QUERIES[_name], SQL[_name] = _property_rule(_name.split("_")[1], _arg, _where)
