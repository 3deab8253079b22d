"""Queries over the carrier tables, one or more for each operator, and SQL that answers the same in DuckDB.

The tables only carry the operators: a part's name stands for a cell, a nation for a class, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import uris as U
from ..functions import values as V
from ..operators import aggregates as A
from ..operators import export as X
from ..operators import graph as G
from ..operators import joins as J
from ..operators import linking as L
from ..operators import ranking as R
from ..operators import table_prep as P
from ..operators import validation as C
from ..operators.steiner import steiner_trees
from ..sources.mapping import map_rows
from ..sources.models import read_description
from ..sources.training import parse_training
from ..sources.turtle import to_turtle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(c: str) -> F.Column:
    return col(c).cast("decimal(18,2)").cast("string")


# ---- tables to rows -------------------------------------------------------------------------------------------------


def _matrix(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select(
        (col("l_orderkey") * 10 + col("l_linenumber")).alias("row_index"), "l_returnflag", *(money(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    )


@query("""
WITH m AS (SELECT l_orderkey * 10 + l_linenumber AS row_index, l_returnflag, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS q,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS e, CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS d, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS x FROM lineitem)
SELECT row_index, l_returnflag, 'l_quantity' AS g0_attrs, q AS g0_attr_values, CAST(NULL AS VARCHAR) AS g1_attrs, CAST(NULL AS VARCHAR) AS g1_attr_values FROM m WHERE q NOT IN ('', '0.00')
UNION ALL SELECT row_index, l_returnflag, 'l_extendedprice', e, NULL, NULL FROM m WHERE e NOT IN ('', '0.00')
UNION ALL SELECT row_index, l_returnflag, NULL, NULL, 'l_discount', d FROM m WHERE d NOT IN ('', '0.00')
UNION ALL SELECT row_index, l_returnflag, NULL, NULL, 'l_tax', x FROM m WHERE x NOT IN ('', '0.00')""")
def p4_matrix_to_rows(spark, sf):
    return P.matrix_to_rows(_matrix(spark, sf), {"g0": ["l_quantity", "l_extendedprice"], "g1": ["l_discount", "l_tax"]}, missing=("", "0.00"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) || '.5,0' ELSE '' END AS price,
  o_orderpriority FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderpriority FROM orders)""")
def p3_digit_groups(spark, sf):
    whole = F.floor("o_totalprice").cast("long")
    grouped = F.format_number(whole, 0)
    text = F.when(col("o_orderkey") % 3 == 0, grouped).when(col("o_orderkey") % 3 == 1, F.concat(whole.cast("string"), lit(".5,0"))).otherwise(lit(","))
    return P.normalise(t(spark, sf, "orders").select("o_orderkey", text.alias("price"), "o_orderpriority"))


@query("""
WITH c AS (SELECT n_nationkey AS r, unnest([0,1,2]) AS c, unnest([CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)]) AS v FROM nation)
SELECT 'nation' AS table_id, r - 3 AS "row", c - 1 AS col, 'content' AS kind, v AS value FROM c WHERE r >= 3 AND r < 20 AND c >= 1 AND c < 3""")
def p1_select_range(spark, sf):
    cells = t(spark, sf, "nation").select(
        lit("nation").alias("table_id"), col("n_nationkey").alias("row"), F.posexplode(F.array(*(col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")))).alias("col", "value")
    ).select("table_id", "row", "col", lit("content").alias("kind"), "value")
    return P.select_range(cells, 3, 20, "B", "C")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber AS pos, CAST(l_linenumber // 2 AS INTEGER) AS r, CAST(l_linenumber % 3 AS INTEGER) AS c, CAST(1 + l_partkey % 2 AS INTEGER) AS rs, CAST(1 + l_suppkey % 2 AS INTEGER) AS cs,
  replace(l_returnflag || chr(10) || l_linestatus || ':unselected: ', ':unselected:', '') AS v FROM lineitem),
p AS (SELECT l_orderkey, pos, r + a AS "row", c + b AS col, trim(replace(v, chr(10), ' ')) AS value FROM s, (VALUES (0),(1)) x(a), (VALUES (0),(1)) y(b) WHERE a < rs AND b < cs)
SELECT CAST(l_orderkey AS VARCHAR) AS table_id, "row", col, 'content' AS kind, value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, "row", col ORDER BY pos DESC, value DESC) AS k FROM p) WHERE k = 1""")
def p6_fill_spans(spark, sf):
    li = t(spark, sf, "lineitem")
    return P.fill_spans(li.select(
        col("l_orderkey").cast("string").alias("table_id"), col("l_linenumber").alias("pos"), F.floor(col("l_linenumber") / 2).cast("int").alias("row"), (col("l_linenumber") % 3).cast("int").alias("col"),
        (1 + col("l_partkey") % 2).cast("int").alias("row_span"), (1 + col("l_suppkey") % 2).cast("int").alias("col_span"), lit("content").alias("kind"),
        F.concat("l_returnflag", lit("\n"), "l_linestatus", lit(":unselected: ")).alias("content"),
    ))


@query("""
WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, o_orderstatus, o_orderpriority FROM orders),
n AS (SELECT o_custkey, CASE WHEN max(r) >= 2 THEN 2 ELSE 0 END AS n FROM c GROUP BY o_custkey),
e AS (SELECT c.o_custkey, r, n, 0 AS col, o_orderstatus AS v FROM c JOIN n USING (o_custkey) UNION ALL SELECT c.o_custkey, r, n, 1, o_orderpriority FROM c JOIN n USING (o_custkey))
SELECT CAST(o_custkey AS VARCHAR) AS table_id, CAST(r - greatest(n - 1, 0) AS INTEGER) AS "row", col, CASE WHEN r < 2 THEN 'columnHeader' ELSE 'content' END AS kind, v AS value FROM e WHERE r >= n
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 0, col, 'columnHeader', CASE WHEN max(CASE WHEN r = 0 THEN v END) = max(CASE WHEN r = 1 THEN v END) THEN max(v)
  ELSE max(CASE WHEN r = 0 THEN v END) || ' ' || max(CASE WHEN r = 1 THEN v END) END FROM e WHERE r < n GROUP BY o_custkey, col""")
def p7_merge_headers(spark, sf):
    from pyspark.sql import Window

    row = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    cells = t(spark, sf, "orders").withColumn("row", row).select(
        col("o_custkey").cast("string").alias("table_id"), "row", F.posexplode(F.array("o_orderstatus", "o_orderpriority")).alias("col", "value"),
    ).select("table_id", "row", "col", F.when(col("row") < 2, "columnHeader").otherwise("content").alias("kind"), "value")
    return P.merge_headers(cells)


@query("""
SELECT 'p' AS table_id, CAST(0 AS INTEGER) AS col_index, 'p_brand' AS name, 'p_brand' AS clean_name
UNION ALL SELECT 'p', 1, 'p_type   kind', 'p_type kind' UNION ALL SELECT 'p', 2, 'Column 2', 'Column 2'""")
def p8_promote_headers(spark, sf):
    body = t(spark, sf, "part").select((col("p_partkey") + 2).cast("int").alias("row"), F.posexplode(F.array("p_brand", "p_type", "p_name")).alias("col", "value"))
    heads = spark.createDataFrame([(0, 0, "p_brand"), (0, 1, "p_type "), (0, 2, ""), (1, 0, ""), (1, 1, " kind"), (1, 2, " ")], "row int, col int, value string")
    cells = heads.unionByName(body).select(lit("p").alias("table_id"), "row", "col", lit("content").alias("kind"), "value")
    return P.promote_headers(cells, 2)[0]


@query("""
SELECT CAST(c_custkey AS BIGINT) AS row_index, CAST(c_nationkey AS VARCHAR) AS nation, 'seg' AS _attrs, c_mktsegment AS _attr_values FROM customer WHERE c_mktsegment <> ''
UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR), 'phone', CAST(c_custkey * 7 AS VARCHAR) FROM customer""")
def p12_run_ops(spark, sf):
    df = t(spark, sf, "customer").select(
        col("c_custkey").alias("row_index"), col("c_nationkey").cast("string").alias("nation"), col("c_name").alias("name"), col("c_mktsegment").alias("seg"), F.format_number(col("c_custkey") * 7, 0).alias("phone")
    )
    return P.run_ops(df, 'norm_table | remove_cols{"cols": "2"} | matrix2relational{"cols": "2:"}')


@query("SELECT l_returnflag, trim(l_linestatus) AS value, count(*) AS n FROM lineitem WHERE trim(CASE WHEN l_linestatus = 'O' THEN ' ' ELSE l_linestatus END) <> '' GROUP BY 1, 2")
def p13_drop_blank(spark, sf):
    cells = t(spark, sf, "lineitem").select("l_returnflag", F.when(col("l_linestatus") == "O", lit(" ")).otherwise(col("l_linestatus")).alias("value"))
    return P.drop_blank(cells).groupBy("l_returnflag", F.trim("value").alias("value")).agg(F.count("*").alias("n"))


@query()
def p15_sample_rows(spark, sf):
    return P.sample_rows(t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), 4, ["c_nationkey"])


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, o_custkey, o_orderpriority FROM orders),
b AS (SELECT o_custkey, CAST(k // 2 AS INTEGER) AS block, list(o_orderpriority ORDER BY k % 2) AS vs FROM o GROUP BY 1, 2)
SELECT 't' AS table_id, CAST(o_custkey AS INTEGER) AS "row", block, CAST(o_custkey AS VARCHAR) AS key, 'block ' || block AS header, array_to_string(vs, '|') AS values_text FROM b""")
def p5_repeated_blocks(spark, sf):
    from pyspark.sql import Window

    k = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("int")
    o = t(spark, sf, "orders").withColumn("k", k)
    blocks = (o.agg(F.max("k")).first()[0] or 0) // 2 + 1
    body = o.select((col("o_custkey") + 1).cast("int").alias("row"), (col("k") + 1).alias("col"), col("o_orderpriority").alias("value"))
    keys = o.select("o_custkey").distinct().select((col("o_custkey") + 1).cast("int").alias("row"), lit(0).alias("col"), col("o_custkey").cast("string").alias("value"))
    heads = spark.createDataFrame([(0, 1 + 2 * b, f"block {b}") for b in range(blocks)], "row int, col int, value string")
    cells = body.unionByName(keys).unionByName(heads).select(lit("t").alias("table_id"), "row", "col", lit("content").alias("kind"), "value")
    out = P.repeated_blocks(cells, 1, 2, blocks, 0, 1, 0)
    return out.select("table_id", "row", "block", "key", "header", F.array_join("values", "|").alias("values_text"))


# ---- functions ------------------------------------------------------------------------------------------------------

_NUMBERS = """CASE CAST(o_orderkey % 8 AS INTEGER) WHEN 0 THEN '1.7' WHEN 1 THEN ' ' || o_orderkey || ' ' WHEN 2 THEN '1d' WHEN 3 THEN '1_000' WHEN 4 THEN 'nan' WHEN 5 THEN '-' || o_custkey || '.25e1' WHEN 6 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END"""


@query(f"""
WITH x AS (SELECT o_orderkey, {_NUMBERS} AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim(raw) AS DOUBLE) END AS as_decimal,
  CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(trim(raw) AS BIGINT) END AS as_integer,
  CASE WHEN regexp_full_match(raw, '[0-9]+') THEN CAST(raw AS BIGINT) END AS whole FROM x""")
def f3_parse_numbers(spark, sf):
    raw = F.expr(_NUMBERS.replace("VARCHAR", "STRING").replace("INTEGER", "INT"))
    df = t(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    c = col("raw")
    return df.select("o_orderkey", "raw", V.parse_decimal(c).alias("as_decimal"), V.parse_integer(c).alias("as_integer"), V.parse_number(c)["whole"].alias("whole"))


@query("""
SELECT s_suppkey, trim(regexp_replace(lower(s_name || ', No. ' || s_suppkey || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || s_nationkey AS attribute,
  CASE WHEN s_suppkey % 2 = 0 THEN 'site__' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') || '__' || s_suppkey END AS uri FROM supplier""")
def f1_slugs(spark, sf):
    s = t(spark, sf, "supplier")
    last = F.when(col("s_suppkey") % 2 == 0, col("s_suppkey").cast("string")).otherwise(lit("0.0"))
    return s.select(
        "s_suppkey", T.slug(F.concat("s_name", lit(", No. "), "s_suppkey", lit("!"))).alias("slug"), T.attribute_id(col("s_name"), col("s_nationkey")).alias("attribute"),
        T.template_uri("site", col("s_name"), last).alias("uri"),
    )


@query("""
SELECT c_custkey, printf('POINT(%.5f %.5f)', c_acctbal / 50, c_acctbal / 110) AS point, c_acctbal / 50 BETWEEN -180 AND 180 AND c_acctbal / 110 BETWEEN -90 AND 90 AS in_range,
  CASE WHEN c_nationkey % 3 > 0 THEN 'POINT (' || c_nationkey || ' ' || c_custkey || ')' END AS pair FROM customer""")
def f7_points(spark, sf):
    p = V.point(col("c_acctbal") / 50, col("c_acctbal") / 110)
    blank = F.when(col("c_nationkey") % 3 > 0, col("c_nationkey").cast("string")).otherwise(lit(" "))
    return t(spark, sf, "customer").select("c_custkey", p.alias("point"), C.point_in_range(p).alias("in_range"), V.point_of_texts(blank, col("c_custkey").cast("string")).alias("pair"))


@query("""
WITH x AS (SELECT s_suppkey, CAST(s_suppkey % 80 AS INTEGER) AS d, CAST(s_nationkey AS INTEGER) AS m FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL WHEN s_suppkey % 4 = 2 THEN printf('POINT(%.5f %.5f)', CAST(-(d + m / 60.0) AS DOUBLE), CAST(d + m / 60.0 AS DOUBLE)) ELSE printf('POINT(%.5f %.5f)', CAST(-d AS DOUBLE), CAST(d + m / 60.0 AS DOUBLE)) END AS point FROM x""")
def f6_coordinates(spark, sf):
    d, m = (col("s_suppkey") % 80).cast("int").cast("string"), col("s_nationkey").cast("int").cast("string")
    kind = col("s_suppkey") % 4
    text = (
        F.when(kind == 0, F.concat(d, lit("°"), m, lit("'B "), d, lit("° W")))
        .when(kind == 1, F.concat(d, lit(" w, "), d, lit("°"), m, lit("' n")))
        .when(kind == 2, F.concat(d, lit("° "), m, lit("′ N, "), d, lit("° "), m, lit("′ W")))
        .otherwise(lit("unknown"))
    )
    return t(spark, sf, "supplier").select("s_suppkey", V.parse_coordinate(text).alias("point"))


@query("""
SELECT p_partkey, upper(part) AS part, CAST(n AS INTEGER) AS n FROM (SELECT p_partkey, unnest(list_distinct(string_split(replace(p_type, ' ', '+'), '+'))) AS part, len(list_distinct(string_split(p_type, ' '))) AS n FROM part)""")
def f10_split_plus(spark, sf):
    parts = F.array_distinct(T.split_plus(F.replace(col("p_type"), lit(" "), lit("+"))))
    return t(spark, sf, "part").select("p_partkey", F.explode(parts).alias("part"), F.size(parts).alias("n")).select("p_partkey", F.upper("part").alias("part"), "n")


@query("""
SELECT p_partkey, array_to_string(CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN ['%', p_brand] WHEN 1 THEN [p_brand, '%'] WHEN 2 THEN ['g/t', '', p_brand] ELSE [p_brand] END, '|') AS tokens FROM part""")
def f11_unit_tokens(spark, sf):
    k = col("p_partkey") % 4
    brand = col("p_brand")
    text = F.when(k == 0, F.concat(lit("%"), brand)).when(k == 1, F.concat(brand, lit("%"))).when(k == 2, F.concat(lit("g/t  "), brand)).otherwise(brand)
    safe = F.when(k.isin(0, 1), F.replace(text, lit(" "), lit("_"))).otherwise(text)
    return t(spark, sf, "part").select("p_partkey", F.array_join(T.unit_tokens(safe), "|").alias("tokens"))


@query("""
SELECT n_nationkey, 'https://minmod.isi.edu/ontology-simple/' || n_name AS abs, 'mos:' || n_name AS rel, n_name AS local, CASE WHEN n_nationkey % 3 = 0 THEN 'https://doi.org/10.1/' || n_nationkey WHEN n_nationkey % 3 = 1 THEN 'http://x/' || n_nationkey
  ELSE 'http://minmod.isi.edu/papers/' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') END AS doc, CASE WHEN n_nationkey % 2 = 0 THEN 'entity' ELSE 'string' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN 'mnr:Q' || n_nationkey ELSE n_name END AS wrapped FROM nation""")
def f13_uris(spark, sf):
    n, k = col("n_name"), col("n_nationkey")
    doi, url = F.when(k % 3 == 0, F.concat(lit("10.1/"), k)), F.when(k % 3 == 1, F.concat(lit("http://x/"), k))
    value = U.wrap_value(F.when(k % 2 == 0, F.concat(lit(U.NAMESPACES["mnr"] + "Q"), k)).otherwise(n))
    return t(spark, sf, "nation").select(
        "n_nationkey", U.to_abs_uri(F.concat(lit("mos:"), n)).alias("abs"), U.to_rel_uri(F.concat(lit(U.NAMESPACES["mos"]), n)).alias("rel"), U.strip_namespace(F.concat(lit(U.NAMESPACES["mnr"]), n)).alias("local"),
        U.document_uri(doi, url, n).alias("doc"), value["kind"].alias("kind"), value["value"].alias("wrapped"),
    )


@query("""
SELECT p_partkey, substr(to_base64(unhex(sha256(p_name))), 1, 8) AS short, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END AS answer,
  replace(p_name || chr(10) || p_brand, chr(10), chr(92) || 'n') AS escaped, CASE WHEN p_type LIKE '%STEEL%' OR lower(p_type) LIKE '%steel%' THEN 'Q1' END AS keyword,
  CASE WHEN p_size > 25 THEN p_brand || '__' || p_size ELSE NULL END AS composite FROM part""")
def f17_text_functions(spark, sf):
    k, b = col("p_partkey"), col("p_brand")
    said = F.when(k % 3 == 0, F.concat(lit('It is "'), b, lit('" or N/A'))).when(k % 3 == 1, F.concat(lit("the `"), b, lit("` and '"), col("p_type"), lit("'"))).otherwise(F.concat(lit("'"), col("p_type"), lit("' then `x`")))
    big = col("p_size") > 25
    return t(spark, sf, "part").select(
        "p_partkey", T.short_hash(col("p_name")).alias("short"), T.extract_answer(said).alias("answer"), T.escape_newlines(F.concat("p_name", lit("\n"), b)).alias("escaped"),
        T.keyword_entity(col("p_type"), "steel", "Q1").alias("keyword"), T.composite_key(F.when(big, b).otherwise(lit(" ")), F.when(big, col("p_size").cast("string"))).alias("composite"),
    )


@query("SELECT r_regionkey, 'http://kg/' || i || '/' || r_name AS url FROM (SELECT r_regionkey, r_name, unnest(range(r_regionkey, 7)) AS i FROM region)")
def f20_expand_range(spark, sf):
    pattern = F.concat(lit("http://kg/{"), "r_regionkey", lit("}-{7}/"), "r_name")
    return t(spark, sf, "region").select("r_regionkey", F.explode(T.expand_range(pattern)).alias("url"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE 'n/a' END AS v, CASE WHEN l_suppkey % 3 = 0 THEN 'int' WHEN l_suppkey % 3 = 1 THEN 'decimal' END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN d IS NULL THEN v END AS as_text, CASE WHEN d = 'decimal' THEN TRY_CAST(v AS DOUBLE) END AS as_real, CASE WHEN d = 'int' THEN TRY_CAST(v AS BIGINT) END AS as_whole, d IS NULL OR v <> 'n/a' AS valid FROM x""")
def f8_typed_literals(spark, sf):
    v = F.when(col("l_linenumber") % 2 == 0, col("l_quantity").cast("int").cast("string")).otherwise(lit("n/a"))
    d = F.when(col("l_suppkey") % 3 == 0, lit(V.XSD + "int")).when(col("l_suppkey") % 3 == 1, lit(V.XSD + "decimal"))
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.typed_literal(v, d).alias("x"), V.valid_literal(v, d).alias("valid"))
    return x.select("l_orderkey", "l_linenumber", col("x.text").alias("as_text"), col("x.real").alias("as_real"), col("x.whole").alias("as_whole"), "valid")


# ---- joins ----------------------------------------------------------------------------------------------------------


@query("""
SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS name, c_name AS "name (1)", c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey""")
def j1_join_tables(spark, sf):
    a = t(spark, sf, "orders").select(col("o_orderkey").alias("id"), col("o_custkey").cast("string").alias("cust"), col("o_orderstatus").alias("name"))
    b = t(spark, sf, "customer").select(col("c_custkey").cast("string").alias("cust"), col("c_name").alias("name"), col("c_nationkey").alias("nation"))
    return J.join_tables(a, b)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j12_without(spark, sf):
    triples = t(spark, sf, "orders").select(col("o_custkey").alias("s"), col("o_orderstatus").alias("p"), col("o_orderkey").alias("o"))
    return J.having(t(spark, sf, "customer").select("c_custkey", "c_name"), triples, "F", negate=True, subject="c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, COALESCE(CASE WHEN p_size < 20 THEN p_brand END, CASE WHEN p_size < 40 THEN p_type END) AS label FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def j10_fallback(spark, sf):
    part = t(spark, sf, "part")
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    first = part.where("p_size < 20").select(col("p_partkey").alias("l_partkey"), col("p_brand").alias("label"))
    second = part.where("p_size < 40").select(col("p_partkey").alias("l_partkey"), col("p_type").alias("label"))
    return J.with_fallback(rows, first, second, "l_partkey", "label")


@query("""
SELECT p_brand AS brand, CASE WHEN right(p_brand, 1) IN ('1', '2') THEN 'Q' || right(p_brand, 1) END AS uri FROM part""")
def j11_trusted_lookup(spark, sf):
    brands = t(spark, sf, "part").select(col("p_brand").alias("brand"))
    trusted = brands.distinct().where(F.right("brand", lit(1)).isin("1", "2")).select(col("brand").alias("value"), F.concat(lit("Q"), F.right("brand", lit(1))).alias("uri"))
    return J.trusted_lookup(brands, trusted, "brand", strict=False)


@query("""
WITH cells AS (SELECT DISTINCT n_name AS cell FROM nation), cat AS (SELECT 'seg' || p_size % 3 AS label, p_partkey AS pos, split_part(p_name, ' ', 1) AS value FROM part),
s AS (SELECT label, pos, value, max(1 - levenshtein(value, lower(cell)) / CAST(greatest(length(value), length(cell)) AS DOUBLE)) AS similarity FROM cat, cells GROUP BY 1, 2, 3)
SELECT label, pos, value, round(similarity, 9) AS similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, pos) AS k FROM s) WHERE k <= 10""")
def j9_most_similar(spark, sf):
    cat = t(spark, sf, "part").select(F.concat(lit("seg"), (col("p_size") % 3).cast("string")).alias("label"), col("p_partkey").alias("pos"), F.split("p_name", " ")[0].alias("value"))
    cells = t(spark, sf, "nation").select(F.lower("n_name").alias("value"))
    return J.most_similar(cat, cells).select("label", "pos", "value", F.round("similarity", 9).alias("similarity"), "rank")


@query("""
SELECT 'g' AS table_id, 'c' || c_custkey AS src, 'n' || c_nationkey AS mid, 'r' || n_regionkey AS dst, 'lives' AS key1, 'lies' AS key2, CAST(1.5 AS DOUBLE) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def j13_two_hops(spark, sf):
    tid = lit("g").alias("table_id")
    a = t(spark, sf, "customer").select(tid, F.concat(lit("c"), "c_custkey").alias("src"), F.concat(lit("n"), "c_nationkey").alias("dst"), lit("lives").alias("key"), lit(0.5).alias("score"))
    b = t(spark, sf, "nation").select(tid, F.concat(lit("n"), "n_nationkey").alias("src"), F.concat(lit("r"), "n_regionkey").alias("dst"), lit("lies").alias("key"), lit(1.0).alias("score"))
    return J.two_hops(a.unionByName(b))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def j14_leave_one_out(spark, sf):
    held = t(spark, sf, "customer").where("c_nationkey = 3").select(col("c_custkey").alias("o_custkey"))
    return J.leave_one_out(t(spark, sf, "orders").select("o_custkey"), held, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


# ---- aggregations and ranking ---------------------------------------------------------------------------------------


def _types(spark, sf):
    return t(spark, sf, "lineitem").groupBy(
        (col("l_suppkey") % 3).cast("string").alias("table_id"), (col("l_partkey") % 50).cast("int").alias("col_index"), F.concat(lit("C"), "l_returnflag").alias("class"), F.concat(lit("p"), "l_linestatus").alias("prop")
    ).agg(F.max(F.round(col("l_extendedprice"), 2)).alias("score"))


_TYPES = """types AS (SELECT CAST(l_suppkey % 3 AS VARCHAR) AS table_id, CAST(l_partkey % 50 AS INTEGER) AS col_index, 'C' || l_returnflag AS class, 'p' || l_linestatus AS prop, max(round(l_extendedprice, 2)) AS score FROM lineitem GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {_TYPES}, b AS (SELECT table_id, col_index, class AS label, score FROM types UNION ALL SELECT table_id, col_index, prop, score FROM types)
SELECT table_id, col_index, label, max(score) AS score FROM b GROUP BY 1, 2, 3""")
def a2_best_labels(spark, sf):
    return A.best_labels(_types(spark, sf))


@query(f"""WITH {_TYPES} SELECT table_id, col_index, class, prop, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY table_id, col_index ORDER BY score DESC, class, prop) AS k FROM types) WHERE k <= 2""")
def w1_top_types(spark, sf):
    return R.top_types(_types(spark, sf))


@query(f"""WITH {_TYPES}, r AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_index ORDER BY score DESC, class, prop) AS k FROM types)
SELECT table_id, col_index, class, prop, score, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 2 AND (table_id, col_index) NOT IN (SELECT (table_id, col_index) FROM r WHERE k = 1 AND class = 'CR')""")
def w2_drop_unknown(spark, sf):
    return R.drop_unknown(R.top_types(_types(spark, sf)), "CR")


@query(f"""WITH {_TYPES}, b AS (SELECT table_id, col_index, class AS label, max(score) AS score FROM types GROUP BY 1, 2, 3)
SELECT table_id, col_index, string_agg(label, ',' ORDER BY score DESC, label) AS labels FROM b GROUP BY 1, 2""")
def w5_type_lists(spark, sf):
    best = _types(spark, sf).groupBy("table_id", "col_index", col("class").alias("label")).agg(F.max("score").alias("score"))
    return R.type_lists(best).select("table_id", "col_index", F.array_join(F.transform("types", lambda x: x["label"]), ",").alias("labels"))


@query(f"""WITH {_TYPES}, n AS (SELECT table_id, class, least(count(DISTINCT col_index), CASE WHEN class = 'CA' THEN 5 ELSE 1000 END) AS n FROM types GROUP BY 1, 2)
SELECT table_id, class, CAST(unnest(range(n)) AS INTEGER) AS n FROM n""")
def a6_class_nodes(spark, sf):
    return A.class_nodes(_types(spark, sf), spark.createDataFrame([("CA", 5)], "class string, most int"))


@query("""
SELECT o_custkey, min(o_orderstatus) IS NOT NULL AS has_status, count(DISTINCT o_orderstatus) = 1 AS consistent, CAST(count(*) AS INTEGER) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def a9_merge_records(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.array("o_orderkey").alias("invs"))
    out = A.merge_records(rows, "o_custkey", ["o_orderstatus"], "invs", strict=False)
    total = F.aggregate("invs", lit(0).cast("long"), lambda a, x: a + x)
    return out.select("o_custkey", col("o_orderstatus").isNotNull().alias("has_status"), "consistent", F.size("invs").alias("n"), total.alias("keys"))


@query("SELECT c_nationkey, count(c_mktsegment) = count(DISTINCT c_mktsegment) AS \"unique\" FROM customer GROUP BY 1")
def a10_all_distinct(spark, sf):
    return A.all_distinct(t(spark, sf, "customer"), "c_mktsegment", ["c_nationkey"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS s, CAST(min(o_orderkey) AS VARCHAR) AS o FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def a11_exactly_one(spark, sf):
    triples = t(spark, sf, "orders").select(col("o_custkey").cast("string").alias("s"), lit("has").alias("p"), col("o_orderkey").cast("string").alias("o"))
    return A.exactly_one(triples, "has", strict=False)


@query("""
WITH g AS (SELECT DISTINCT o_custkey % 20 AS grp, o_custkey AS item FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey % 20 AS grp, o_custkey AS item FROM orders WHERE o_orderpriority LIKE '1%'),
b AS (SELECT COALESCE(g.grp, p.grp) AS grp, count(g.item) AS gold, count(p.item) AS predicted, sum(CASE WHEN g.item = p.item THEN 1 ELSE 0 END) AS hits FROM g FULL JOIN p ON g.grp = p.grp AND g.item = p.item GROUP BY 1)
SELECT grp, round(hits / CAST(predicted AS DOUBLE), 9) AS precision, round(hits / CAST(gold AS DOUBLE), 9) AS recall FROM b""")
def a12_precision_recall(spark, sf):
    o = t(spark, sf, "orders").select((col("o_custkey") % 20).alias("grp"), col("o_custkey").alias("item"), "o_orderstatus", "o_orderpriority")
    out = A.precision_recall(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority like '1%'"), ["grp"], ["item"])
    return out.select("grp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("""
SELECT o_orderkey, COALESCE(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, '') AS gold, substr(o_orderpriority, 1, 1) AS predicted FROM orders WHERE o_orderkey % 5 > 0""")
def a13_confusion(spark, sf):
    o = t(spark, sf, "orders")
    gold = o.where("o_orderkey % 3 > 0").select("o_orderkey", col("o_orderstatus").alias("label"))
    predicted = o.where("o_orderkey % 5 > 0").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("label"))
    return A.confusion(gold, predicted, ["o_orderkey"])


@query("""
WITH k AS (SELECT p_partkey AS doc, t.i AS pos, t.w AS token FROM part, (SELECT 1) d, LATERAL (SELECT unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i) t),
s AS (SELECT doc, pos, token, CASE CAST(length(token) % 3 AS INTEGER) WHEN 0 THEN 'unit' WHEN 1 THEN 'commodity' ELSE 'commodity_form' END AS kind FROM k)
SELECT doc, kind, token, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY pos DESC) AS r FROM s) WHERE r = 1""")
def w8_last_of_kind(spark, sf):
    words = t(spark, sf, "part").select(col("p_partkey").alias("doc"), F.posexplode(F.split("p_name", " ")).alias("pos", "token"))
    kind = F.element_at(F.array(*map(lit, L.KINDS)), (F.length("token") % 3 + 1).cast("int"))
    return R.last_of_kind(words.withColumn("kind", kind), ["doc", "kind"], "pos", ["token", "pos"])


@query("""
WITH s AS (SELECT p_partkey AS name, 'unit' AS kind, 'u' || p_size AS id, CAST(p_size AS DOUBLE) AS score FROM part UNION ALL SELECT p_partkey, 'commodity', 'c' || p_size, CAST(p_size + p_partkey % 2 AS DOUBLE) FROM part)
SELECT name, kind, id, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, CASE kind WHEN 'unit' THEN 1 ELSE 2 END, id) AS k FROM s) WHERE k = 1""")
def w7_argmax_kind(spark, sf):
    p = t(spark, sf, "part")
    row = lambda kind, letter, score: p.select(col("p_partkey").alias("name"), lit(kind).alias("kind"), F.concat(lit(letter), "p_size").alias("id"), score.cast("double").alias("score"))
    return R.argmax_kind(row("unit", "u", col("p_size")).unionByName(row("commodity", "c", col("p_size") + col("p_partkey") % 2)), ["name"], L.KINDS)


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS ordinal FROM customer")
def w9_ordinals(spark, sf):
    return R.ordinals(t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_acctbal", "c_custkey"], ["c_nationkey"]).drop("c_acctbal")


@query("""
SELECT CASE WHEN l_suppkey % 5 > 0 THEN (l_suppkey % 4) / CAST(l_suppkey % 5 AS DOUBLE) END AS agreement, CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'O' THEN 0.95 WHEN l_returnflag <> 'N' AND l_linenumber > 3 THEN 0.8 WHEN l_returnflag <> 'N' THEN 0.55 ELSE 0.3 END::DOUBLE AS evidence, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def a15_confidences(spark, sf):
    given = lambda cond: F.when(cond, lit(1))
    evidence = A.evidence_confidence(given(col("l_returnflag") != "N"), given(col("l_linestatus") == "O"), given(col("l_linenumber") > 3))
    return t(spark, sf, "lineitem").groupBy(A.agreement(col("l_suppkey") % 5, col("l_suppkey") % 4).alias("agreement"), evidence.alias("evidence")).agg(F.count("*").alias("n"))


# ---- graphs ---------------------------------------------------------------------------------------------------------


def _connections(spark, sf):
    c, n, r = (t(spark, sf, x) for x in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    none = lit(None).cast("string")
    fine = j.groupBy(col("c_mktsegment").alias("prop"), col("n_name").alias("source_type")).agg(F.count("*").cast("double").alias("freq")).withColumn("target_type", none)
    coarse = j.groupBy(col("c_mktsegment").alias("prop"), col("r_name").alias("source_type")).agg(F.count("*").cast("double").alias("freq")).withColumn("target_type", none)
    linked = j.groupBy(col("c_mktsegment").alias("prop"), col("n_name").alias("source_type"), col("r_name").alias("target_type")).agg(F.sum("c_custkey").cast("double").alias("freq"))
    conns = fine.unionByName(coarse).unionByName(linked).withColumn("qual", col("prop"))
    ancestors = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(col("n_name").alias("class"), col("r_name").alias("ancestor"))
    return conns, ancestors


_CONNS = """j AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fine AS (SELECT c_mktsegment AS prop, n_name AS s, r_name AS up, CAST(count(*) AS DOUBLE) AS freq FROM j GROUP BY 1, 2, 3), coarse AS (SELECT c_mktsegment AS prop, r_name AS s, CAST(count(*) AS DOUBLE) AS freq FROM j GROUP BY 1, 2),
inh AS (SELECT fine.prop, fine.s AS source_type, fine.freq, fine.freq + coarse.freq AS inherit_freq FROM fine JOIN coarse ON fine.prop = coarse.prop AND fine.up = coarse.s UNION ALL SELECT prop, s, freq, freq FROM coarse)"""


@query(f"WITH {_CONNS} SELECT prop, source_type, freq, inherit_freq FROM inh")
def j7_inherited(spark, sf):
    conns, ancestors = _connections(spark, sf)
    return G.inherited(conns.where("target_type is null"), ancestors).select("prop", "source_type", "freq", "inherit_freq")


@query(f"""WITH {_CONNS}, tot AS (SELECT *, sum(inherit_freq) OVER (PARTITION BY prop) AS total_freq FROM inh)
SELECT prop, source_type, inherit_freq, total_freq FROM (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY inherit_freq DESC, source_type) AS k FROM tot) WHERE k <= 5""")
def g10_schema_graph(spark, sf):
    conns, ancestors = _connections(spark, sf)
    classes = conns.select(col("source_type").alias("class")).distinct()
    return G.schema_graph(conns, ancestors, conns.select("prop"), classes)[0].select("prop", "source_type", "inherit_freq", "total_freq")


_SCHEMA = [("CA", "knows", "CN", 0.7), ("CN", "holds", "CR", 0.4), ("CA", "rare", "CR", 1e-9)]


def _graph(spark, sf):
    return G.simple_graph(_types(spark, sf), spark.createDataFrame(_SCHEMA, "source_type string, prop string, target_type string, score double"), spark.createDataFrame([("CA", 3), ("CN", 3), ("CR", 3)], "class string, most int"))


_GRAPH = f"""{_TYPES}, n AS (SELECT table_id, class, least(count(DISTINCT col_index), 3) AS n FROM types GROUP BY 1, 2), nodes AS (SELECT table_id, class, 'class:' || class || ':' || unnest(range(n)) AS id FROM n),
schema_ AS (SELECT * FROM (VALUES ('CA', 'knows', 'CN', CAST(0.7 AS DOUBLE)), ('CN', 'holds', 'CR', CAST(0.4 AS DOUBLE)), ('CA', 'rare', 'CR', CAST(1e-9 AS DOUBLE))) v(a, p, b, score)),
edges AS (SELECT types.table_id, nodes.id AS src, 'column:' || col_index AS dst, prop AS key, score, 'from_stype_model' AS source FROM types JOIN nodes ON types.table_id = nodes.table_id AND types.class = nodes.class
UNION ALL SELECT x.table_id, x.id, y.id, p, score, 'from_kg_mining' FROM nodes x JOIN schema_ ON x.class = a JOIN nodes y ON y.class = b AND x.table_id = y.table_id WHERE x.id <> y.id)"""


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def g7_simple_graph(spark, sf):
    return _graph(spark, sf)[1]


@query(f"""WITH {_GRAPH}, p AS (SELECT * FROM edges WHERE score >= 1e-7), e AS (SELECT table_id, src AS node_id, 0 AS i, 1 AS o FROM p UNION ALL SELECT table_id, dst, 1, 0 FROM p)
SELECT table_id, node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM e GROUP BY 1, 2""")
def g13_pruned_degrees(spark, sf):
    return G.degrees(G.prune(_graph(spark, sf)[1]))


@query(f"""WITH {_GRAPH}, s AS (SELECT table_id, src, dst, key, max(score) AS st FROM edges GROUP BY 1, 2, 3, 4)
SELECT table_id, src, dst, key, round(st * CASE WHEN src LIKE 'class:CA%' THEN 0.5 WHEN src LIKE 'class:CR%' THEN 0.25 ELSE 1.0 END * CASE WHEN dst LIKE 'class:CA%' THEN 0.5 WHEN dst LIKE 'class:CR%' THEN 0.25 ELSE 1.0 END, 9) AS prob FROM s""")
def g9_edge_probabilities(spark, sf):
    nodes, edges = _graph(spark, sf)
    probs = nodes.where("uri in ('CA', 'CR')").select("table_id", "node_id", F.when(col("uri") == "CA", lit(0.5)).otherwise(lit(0.25)).alias("prob"))
    scored = edges.withColumn("st", F.when(col("source") == G.FROM_TYPES, col("score"))).withColumn("kg", F.when(col("source") == G.FROM_GRAPH, col("score")))
    return G.edge_probabilities(scored, probs).withColumn("prob", F.round("prob", 9))


def _statements(spark, sf):
    o = t(spark, sf, "orders")
    tid, s = lit("g").alias("table_id"), F.concat(lit("statement:"), "o_orderkey")
    into = o.where("o_orderkey % 3 > 0").select(tid, F.concat(lit("class:"), "o_custkey").alias("src"), s.alias("dst"), lit("p").alias("key"), lit(1.0).alias("score"))
    out = o.where("o_orderkey % 4 > 0").select(tid, s.alias("src"), F.concat(lit("column:"), "o_orderstatus").alias("dst"), lit("p").alias("key"), lit(1.0).alias("score"))
    edges = into.unionByName(out)
    ids = o.select(tid, F.explode(F.array(s, F.concat(lit("class:"), "o_custkey"), F.concat(lit("column:"), "o_orderstatus"))).alias("node_id")).distinct()
    return ids.withColumn("kind", F.substring_index("node_id", ":", 1)), edges


@query("""
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 4 > 0), e AS (SELECT 'class:' || o_custkey AS src, 'statement:' || o_orderkey AS dst FROM o UNION ALL SELECT 'statement:' || o_orderkey, 'column:' || o_orderstatus FROM o)
SELECT 'g' AS table_id, src AS node_id, split_part(src, ':', 1) AS kind FROM e UNION SELECT 'g', dst, split_part(dst, ':', 1) FROM e""")
def g14_drop_dangling(spark, sf):
    return G.drop_standalone(*G.drop_dangling(*_statements(spark, sf)))


@query("""
WITH e AS (SELECT DISTINCT o_orderstatus AS c, o_custkey % 40 AS k FROM orders), n AS (SELECT count(DISTINCT o_orderstatus) AS n FROM orders)
SELECT 'g' AS table_id, 'class:' || k AS root FROM e, n GROUP BY k, n HAVING count(DISTINCT c) = n UNION SELECT 'g', 'class:top'""")
def u3_common_roots(spark, sf):
    tid = lit("g").alias("table_id")
    pairs = t(spark, sf, "orders").select((col("o_custkey") % 40).alias("k"), "o_orderstatus").distinct()
    edges = pairs.select(tid, F.concat(lit("class:"), "k").alias("src"), F.concat(lit("column:"), "o_orderstatus").alias("dst"))
    edges = edges.unionByName(pairs.select(tid, lit("class:top").alias("src"), F.concat(lit("class:"), "k").alias("dst")).distinct())
    nodes = edges.select("table_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("kind", F.substring_index("node_id", ":", 1))
    return G.common_roots(edges, nodes.where("kind = 'column'").select("table_id", "node_id"), nodes)


@query("""
SELECT table_id, source, target, u AS uri FROM (SELECT CAST(o_custkey AS VARCHAR) AS table_id, CAST(o_orderkey AS INTEGER) AS source, CAST(o_orderkey % 7 AS INTEGER) AS target, unnest(CASE WHEN o_orderstatus = 'O' THEN ['commodity', 'grade_unit'] ELSE [o_orderstatus] END) AS u FROM orders)""")
def g24_split_unit_property(spark, sf):
    edges = t(spark, sf, "orders").select(col("o_custkey").cast("string").alias("table_id"), col("o_orderkey").cast("int").alias("source"), (col("o_orderkey") % 7).cast("int").alias("target"), col("o_orderstatus").alias("uri"))
    return G.split_unit_property(edges, "O", "commodity", "grade_unit")


@query()
def g16_steiner_trees(spark, sf):
    nodes, edges = _graph(spark, sf)
    scored = edges.withColumn("prob", F.when(col("source") == G.FROM_TYPES, col("score") / 200000).otherwise(col("score")))
    return steiner_trees(nodes, scored)


# ---- triples, records, validation -----------------------------------------------------------------------------------

_DESCRIPTION = """
version: simple-tree-1
model:
  - type: mos:MineralSite
    props:
      mos:name: name
      mos:country: {column: 2}
      mos:deposit_type: [segment, name]
      mos:mineral_inventory:
        type: mos:MineralInventory
        props:
          mos:tonnage: balance
          mos:commodity: {literal-string: Copper}
prefixes: {mos: "https://minmod.isi.edu/ontology-simple/"}
"""
_MOS, _TYPE = U.NAMESPACES["mos"], U.RDF_TYPE


def _triples(spark, sf):
    c = t(spark, sf, "customer").select(
        col("c_custkey").alias("row_index"), col("c_name").alias("name"), col("c_mktsegment").alias("segment"), F.when(col("c_nationkey") % 4 > 0, col("c_nationkey").cast("string")).otherwise(lit("")).alias("country"),
        F.when(col("c_custkey") % 5 > 0, money("c_acctbal")).otherwise(lit("-")).alias("balance"),
    )
    return X.to_triples(c, read_description(_DESCRIPTION, ["name", "segment", "country", "balance"]))


_TRIPLES = f"""c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS n, CASE WHEN c_custkey % 5 > 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) ELSE '-' END AS bal FROM customer),
tr AS (SELECT '_:n0_' || k AS s, '{_TYPE}' AS p, '{_MOS}MineralSite' AS o, 'uri' AS o_kind FROM c UNION ALL SELECT '_:n4_' || k, '{_TYPE}', '{_MOS}MineralInventory', 'uri' FROM c
UNION ALL SELECT '_:n0_' || k, '{_MOS}name', name, 'literal' FROM c UNION ALL SELECT '_:n0_' || k, '{_MOS}country', CAST(n AS VARCHAR), 'literal' FROM c WHERE n % 4 > 0
UNION ALL SELECT '_:n0_' || k, '{_MOS}deposit_type', seg, 'literal' FROM c UNION ALL SELECT '_:n0_' || k, '{_MOS}deposit_type', name, 'literal' FROM c
UNION ALL SELECT '_:n0_' || k, '{_MOS}mineral_inventory', '_:n4_' || k, 'bnode' FROM c UNION ALL SELECT '_:n4_' || k, '{_MOS}tonnage', bal, 'literal' FROM c UNION ALL SELECT '_:n4_' || k, '{_MOS}commodity', 'Copper', 'literal' FROM c)"""


@query(f"WITH {_TRIPLES} SELECT s, p, o, o_kind, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang FROM tr")
def m5_to_triples(spark, sf):
    return _triples(spark, sf)


@query(f"""WITH {_TRIPLES} SELECT s, CAST(count(DISTINCT p) AS INTEGER) AS n_props, max(CASE WHEN p = '{_TYPE}' THEN o END) AS type, string_agg(o, '|' ORDER BY o) FILTER (p = '{_MOS}deposit_type') AS deposit FROM tr GROUP BY s""")
def a8_resources(spark, sf):
    r = A.resources(_triples(spark, sf))
    return r.select("s", F.size("props").alias("n_props"), col("types")[0].alias("type"), F.array_join(col("props")[_MOS + "deposit_type"], "|").alias("deposit"))


@query("""
SELECT 's/carrier' AS created_by, 'http://doc' AS source_id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS record_id, c_name AS name, CASE WHEN c_nationkey % 4 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS country, 'https://minmod.isi.edu/resource/Q701' AS crs, CAST(2 AS INTEGER) AS n_types,
  'Copper' AS commodity, CASE WHEN c_custkey % 5 > 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS tonnage FROM customer""")
def m6_to_records(spark, sf):
    source = spark.createDataFrame([("_:doc", _MOS + "source_id", "http://doc", "literal", None, None)], "s string, p string, o string, o_kind string, datatype string, lang string")
    r = X.to_records(_triples(spark, sf).unionByName(source), "s/carrier")
    inv = col("mineral_inventory")[0]
    return r.select(
        "created_by", "source_id", "record_id", "name", F.try_element_at("location_info.country", lit(1))["observed_name"].alias("country"), col("location_info.crs.normalized_uri").alias("crs"), F.size("deposit_type_candidate").alias("n_types"),
        inv["commodity"]["observed_name"].alias("commodity"), inv["ore"]["value"].alias("tonnage"),
    )


@query("""
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS s, 'Mine ' || s_nationkey % 3 AS name, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey * 2 AS BIGINT) END AS ri, CASE WHEN s_suppkey % 4 = 1 THEN 'rec' || s_suppkey END AS rid, CASE WHEN s_suppkey % 4 = 2 THEN 'Côte ' || s_nationkey END AS country,
  row_number() OVER (ORDER BY 'Mine ' || s_nationkey % 3, CAST(s_suppkey AS VARCHAR)) - 1 AS ord, 'mine-' || s_nationkey % 3 AS slug FROM supplier)
SELECT s, CASE WHEN ri IS NOT NULL THEN slug || '__' || ri WHEN rid IS NOT NULL THEN rid ELSE slug || CASE WHEN country IS NULL THEN '' ELSE '__' || replace(replace(lower(country), 'ô', 'o'), ' ', '-') END || '__' || ord END AS record_id FROM s""")
def m8_record_ids(spark, sf):
    k = col("s_suppkey")
    sites = t(spark, sf, "supplier").select(
        k.cast("string").alias("s"), F.concat(lit("Mine "), col("s_nationkey") % 3).alias("name"), F.when(k % 4 == 0, k * 2).alias("row_index"), F.when(k % 4 == 1, F.concat(lit("rec"), k)).alias("record_id"),
        F.when(k % 4 == 2, F.concat(lit("Côte "), "s_nationkey")).alias("country"),
    )
    return X.record_ids(sites, lit("row")).select("s", "record_id")


@query("""
WITH l AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS n, CAST(o_custkey AS DOUBLE) AS q, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS e FROM orders),
r AS (SELECT k, q AS ore, e AS grade, 2 AS n_categories FROM l WHERE n = 1 UNION ALL SELECT k, q, e, 3 FROM l WHERE n IN (2, 3) UNION ALL SELECT k, e, NULL, 2 FROM l WHERE n IN (2, 4) UNION ALL SELECT k, NULL, NULL, NULL FROM l WHERE n > 4)
SELECT CAST(k AS VARCHAR) AS s, 'Gold' AS commodity, ore, grade, n_categories FROM r""")
def m10_inventories(spark, sf):
    li = t(spark, sf, "orders").select(col("o_orderkey").cast("string").alias("s"), (col("o_orderkey") % 5 + 1).alias("n"), col("o_custkey").cast("string").alias("q"), money("o_totalprice").alias("e"))
    fact = lambda p, o: F.struct(lit(_MOS + p).alias("p"), o.alias("o"))
    n = col("n")
    items = [
        F.struct(lit(_TYPE).alias("p"), lit(_MOS + "MineralInventory").alias("o")), fact("commodity", lit(" Gold ")), fact("tonnage", F.when(n == 1, col("q")).otherwise(lit("—"))), fact("grade", F.when(n == 1, col("e"))),
        fact("category", F.when(n == 1, lit("Measured+Indicated"))), fact("resource_tonnage", F.when(n.isin(2, 3), col("q"))), fact("resource_grade", F.when(n.isin(2, 3), col("e"))), fact("reserve_tonnage", F.when(n.isin(2, 4), col("e"))),
        fact("reserve_grade", F.when(n.isin(2, 4), lit("n/a"))),
    ]
    triples = li.select("s", F.inline(F.array(*items))).where("o is not null").select("s", "p", "o", F.when(col("p") == _TYPE, "uri").otherwise("literal").alias("o_kind"), F.when(col("p") != _TYPE, F.when(~col("p").contains("tegory") & ~col("p").endswith("commodity"), lit(V.XSD + "decimal"))).alias("datatype"), lit(None).cast("string").alias("lang"))
    out = X.inventories(triples)
    i = col("inventory")
    return out.select("s", i["commodity"]["observed_name"].alias("commodity"), i["ore"]["value"].alias("ore"), i["grade"]["value"].alias("grade"), F.when(i["category"].isNotNull(), F.size(i["category"])).alias("n_categories"))


_LABELS = [("unit", "Q1", "%", None), ("unit", "Q2", "g/t", None), ("commodity", "Q3", "Copper", None), ("commodity_form", "Q4", "Cu2O", "Q3"), ("commodity", "Q5", "Gold", None)]


@query("""
WITH v AS (SELECT DISTINCT CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN '%copper' WHEN 1 THEN 'Gold%' WHEN 2 THEN 'g/t Gold' WHEN 3 THEN 'Cu2O%' WHEN 4 THEN 'zzzz' ELSE 'gold copper' END AS value FROM part)
SELECT value, CASE WHEN value IN ('%copper', 'Gold%', 'Cu2O%') THEN 'Q1' WHEN value = 'g/t Gold' THEN 'Q2' END AS unit, CASE WHEN value IN ('%copper', 'gold copper', 'Cu2O%') THEN 'Q3' WHEN value IN ('Gold%', 'g/t Gold') THEN 'Q5' END AS commodity,
  CASE WHEN value = 'Cu2O%' THEN 'Q4' END AS commodity_form, CASE WHEN value = 'zzzz' THEN 0.0 ELSE 1.0 END::DOUBLE AS commodity_score FROM v""")
def m12_link_units(spark, sf):
    labels = spark.createDataFrame(_LABELS, "kind string, id string, label string, commodity string")
    names = F.array(*map(lit, ("%copper", "Gold%", "g/t Gold", "Cu2O%", "zzzz", "gold copper")))
    texts = t(spark, sf, "part").select(F.element_at(names, (col("p_partkey") % 6 + 1).cast("int")).alias("text"))
    return L.link_units(texts, labels).select("value", "unit", "commodity", "commodity_form", "commodity_score")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'http://x/' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'Q' || c_nationkey END AS uri, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN 0.99 WHEN c_custkey % 3 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM customer""")
def m11_candidates(spark, sf):
    k = col("c_custkey") % 3
    value = F.when(k == 0, F.concat(lit("http://x/"), "c_nationkey")).otherwise(F.concat(lit(" "), "c_mktsegment", lit(" ")))
    c = L.candidate(value, k == 0, F.when(k == 1, F.concat(lit("Q"), "c_nationkey")), lit(0.5))
    return t(spark, sf, "customer").select("c_custkey", c["normalized_uri"].alias("uri"), c["observed_name"].alias("name"), c["confidence"].alias("confidence"))


_MAPPING = """
prefixes: {ex: "http://ex/"}
attributes:
  id: 0
  status: {columns: [1, 2], missing_values: ["", "O"]}
  total: 3
semantic_model:
  ex:Order:1:
    properties: [[drepr:uri, id], [ex:status, status], [ex:total, total, xsd:decimal]]
    static_properties: [[ex:source, carrier]]
    links: [[ex:by, "ex:Person:1"]]
  ex:Person:1:
    properties: [[drepr:blank, who]]
"""


@query(f"""
WITH o AS (SELECT 'http://o/' || o_orderkey AS s, o_orderstatus AS a, o_orderpriority AS b, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS c, '_:ex_Person_1_' || substr(upper(sha256(CAST(o_custkey AS VARCHAR))), 1, 16) AS w FROM orders)
SELECT s, '{_TYPE}' AS p, 'http://ex/Order' AS o, 'uri' AS o_kind, CAST(NULL AS VARCHAR) AS datatype FROM o UNION SELECT s, 'http://ex/status', a, 'literal', NULL FROM o WHERE a <> 'O' UNION SELECT s, 'http://ex/status', b, 'literal', NULL FROM o
UNION SELECT s, 'http://ex/total', c, 'literal', '{V.XSD}decimal' FROM o UNION SELECT s, 'http://ex/source', 'carrier', 'literal', NULL FROM o UNION SELECT s, 'http://ex/by', '_:ex_Person_1_' || lower(substr(w, 15)), 'bnode', NULL FROM o
UNION SELECT '_:ex_Person_1_' || lower(substr(w, 15)), '{_TYPE}', 'http://ex/Person', 'uri', NULL FROM o""")
def m18_declarative_mapping(spark, sf):
    o = t(spark, sf, "orders").select(
        F.concat(lit("http://o/"), "o_orderkey").alias("id"), col("o_orderstatus").alias("status"), col("o_orderpriority").alias("priority"), money("o_totalprice").alias("total"), col("o_custkey").cast("string").alias("cust"), col("o_orderkey").alias("row_index")
    )
    return map_rows(o, _MAPPING, {"who": col("cust")}).drop("lang")


@query("""
SELECT '<http://n/' || n_nationkey || '>' || chr(10) || '    <http://p/name> "' || n_name || '" ;' || chr(10) || '    <http://p/region> <http://r/' || n_regionkey || '> .' AS text FROM nation""")
def k2_to_turtle(spark, sf):
    n = t(spark, sf, "nation")
    none = lit(None).cast("string")
    s = F.concat(lit("http://n/"), "n_nationkey").alias("s")
    a = n.select(s, lit("http://p/name").alias("p"), col("n_name").alias("o"), lit("literal").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    b = n.select(s, lit("http://p/region").alias("p"), F.concat(lit("http://r/"), "n_regionkey").alias("o"), lit("uri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    return to_turtle(a.unionByName(b)).select("text")


@query("""
WITH v AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, c_name AS value FROM customer)
SELECT 'C' || c_nationkey AS class, 'prop' AS prop, 'tbl' AS "table", 'name' AS "column", CAST(pos AS INTEGER) AS pos, value FROM v""")
def s11_training_chunks(spark, sf):
    lists = t(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "\n").alias("v"))
    texts = lists.select(F.concat(lit("C"), "c_nationkey", lit("---prop\n\n::tbl::\nname\n\n"), "v", lit("\n\n" + "-" * 20 + "\n")).alias("value"))
    return parse_training(texts).select("class", "prop", "table", "column", "pos", "value")


def _shacl(spark, sf):
    """Triples of orders as samples, with properties left out or out of range here and there."""
    k = col("o_orderkey")
    gemo, xsd = U.NAMESPACES["gemo"], V.XSD
    fact = lambda p, o, d="string": F.struct(lit(gemo + p).alias("p"), o.cast("string").alias("o"), lit("literal").alias("o_kind"), lit(xsd + d).alias("datatype"))
    items = [
        F.struct(lit(_TYPE).alias("p"), lit(gemo + "Sample").alias("o"), lit("uri").alias("o_kind"), lit(None).cast("string").alias("datatype")), fact("sample_id", F.when(k % 3 > 0, k)), fact("sample_name", F.when(k % 5 > 0, col("o_orderstatus"))),
        fact("top_depth_m", F.when(k % 7 > 0, k % 100), "decimal"), fact("bottom_depth_m", F.when(k % 11 > 0, k % 50 + 100), "decimal"), fact("year", F.when(k % 13 == 0, lit("soon")).otherwise((k % 3000).cast("string")), "integer"),
    ]
    return t(spark, sf, "orders").select(F.concat(lit("http://s/"), k).alias("s"), F.inline(F.array(*items))).where("o is not null").withColumn("lang", lit(None).cast("string"))


_GEMO = U.NAMESPACES["gemo"]


@query(f"""
SELECT 'http://s/' || o_orderkey AS focus, '{_GEMO}sample_id' AS path, 'any' AS rule, 'Warning' AS severity FROM orders WHERE o_orderkey % 15 = 0
UNION ALL SELECT 'http://s/' || o_orderkey, '{_GEMO}top_depth_m', 'together', 'Warning' FROM orders WHERE (o_orderkey % 7 > 0) <> (o_orderkey % 11 > 0)""")
def v1_cross_rules(spark, sf):
    return C.check_cross(_shacl(spark, sf)).drop("message")


@query(f"""
WITH y AS (SELECT 'http://s/' || o_orderkey AS focus, o_orderkey AS k FROM orders)
SELECT focus, '{_GEMO}year' AS path, 'datatype' AS rule, 'Violation' AS severity FROM y WHERE k % 13 = 0 UNION ALL SELECT focus, '{_GEMO}year', 'minInclusive', 'Violation' FROM y WHERE k % 13 = 0 OR k % 3000 < 1000
UNION ALL SELECT focus, '{_GEMO}year', 'maxInclusive', 'Warning' FROM y WHERE k % 13 = 0 OR k % 3000 > 2500 UNION ALL SELECT focus, '{_GEMO}sample_id', 'minCount', 'Warning' FROM y WHERE k % 3 = 0
UNION ALL SELECT focus, '{_GEMO}sample_name', 'maxCount', 'Violation' FROM y WHERE k % 5 > 0 UNION ALL SELECT focus, '{_GEMO}sample_id', 'nodeKind', 'Violation' FROM y WHERE k % 3 > 0""")
def v10_property_rules(spark, sf):
    c = "gemo:Sample"
    rules = C.rules_of(spark, [
        (c, "gemo:year", "datatype", "xsd:integer", "Violation"), (c, "gemo:year", "minInclusive", 1000, "Violation"), (c, "gemo:year", "maxInclusive", 2500, "Warning"), (c, "gemo:sample_id", "minCount", 1, "Warning"),
        (c, "gemo:sample_name", "maxCount", 0, "Violation"), (c, "gemo:sample_id", "nodeKind", C.SH + "IRI", "Violation"),
    ])
    return C.check_properties(_shacl(spark, sf), rules).drop("message")
