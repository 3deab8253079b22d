import pytest
from pyspark.sql import functions as F

from strataform.functions.uris import NAMESPACES
from strataform.operators import export as X
from strataform.operators import validation as C
from strataform.operators.aggregates import merge_records
from strataform.sources import models as M
from strataform.sources import ontology as O
from strataform.sources import training as T
from strataform.sources import turtle as TTL

MOS = NAMESPACES["mos"]
TREE = """
version: simple-tree-1
model:
  - type: mos:MineralSite
    props:
      mos:row_index: row index
      mos:name: Name
      mos:deposit_type: [Main, Other]
      mos:mineral_inventory:
        - type: mos:MineralInventory
          props: {mos:tonnage: Column 4, mos:commodity: {literal-string: Cu}, mos:category: {literal-string: Measured+Indicated}}
        - type: mos:MineralInventory
          props: {mos:tonnage: {column: 5}, mos:commodity: {literal-string: Zn}}
      mos:reference:
        type: mos:Document
        props: {mos:doi: {literal-string: 10.1/x}, mos:title: {literal-string: A paper}}
prefixes: {mos: "https://minmod.isi.edu/ontology-simple/"}
"""
COLUMNS = ["row index", "Name", "Main", "Other", "", "Main"]
ONTOLOGY = """@prefix mos: <https://minmod.isi.edu/ontology-simple/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . # a comment
mos:Site a owl:Class ; rdfs:label "Site"@en . mos:Mine a owl:Class ; rdfs:label "Mine" ; rdfs:subClassOf mos:Site .
mos:inv a owl:ObjectProperty ; rdfs:domain mos:Site ; rdfs:range mos:Mine ; rdfs:label "inv"@en ; .
mos:grade a owl:DatatypeProperty ; rdfs:domain mos:Mine ; rdfs:range xsd:float ; rdfs:label "grade" , "Grade" .
mos:note a owl:DatatypeProperty ; rdfs:domain mos:Mine ."""


def test_description_round_trip():
    model = M.read_description(TREE, COLUMNS)
    assert [n.kind for n in model.nodes].count("class") == 4
    assert {n.col_index for n in model.nodes if n.kind == "data"} == {0, 1, 2, 3, 4, 5}
    again = M.read_description(M.write_description(model, COLUMNS), COLUMNS)
    assert M.model_to_json(again) == M.model_to_json(model)
    assert M.model_to_json(M.model_from_json(M.model_to_json(model))) == M.model_to_json(model)


@pytest.mark.parametrize("bad", ["version: x\nmodel: []", "version: simple-tree-1\nmodel: [{type: 'mos:A', props: {'mos:b': nowhere}}]", "version: simple-tree-1\nmodel: [{type: 'mos:A', props: {'mos:b': {column: 99}}}]", "version: simple-tree-1\nmodel: [{type: 'mos:A', props: {'mos:b': {odd: 1}}}]"])
def test_bad_descriptions(bad):
    with pytest.raises(M.DescriptionError):
        M.read_description(bad, COLUMNS)


def table(spark):
    rows = [(0, "0", "Big Mine", "vein", "", "1.5", "2"), (1, "1", "Côte", "skarn", "vein", "—", "")]
    return spark.createDataFrame(rows, "rid long, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string")


def test_table_to_records(spark):
    triples = X.to_triples(table(spark), M.read_description(TREE, COLUMNS), row="rid", datatypes={MOS + "tonnage": NAMESPACES["xsd"] + "decimal"})
    rows = {r.record_id: r for r in X.to_records(triples, "u/me").collect()}
    assert set(rows) == {"big-mine__0", "cote__1"}
    big, cote = rows["big-mine__0"], rows["cote__1"]
    assert big.source_id == "https://doi.org/10.1/x" and big.location_info.crs.normalized_uri.endswith("Q701")
    assert sorted((i.commodity.observed_name, i.ore.value) for i in big.mineral_inventory) == [("Cu", 1.5), ("Zn", 2.0)]
    assert [c.observed_name for i in big.mineral_inventory if i.category for c in i.category] == ["Measured", "Indicated"]
    assert sorted(c.observed_name for c in cote.deposit_type_candidate) == ["skarn", "vein"]
    assert [i.ore for i in cote.mineral_inventory] == [None, None]
    with pytest.raises(ValueError):
        X.to_records(triples, "me")


def test_empty_table_gives_no_triples(spark):
    assert X.to_triples(table(spark).limit(0), M.read_description(TREE, COLUMNS), row="rid").count() == 0


def test_records_that_differ_are_an_error(spark):
    df = spark.createDataFrame([("a", "x", [1]), ("a", "y", [2]), ("b", "z", [3])], "k string, n string, v array<int>")
    with pytest.raises(Exception, match="records differ"):
        merge_records(df, "k", ["n"], "v").collect()
    assert {r.k: r.consistent for r in merge_records(df, "k", ["n"], "v", strict=False).collect()} == {"a": False, "b": True}
    with pytest.raises(Exception, match="repeated record"):
        merge_records(df.where("n <> 'y'").unionByName(df.where("n = 'x'")), "k", ["n"], "v", allow=False).collect()


def test_turtle_round_trip(spark, tmp_path):
    text = ONTOLOGY + '\n<http://a> mos:x "q\\"\\n\\u00e9" , 5 , 1.5 , 2e3 , true ; mos:y [ mos:z ( 1 "b"@en ) ] . _:k mos:x """long\n"text""" .'
    (tmp_path / "a.ttl").write_text(text)
    triples = TTL.read_turtle(spark, f"{tmp_path}/a.ttl").drop("source_file")
    TTL.write_turtle(triples, f"{tmp_path}/out")
    back = TTL.read_turtle(spark, f"{tmp_path}/out").drop("source_file")
    flat = lambda df: sorted((r.p, r.o if r.o_kind != "bnode" else "", r.o_kind, r.datatype or "", r.lang or "") for r in df.collect())
    assert flat(triples) == flat(back) and triples.count() > 20
    assert 'q"\né' in [r.o for r in triples.collect()]
    with pytest.raises(TTL.TurtleError):
        TTL.parse_turtle("zzz:a zzz:b zzz:c .")


def test_turtle_is_parsed_line_by_line():
    text = '@prefix m: <http://m/> . # "\n<http://a> m:x """one\n\n"two" # three\n""" ,\n\n \'\'\'a\n"""\nb\'\'\', "", "c"\n ; m:y ( 1\n 2 ) .\n# end\n<http://b> m:z """""" .'
    whole = TTL.parse_turtle(text)
    assert list(TTL._Parser(text.splitlines(keepends=True)).parse()) == whole and [t[2] for t in whole[:2]] == ['one\n\n"two" # three\n', 'a\n"""\nb']
    read = 0

    def statements():
        nonlocal read
        for read in range(1, 1001):
            yield f'<http://s{read}> <http://p> """{read}\n'
            yield f'""" , {read} .\n'

    triples = TTL._Parser(statements()).parse()
    assert next(triples) == ("http://s1", "http://p", "1\n", "literal", None, None) and read < 4
    assert sum(1 for _ in triples) == 1999
    for bad in ('<http://a> <http://b> """c\n', "<http://a> <http://b>\n", '<http://a> <http://b> "c\n" .\n', "<http://a> <http://b> ( 1\n"):
        with pytest.raises(TTL.TurtleError):
            list(TTL._Parser(bad.splitlines(keepends=True)).parse())


def test_split_turtle_file_keeps_its_order(spark, tmp_path):
    own = [f'<http://s{i}> <http://p> """{i}\r\n.""" .\n' for i in range(2000)]
    (tmp_path / "a.ttl").write_bytes("".join(own).encode())
    (tmp_path / "b.ttl").write_bytes(("\n\n" + "".join(own[:3])).encode())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "1000")
        assert spark.read.text(f"{tmp_path}/a.ttl").rdd.getNumPartitions() > 9
        got = TTL.read_turtle(spark, f"{tmp_path}/*.ttl").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r.source_file[-5:], r.s, r.o) for r in got) == sorted([("a.ttl", f"http://s{i}", f"{i}\r\n.") for i in range(2000)] + [("b.ttl", f"http://s{i}", f"{i}\r\n.") for i in range(3)])


def test_ontology(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(ONTOLOGY)
    triples = TTL.read_turtle(spark, f"{tmp_path}/o.ttl")
    props = {r.id: r for r in O.read_properties(triples).collect()}
    assert props["mos:inv"].datatype == O.ANY_URI and props["mos:grade"].datatype.endswith("float") and props["mos:note"].datatype == ""
    conns = {r.prop.rpartition("/")[2]: (r.source_type.rpartition("/")[2], r.target_type) for r in O.connections(O.read_properties(triples)).collect()}
    assert conns["grade"] == ("Mine", None) and conns["inv"] == ("Site", MOS + "Mine")
    classes = O.read_classes(triples)
    assert [(r["class"], r.ancestor, r.distance) for r in O.ancestors(classes).collect()] == [(MOS + "Mine", MOS + "Site", 1)]
    assert O.default_classes(spark).unionByName(classes).count() == 4


def test_meta_properties(spark):
    metas = spark.createDataFrame([("m", [("[source]", "p", "[target]")]), ("n", [("[source]", "p", "x"), ("C", "q", "[target]")])], "id string, edges array<struct<source:string,prop:string,target:string>>")
    assert {r.id: r.prop for r in O.expand_meta(metas).collect()} == {"m": "p", "n": "q"}
    assert {r.id: r.prop for r in O.equivalent_property(metas).collect()} == {"m": "p", "n": None}


def test_training_round_trip(spark, tmp_path):
    rows = [("C", "p", "t1", "grade", str(v)) for v in range(150)] + [("C", "p", "t2", "g\nx", "a"), ("C", "p", "t2", "g\nx", " ")]
    labelled = spark.createDataFrame(rows, "class string, prop string, table string, column string, value string")
    text = T.training_texts(labelled).first().text
    (tmp_path / "f.txt").write_text(text)
    back = T.read_training(spark, f"{tmp_path}/f.txt")
    assert {(r.table, r.column, r["count"]) for r in back.groupBy("table", "column").count().collect()} == {("t1", "grade", 100), ("t2", "g\\nx", 1)}
    (tmp_path / "g.txt").write_text("C---p\n\nname\n\n1\n2\n")
    assert T.read_training(spark, f"{tmp_path}/g.txt").where("table is null").count() > 0


def test_shacl(spark):
    shapes = """@prefix sh: <http://www.w3.org/ns/shacl#> . @prefix g: <https://geochemistry.isi.edu/ontology/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
    g:S a sh:NodeShape ; sh:targetClass g:Sample ; sh:property [ sh:path g:year ; sh:datatype xsd:integer ; sh:maxCount 1 ; sh:minInclusive 1000 ] ; sh:property [ sh:path g:of ; sh:class g:Paper ; sh:minCount 1 ; sh:severity sh:Warning ; sh:message "needs one" ] ."""
    data = """@prefix g: <https://geochemistry.isi.edu/ontology/> . g:a a g:Sample ; g:sample_id "1" ; g:year 999 , 2000 ; g:of g:b . g:b a g:Paper ; g:paper_title "t" . g:c a g:Sample ; g:top_depth_m 1.0 ; g:year "x" .
    @prefix m: <https://minmod.isi.edu/ontology/> . g:l a m:LocationInfo ; m:location "POINT(200 10)" . g:k a m:LocationInfo ; m:location "POLYGON((0 0))" ."""
    kind = TTL.TRIPLE
    rules = C.read_rules(spark.createDataFrame(TTL.parse_turtle(shapes), kind))
    got = {(r.focus[-1], r.path.rpartition("/")[2], r.rule) for r in C.validate(spark.createDataFrame(TTL.parse_turtle(data), kind), rules).collect()}
    assert got == {("a", "year", "maxCount"), ("a", "year", "minInclusive"), ("c", "year", "datatype"), ("c", "year", "minInclusive"), ("c", "of", "minCount"), ("c", "sample_id", "any"), ("c", "top_depth_m", "together"), ("l", "location", "point")}


def test_collapse_locations(spark):
    kind = "site string, location_info array<struct<location:struct<latitude:double,longitude:double>,country:array<string>,state_or_province:array<string>,source:string,confidence:double,metadata:struct<observed_name:string,normalized_uri:string,is_selected:boolean,rejected:boolean>>>"
    one = lambda sel, rej: ((36.5, -82.5), ["USA"], ["Tennessee"], "mindat", 0.9, ("Mine", "http://m/1", sel, rej))
    df = spark.createDataFrame([("a", [one(False, False), one(True, False)]), ("b", [one(True, True)]), ("c", [])], kind)
    got = {r.site: r.location_info for r in C.collapse_locations(df).collect()}
    assert got["a"].location == "POINT (-82.5 36.5)" and got["a"].country[0].observed_name == "USA" and got["a"].location_description == "Mine (http://m/1)"
    assert got["b"] is None and got["c"] is None


def test_streaming(spark, tmp_path):
    from strataform import streaming

    spark.createDataFrame([("2,200",), ("x",)], "v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("v string").parquet(f"{tmp_path}/in")
    streaming.to_table(streaming.normalised_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["2200", "x"]
    timed = spark.readStream.schema("v string").parquet(f"{tmp_path}/in").withColumn("at", F.current_timestamp())
    query = streaming.quality_by_window(timed, "at", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n_cells")).first()[0] == 2


def test_labeller(spark):
    from strataform.operators import labelling as L

    data = {"grade": ["0.5", "1.2", "3"], "name": ["Alpha", "Beta", "Gamma"], "year": ["1999", "2001", "2015"]}
    training = spark.createDataFrame([("C", k, f"t{j}", k, v) for k, vs in data.items() for j in range(2) for v in vs], "class string, prop string, tcol string, column string, value string")
    cells = spark.createDataFrame([("t", i, k, v) for i, (k, vs) in enumerate(data.items()) for v in vs], "table_id string, col_index int, column string, value string")
    pairs = L.features(cells, training)
    truth = F.element_at(F.array(*map(F.lit, data)), F.col("col_index") + 1)
    model = L.fit_labeller(pairs.withColumn("label", (F.col("prop") == truth).cast("double")))
    best = {r.col_index: r.prop for r in L.predict_types(model, pairs, 1).collect()}
    assert best == {0: "grade", 1: "name", 2: "year"}
    asked = L.ask_types(cells.groupBy("table_id", "col_index", "column").agg(F.collect_list("value").alias("values")), lambda name, values: name if name != "year" else None, training.select("class", "prop").distinct())
    assert {r.col_index for r in asked.collect()} == {0, 1}


def test_rules_broadcast_nothing_that_grows(spark, tmp_path):
    from strataform.plans import QUERIES

    spark.range(100).selectExpr("id as o_orderkey", "'F' as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("v10_property_rules", "v11_minCount", "v13_class"):
        depth, plan = None, QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "FileScan" in plan
        for line in plan.splitlines():
            at = len(line) - len(line.lstrip(" :+-"))
            depth = at if "BroadcastExchange" in line else None if depth is not None and at <= depth else depth
            assert depth is None or "FileScan" not in line, name


def test_many_rules_are_merged(spark, monkeypatch):
    triples = spark.createDataFrame([("a", C.RDF_TYPE, "http://C", "uri", None, None)], TTL.TRIPLE)
    rules = spark.createDataFrame([("s", "http://C", f"http://p{i}", "minCount", "1", "Violation", "m") for i in range(5)], C.RULE)
    monkeypatch.setattr(C, "RULES", 4)
    found = C.check_properties(triples, rules)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5


@pytest.mark.parametrize("name", [
    "v10_property_rules",
    "v11_maxCount",
    "v11_minCount",
    "v12_maxInclusive",
    "v12_minInclusive",
    "v13_class",
])
def test_rule_query_broadcasts_only_rules(spark, tmp_path, name):
    import re

    from strataform.plans import QUERIES

    spark.range(100).selectExpr("id as o_orderkey", "'F' as o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan()
    kinds = re.findall(r"(BroadcastHashJoin|BroadcastNestedLoopJoin|SortMergeJoin) .*?(Inner|LeftOuter|LeftAnti)", plan.toString())
    merged = [how for join, how in kinds if join == "SortMergeJoin"]
    assert sorted(merged) == ["Inner", "Inner", "LeftAnti", "LeftOuter"]  # values, those of classes, classes of objects, counts
    assert {how for join, how in kinds if join != "SortMergeJoin"} == {"Inner"}  # rules
