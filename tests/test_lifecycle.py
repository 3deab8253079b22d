import io
import json
import re
import zipfile

from pyspark.sql import functions as F

from strataform.functions.uris import NAMESPACES
from strataform.operators import labelling as L
from strataform.plans import lifecycle
from strataform.sources import analysis, models, spreadsheets
from strataform.sources import ontology as O
from strataform.sources import turtle as TTL

MOS = NAMESPACES["mos"]


def workbook():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Na</t><t>me</t></si><si><t>x</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row><c r="A2"><v>2013.0</v></c><c r="AB2"><v>0.5</v></c><c r="B2" t="b"><v>1</v></c><c r="D2"/></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData/></worksheet>')
    return out.getvalue()


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    cells = spreadsheets.read_spreadsheet(spark, f"{tmp_path}/w.xlsx")
    assert {(r.sheet, r.row, r.col, r.value) for r in cells.collect()} == {("One", 0, 0, "Name"), ("One", 0, 2, "in"), ("One", 1, 0, "2013"), ("One", 1, 27, "0.5"), ("One", 1, 1, "TRUE")}
    assert spreadsheets.fill_grid(cells).count() == 2 * 28


def test_analysis(spark, tmp_path):
    cell = lambda r, c, kind, text, **more: {"row_index": r, "column_index": c, "kind": kind, "content": text, **more}
    cells = [cell(0, 0, "columnHeader", "Tonnage", column_span=2), cell(1, 0, "columnHeader", "Mt"), cell(1, 1, "columnHeader", "%\nCu"), cell(2, 0, None, "5 :unselected:"), cell(2, 1, "content", "0.5")]
    (tmp_path / "r.json").write_text(json.dumps({"tables": [{"row_count": 3, "column_count": 2, "cells": cells}]}))
    names, body = analysis.analysed_tables(analysis.read_analysis(spark, f"{tmp_path}/r.json"))
    assert [r.name for r in names.orderBy("col_index").collect()] == ["Tonnage Mt", "Tonnage % Cu"]
    assert [(r.row, r.value) for r in body.orderBy("col").collect()] == [(0, "5"), (0, "0.5")]


def test_label_infer_export(spark, tmp_path):
    data = {"name": ["Alpha Mine", "Beta Pit", "Gamma Hill"], "tonnage": ["1.5", "20", "300"], "commodity": ["Cu", "Zn", "Cu"]}
    klass = {"name": "MineralSite", "tonnage": "MineralInventory", "commodity": "MineralInventory"}
    training = spark.createDataFrame([(MOS + klass[k], MOS + k, f"{k}{j}", k, v) for k, vs in data.items() for j in range(2) for v in vs], "class string, prop string, tcol string, column string, value string")
    cells = spark.createDataFrame([("t", i, k, v) for i, (k, vs) in enumerate(data.items()) for v in [*vs, " "]], "table_id string, col_index int, column string, value string")
    pairs = L.features(cells, training)
    truth = F.element_at(F.array(*(F.lit(MOS + k) for k in data)), F.col("col_index") + 1)
    model = L.fit_labeller(pairs.withColumn("label", (F.col("prop") == truth).cast("double")))
    types = lifecycle.label_columns(cells, training, model, 1).cache()
    schema = spark.createDataFrame([(MOS + "MineralSite", MOS + "mineral_inventory", MOS + "MineralInventory", 1.0)], "source_type string, prop string, target_type string, score double")
    limits = spark.createDataFrame([(MOS + "MineralInventory", 1)], "class string, most int")
    nodes, edges = lifecycle.infer_models(types, schema, limits)
    found = lifecycle.collect_model(nodes, edges, "t")
    assert sorted(n.kind for n in found.nodes) == ["class", "class", "data", "data", "data"] and len(found.edges) == 4
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*data.values()))], "row_index long, name string, tonnage string, commodity string")
    source = models.Model([*found.nodes, models.Node(99, "literal", value="http://doc")], [*found.edges, models.Link(found.roots()[0].id, 99, MOS + "source_id")])
    got = {r.name: r for r in lifecycle.export_table(table, source, f"{tmp_path}/out", "u/me").collect()}
    assert got["Beta Pit"].mineral_inventory[0].ore.value == 20.0 and got["Beta Pit"].source_id == "http://doc"
    folders = lifecycle.map_files(spark, f"{tmp_path}/out/data.ttl/*.txt", f"{tmp_path}/again", "u/me")
    assert sum(spark.read.json(f).count() for f in folders) == 3


def test_stores(spark, tmp_path):
    (tmp_path / "o.ttl").write_text('@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/2000/01/rdf-schema#> . <http://c> a o:Class ; r:label "C" . <http://p> a o:DatatypeProperty ; r:domain <http://c> .')
    (tmp_path / "e.ttl").write_text('@prefix r: <http://www.w3.org/2000/01/rdf-schema#> . @prefix s: <http://www.w3.org/2004/02/skos/core#> . <https://minmod.isi.edu/resource/Q1> r:label "One" ; s:altLabel "1" , "I" ; <http://is> <https://minmod.isi.edu/resource/Q2> .')
    lifecycle.build_stores(spark, f"{tmp_path}/o.ttl", f"{tmp_path}/e.ttl", f"{tmp_path}/db")
    assert spark.read.parquet(f"{tmp_path}/db/classes").first().label == "C" and spark.read.parquet(f"{tmp_path}/db/props").count() == 1
    entities = spark.read.parquet(f"{tmp_path}/db/entities")
    view = O.entity_views(entities).first()
    assert view.id == "mnr:Q1" and view.aliases == ["1", "I"] and view.props["http://is"][0].value == "mnr:Q2"
    assert spark.read.parquet(f"{tmp_path}/db/entity_labels").first().label == "One"
    bad = spark.createDataFrame(TTL.parse_turtle("<http://x> <http://y> 1 ."), TTL.TRIPLE)
    import pytest

    with pytest.raises(Exception, match="no label"):
        O.read_entities(bad).collect()


def test_library_does_not_need_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in [*root.joinpath("strataform").rglob("*.py")]:
        if "llm" not in path.parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", path.read_text()), path
