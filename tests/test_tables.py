"""Tables: small extracts of published examples, kept here as text."""

import pytest
from pyspark.sql import functions as F

from strataform.operators import joins as J
from strataform.operators import table_prep as P
from strataform.sources import tables as S

GRAPHITE = "record_id,Mineral Site Name,Tonnage,Grade\r\n1,\"Ambatâ, north\",\"2,200\",5.5\r\n2,Balama,,10\r\n"


@pytest.fixture
def graphite(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes(GRAPHITE.encode())
    return S.read_csv(spark, f"{tmp_path}/g.csv")


def test_read_and_normalise(graphite):
    rows = [tuple(r) for r in P.normalise(graphite).orderBy("record_id").collect()]
    assert rows == [("1", "Ambatâ, north", "2200", "5.5"), ("2", "Balama", "", "10")]


def test_other_suffix_is_an_error(spark):
    with pytest.raises(ValueError, match="not a delimited file"):
        S.read_csv(spark, "x.xlsx")


def test_raw_cells_and_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,,x\n b,,\n1,2,3\n")
    cells = S.read_raw_cells(spark, f"{tmp_path}/t.csv").withColumn("table_id", F.lit("t"))
    assert cells.count() == 9
    names, body = P.promote_headers(cells, 2)
    assert [r.name for r in names.orderBy("col_index").collect()] == ["a  b", "Column 1", "x"]
    assert [(r.row, r.value) for r in body.orderBy("col").collect()] == [(0, "1"), (0, "2"), (0, "3")]
    assert P.spread(body, 3).first()["c2"] == "3"


def test_matrix(spark):
    df = spark.createDataFrame([(0, "p", "1", "NA", "5"), (1, "q", "", "N/A", "None"), (2, "r", None, "2", "")], "row_index long, name string, La string, Ce string, Y string")
    got = P.matrix_to_rows(df, {"g0": ["La", "Ce"], "g1": ["Y"]})
    assert {tuple(r) for r in got.collect()} == {(0, "p", "La", "1", None, None), (0, "p", None, None, "Y", "5"), (2, "r", "Ce", "2", None, None)}
    assert got.count() == 3
    assert P.matrix_to_rows(df.limit(0), {"": ["La"]}).count() == 0


def test_column_specs():
    assert P.parse_columns("1,2,3", 5) == {"": [1, 2, 3]}
    assert P.parse_columns("2:9", 5) == {"": [2, 3, 4]}
    assert P.parse_columns("1:2,4:", 6) == {"g0": [1, 2], "g1": [4, 5]}
    assert P.parse_columns("5", 6) == {"": [5]}
    assert P.parse_columns("1,3:4", 6) == {"g0": [1], "g1": [3, 4]}
    assert P.parse_columns({"a": [0, 9]}, 3) == {"a": [0]}
    assert P.column_number("BO") == 66 and P.column_number("A") == 0 and P.column_number("DL") == 115
    for bad in ("x", "1-2", ""):
        with pytest.raises(ValueError):
            P.parse_columns(bad, 3)


def test_operations_with_bars_in_json():
    assert P.parse_ops('norm_table | remove_cols{"cols": "1|2"}|x{}') == [("norm_table", {}), ("remove_cols", {"cols": "1|2"}), ("x", {})]
    with pytest.raises(ValueError):
        P.parse_ops("a | ???")


def test_join_rules(spark):
    a = spark.createDataFrame([("1", "x"), ("", "y"), ("3", "z")], "k string, name string")
    b = spark.createDataFrame([("1", "p"), ("1", "q"), ("", "r")], "k string, name string")
    got = sorted(tuple(r) for r in J.join_tables(a, b).collect())
    assert got == [("", "y", "r"), ("1", "x", "p"), ("1", "x", "q")]
    assert J.join_tables(a, b).columns == ["k", "name", "name (1)"]
    with pytest.raises(ValueError, match="no column in common"):
        J.natural_column(["a"], ["b"])
    with pytest.raises(ValueError, match="clash"):
        J.disambiguate(["k", "name", "name (1)"], ["k", "name"], "k")


def test_trusted_lookup_is_strict(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    trusted = spark.createDataFrame([("a", "Q1")], "value string, uri string")
    assert J.trusted_lookup(rows, trusted, "t", strict=False).where("uri is null").count() == 1
    with pytest.raises(Exception, match="not trusted"):
        J.trusted_lookup(rows, trusted, "t").collect()


def test_spans_and_headers(spark):
    spans = spark.createDataFrame([("t", 0, 0, 0, 1, 2, "columnHeader", "A\nb"), ("t", 1, 1, 0, 1, 1, "columnHeader", "c"), ("t", 2, 1, 1, 1, 1, "columnHeader", "A b"), ("t", 3, 2, 0, 1, 2, "content", ":unselected: v ")], "table_id string, pos int, row int, col int, row_span int, col_span int, kind string, content string")
    cells = P.fill_spans(spans)
    got = {(r.row, r.col): r.value for r in P.merge_headers(cells).collect()}
    assert got == {(0, 0): "A b c", (0, 1): "A b", (1, 0): "v", (1, 1): "v"}
    heads = cells.where("kind = 'columnHeader'")
    assert P.merge_headers(heads).count() == heads.count()


def test_samples_are_stable(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("a"))
    one, two = (sorted(r.a for r in P.sample_rows(df.repartition(n), 7).collect()) for n in (2, 5))
    assert one == two and len(one) == 7


def test_shorten(spark):
    seen = []

    def attempt(df):
        seen.append(df.count())
        if seen[-1] > 12:
            raise OverflowError
        return seen[-1]

    assert P.shorten_until(spark.range(40), ["id"], attempt, 40) == 10 and seen == [40, 30, 20, 10]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    S.write_store(df, f"{tmp_path}/s", "id", 2)
    defaults = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    assert {(r.id, r.v) for r in S.open_store(spark, f"{tmp_path}/s", "id", defaults).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {(r.id, r.v) for r in S.open_store(spark, f"{tmp_path}/s", "id", defaults, stored_first=False).collect()} == {("a", 1), ("b", 9), ("c", 3)}


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    S.write_records(df, f"{tmp_path}/r", compress=True)
    assert sorted((r.a, r.b) for r in spark.read.json(f"{tmp_path}/r").collect()) == [(1, "x"), (2, None)]
    S.write_csv(df, f"{tmp_path}/c", ["a"])
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2


def test_labelled_dataset_of_a_zip(spark, tmp_path):
    import zipfile

    from strataform.sources.training import read_dataset, table_cells

    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("set/tables/one.csv", 'a,"b, c"\n1,"x\ny"\n2\n')
        z.writestr("set/tables/two.csv", "a\n")
        z.writestr("set/tables/alone.csv", "a\n1\n")
        z.writestr("set/descriptions/one/version.01.json", "old")
        z.writestr("set/descriptions/one/version.02.json", "new")
        z.writestr("set/descriptions/two.json", "two")
        z.writestr("set/descriptions/none.json", "none")
    pairs = read_dataset(spark, str(tmp_path / "set.zip"))
    assert {r.stem: r.description for r in pairs.collect()} == {"one": "new", "two": "two"}
    cells = sorted(tuple(r) for r in table_cells(pairs).collect())
    assert cells == [("one", 0, 0, "a", "1"), ("one", 0, 1, "b, c", "x\ny"), ("one", 1, 0, "a", "2"), ("one", 1, 1, "b, c", "")]
