import pytest

from compare import DATA, same
from strataform.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, f"{DATA}/sf0.001", QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["table_id", "col_index", "class", "prop", "score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_top_n_is_cut_before_the_shuffle(spark):
    plan = QUERIES["w1_top_types"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
