from compare import DATA
from strataform.plans import QUERIES
from strataform.plans.carriers import _graph


def test_trees_reach_every_column(spark):
    sf = f"{DATA}/sf0.001"
    columns = lambda df: {(r.table_id, r.dst) for r in df.where("dst like 'column:%'").select("table_id", "dst").collect()}
    assert columns(QUERIES["g16_steiner_trees"](spark, sf)) == columns(_graph(spark, sf)[1])
