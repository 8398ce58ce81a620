import pytest

from tests.oracle import same_rows
from waymark import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, name):
    same_rows(plans.QUERIES[name](spark, SF), SF, plans.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_without_sql(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_datum_round_trip(spark):
    assert plans.QUERIES["shifted_datum_round_trip"](spark, SF).where("error > 0").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_of_all_links(spark):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    buyer = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    for order, part in lines:
        x, y = root(buyer[order]), root(-1 - part)
        parent[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in plans.QUERIES["graph_components"](spark, SF).collect()} == {x: root(x) for x in parent}
