"""Every registered query against its DuckDB equivalent on the smallest test tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle.compare import duck, duck_rows, spark_rows
from rollcall.sources import requests
from rollcall.sources.bindings import role
from tests.conftest import SF


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


OWN = [*entry.READS, *entry.WRITES]


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.queries()) and set(OWN) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", OWN)
def test_query(spark, connection, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == duck_rows(connection, entry.oracle_sql()[name])


def test_binding_counts(spark, connection):
    from oracle.sql import BASE

    model = entry.Tables(spark, SF).model
    for name, table in model.tables().items():
        assert table.count() == connection.execute(f"{BASE} SELECT count(*) FROM {name}").fetchone()[0], name
    assert model.marks.where("status = 'present'").count() == 155
    assert model.stage2_sessions.count() == 4 and model.stage2_marks.count() == 7


def test_every_order_and_event_has_a_role(spark):
    t = entry.Tables(spark, SF)
    roles = {r.role: r["count"] for r in t.orders.select(role(F.col("o_orderpriority")).alias("role")).groupBy("role").count().collect()}
    assert set(roles) == {"outing", "service"} and sum(roles.values()) == t.orders.count()
    assert t.feed.count() == t.events.count()
    days = t.orders.selectExpr("cast(o_orderdate as date) as d").distinct().count()
    pairs = t.orders.selectExpr("cast(o_orderdate as date)", "o_custkey").distinct().count()
    for asked, lines in (requests.event_requests(t.orders), requests.replace_requests(t.orders)):
        assert asked.count() == days and lines.where("member_id >= 0").distinct().count() == pairs
    assert requests.event_ids_to_delete(t.orders, "k").count() == days
