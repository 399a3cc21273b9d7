"""Registered queries against their SQL on the smallest tables."""

import pytest

from checks.compare import differences, duck
from checks.queries import ORACLES, QUERIES
from tracewing.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], con) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())


def test_waybills_without_pieces_whatever_their_number_of_events(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from checks import queries

    seen, publish = [], queries.flows.publish
    scored = queries.scored_events(spark, SF).limit(20).withColumn("awbNo", F.lit(None).cast("string"))
    # 20 waybills of 300 events
    many = scored.withColumn("of", F.explode(F.sequence(F.lit(1), F.lit(300))))
    many = many.withColumn("n", F.row_number().over(Window.orderBy("of", "event_id")).cast("bigint"))
    many = many.withColumn("awbNo", F.concat(F.lit("w"), (F.col("n") % 20).cast("string"))).withColumn("event_id", F.col("n"))
    many = stored(many.drop("of", "n"), "many-events")
    monkeypatch.setattr(queries, "scored_events", lambda *_: many)
    monkeypatch.setattr(queries.flows, "publish", lambda s, pieces, names: seen.append(pieces) or publish(s, pieces, names))
    row = queries.QUERIES["publish_dangling_links"](spark, SF).first()
    assert (row.shipments, row.events, row.dangling) == (20, 6_000, 0)
    linked = seen[0].where("awbNo is not null")
    assert 0 < linked.select("awbNo").distinct().count() < 20
    assert linked.count() > 2_000
