"""What is kept, joined and sorted stays small: digests that are new, links of a hop, shares of leaves, nodes of a task."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from checks import queries as q
from tracewing.operators import jsonld, learning
from tracewing.session import scratch_path
from tracewing.sources import writers

SF = "/root/testdata/sf0.001"


def _outbox(spark, n, more="select * from range(0)"):
    return spark.range(n).unionByName(spark.sql(more)).select(
        F.lit("e").alias("endpoint"), F.concat(F.lit("kind-"), (F.col("id") % 3).cast("string")).alias("kind"), F.col("id").cast("string").alias("body")
    )


@pytest.mark.parametrize("few", [0, 4, 200_000])
def test_each_body_is_sent_once_whatever_is_new(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(writers, "FEW", few)
    path, ledger = f"{tmp_path}/sent", f"{tmp_path}/ledger"
    before = spark.conf.get(writers.OPEN_FILES)
    repeated = "select explode(array(1L, 1L, 7L, 20L)) id"
    for run, n in (("1", 3), ("2", 3), ("3", 10), ("4", 12)):
        writers.send_once(_outbox(spark, n, repeated), path, ledger, run)
    sent = spark.read.schema("endpoint string, body string, run int, kind string").json(path).collect()
    assert sorted((r.run, int(r.body)) for r in sent) == [(1, 0), (1, 1), (1, 2), (1, 7), (1, 20)] + [(3, i) for i in (3, 4, 5, 6, 8, 9)] + [(4, 10), (4, 11)]
    digests = [r.digest for r in spark.read.parquet(ledger).collect()]
    assert set(digests) == {r.digest for r in writers._digested(_outbox(spark, 12, "select 20L id")).collect()} and len(digests) == 13
    assert spark.conf.get(writers.OPEN_FILES) == before


def test_a_run_without_news_keeps_no_digests(spark, tmp_path):
    for run in ("1", "2"):
        tables = {t for t in glob.glob(f"{scratch_path(spark, 'x').rsplit('/', 1)[0]}/*") if "digests" in t}
        writers.send_once(_outbox(spark, 50), f"{tmp_path}/sent", f"{tmp_path}/ledger", run)
    made = {t for t in glob.glob(f"{scratch_path(spark, 'x').rsplit('/', 1)[0]}/*") if "digests" in t} - tables
    assert made and sum(spark.read.parquet(t).count() for t in made) == 0


def test_appending_by_kind_keeps_rows_and_settings(spark, tmp_path):
    before = spark.conf.get(writers.OPEN_FILES)
    for _ in range(2):
        writers.append_parquet(spark.range(100).withColumn("kind", (F.col("id") % 11).cast("string")), f"{tmp_path}/kinds", ["kind"])
    rows = spark.read.parquet(f"{tmp_path}/kinds").collect()
    assert sorted(r.id for r in rows) == sorted([*range(100)] * 2) and all(str(r.id % 11) == str(r.kind) for r in rows)
    assert spark.conf.get(writers.OPEN_FILES) == before


def test_paths_read_the_triples_once_a_hop(spark, tmp_path):
    rows = [("u", "w", "@type", "type", "Way"), ("u", "w", "to", "ref", "s"), ("u", "v", "@type", "type", "Way"), ("u", "s", "of", "ref", "p"), ("u", "s", "of", "ref", "r")]
    spark.createDataFrame(rows, "doc_url string, subject string, predicate string, kind string, value string").write.parquet(f"{tmp_path}/all-triples")
    triples = spark.read.parquet(f"{tmp_path}/all-triples")
    paths = jsonld.resolve_paths(triples, "Way", [jsonld.Hop("ship", "to"), jsonld.Hop("piece", "of")], limit=1)
    assert not [f for f in paths.inputFiles() if "all-triples" in f]
    assert sorted((r.start, r.ship or "", r.piece or "") for r in paths.collect()) == [("v", "", ""), ("w", "s", "p"), ("w", "s", "r")]


def test_shares_of_leaves_are_a_constant(spark):
    leaves = spark.createDataFrame([(0, 0, 0.25, 4), (0, 2, 1 / 3, 3), (2, 1, 1.0, 1)], "tree int, leaf int, share double, n int")
    held = learning._shares_by_place(leaves)
    assert spark.range(1).select(held.alias("s")).first().s == [[0.25, None, 1 / 3], None, [None, 1.0]]
    none = learning._shares_by_place(leaves.where("tree > 5"))
    assert spark.range(1).select(none.alias("s")).first().s == []


def test_a_task_gathers_a_bounded_number_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(q, "GATHERED", 100)
    plan = q.QUERIES["jsonld_nodes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(piece_id#\d+, (\d+)\), REPARTITION_BY_NUM", plan)[1]) >= 60


def test_nodes_of_other_classes_are_not_gathered(spark):
    rows = [("u", "a", "@type", "type", "A"), ("u", "a", "n", "value", "1"), ("u", "b", "@type", "type", "B"), ("u", "b", "n", "value", "2"), ("u", "c", "@type", "type", "B")]
    triples = spark.createDataFrame(rows, "doc_url string, subject string, predicate string, kind string, value string")
    assert [tuple(r) for r in jsonld.triples_to_nodes(triples, {"n": "n"}, ["A"]).collect()] == [("u", "a", ["1"])]
    kept = jsonld.triples_to_nodes(triples, {"n": "n", "t": "@type"}, ["B"]).collect()
    assert sorted(tuple(r) for r in kept) == [("u", "b", ["2"], ["B"]), ("u", "c", [], ["B"])]
