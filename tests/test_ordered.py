"""Sorted tables with file bounds, tables rewritten by month, the ledger of what was sent."""

import os

import pytest
from pyspark.sql import functions as F

from tracewing.operators import documents as d
from tracewing.session import stored
from tracewing.sources import ordered, writers
from tracewing.streaming import append


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(2000).select(
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101)).alias("k"), "id",
        F.timestamp_add("DAY", (F.col("id") % 90).cast("int"), F.lit("2024-01-15").cast("timestamp_ntz")).alias("ts"),
    )


def files_of(path):
    return sorted(f for f in os.listdir(path) if f.startswith("part-"))


def test_files_are_in_order_and_their_bounds_are_told(spark, rows, tmp_path):
    path = str(tmp_path / "sorted")
    ordered.write_sorted(rows, path, ["k", "id"], 8)
    bounds = ordered.file_bounds(spark, path).orderBy("file").collect()
    assert [b.file for b in bounds] == [f for f in files_of(path) if f in {b.file for b in bounds}] and len(bounds) > 3
    found = []
    for b in bounds:
        part = [tuple(r) for r in spark.read.parquet(f"{path}/{b.file}").select("k", "id").collect()]
        assert (tuple(b.first), tuple(b.last), b.n) == (part[0], part[-1], len(part))
        found += part
    assert found == sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and len(found) == 2000
    assert spark.read.parquet(path).count() == 2000


@pytest.mark.parametrize("low, high", [(10, 20), (None, 5), (95, None), (200, None), (None, -1), (50, 50), (None, None)])
def test_a_range_opens_only_the_files_that_may_hold_it(spark, rows, tmp_path, low, high):
    path = str(tmp_path / "sorted")
    ordered.write_sorted(rows, path, ["k", "id"], 8)
    got = ordered.read_sorted(spark, path, "k", low, high)
    want = rows.where((F.lit(low is None) | (F.col("k") >= F.lit(low))) & (F.lit(high is None) | (F.col("k") <= F.lit(high)))) if (low, high) != (None, None) else rows
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    if low is not None and high is not None:
        assert 0 < len(got.inputFiles()) < 4


def test_an_empty_sorted_table(spark, rows, tmp_path):
    path = str(tmp_path / "sorted")
    ordered.write_sorted(rows.limit(0), path, ["k", "id"], 4)
    assert ordered.read_sorted(spark, path, "k", 1, 2).count() == 0


def test_one_month_is_replaced_and_others_keep_their_files(spark, rows, tmp_path):
    path = str(tmp_path / "months")
    ordered.write_months(rows.withColumn("ts", F.when(F.col("id") != 0, F.col("ts"))), path, "ts")
    months = sorted(f for f in os.listdir(path) if f.startswith("month="))
    assert months == ["month=2024-01", "month=2024-02", "month=2024-03", "month=2024-04", "month=none"]
    before = {m: files_of(f"{path}/{m}") for m in months}
    ordered.write_months(rows.where("date_format(ts, 'yyyy-MM') = '2024-02'").withColumn("id", -F.col("id")), path, "ts")
    after = {m: files_of(f"{path}/{m}") for m in months}
    assert [m for m in months if before[m] != after[m]] == ["month=2024-02"]
    read = ordered.read_months(spark, path, ["2024-02"])
    assert read.where("id >= 0").isEmpty() and read.count() == rows.where("date_format(ts, 'yyyy-MM') = '2024-02'").count()
    assert ordered.read_months(spark, path).count() == 2000


def test_months_are_pruned(spark, rows, tmp_path):
    path = str(tmp_path / "months")
    ordered.write_months(rows, path, "ts")
    plan = ordered.read_months(spark, path, ["2024-03"])._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "month#" in pruned and "2024-03" in pruned


def outbox(spark, pieces):
    made = spark.createDataFrame(pieces, "piece_id string, weight double")
    return d.outbox(d.piece_documents(made))


def sent(spark, path):
    return spark.read.schema("endpoint string, body string, run string, kind string").json(path).groupBy("run").count().rdd.collectAsMap()


def test_nothing_is_sent_twice(spark, tmp_path):
    path, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    first, changed = [("a", 1.0), ("b", 2.0), ("b", 2.0)], [("a", 1.0), ("b", 3.0)]
    for run, pieces in (("r1", first), ("r2", first), ("r3", changed), ("r4", changed), ("r5", [])):
        writers.send_once(outbox(spark, pieces), path, ledger, run)
    assert sent(spark, path) == {"r1": 2, "r3": 1}
    assert spark.read.parquet(ledger).count() == 3


def test_a_run_that_failed_before_its_ledger_sends_again(spark, tmp_path, monkeypatch):
    path, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    writers.unsent(outbox(spark, [("a", 1.0)]), ledger).select("endpoint", "kind", "body").write.partitionBy("kind").json(f"{path}/run=r1")
    writers.send_once(outbox(spark, [("a", 1.0)]), path, ledger, "r1")
    assert sent(spark, path) == {"r1": 1} and spark.read.parquet(ledger).count() == 1


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path, rejected = str(tmp_path / "quads"), str(tmp_path / "rejects")
    docs = spark.createDataFrame([("u", "piece", '{"@id":"a","p:q":1}'), ("v", "piece", "{oops")], "doc_url string, kind string, body string")
    for batch in (0, 0, 1, 0):
        append.write_batch(docs, batch, path, rejected)
    assert spark.read.parquet(path).groupBy("batch").count().collect() == spark.read.parquet(rejected).groupBy("batch").count().collect()
    assert spark.read.parquet(path).count() == 2


def test_a_stream_of_documents_is_read_once(spark, tmp_path):
    source, path, rejected, offsets = (str(tmp_path / n) for n in ("in", "quads", "rejects", "offsets"))
    for run in range(2):
        lines = [(f'{{"@id":"e{run}{i}","p:q":"x"}}',) for i in range(3)] + [("{broken",)]
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(source)
        for _ in range(2):
            append.ingest_stream(append.jsonld_line_stream(spark.readStream.text(source), "event"), path, rejected, offsets)
        assert spark.read.parquet(path).count() == 3 * (run + 1) and spark.read.parquet(rejected).count() == run + 1


@pytest.mark.parametrize("few", [0, 1, 100])
def test_bodies_are_kept_once_and_sent_whichever_digests_are_few(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(writers, "FEW", few)
    stores = []
    monkeypatch.setattr(writers, "stored", lambda df, name: stores.append(df.columns) or stored(df, name))
    path, ledger = str(tmp_path / "sent"), str(tmp_path / "ledger")
    runs = {"r1": [("a", 1.0), ("a", 1.0), ("b", 2.0)], "r2": [("a", 1.0), ("b", 2.0)], "r3": [("a", 9.0), ("a", 9.0), ("b", 2.0), ("c", 3.0)]}
    for run, pieces in runs.items():
        writers.send_once(outbox(spark, pieces), path, ledger, run)
    assert sent(spark, path) == {"r1": 2, "r3": 2}
    assert all("body" not in columns for columns in stores)
    assert spark.read.parquet(ledger).count() == 4
