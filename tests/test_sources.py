import json

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from checks.views import milestones_raw
from tracewing import session
from tracewing.operators import milestones
from tracewing.plans import flows
from tracewing.schema import RAW_MILESTONE_COLUMNS
from tracewing.sources import readers, writers
from tracewing.streaming.append import append_available

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def csv_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("csv") / "milestones")
    raw = milestones_raw(spark, SF)
    names = {c.lower(): c for c in raw.columns}
    raw.selectExpr(*[names.get(c.lower(), f"cast(null as string) {c}") for c in RAW_MILESTONE_COLUMNS]).write.option("header", True).csv(path)
    return path


def test_csv_gives_the_same_events_as_the_table(spark, csv_path, tmp_path):
    events = flows.prepare(spark, csv_path, str(tmp_path / "events"), str(tmp_path / "events-csv"))
    direct = milestones.prepare_events(milestones_raw(spark, SF))
    assert events.count() == direct.count() > 0
    assert events.exceptAll(direct).isEmpty()
    assert spark.read.csv(str(tmp_path / "events-csv")).count() == direct.count()


def test_empty_fields_are_null_and_headers_are_checked(spark, csv_path, tmp_path):
    assert readers.read_milestones_csv(spark, csv_path).where("Month is not null").isEmpty()
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(("Wrong", *RAW_MILESTONE_COLUMNS[1:])) + "\n" + "," * 21 + "x\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_milestones_csv(spark, str(bad)).collect()
    semicolons = tmp_path / "semi.csv"
    semicolons.write_text(";".join(RAW_MILESTONE_COLUMNS) + "\n" + ";" * 21 + "x\n")
    assert readers.read_milestones_csv(spark, str(semicolons), ";").first().Actual == "x"


def test_documents_from_files_and_lines(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for i in range(3):
        (tmp_path / "files" / f"{i}.json").write_text(json.dumps({"@id": f"p{i}", "v": "1"}, indent=2))
    files = readers.read_jsonld_files(spark, str(tmp_path / "files"), "piece")
    assert files.count() == 3 and files.columns == ["doc_url", "kind", "body"]
    (tmp_path / "lines.json").write_text('{"@id":"p1","v":"1"}\n{"v":"2"}\n')
    lines = readers.read_jsonld_lines(spark, str(tmp_path / "lines.json"), "piece")
    urls = sorted(r.doc_url for r in lines.collect())
    assert urls[1] == "p1" and "#" in urls[0]
    flows.ingest(files.unionByName(lines), str(tmp_path / "triples"))
    flows.ingest(lines, str(tmp_path / "triples"))
    got = spark.read.parquet(str(tmp_path / "triples"))
    assert got.count() == 7 and {r.object_kind for r in got.collect()} == {"piece"}


def test_tables_and_outbox(spark, tmp_path):
    df = spark.createDataFrame([("http://x", "piece", '{"a":"1"}'), ("http://x/e", "event", "{}")], "endpoint string, kind string, body string")
    writers.write_outbox(df, str(tmp_path / "out"))
    assert sorted(spark.read.json(str(tmp_path / "out")).select(df.columns).collect()) == sorted(df.collect())
    writers.save_scored(df, "scored_here")
    writers.save_scored(df, "scored_here")
    assert readers.read_table(spark, "scored_here").count() == 2


def test_each_run_appends_what_is_new(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for run in range(3):
        spark.range(run * 10, run * 10 + 10).write.mode("append").parquet(source)
        append_available(spark.readStream.schema("id bigint").parquet(source), sink, check)
        append_available(spark.readStream.schema("id bigint").parquet(source), sink, check)
        assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(run * 10 + 10))


def test_shared_folder_is_the_named_one(spark, monkeypatch):
    folder = session.shared_folder(spark)
    assert folder == session.shared_folder(spark)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_outbox_files_are_compressed(spark, tmp_path):
    df = spark.createDataFrame([("e", "piece", "b" * 1000)], "endpoint string, kind string, body string")
    writers.write_outbox(df, str(tmp_path / "out"))
    assert all(f.name.endswith(".json.gz") for f in (tmp_path / "out").glob("kind=piece/part-*"))
    writers.write_outbox(df, str(tmp_path / "orc"), "orc")
    assert spark.read.orc(str(tmp_path / "orc")).count() == 1


def test_outbox_is_written_without_sorting_documents(spark, tmp_path, monkeypatch):
    """Documents of a task go to a file for each kind as they come; more kinds than files are sorted and complete."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    n = F.col("id").cast("string")
    seen, save = [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, path: seen.append(int(spark.conf.get(name))) or save(self, path))
    for kinds in (3, 2 * writers.KINDS):
        kind = F.concat(F.lit("k"), (F.col("id") % kinds).cast("string"))
        docs = spark.range(2_000, numPartitions=2).select(F.concat(F.lit("e"), n).alias("endpoint"), kind.alias("kind"), F.repeat(n, 50).alias("body"))
        path = str(tmp_path / f"out{kinds}")
        writers.write_outbox(docs, path)
        files = [f.parent.name for f in (tmp_path / f"out{kinds}").glob("kind=*/part-*")]
        assert len(files) == 2 * kinds and len(set(files)) == kinds
        again = spark.read.schema("endpoint string, body string, kind string").json(path).select(docs.columns)
        assert again.exceptAll(docs).isEmpty() and docs.exceptAll(again).isEmpty()
    # Spark plans a sort by kind where this is 0
    assert seen == [writers.KINDS] * 2 and spark.conf.get(name) == before
    spark.conf.set(name, "20")
    try:
        writers.write_outbox(docs, path)
        assert seen[-1] == 20 == int(spark.conf.get(name))
    finally:
        spark.conf.set(name, before)
