"""Documents opened as rows, a level at a time, say what they say when opened inside their row."""

import json

import pytest
from pyspark.sql import functions as F

from tracewing.operators import documents as d
from tracewing.operators import jsonld
from tracewing.plans import flows

PLAIN = {
    "flat": {"@id": "a", "@type": "T", "n": None, "i": 5, "d": 1.50, "w": 5.0, "big": 1e21, "b": False, "t": "x [{ , é"},
    "typed": {"p": {"@value": "30.0", "@type": "http://t"}, "q": {"@language": "de", "@value": "ja"}, "r": {"@value": 3.0}, "s": {"@value": None}},
    "nodes": {"@id": "a", "m": [{"@id": "b"}, {"@id": "c", "x": 1}, {"y": {}}, {}], "none": [], "@type": {"@id": "z"}, "@language": "de"},
    "deep": {"p": {"p": {"p": {"p": {"p": [{"p": {"q": [{"r": 1}, {"r": 1}]}, "@type": 7}]}}}}},
    "list": [{"@id": "a", "p": "x"}, {"p": "x"}, {"p": {"@value": True}}],
    "scalar": '"text {"', "spaced": ' {\n "@id" : "a" ,\t"m" : [ { "@id" : "b" } , { "q" : "} x" } ] } ',
    "repeated": '{"p":1,"p":{"@id":"b"},"q":2}', "quotes": {"@id": "a", "p": 'say "x", {"y"}', "q": "a\\b/c"},
}
INVOLVED = {
    "twice": {"@id": "a", "p": {"@id": "a", "p": {"@id": "b"}}}, "same": [{"@id": "a", "p": 1}, {"@id": "a", "p": 1}],
    "scalars": {"@id": "a", "p": ["x", "x"]}, "later": {"@id": "a", "p": [{"@id": "b"}, "x", "x"]}, "types": {"@type": ["T", "T"]},
    "literals": {"@id": "a", "p": [{"@value": "x"}, {"@value": "x"}]}, "beside": {"@id": "a", "p": [{"q": 1, "@value": "x"}, {"@value": "x"}]},
    "nested": {"@id": "a", "p": [[{"@id": "b"}], [{"@id": "c"}]]}, "numbered": {"@id": 5, "p": {"@id": "5", "q": 1}, "r": {"q": 1}},
    "slashes": '{"@id":"a\\/b","p":{"@id":"a/b","x":1},"x":1}', "letters": '{"\\u0040id":"a","p":{"\\u0040id":"a","p":{"@id":"a"}}}',
    "graph": {"@id": "g", "@graph": [{"@id": "a"}, {"@id": "b", "p": 1}]}, "set": {"@id": "a", "p": {"@set": [1, 1]}},
    "context": {"@context": {"p": "http://p"}, "@id": "a", "p": 1}, "inside": {"@id": "a", "p": {"@context": {}, "q": 1}},
    "literal": {"@value": "alone"}, "looks": {"@id": "a", "m": [{}], "p": "}, x"}, "reverse": {"@id": "a", "@reverse": {"p": {"@id": "b"}}}, "broken": "{oops", "empty": " ", "missing": None, "brackets": "[",
}


@pytest.fixture(scope="module")
def odd(spark):
    bodies = [(n, b if b is None or isinstance(b, str) else json.dumps(b, ensure_ascii=False)) for n, b in (PLAIN | INVOLVED).items()]
    return spark.createDataFrame(bodies, "doc_url string, body string")


def test_which_documents_are_plain(odd):
    got = {r.doc_url: r.plain for r in odd.select("doc_url", jsonld.is_plain("body").alias("plain")).collect()}
    assert {n for n in PLAIN if not got[n]} == set()
    # a text that is no JSON or no text may look plain
    assert {n for n in INVOLVED if got[n]} <= {"broken", "empty", "missing", "brackets"}


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_rows_equal_documents_opened_inside_their_row(odd, monkeypatch, levels):
    monkeypatch.setattr(jsonld, "LEVELS", levels)
    docs = odd.unionByName(odd.where("doc_url in ('flat', 'twice', 'broken')")).withColumn("k", F.concat(F.lit("k-"), "doc_url"))
    rows = jsonld.document_rows(docs, keep=["k"]).collect()
    got = sorted((r.doc_url, r.k, r.reason, r.body, *[r[f] for f in jsonld.QUAD_FIELDS]) for r in rows if r.reason) + sorted(
        (str((r.doc_url, r.k, *[r[f] for f in jsonld.QUAD_FIELDS])) for r in rows if not r.reason)
    )
    whole = jsonld.parse_documents(docs, keep=["k"]).collect()
    none = [None] * len(jsonld.QUAD_FIELDS)
    want = sorted((r.doc_url, r.k, r.reason, r.body, *none) for r in whole if r.reason) + sorted(
        str((r.doc_url, r.k, *s)) for r in whole if not r.reason for s in r.statements or ()
    )
    assert got == want and len(want) > 60


def test_own_documents_are_plain(spark):
    way = spark.sql(
        "select 'awb-1' waybill_id, 'jfk' departure, 'fra' arrival, 'shp' shipper, 'cne' consignee, 'fwd' forwarder,"
        " 'booking-1' booking_id, 'ship-1' shipment_id"
    )
    pieces = spark.sql("select 'ship-1' shipment_id, 'awb-1' waybill_id, concat('piece-', id) piece_id, 30 weight from range(3)")
    event = spark.sql(
        "select 'FOH' event_code, timestamp_ntz'2023-05-18 18:03:00' event_ts, 'ship-1' linked_id, 'qsh' location_id, 'carrier' recorder_id"
    )
    every = d.waybill_documents(way).union(d.shipment_documents(pieces)).union(d.piece_documents(pieces)).union(d.event_documents(event))
    assert every.where(~jsonld.is_plain("body")).count() == 0


def test_ingest_writes_statements_and_rejects(spark, odd, tmp_path):
    docs = odd.withColumn("kind", F.lit("any"))
    flows.ingest(docs, f"{tmp_path}/quads", f"{tmp_path}/rejects", graphs=True)
    told = {r.doc_url for r in spark.read.parquet(f"{tmp_path}/rejects").collect()}
    assert told == {"inside", "reverse", "broken", "empty", "missing", "brackets"}
    assert spark.read.parquet(f"{tmp_path}/quads").count() == jsonld.flatten_quads(odd).count()
    with pytest.raises(ValueError, match="can't be read"):
        flows.ingest(docs, f"{tmp_path}/more")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_of_small_keys_are_shuffled_once(spark):
    n = F.col("id")
    legs = spark.range(600).select(
        F.concat(F.lit("b"), (n % 40).cast("string")).alias("booking_id"), F.concat(F.lit("w"), (n % 40).cast("string")).alias("waybill_id"),
        F.when(n % 40 != 7, (n % 4).cast("int")).alias("sequence"), F.concat(F.lit("leg-"), (n % 3).cast("string")).alias("activity_id"),
    )
    found = d.gather_members(legs, "booking_id", ["waybill_id"], ["sequence", "activity_id"])
    assert _plan(found).count("Exchange ") == 1 and "Join" not in _plan(found)
    want = {}
    for r in legs.collect():
        want.setdefault((r.booking_id, r.waybill_id), set()).update(() if r.sequence is None else {(r.sequence, r.activity_id)})
    got = {(r.booking_id, r.waybill_id): (r.page, r.pages, [tuple(m) for m in r.members]) for r in found.collect()}
    assert got == {k: (0, 1, sorted(v)) for k, v in want.items()} and got["b7", "w7"][2] == []


def test_large_and_small_keys_together(spark):
    """Keys above and at the size of a page, a null key, repeated members, and members derived in their row."""
    rows = [("big", i % 30) for i in range(90)] + [("repeated", 1)] * 40 + [("even", i) for i in range(10)] + [(None, 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("c", F.concat(F.lit("c-"), "k"))
    derived = {"twice": lambda m: m["v"] * 2}
    got = d.gather_members(df, "k", ["c"], ["v"], 10, derived).collect()
    by_key = {}
    for r in got:
        assert r.c == (r.k and f"c-{r.k}") and [m.v for m in r.members] == sorted(m.v for m in r.members)
        assert all(m.twice == 2 * m.v for m in r.members)
        by_key.setdefault(r.k, []).append(r)
    assert sorted(m.v for r in by_key["big"] for m in r.members) == list(range(30))
    assert {r.pages for r in by_key["big"]} == {3} and 0 in {r.page for r in by_key["big"]}
    assert {k: [(r.page, r.pages, [m.v for m in r.members]) for r in v] for k, v in by_key.items() if k != "big"} == {
        "repeated": [(0, 1, [1])], "even": [(0, 1, list(range(10)))], None: [(0, 1, [3])], "none": [(0, 1, [])],
    }


def test_tasks_gather_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "TASK_ROWS", 20)
    df = spark.range(1_000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    found = d.gather_members(df, "k", [], ["v"])
    assert "hashpartitioning(k" in _plan(found) and ", 50), REPARTITION_BY_NUM" in _plan(found)
    assert found.count() == 300 and found.agg(F.sum(F.size("members"))).first()[0] == 1_000
    # no rows, no documents
    assert d.gather_members(df.limit(0), "k", [], ["v"]).count() == 0
