"""Range-split sequences must give exactly what plain windows give."""


import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewing.operators import ranking, sequence, skew


ORDER = ["eventDate", "event_id"]


@pytest.fixture(scope="module")
def events(spark):
    """A third of the rows in one waybill, a NULL waybill, ties and NULL times."""
    return spark.range(3000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 37).cast("string")).alias("awbNo"),
        F.when(F.col("id") % 5 != 0, F.timestamp_add("MINUTE", (F.col("id") * 7919 % 600).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("eventDate"),
        F.when(F.col("id") % 2 == 0, "DLV").otherwise("POD").alias("eventCode"),
        (F.col("id") % 4 == 0).cast("int").alias("statusBinary"),
    )


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def plain(events, order):
    """Lead and lag by a window over the whole key."""
    w = Window.partitionBy("awbNo").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return events.withColumns({"next_id": F.lead("event_id").over(w), "last_date": F.lag("eventDate").over(w)})


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_split_windows(spark, events, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = skew.with_neighbours(
            events, ["awbNo"], ORDER, {"next_id": F.col("event_id")}, {"last_date": F.col("eventDate")}
        )
        assert rows(got) == rows(plain(events, ORDER))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    "operator",
    [sequence.next_flag_label, sequence.hours_to_next, sequence.hours_since_previous, sequence.duration_to_next_event],
)
def test_ties_do_not_depend_on_the_input_order(events, operator):
    tied = events.withColumn("eventDate", F.date_trunc("day", "eventDate").cast("timestamp_ntz"))
    assert rows(operator(tied.repartition(7), ["eventDate"])) == rows(operator(tied.coalesce(1), ["eventDate"]))


def test_a_sequence_without_keys(spark):
    got = skew.with_neighbours(spark.range(1000).repartition(5), [], ["id"], {"n": F.col("id")}, {"p": F.col("id")})
    assert {(r.id, r.p, r.n) for r in got.collect()} == {
        (i, i - 1 if i else None, i + 1 if i < 999 else None) for i in range(1000)
    }


def test_an_empty_sequence(events):
    assert sequence.hours_to_next(events.limit(0), ORDER).count() == 0


def test_numbers_follow_key_order(events):
    got = ranking.dense_key_id(events, "awbNo").orderBy("row_num").collect()
    keys = sorted({r.awbNo for r in events.select("awbNo").distinct().collect() if r.awbNo is not None})
    assert [(r.awbNo, r.row_num) for r in got] == [(k, i + 1) for i, k in enumerate(keys)]
    numbered = ranking.attach_key_id(events, "awbNo").select("awbNo", "row_num").distinct().collect()
    assert sorted(map(tuple, numbered)) == [(k, i + 1) for i, k in enumerate(keys)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(events, descending):
    counted = events.where("eventDate is not null").groupBy("eventCode", "eventDate").agg(F.count("*").alias("n"))
    got = ranking.running_totals(counted, ["eventCode"], "eventDate", {"before": "n"}, descending).toPandas()
    got = got.sort_values(["eventCode", "eventDate"], ascending=[True, not descending])
    assert (got.groupby("eventCode").n.cumsum() - got.n == got.before).all()


@pytest.mark.parametrize("heavy", [0, 10, 60, 1500])
def test_heavy_keys_are_ranged_and_give_the_same(events, heavy):
    got = skew.with_neighbours(events, ["awbNo"], ORDER, {"next_id": F.col("event_id")}, {"last_date": F.col("eventDate")}, heavy=heavy)
    assert rows(got) == rows(plain(events, ORDER))


def test_only_rows_of_heavy_keys_are_checkpointed(events, monkeypatch):
    seen = []
    monkeypatch.setattr(skew, "settle", lambda df: seen.append(df) or df.checkpoint(eager=True))
    skew.with_neighbours(events, ["awbNo"], ORDER, {"n": F.col("event_id")}).count()
    assert seen == []
    skew.with_neighbours(events, ["awbNo"], ORDER, {"n": F.col("event_id")}, heavy=500).count()
    assert [df.count() for df in seen] == [1000] and {r.awbNo for r in seen[0].select("awbNo").collect()} == {"hot"}


@pytest.mark.parametrize("limit", [1, 7, 100, 10_000])
def test_salted_joins_meet_every_pair_once(spark, limit):
    left = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, "hub").when(F.col("id") % 9 == 1, None).otherwise((F.col("id") % 5).cast("string")).alias("k"))
    right = spark.range(90).select(F.col("id").alias("other"), F.when(F.col("id") % 3 == 0, "hub").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    got = skew.salted_join(left, right, "k", limit)
    assert got.columns == ["k", "id", "other"]
    assert rows(got) == rows(left.join(right, "k").select("k", "id", "other"))


def test_a_hub_is_spread_over_parts(spark):
    left, right = spark.range(1000).withColumn("k", F.lit("hub")), spark.range(3).select(F.col("id").alias("o"), F.lit("hub").alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 50)
    try:
        joined = skew.salted_join(left.hint("merge"), right, "k", 100)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert joined.count() == 3000 and sum(p.n for p in parts) == 3000
