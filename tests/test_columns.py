from datetime import datetime

from pyspark.sql import functions as F

from tracewing.functions import columns as cols


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr.alias("x")).first()["x"]


def test_milestone_times(spark):
    parse = cols.parse_milestone_ts("c")
    assert one(spark, "02-01-23 15:10", parse) == datetime(2023, 1, 2, 15, 10)
    assert one(spark, "02-01-23 5:10", parse) == datetime(2023, 1, 2, 5, 10)
    for junk in ("", "junk", "2-01-23 15:10", None):
        assert one(spark, junk, parse) is None


def test_chargeable_weight_skips_unreadable_text(spark):
    df = spark.createDataFrame([("10", "0.3"), ("abc", "0.6"), ("7", None), (None, None)], "w string, v string")
    got = [r["x"] for r in df.select(cols.chargeable_weight("w", "v").alias("x")).collect()]
    assert got == [50.0, 100.0, 7.0, None]


def test_clean_delay(spark):
    assert one(spark, "-1:30", cols.clean_delay("c")) == 1.30
    assert one(spark, "2:05", cols.clean_delay("c")) == 2.05
    assert one(spark, "", cols.clean_delay("c")) is None
    assert one(spark, "-1:30", cols.clean_delay("c", keep_colons=True)) is None
    assert one(spark, "-7", cols.clean_delay("c", keep_colons=True)) == 7.0


def test_calendar_parts(spark):
    df = spark.sql("select timestamp_ntz'2023-01-01 13:45:00' eventDate")
    row = cols.calendar_features(df).first()
    assert (row.eventDate_weekday, row.eventDate_hour, row.eventDate_month, row.eventDate_weekofyear) == (1, 13, 1, 52)


def test_waybill_parts_of_both_forms(spark):
    for text in ("awb-KLM-70318844", "KLM-70318844"):
        assert tuple(one(spark, text, cols.waybill_parts("c"))) == ("KLM", "70318844")
    assert one(spark, "x", cols.waybill_key(F.lit("KLM"), F.lit("1"))) == "awb-KLM-1"


def test_event_names(spark):
    for code, name in cols.EVENT_NAMES.items():
        assert one(spark, code, cols.event_name("c")) == name
    assert one(spark, "XYZ", cols.event_name("c")) is None


def test_ids(spark):
    again = [one(spark, "a", cols.name_based_id("c", F.lit("b"))) for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == 36
    assert one(spark, "a", cols.random_id()) != one(spark, "a", cols.random_id())
