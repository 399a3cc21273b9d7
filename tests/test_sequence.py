from datetime import datetime

import pytest

from tracewing.operators import features, sequence

ORDER = ["eventDate", "event_id"]


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id int, awbNo string, eventDate timestamp_ntz, eventCode string")


def at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


ROWS = [
    (1, "a", at(1), "RIH"), (2, "a", at(3), "DLV"), (3, "a", at(3), "DIS"), (4, "a", at(4, 30), "POD"),
    (5, "b", at(9), "DIS"),  # a single event
    (6, "c", None, "DLV"), (7, "c", at(5), "POD"),  # NULL time sorts first
    (8, "d", at(2), "DLV"), (9, "d", at(4), "POD"),
]


def by_id(df, column):
    return {r.event_id: r[column] for r in df.collect()}


def test_next_flag(spark):
    flagged = sequence.status_flag(events(spark, ROWS))
    assert by_id(sequence.next_flag_label(flagged, ORDER), "statusTarget") == {
        1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0,
    }


def test_hours(spark):
    df = events(spark, ROWS)
    assert by_id(sequence.hours_to_next(df, ORDER), "eventDate_diff_hours") == {
        1: 2.0, 2: 0.0, 3: 1.5, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 2.0, 9: 0.0,
    }
    assert by_id(sequence.hours_since_previous(df, ORDER), "eventDate_diff_hours") == {
        1: 0.0, 2: 2.0, 3: 0.0, 4: 1.5, 5: 0.0, 6: 0.0, 7: 0.0, 8: 0.0, 9: 2.0,
    }


def test_only_the_very_next_event_counts(spark):
    got = by_id(sequence.duration_to_next_event(events(spark, ROWS), ORDER), "duration_dlv_pod")
    assert got[2] is None  # an irregularity comes between
    assert got[8] == 2.0 and got[9] is None and got[6] is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="commodity"):
        features.irregularity_features(events(spark, ROWS))


def test_feature_columns(spark):
    from checks.views import milestone_events

    from tests.conftest import SF

    rows = features.irregularity_features(milestone_events(spark, SF))
    used = {*features.IRREGULARITY_NUMERIC, *features.IRREGULARITY_CATEGORIES, features.IRREGULARITY_FLAG}
    assert used | {"statusTarget", "awbNo", "delay_h", "eventDate_month"} == set(rows.columns)
    pod = features.delivery_features(milestone_events(spark, SF))
    assert {*features.DELIVERY_NUMERIC, *features.DELIVERY_CATEGORIES, "duration_dlv_pod"} <= set(pod.columns)
    assert not {"awbNo", "eventDate", "total_weight"} & set(pod.columns)
