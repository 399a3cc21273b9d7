from datetime import datetime

import pytest

from tracewing.operators import milestones as m
from tracewing.schema import RAW_MILESTONE_COLUMNS, RAW_MILESTONES


def raw(spark, rows):
    """Rows of (key, milestone, baselined, dynamic, actual)."""
    full = []
    for key, code, base, dynamic, actual in rows:
        known = dict(
            HAWB_No=key, HAWB_Origin="AAA", HAWB_Destination="BBB", Baseline_Pieces="2", Baseline_Weight="10",
            Baseline_Volume="0.3", Milestone=code, Baselined=base, Dynamic=dynamic, Actual=actual,
        )
        full.append(tuple(known.get(c) for c in RAW_MILESTONE_COLUMNS))
    return spark.createDataFrame(full, RAW_MILESTONES)


RULES = (m.DeliveryRule(1, 1, 60, 30), m.DeliveryRule(2, 3, 120, 50))
T = "02-01-23 10:00"


def at(hour, minute=0):
    return datetime(2023, 1, 2, hour, minute)


def test_delivery_times(spark):
    rows = [
        ("k1", "RIH", T, T, "02-01-23 9:00"),  # rule 1, happened
        ("k1", "RIH", T, T, None),  # rule 1, from the dynamic time
        ("k2", "RIH", T, None, None),  # rule 2 without any time
        ("k3", "RIH", T, T, "junk"),  # unreadable counts as missing
        ("k4", "RIH", T, T, T),  # beyond the rules
        ("k4", "RIH", T, T, None),
        (None, "RIH", T, T, T),  # no key: drops out
        ("k1", "POD", T, T, T),  # not a hand-over
    ]
    got = sorted((r.awbNo, r.eventDate or datetime.max) for r in m.impute_delivery(raw(spark, rows), RULES).collect())
    assert got == [
        ("k1", at(9, 30)), ("k1", at(11)), ("k2", datetime.max), ("k3", at(12)), ("k4", at(10)), ("k4", datetime.max),
    ]


def test_one_pass_equals_union_of_both(spark):
    rows = [(f"k{i % 7}", ("RIH", "POD", "TPN", "DIS")[i % 4], T, T, T if i % 3 else None) for i in range(60)]
    df = raw(spark, rows)
    both = m.actual_events(df).unionByName(m.impute_delivery(df, RULES)).where(
        "eventCode in ('DLV','RIH','DIH','RIW','OFD','TPN','POD')"
    )
    got = m.prepare_events(df, rules=RULES)
    assert sorted(map(str, got.drop("wgt_chargeable").collect())) == sorted(map(str, both.collect()))
    assert {r.wgt_chargeable for r in got.collect()} == {50.0}


def test_codes_with_a_misplaced_comma_lose_two_codes(spark):
    df = raw(spark, [("k", c, T, T, T) for c in ("OFD", "TPN", "POD", "RIH")])
    kept = {r.eventCode for r in m.prepare_events(df, m.EVENT_CODES_JOINED, RULES).collect()}
    assert kept == {"POD", "RIH", "DLV"}


def test_rules_follow_key_numbers(spark):
    df = raw(spark, [(f"k{i}", "RIH", T, T, T) for i in range(5)] * 3)
    got = sorted((r.awbNo, r.eventDate) for r in m.impute_delivery(df, RULES).distinct().collect())
    assert got == [("k0", at(10, 30)), ("k1", at(10, 50)), ("k2", at(10, 50)), ("k3", at(10)), ("k4", at(10))]


def test_plan_reads_needed_columns_and_pushes_the_filter(spark, tmp_path):
    raw(spark, [("k", "RIH", T, T, T)]).write.parquet(str(tmp_path / "raw"))
    plan = m.prepare_events(spark.read.parquet(str(tmp_path / "raw")), rules=RULES)._jdf.queryExecution().toString()
    assert "Forwarder" not in plan.split("== Physical Plan ==")[1]
    assert "PushedFilters: [IsNotNull(HAWB_No), Or(" in plan
