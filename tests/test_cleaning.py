import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import SPEC, one, raw_row, raw_trips, rows
from tripledger.operators import cleaning


def test_malformed_and_missing_times_are_counted_once(spark):
    raw = raw_trips(spark, [
        raw_row("a"), raw_row("b", start="garbage"), raw_row("c", end=None),
        raw_row("d", start="garbage", member=None),
    ])
    got = one(cleaning.quality_audit(raw, SPEC))
    assert (got["n_raw"], got["dropped_bad_time"]) == (4, 3)
    assert (got["dropped_bad_duration"], got["dropped_bad_enum"], got["n_clean"]) == (0, 0, 1)


@pytest.mark.parametrize("end, kept", [
    ("2025-01-06 10:00:00", False), ("2025-01-06 09:55:00", False),
    ("2025-01-07 10:00:00", True), ("2025-01-07 10:00:01", False),
])
def test_duration_limits(spark, end, kept):
    raw = raw_trips(spark, [raw_row(end=end)])
    assert cleaning.clean(raw, SPEC).count() == int(kept)
    assert one(cleaning.quality_audit(raw, SPEC))["dropped_bad_duration"] == int(not kept)


def test_fractions_of_seconds_are_cut_on_both_sides(spark):
    raw = raw_trips(spark, [raw_row(start="2025-01-06 10:00:00.900", end="2025-01-06 10:01:00.100")])
    assert one(cleaning.clean(raw, SPEC))["duration_min"] == 1.0


def test_wall_clock_does_not_depend_on_the_session_zone(spark):
    raw = raw_trips(spark, [raw_row(start="2025-03-09 01:30:00", end="2025-03-09 03:30:00")])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
        assert one(cleaning.clean(raw, SPEC))["duration_min"] == 120.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_missing_class_counts_only_when_the_rest_is_good(spark):
    raw = raw_trips(spark, [
        raw_row("a", member=None), raw_row("b", bike=None),
        raw_row("c", member=None, end="2025-01-06 10:00:00"), raw_row("d"),
    ])
    got = one(cleaning.quality_audit(raw, SPEC))
    assert (got["dropped_bad_enum"], got["dropped_bad_duration"], got["n_clean"]) == (2, 1, 1)


def test_audit_classes_partition_the_rows(spark):
    raw = raw_trips(spark, [
        raw_row("a"), raw_row("a"), raw_row("b", start=None), raw_row("c", end="2025-01-01 00:00:00"),
        raw_row("d", bike=None),
    ])
    got = one(cleaning.quality_audit(raw, SPEC))
    dropped = got["dropped_bad_time"] + got["dropped_bad_duration"] + got["dropped_bad_enum"]
    assert got["n_raw"] == dropped + got["n_clean"] + got["n_removed_as_duplicate"]
    assert cleaning.clean(raw, SPEC).count() == got["n_clean"]


def test_duplicates_raw_and_removed(spark):
    raw = raw_trips(spark, [raw_row("a", end="2025-01-06 10:00:00"), raw_row("a"), raw_row("b")])
    report = one(cleaning.quality_report(cleaning.quality_audit(raw, SPEC), 2025))
    assert report["n_duplicate_rides"] == 1
    assert report["n_removed_as_duplicate"] == 0
    assert report["n_clean"] == 2
    assert report["drop_rate_pct"] == pytest.approx(33.333)
    assert report["rules"]["duration"] == "(0, 1440] minutes"


def test_null_ids_are_not_distinct_but_collapse_to_one_row(spark):
    raw = raw_trips(spark, [raw_row(None), raw_row(None), raw_row("a")])
    got = one(cleaning.quality_audit(raw, SPEC))
    assert got["n_distinct_ride_id"] == 1
    assert got["n_clean"] == cleaning.clean(raw, SPEC).count() == 2


def test_dedup_keeps_the_same_row_whatever_the_order(spark):
    data = [raw_row("a", start=f"2025-01-06 10:0{i}:00", origin=str(i)) for i in range(5)]
    first = one(cleaning.clean(raw_trips(spark, data), SPEC))
    again = one(cleaning.clean(raw_trips(spark, data[::-1]).repartition(3), SPEC))
    assert first == again
    assert first["start_station_id"] == "0"


def test_dedup_within_a_column_that_the_key_determines(spark):
    df = spark.createDataFrame(
        [("1-1", 1, 5, "b"), ("1-1", 1, 5, "a"), ("1-2", 1, None, "c"), ("1-2", 1, 2, "d"), ("2", 2, 1, None)],
        "id string, place int, n int, name string")
    got = cleaning.dedup(df, "id", within="place")
    assert got.columns == ["id", "n", "name"]
    assert sorted(map(tuple, got.collect())) == [("1-1", 5, "a"), ("1-2", None, "c"), ("2", 1, None)]


def test_hot_trip_id_is_reduced_before_the_shuffle(spark):
    raw = raw_trips(spark, [raw_row("hot", origin=str(i % 7)) for i in range(3000)] + [raw_row("a")])
    assert cleaning.clean(raw.repartition(4), SPEC).count() == 2
    plan = cleaning.clean(raw, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_calendar_and_period(spark):
    raw = raw_trips(spark, [
        raw_row("a", start="2024-12-31 23:59:00", end="2025-01-01 00:09:00", month=1),
        raw_row("b", start="2025-01-05 08:00:00", end="2025-01-05 08:05:00"),
        raw_row("c", start="2025-01-04 08:00:00", end="2025-01-04 08:05:00"),
    ])
    got = rows(cleaning.clean(raw, SPEC), "ride_id")
    assert got["a"]["date"] == dt.date(2024, 12, 31) and got["a"]["month"] == 1
    assert (got["b"]["dow"], got["b"]["day_type"]) == (7, "sunday")
    assert (got["c"]["dow"], got["c"]["day_type"], got["c"]["hour"]) == (6, "saturday", 8)


def test_output_columns_and_missing_places(spark):
    df = cleaning.clean(raw_trips(spark, [raw_row(origin=None, destination=None)]), SPEC)
    assert df.columns == SPEC.clean_columns() and len(df.columns) == 20
    assert one(df)["end_station_id"] is None


def test_empty_input(spark):
    empty = raw_trips(spark, [raw_row()]).where(F.lit(False))
    report = one(cleaning.quality_report(cleaning.quality_audit(empty, SPEC), 2025))
    assert report["n_raw"] == 0 and report["drop_rate_pct"] == 0.0
    assert cleaning.clean(empty, SPEC).count() == 0


def test_duplicate_keys(spark):
    raw = raw_trips(spark, [raw_row(i) for i in ("a", "a", "b", "c", "c", "c", None)])
    got = rows(cleaning.duplicate_keys(raw, "ride_id"), "copies")
    assert {k: v["n_keys"] for k, v in got.items()} == {1: 1, 2: 1, 3: 1}
    assert one(cleaning.distinct_count(raw, "ride_id"))["n_distinct"] == 3
