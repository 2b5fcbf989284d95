import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import SPEC, one, rows, trips
from tripledger.functions import columns as C
from tripledger.operators import metrics as M


def make(spark, n=400, seed=3):
    rng = random.Random(seed)
    return trips(spark, [(
        f"2025-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:15:00",
        rng.randint(1, 30_000) / 60, rng.choice(["member", "casual"]),
        rng.choice(["classic_bike", "electric_bike"]), rng.choice("ABCD"),
        rng.choice(["A", "B", "C", None]),
    ) for _ in range(n)])


@pytest.mark.parametrize("value, label", [
    (0.0, "0-5"), (4.999, "0-5"), (5.0, "5-10"), (239.9, "120-240"), (240.0, "240+"), (None, None),
])
def test_bucket_edges(spark, value, label):
    df = C.bucketize(spark.createDataFrame([(value,)], "v double"), "v")
    assert one(df)["bucket"] == label


def test_roll_ups_agree(spark):
    df = make(spark)
    cube, daily, hist = M.fact_cube(df, SPEC), M.daily_summary(df, SPEC), M.duration_hist(df, SPEC)
    monthly, kpi = rows(M.period_summary(df, SPEC), "month"), one(M.kpi(df, SPEC))
    for table in (cube, daily, hist):
        assert table.agg(F.sum("n")).first()[0] == 400 == kpi["n_rides"]
    assert kpi["n_member"] + kpi["n_casual"] == kpi["n_classic"] + kpi["n_electric"] == 400
    by_month = rows(hist.groupBy("month").agg(F.sum("n").alias("n")), "month")
    assert {m: r["n"] for m, r in by_month.items()} == {m: r["n"] for m, r in monthly.items()}
    assert kpi["n_days"] == daily.count()


def test_sums_do_not_depend_on_partitioning_or_grain(spark):
    df = make(spark)
    facts = M.compact_facts(M.trip_facts(df, SPEC))
    keys = ("month", "dow", "hour", "member", "bike")
    want = rows(M.fact_cube(df, SPEC), *keys)
    assert want == rows(M.fact_cube(df.repartition(7), SPEC), *keys)
    assert want == rows(M.fact_cube(facts, SPEC), *keys)
    assert rows(M.daily_summary(df, SPEC), "date") == rows(M.daily_summary(facts, SPEC), "date")
    assert one(M.kpi(df, SPEC)) == one(M.kpi(df, SPEC, facts=facts))
    assert rows(M.period_summary(df, SPEC), "month") == \
        rows(M.period_summary(df, SPEC, facts=facts), "month")


def test_period_summary_values_and_missing_class(spark):
    df = trips(spark, [
        ("2025-01-01 08:00:00", 10, "member", "classic_bike", "A", "B"),
        ("2025-01-02 08:00:00", 20, "member", "classic_bike", "A", "B"),
        ("2024-12-31 08:00:00", 60, "member", "classic_bike", "A", "B", 1),
    ])
    got = one(M.period_summary(df, SPEC))
    assert got == {"month": 1, "n": 3, "avg_min": 30.0, "p50_min": 20.0, "n_casual": 0,
                   "n_member": 3, "n_classic": 3, "n_electric": 0, "electric_share": 0.0}
    assert one(M.period_summary(df, SPEC, median="approx"))["p50_min"] == 20.0


def test_kpi_peak_tie_takes_the_earliest_day_and_no_electric_is_zero(spark):
    df = trips(spark, [
        ("2025-01-03 08:00:00", 10, "casual", "classic_bike", "A", None),
        ("2025-01-02 08:00:00", 20, "member", "classic_bike", "B", "B"),
    ])
    got = one(M.kpi(df, SPEC))
    assert (got["peak_date"], got["peak_day_rides"], got["n_days"]) == ("2025-01-02", 1, 2)
    assert got["electric_offstation_pct"] == 0.0
    assert got["active_stations"] == 2
    assert one(M.kpi(df, SPEC, median="approx"))["p50_min"] == 10.0


def test_offstation_percentage(spark):
    df = trips(spark, [
        ("2025-01-02 08:00:00", 20, "member", "electric_bike", "B", d) for d in ("A", None, None)])
    assert one(M.kpi(df, SPEC))["electric_offstation_pct"] == 66.7


def test_null_duration_keeps_a_null_bucket(spark):
    df = trips(spark, [("2025-01-02 08:00:00", None, "member", "electric_bike", "B", "A")])
    assert one(M.duration_hist(df, SPEC))["bucket"] is None


def test_station_profile(spark):
    df = trips(spark, [
        ("2025-01-02 08:00:00", 20, "member", "electric_bike", "A", "B"),
        ("2025-01-02 08:00:00", 20, "casual", "electric_bike", "A", "A"),
        ("2025-01-02 08:00:00", 20, "casual", "electric_bike", "A", "Z"),
        ("2025-01-02 08:00:00", 20, "casual", "electric_bike", "C", None),
        ("2025-01-02 08:00:00", 20, "casual", "electric_bike", None, "C"),
    ])
    got = rows(M.station_profile(df, SPEC), "station_id")
    assert set(got) == {"A", "C"}                      # destinations only are lost
    assert (got["A"]["starts"], got["A"]["ends"], got["A"]["net"]) == (3, 1, -2)
    assert got["A"]["member_share"] == 0.333 and got["A"]["name"] == "station A"
    assert (got["C"]["ends"], got["C"]["net"]) == (1, 0)
    origin_only = trips(spark, [("2025-01-02 08:00:00", 20, "member", "electric_bike", "A", None)])
    assert one(M.station_profile(origin_only, SPEC))["net"] == -1


def test_station_name_is_the_most_frequent_one_and_unplaced_stations_drop(spark):
    df = trips(spark, [("2025-01-02 08:00:00", 20, "member", "electric_bike", "A", None)] * 3)
    named = df.withColumn("start_station_name", F.when(F.col("ride_id") == "0", "old").otherwise("new"))
    assert one(M.station_profile(named, SPEC))["name"] == "new"
    unplaced = df.withColumn("start_lat", F.lit(None).cast("double"))
    assert M.station_profile(unplaced, SPEC).count() == 0
    assert one(M.kpi(unplaced, SPEC))["active_stations"] == 0


def test_od_threshold_self_loops_and_top(spark):
    data = [("2025-01-02 08:00:00", 20, "member", "electric_bike", "A", "A")] * 5 \
        + [("2025-01-02 08:00:00", 10, "casual", "electric_bike", "A", "B")] * 4 \
        + [("2025-01-02 08:00:00", 10, "casual", "electric_bike", "B", "A")] * 5
    df = trips(spark, data)
    st = M.station_profile(df, SPEC)
    got = rows(M.od_flows(df, SPEC, st, min_n=5), "start_id", "end_id")
    assert set(got) == {("A", "A"), ("B", "A")}
    assert got["A", "A"]["n_member"] == 5 and got["A", "A"]["avg_min"] == 20.0
    assert [r["start_id"] for r in M.od_flows(df, SPEC, st, min_n=1, top=2).collect()] == ["A", "B"]


def test_metric_scans_read_only_needed_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    make(spark).write.parquet(path)
    plan = M.fact_cube(spark.read.parquet(path), SPEC)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1]
    assert "start_lat" not in schema and "ride_id" not in schema
    assert "HashAggregate" in plan and "SortAggregate" not in plan
