import pytest

from tests.helpers import one, rows
from tripledger.functions import columns as C
from tripledger.operators import slices as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def cube(spark):
    data = [
        (1, 1, 8, "member", "classic_bike", 10, 100.0), (1, 6, 8, "casual", "electric_bike", 4, 90.5),
        (1, 1, 22, "member", "electric_bike", 3, 30.0), (2, 2, 17, "member", "classic_bike", 20, 150.0),
        (2, 7, 17, "casual", "classic_bike", 6, 120.0), (2, 3, 6, "casual", "electric_bike", 20, 60.0),
    ]
    return spark.createDataFrame(
        data, "month int, dow int, hour int, member string, bike string, n long, sum_min double")


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(
        [("2025-01-06", 1, "weekday", 13, 13, 0), ("2025-01-11", 6, "saturday", 4, 0, 4),
         ("2025-02-04", 2, "weekday", 40, 20, 20), ("2025-02-09", 7, "sunday", 6, 0, 6)],
        "date string, dow int, day_type string, n long, n_member long, n_casual long")


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame(
        [("a", "A", 41.0, -87.0, 10, 4, 6, 1), ("b", "B", 41.5, -87.5, 10, 10, 15, 15),
         ("c", "C", 42.0, -88.0, 2, 0, 2, 0)],
        "station_id string, name string, lat double, lng double, starts long, starts_member long, "
        "ends long, ends_member long").withColumn("net", F.col("ends") - F.col("starts"))


@pytest.mark.parametrize("hour, inside", [(21, False), (22, True), (4, True), (5, False), (0, True)])
def test_night_band_wraps_midnight(spark, hour, inside):
    df = spark.range(1).select(C.hour_band(F.lit(hour), 22, 4).alias("x"))
    assert one(df)["x"] is inside


def test_slices_and_rollups(cube):
    assert S.slice_cube(cube).count() == 6
    assert S.slice_cube(cube, 2, "casual").agg(F.sum("n")).first()[0] == 26
    assert rows(S.rollup_cube(cube, ["member"]), "member")["member"]["sum_min"] == 280.0
    total = [r for r in S.cube_grouping_sets(cube, [["month"], []]).collect() if r["level"] == 1]
    assert total[0]["n"] == 63


def test_dense_axes(cube):
    heat = rows(S.week_heat(cube, 1), "dow", "hour")
    assert len(heat) == 168 and heat[1, 8]["n"] == 10 and heat[2, 17]["n"] == 0
    months = rows(S.monthly_stack(cube), "month")
    assert len(months) == 12 and months[5]["electric_share"] == 0.0 and months[1]["electric_share"] == 41.2
    curves = rows(S.hour_curves(cube), "hour")
    assert len(curves) == 24 and curves[8]["casual_weekend"] == 4 and curves[3]["member_weekday"] == 0
    assert rows(S.hour_avg(cube), "hour")[8]["avg_min"] == 13.6
    classes = rows(S.class_structure(cube, 2), "month")
    assert classes[1]["member_classic"] == 0 and classes[2]["casual_electric"] == 20


def test_peaks_and_shares(cube, daily):
    assert one(S.peak_hour(cube)) == {"hour": 6, "n": 20}      # tie of hours 6 and 17
    assert one(S.peak_hour(cube, (7, 10)))["hour"] == 8
    assert rows(S.share_by_daytype(daily), "weekend")[False]["share"] == 37.74
    assert rows(S.share_by_period(cube), "month")[1]["share"] == 41.18
    assert one(S.first_last_share(cube))["last_share"] == 43.48
    assert rows(S.avg_grid(cube), "member", "bike")["casual", "electric_bike"]["avg_min"] == 6.3


def test_daily_split(daily):
    got = rows(S.daily_split(daily, "casual"), "date")
    assert got["2025-02-04"] == {"date": "2025-02-04", "weekday": 20, "weekend": None}
    assert got["2025-01-11"]["weekend"] == 4


def test_cards_use_one_scope(spark, cube, daily):
    kpi = spark.createDataFrame([(9.4, 3, "2025-02-04", 40)],
                                "p50_min double, active_stations long, peak_date string, peak_day_rides long")
    got = one(S.kpi_cards(cube, daily, kpi, 2, "casual"))
    assert (got["n_rides"], got["member_share"], got["avg_min"]) == (26, 43.5, 6.9)
    assert got["electric_share"] == 76.9 and got["avg_per_day"] == 13.0
    assert got["peak_date"] == "2025-02-04"
    assert one(S.kpi_cards(cube, daily, kpi))["avg_per_day"] == 16.0


def test_station_lists(stations):
    assert [r["station_id"] for r in S.top_stations(stations, 2).collect()] == ["a", "b"]
    assert [r["station_id"] for r in S.top_stations(stations, 1, "member").collect()] == ["b"]
    got = rows(S.station_measures(stations, "casual"), "station_id")
    assert got["a"]["starts_value"] == 6 and got["a"]["net_value"] == -1
    assert [r["net_value"] for r in S.net_extremes(stations, 1).collect()] == [-4, 5]
    assert S.net_extremes(stations, 3).count() == 6            # short lists overlap
    assert one(S.net_scale(stations)) == {"net_max": 5}
    assert one(S.bbox(stations)) == {"x_min": -88.01, "x_max": -86.99, "y_min": 40.99, "y_max": 42.01}


def test_corridors_and_narrative(spark, cube, stations):
    od = spark.createDataFrame(
        [("a", "b", 64, 60, "A", 41.0, -87.0, "B", 41.5, -87.5),
         ("b", "a", 64, 0, "B", 41.5, -87.5, "A", 41.0, -87.0)],
        "start_id string, end_id string, n long, n_member long, s_name string, s_lat double, "
        "s_lng double, e_name string, e_lat double, e_lng double")
    got = S.top_corridors(od, 1).collect()
    assert got[0]["label"] == "A → B" and got[0]["weight"] == 3.0
    assert rows(S.top_corridors(od, 2, "casual"), "start_id")["a"]["weight"] == 1.0
    n = one(S.narrative_numbers(cube, stations, od))
    assert (n["peak_month"], n["low_month"], n["peak_ratio"]) == (2, 1, 2.71)
    assert n["night_share"] == 4.8 and n["peak_hour"] == 6 and n["am_peak_hour"] == 6
    assert (n["top_station"], n["top_inflow"], n["top_outflow"]) == ("A", "B", "A")
    assert n["top_flow"] == "A → B"


def test_buckets_keep_their_order_and_empty_cells(spark):
    hist = spark.createDataFrame(
        [(1, "member", "classic_bike", "5-10", 1, 3), (2, "casual", "classic_bike", "0-5", 0, 4)],
        "month int, member string, bike string, bucket string, bucket_ord int, n long")
    got = rows(S.bucket_by_rider(hist, 1), "bucket")
    assert got["0-5"]["n_casual"] == 0 and got["5-10"]["n_member"] == 3


def test_values_off_the_axis_stay(spark):
    cube = spark.createDataFrame(
        [(1, 1, 8, "member", "electric_bike", 2, 1.0), (13, 1, 8, "member", "electric_bike", 5, 1.0),
         (None, 1, None, "casual", "classic_bike", 7, 1.0)],
        "month int, dow int, hour int, member string, bike string, n bigint, sum_min double")
    got = {r["month"]: (r["n_member"], r["n_casual"]) for r in S.monthly_stack(cube).collect()}
    assert len(got) == 14 and got[13] == (5, 0) and got[None] == (0, 7) and got[2] == (0, 0)
    assert {r["month"] for r in S.class_structure(cube).collect()} == {*range(1, 14), None}
    assert sum(r["n"] for r in S.week_heat(cube).collect()) == 14
    assert {r["hour"] for r in S.hour_curves(cube).collect()} == {*range(24), None}
