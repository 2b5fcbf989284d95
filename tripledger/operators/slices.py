"""Filtered roll-ups over the metric tables: what dashboard and report ask for.

``period=0`` means all periods and ``rider="all"`` all riders. Inputs are metric
tables, whose size is bounded by the calendar, the classes and the stations; the
trips themselves are never read here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.spec import TripSpec

SPEC = TripSpec()


def slice_cube(cube: DataFrame, period: int = 0, rider: str = "all") -> DataFrame:
    if period:
        cube = cube.where(F.col("month") == period)
    if rider != "all":
        cube = cube.where(F.col("member") == rider)
    return cube


def with_weekend(df: DataFrame) -> DataFrame:
    return df.withColumn("weekend", C.is_weekend(F.col("dow")))


def _minutes_sum() -> Column:
    # one-decimal minutes add up exactly as decimals
    return F.sum(F.col("sum_min").cast("decimal(18,1)")).cast("double")


def rollup_cube(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cube.groupBy(*keys).agg(F.sum("n").alias("n"), _minutes_sum().alias("sum_min"))


def cube_grouping_sets(cube: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Several roll-ups in one pass; ``level`` tells them apart."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return (
        cube.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
        .agg(F.grouping_id(*keys).alias("level"), F.sum("n").alias("n"),
             _minutes_sum().alias("sum_min"))
    )


def avg_from_cube(cube: DataFrame, keys: Sequence[str], digits: int = 1) -> DataFrame:
    """Mean minutes as a ratio of sums."""
    return rollup_cube(cube, keys).select(
        *keys, C.share(F.col("sum_min"), F.col("n"), 1, digits).alias("avg_min"))


def _axis(df: DataFrame, name: str, first: int, last: int) -> DataFrame:
    return df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def _dense(axis: DataFrame, values: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """The axis with its values, zero where there are none; rows off the axis stay as they are."""
    frame = axis.select(*keys).unionByName(values.select(*keys)).distinct()
    own = values.select(*[F.col(k).alias(f"_{k}") for k in keys], *fill)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return frame.join(own, same, "left").select(*keys, *fill).fillna(0, list(fill))


def _n_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


# --- cards and series ------------------------------------------------------------

def kpi_cards(
    cube: DataFrame, daily: DataFrame, kpi: DataFrame, period: int = 0, rider: str = "all",
) -> DataFrame:
    """The overview cards.

    Riders are filtered everywhere but in the member share. The average per day
    selects days by the month of their date, the rest by partition period.
    """
    in_rider = F.lit(True) if rider == "all" else F.col("member") == rider
    minutes = F.sum(F.when(in_rider, F.col("sum_min").cast("decimal(18,1)"))).cast("double")
    cards = slice_cube(cube, period).agg(
        _n_if(in_rider).alias("n_rides"),
        C.share(_n_if(F.col("member") == SPEC.member), F.sum("n")).alias("member_share"),
        C.share(minutes, _n_if(in_rider), 1).alias("avg_min"),
        C.share(_n_if(in_rider & (F.col("bike") == SPEC.electric)), _n_if(in_rider))
        .alias("electric_share"),
    )
    days = daily if not period else daily.where(F.month(F.col("date").cast("date")) == period)
    day_value = C.measure_for(rider, "n", "n_member", SPEC)
    per_day = days.agg(C.share(F.sum(day_value), F.count("*"), 1, 0).alias("avg_per_day"))
    whole = kpi.select(F.struct(
        "p50_min", "active_stations", "peak_date", "peak_day_rides").alias("k")).scalar()
    return cards.withColumn("avg_per_day", per_day.scalar()).withColumn("k", whole).select(
        "n_rides", "member_share", "avg_min", "electric_share", "avg_per_day",
        "k.p50_min", "k.active_stations", "k.peak_date", "k.peak_day_rides")


def monthly_stack(cube: DataFrame, rider: str = "all", periods: int = 12) -> DataFrame:
    """Every period with trips by rider and the electric share, zeros for gaps."""
    by_month = slice_cube(cube, 0, rider).groupBy("month").agg(
        _n_if(F.col("member") == SPEC.member).alias("n_member"),
        _n_if(F.col("member") == SPEC.casual).alias("n_casual"),
        C.share(_n_if(F.col("bike") == SPEC.electric), F.sum("n")).alias("electric_share"),
    )
    return _dense(_axis(cube, "month", 1, periods), by_month, ["month"],
                  ["n_member", "n_casual", "electric_share"])


def share_by_period(cube: DataFrame, vehicle: str = SPEC.electric) -> DataFrame:
    return cube.groupBy("month").agg(
        C.share(_n_if(F.col("bike") == vehicle), F.sum("n"), 100, 2).alias("share"))


def first_last_share(cube: DataFrame, vehicle: str = SPEC.electric) -> DataFrame:
    s = share_by_period(cube, vehicle)
    return s.agg(
        F.min_by("share", "month").alias("first_share"), F.max_by("share", "month").alias("last_share"))


def daily_split(daily: DataFrame, rider: str = "all") -> DataFrame:
    """One column for weekdays and one for weekends, null where the other applies."""
    value = C.measure_for(rider, "n", "n_member", SPEC)
    weekday = F.col("day_type") == "weekday"
    return daily.select(
        "date", F.when(weekday, value).alias("weekday"), F.when(~weekday, value).alias("weekend"))


def share_by_daytype(daily: DataFrame, rider: str = SPEC.casual) -> DataFrame:
    """Share of a rider class among weekday and among weekend trips."""
    value = C.measure_for(rider, "n", "n_member", SPEC)
    return daily.groupBy(C.is_weekend(F.col("dow")).alias("weekend")).agg(
        C.share(F.sum(value), F.sum("n"), 100, 2).alias("share"))


# --- hours and durations -----------------------------------------------------------

def week_heat(cube: DataFrame, period: int = 0, rider: str = "all") -> DataFrame:
    """Dense weekday × hour grid, 168 cells."""
    grid = (
        _axis(cube, "dow", 1, 7)
        .select("dow", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    )
    cells = slice_cube(cube, period, rider).groupBy("dow", "hour").agg(F.sum("n").alias("n"))
    return _dense(grid, cells, ["dow", "hour"], ["n"])


def hour_curves(cube: DataFrame, period: int = 0) -> DataFrame:
    """Trips by hour, one column per rider and day type."""
    weekend = C.is_weekend(F.col("dow"))
    series = {
        f"{rider}_{name}": _n_if((F.col("member") == rider) & cond)
        for rider in (SPEC.member, SPEC.casual)
        for name, cond in (("weekday", ~weekend), ("weekend", weekend))
    }
    by_hour = slice_cube(cube, period).groupBy("hour").agg(
        *[v.alias(k) for k, v in series.items()])
    return _dense(_axis(cube, "hour", 0, 23), by_hour, ["hour"], list(series))


def hour_avg(cube: DataFrame, period: int = 0, rider: str = "all") -> DataFrame:
    values = avg_from_cube(slice_cube(cube, period, rider), ["hour"])
    return _dense(_axis(cube, "hour", 0, 23), values, ["hour"], ["avg_min"])


def bucket_by_rider(hist: DataFrame, period: int = 0, rider: str = "all") -> DataFrame:
    """Trips by duration bucket and rider; buckets empty in the slice stay with zero."""
    in_slice = F.lit(True)
    if period:
        in_slice = in_slice & (F.col("month") == period)
    if rider != "all":
        in_slice = in_slice & (F.col("member") == rider)
    return hist.groupBy("bucket", "bucket_ord").agg(
        _n_if(in_slice & (F.col("member") == SPEC.member)).alias("n_member"),
        _n_if(in_slice & (F.col("member") == SPEC.casual)).alias("n_casual"),
    )


def peak_hour(
    cube: DataFrame, hours: tuple[int, int] | None = None, days: tuple[int, int] = (1, 5),
) -> DataFrame:
    """The busiest hour (earliest on ties), within hours and weekdays if given."""
    rows = cube.where(F.col("dow").between(*days))
    if hours:
        rows = rows.where(F.col("hour").between(*hours))
    return rows.groupBy("hour").agg(F.sum("n").alias("n")).agg(
        F.max_by("hour", F.struct("n", -F.col("hour"))).alias("hour"), F.max("n").alias("n"))


# --- stations and corridors -----------------------------------------------------------

def station_measures(stations: DataFrame, rider: str = "all") -> DataFrame:
    """Starts and net flow for the rider filter."""
    ends = C.measure_for(rider, "ends", "ends_member", SPEC)
    starts = C.measure_for(rider, "starts", "starts_member", SPEC)
    return stations.select(
        "station_id", "name", "lat", "lng",
        starts.alias("starts_value"), (ends - starts).alias("net_value"))


def top_stations(stations: DataFrame, k: int = 15, rider: str = "all") -> DataFrame:
    return (
        station_measures(stations, rider).orderBy(F.desc("starts_value"), "station_id")
        .limit(k).select("station_id", "name", "starts_value")
    )


def net_extremes(stations: DataFrame, k: int = 6, rider: str = "all") -> DataFrame:
    """The strongest inflows and outflows; short lists may overlap, as both are wanted."""
    net = station_measures(stations, rider).select("station_id", "name", "net_value")
    top = net.orderBy(F.desc("net_value"), "station_id").limit(k)
    bottom = net.orderBy("net_value", "station_id").limit(k)
    return top.unionByName(bottom).orderBy("net_value", "station_id")


def top_corridors(od: DataFrame, k: int = 60, rider: str = "all") -> DataFrame:
    """The first k flows by all trips, with the volume of the rider filter and a line weight."""
    volume = C.measure_for(rider, "n", "n_member", SPEC)
    return (
        od.orderBy(F.desc("n"), "start_id", "end_id").limit(k)
        .select(
            "start_id", "end_id", C.corridor_label(F.col("s_name"), F.col("e_name")).alias("label"),
            "s_lng", "s_lat", "e_lng", "e_lat", volume.alias("volume"),
            F.round(C.corridor_weight(volume), 6).alias("weight"))
    )


def station_map(stations: DataFrame, rider: str = "all") -> DataFrame:
    return station_measures(stations, rider).withColumn(
        "weight", F.round(C.bubble_weight(F.col("starts_value")), 6))


def bbox(stations: DataFrame, pad: float = 0.01) -> DataFrame:
    return stations.agg(
        F.round(F.min("lng") - pad, 6).alias("x_min"), F.round(F.max("lng") + pad, 6).alias("x_max"),
        F.round(F.min("lat") - pad, 6).alias("y_min"), F.round(F.max("lat") + pad, 6).alias("y_max"))


def net_scale(stations: DataFrame, rider: str = "all") -> DataFrame:
    """Half-width of a symmetric scale, at least 1."""
    return station_measures(stations, rider).agg(
        F.greatest(F.lit(1).cast("bigint"), F.max(F.abs("net_value"))).alias("net_max"))


# --- classes ---------------------------------------------------------------------------

CLASS_PAIRS = tuple(
    (rider, vehicle) for rider in (SPEC.member, SPEC.casual)
    for vehicle in (SPEC.classic, SPEC.electric)
)


def class_structure(cube: DataFrame, period: int = 0, periods: int = 12) -> DataFrame:
    """Every period by rider × vehicle, zeros for gaps and for periods outside the filter."""
    series = {
        f"{r}_{v.split('_')[0]}": _n_if((F.col("member") == r) & (F.col("bike") == v))
        for r, v in CLASS_PAIRS
    }
    by_month = slice_cube(cube, period).groupBy("month").agg(
        *[v.alias(k) for k, v in series.items()])
    return _dense(_axis(cube, "month", 1, periods), by_month, ["month"], list(series))


def avg_grid(cube: DataFrame, period: int = 0) -> DataFrame:
    """Mean minutes by rider × vehicle."""
    return avg_from_cube(slice_cube(cube, period), ["member", "bike"])


# --- text numbers -------------------------------------------------------------------------

def insight(kpi: DataFrame) -> DataFrame:
    return kpi.select(
        "n_rides",
        C.share(F.col("n_member"), F.col("n_member") + F.col("n_casual")).alias("member_share"),
        C.share(F.col("n_electric"), F.col("n_rides")).alias("electric_share"),
        "electric_offstation_pct")


def narrative_numbers(cube: DataFrame, stations: DataFrame, od: DataFrame) -> DataFrame:
    """One row with the numbers of the report text.

    The cube is reduced by hour and by month once each; every number is then a
    small aggregate of those.
    """
    weekend = C.is_weekend(F.col("dow"))
    tenths = F.col("sum_min").cast("decimal(18,1)")
    member, casual = F.col("member") == SPEC.member, F.col("member") == SPEC.casual
    by_hour = cube.groupBy("hour").agg(
        F.sum("n").alias("n"),
        _n_if(~weekend).alias("n_wd"), _n_if(weekend).alias("n_we"),
        _n_if(casual & ~weekend).alias("n_casual_wd"), _n_if(casual & weekend).alias("n_casual_we"),
        _n_if(member).alias("n_member"), _n_if(casual).alias("n_casual"),
        _n_if(F.col("bike") == SPEC.electric).alias("n_electric"),
        F.sum(F.when(member, tenths)).alias("min_member"),
        F.sum(F.when(casual, tenths)).alias("min_casual"),
    )
    hour, n = F.col("hour"), F.col("n")
    morning = F.when(hour.between(6, 10) & (F.col("n_wd") > 0), F.struct("n_wd", -hour))
    busiest = F.when(F.col("n_wd") > 0, F.struct("n_wd", -hour))
    numbers = by_hour.agg(
        C.share(F.sum("n_member"), F.sum("n_member") + F.sum("n_casual")).alias("member_share"),
        C.share(F.sum("n_electric"), F.sum("n")).alias("electric_share"),
        C.share(F.sum("min_member"), F.sum("n_member"), 1).alias("member_avg_min"),
        C.share(F.sum("min_casual"), F.sum("n_casual"), 1).alias("casual_avg_min"),
        C.share(F.sum("n_casual_wd"), F.sum("n_wd")).alias("weekday_casual_share"),
        C.share(F.sum("n_casual_we"), F.sum("n_we")).alias("weekend_casual_share"),
        F.max_by("hour", busiest).alias("peak_hour"),
        F.max_by("hour", morning).alias("am_peak_hour"),
        C.share(F.sum(F.when(C.hour_band(hour, 22, 4), n)), F.sum("n")).alias("night_share"),
    )
    month = F.col("month")
    months = (
        cube.groupBy("month").agg(
            F.sum("n").alias("n"),
            C.share(_n_if(F.col("bike") == SPEC.electric), F.sum("n")).alias("e"))
        .agg(F.struct(
            F.max_by("month", F.struct("n", -month)).alias("peak_month"),
            F.min_by("month", F.struct("n", month)).alias("low_month"),
            C.share(F.max("n"), F.min("n"), 1, 2).alias("peak_ratio"),
            F.min_by("e", "month").alias("first_electric_share"),
            F.max_by("e", "month").alias("last_electric_share"),
        ).alias("m"))
    )

    def first_name(*order: Column) -> Column:
        return F.min(F.struct(*order, "station_id", "name"))["name"]

    places = stations.agg(F.struct(
        first_name(-F.col("starts")).alias("top_station"),
        first_name(-F.col("net")).alias("top_inflow"),
        first_name(F.col("net")).alias("top_outflow"),
    ).alias("p"))
    flow = od.agg(F.min(F.struct(
        (-F.col("n")).alias("neg"), "start_id", "end_id",
        C.corridor_label(F.col("s_name"), F.col("e_name")).alias("label")))["label"].alias("f"))
    return (
        numbers.withColumns({"m": months.scalar(), "p": places.scalar(), "top_flow": flow.scalar()})
        .select("*", "m.*", "p.*").drop("m", "p")
    )
