"""The metric layer: seven tables over the clean trips.

Counts and minutes are additive, so most tables accept *facts*: either one row
per trip (:func:`trip_facts`, a plain projection) or facts already summed to a
coarser grain (:func:`compact_facts`). The result is the same to the last digit,
see :mod:`tripledger.functions.exact`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.functions import exact as X
from tripledger.operators.ranking import (
    coarser_counts, join_on, quantiles_of_counts, value_counts,
)
from tripledger.spec import TripSpec

FACT_KEYS = ("month", "date", "dow", "day_type", "hour", "member", "bike", "bucket", "bucket_ord")
FACT_MEASURES = ("n_trips", "n_off", "min_whole", "min_ticks")
APPROX_ACCURACY = 1000


# --- facts ---------------------------------------------------------------------

def trip_facts(trips: DataFrame, spec: TripSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Row-level facts: output names fixed, measures additive; ``keep`` passes columns through."""
    minutes = F.col(spec.duration)
    ordinal = C.bucket_ord(minutes)
    return trips.select(
        *keep,
        F.col(spec.period).alias("month"), F.col(spec.date).alias("date"),
        F.col(spec.dow).alias("dow"), F.col(spec.day_type).alias("day_type"),
        F.col(spec.hour).alias("hour"),
        F.col(spec.rider).alias("member"), F.col(spec.vehicle).alias("bike"),
        C.bucket_label(ordinal).alias("bucket"), ordinal.alias("bucket_ord"),
        F.lit(1).cast("bigint").alias("n_trips"),
        C.offstation(spec).cast("bigint").alias("n_off"),
        X.whole_part(minutes).alias("min_whole"), X.tick_part(minutes).alias("min_ticks"),
    )


def compact_facts(facts: DataFrame, keys: Sequence[str] = FACT_KEYS) -> DataFrame:
    """Facts summed to ``keys``; the full grain is bounded by the calendar."""
    return facts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in FACT_MEASURES])


def _facts(df: DataFrame, spec: TripSpec) -> DataFrame:
    return df if "n_trips" in df.columns else trip_facts(df, spec)


def _n(cond: Column | None = None, measure: str = "n_trips") -> Column:
    m = F.col(measure)
    return F.coalesce(F.sum(m if cond is None else F.when(cond, m)), F.lit(0))


def _minutes() -> Column:
    return X.join_parts(F.sum("min_whole"), F.sum("min_ticks"))


# --- cube, periods, days, durations -----------------------------------------------

def fact_cube(trips: DataFrame, spec: TripSpec) -> DataFrame:
    """(month, dow, hour, member, bike) → n, sum_min."""
    return (
        _facts(trips, spec).groupBy("month", "dow", "hour", "member", "bike")
        .agg(_n().alias("n"), F.round(_minutes(), 1).cast("double").alias("sum_min"))
    )


def _class_counts(spec: TripSpec) -> list[Column]:
    return [
        _n(F.col("member") == spec.casual).alias("n_casual"),
        _n(F.col("member") == spec.member).alias("n_member"),
        _n(F.col("bike") == spec.classic).alias("n_classic"),
        _n(F.col("bike") == spec.electric).alias("n_electric"),
    ]


def _approx_median(value: Column) -> Column:
    return F.round(F.percentile_approx(value, 0.5, APPROX_ACCURACY), 1)


def minute_counts(trips: DataFrame, spec: TripSpec) -> DataFrame:
    """Trips per period and duration, the input of every exact median.

    Durations of clean trips are whole seconds up to a day, so a period has at most
    86,400 of them however many trips it holds.
    """
    named = trips.select(F.col(spec.period).alias("month"), F.col(spec.duration).alias("minutes"))
    return value_counts(named, "minutes", ["month"])


def period_summary(
    trips: DataFrame, spec: TripSpec, median: str = "exact", facts: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Per period: trips, mean and median minutes, trips by class, electric share.

    ``median="approx"`` uses a bounded sketch; ``"exact"`` ranks value counts.
    ``facts`` and ``counts`` may bring stored reductions of the same trips.
    """
    source = _facts(trips if facts is None else facts, spec)
    sums = source.groupBy("month").agg(
        _n().alias("n"),
        F.round(_minutes().cast("double") / F.sum("n_trips"), 1).alias("avg_min"),
        *_class_counts(spec),
    )
    if median == "approx":
        mid = trips.groupBy(F.col(spec.period).alias("month")).agg(
            _approx_median(F.col(spec.duration)).alias("p50_min"))
    else:
        counts = minute_counts(trips, spec) if counts is None else counts
        mid = quantiles_of_counts(counts, "minutes", {"p50_min": 0.5}, ["month"]).withColumn(
            "p50_min", F.round("p50_min", 1))
    return join_on(sums, mid, ["month"], "left").select(
        "month", "n", "avg_min", "p50_min", "n_casual", "n_member", "n_classic", "n_electric",
        C.share(F.col("n_electric"), F.col("n")).alias("electric_share"))


def daily_summary(trips: DataFrame, spec: TripSpec) -> DataFrame:
    return (
        _facts(trips, spec).groupBy("date", "dow", "day_type")
        .agg(
            _n().alias("n"),
            _n(F.col("member") == spec.member).alias("n_member"),
            _n(F.col("member") == spec.casual).alias("n_casual"),
        )
        .withColumn("date", F.col("date").cast("string"))
    )


def duration_hist(trips: DataFrame, spec: TripSpec) -> DataFrame:
    return (
        _facts(trips, spec).groupBy("month", "member", "bike", "bucket", "bucket_ord")
        .agg(_n().alias("n"))
    )


def bucket_labels(hist: DataFrame) -> DataFrame:
    """The bucket labels that occur, in axis order."""
    return hist.select("bucket", "bucket_ord").distinct().orderBy("bucket_ord")


# --- stations and flows -------------------------------------------------------------

def station_profile(trips: DataFrame, spec: TripSpec, how: str = "left") -> DataFrame:
    """Station starts, ends, net flow, member share, name and mean position.

    A trip adds to two stations. Both contributions are emitted in one scan and
    meet in one aggregation, so there is no join of starts to ends. ``how="left"``
    keeps stations with at least one start, ``"full"`` all of them. Stations
    without a position are dropped. The name is the most frequent one.
    """
    side = F.explode(F.array(
        F.struct(F.col(spec.origin).alias("station_id"), F.lit(True).alias("is_start")),
        F.struct(F.col(spec.destination).alias("station_id"), F.lit(False).alias("is_start")),
    )).alias("s")
    is_start = F.col("s.is_start")

    def at_start(column: str) -> Column:
        return F.when(is_start, F.col(column))

    sides = (
        trips.select(spec.origin_name, spec.origin_x, spec.origin_y, spec.rider, side)
        .where(F.col("s.station_id").isNotNull())
        .select(
            F.col("s.station_id").alias("station_id"), is_start.alias("is_start"),
            (F.col(spec.rider) == spec.member).alias("is_member"),
            at_start(spec.origin_name).alias("name"),
            at_start(spec.origin_x).alias("x"), at_start(spec.origin_y).alias("y"),
        )
    )
    start, member = F.col("is_start"), F.col("is_member")
    by_name = sides.groupBy("station_id", "name").agg(
        F.count_if(start).alias("starts"), F.count_if(start & member).alias("starts_member"),
        F.count_if(~start).alias("ends"), F.count_if(~start & member).alias("ends_member"),
        *[f.alias(f"{axis}_{part}") for axis in ("x", "y") for part, f in (
            ("n", F.count(axis)),
            ("whole", F.sum(X.whole_part(F.col(axis)))),
            ("ticks", F.sum(X.tick_part(F.col(axis), X.FINE))),
        )],
    )

    def mean(axis: str) -> Column:
        total = X.join_parts(F.sum(f"{axis}_whole"), F.sum(f"{axis}_ticks"), X.FINE)
        return F.round(F.try_divide(total.cast("double"), F.sum(f"{axis}_n").cast("double")), 5)

    named = F.when(F.col("name").isNotNull(), F.struct("starts", "name"))
    profile = by_name.groupBy("station_id").agg(
        F.max(named)["name"].alias("name"),
        mean("y").alias("lat"), mean("x").alias("lng"),
        *[F.sum(c).alias(c) for c in ("starts", "starts_member", "ends", "ends_member")],
    )
    if how == "left":
        profile = profile.where(F.col("starts") > 0)
    return profile.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(
        "station_id", "name", "lat", "lng", "starts", "starts_member", "ends", "ends_member",
        (F.col("ends") - F.col("starts")).alias("net"),
        C.share(F.col("starts_member"), F.col("starts"), 1, 3).alias("member_share"),
    )


def od_edges(trips: DataFrame, spec: TripSpec, min_n: int = 100) -> DataFrame:
    """Origin–destination pairs with at least ``min_n`` trips, self-loops included."""
    minutes = F.col(spec.duration)
    return (
        trips.where(F.col(spec.origin).isNotNull() & F.col(spec.destination).isNotNull())
        .groupBy(F.col(spec.origin).alias("start_id"), F.col(spec.destination).alias("end_id"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col(spec.rider) == spec.member).alias("n_member"),
            F.round(X.exact_mean(minutes), 1).alias("avg_min"),
        )
        .where(F.col("n") >= min_n)
    )


def od_flows(
    trips: DataFrame, spec: TripSpec, stations: DataFrame, min_n: int = 100, top: int = 1000,
) -> DataFrame:
    """The busiest edges between stations of known position.

    The station lookup joins aggregated edges twice. No broadcast is forced: the
    planner broadcasts it while it is under the threshold and shuffles it beyond.
    """
    def lookup(prefix: str, key: str) -> DataFrame:
        return stations.select(
            F.col("station_id").alias(key), F.col("name").alias(f"{prefix}_name"),
            F.col("lat").alias(f"{prefix}_lat"), F.col("lng").alias(f"{prefix}_lng"))

    return (
        od_edges(trips, spec, min_n)
        .join(lookup("s", "start_id"), "start_id").join(lookup("e", "end_id"), "end_id")
        .select("start_id", "end_id", "n", "n_member", "avg_min",
                "s_name", "s_lat", "s_lng", "e_name", "e_lat", "e_lng")
        .orderBy(F.desc("n"), "start_id", "end_id").limit(top)
    )


# --- overview --------------------------------------------------------------------------

def active_stations(trips: DataFrame, spec: TripSpec) -> DataFrame:
    """One row: stations with a start and a known position."""
    return (
        trips.where(F.col(spec.origin).isNotNull())
        .groupBy(F.col(spec.origin).alias("station_id"))
        .agg(F.count(spec.origin_x).alias("nx"), F.count(spec.origin_y).alias("ny"))
        .agg(F.count_if((F.col("nx") > 0) & (F.col("ny") > 0)).alias("active_stations"))
    )


def kpi(
    trips: DataFrame, spec: TripSpec, median: str = "exact", facts: DataFrame | None = None,
    counts: DataFrame | None = None, stations: DataFrame | None = None,
) -> DataFrame:
    """One row of twelve overview measures.

    Trip counts, the peak day and the number of days come from one pass that
    groups by date; the median and the active stations take one pass each. Stored
    facts, value counts and station profiles replace those passes.
    """
    source = _facts(trips if facts is None else facts, spec)
    days = source.groupBy("date").agg(
        _n().alias("n"), *_class_counts(spec),
        _n(F.col("bike") == spec.electric, "n_off").alias("n_electric_off"),
        F.sum("min_whole").alias("min_whole"), F.sum("min_ticks").alias("min_ticks"),
    )
    row = days.agg(
        F.sum("n").alias("n_rides"),
        *[F.sum(c).alias(c) for c in ("n_member", "n_casual", "n_classic", "n_electric")],
        F.round(_minutes().cast("double") / F.sum("n"), 1).alias("avg_min"),
        C.share(F.sum("n_electric_off"), F.sum("n_electric")).alias("electric_offstation_pct"),
        F.min(F.struct((-F.col("n")).alias("neg_n"), "date")).alias("_peak"),
        F.count("*").alias("n_days"),
    )
    if median == "approx":
        mid = trips.agg(_approx_median(F.col(spec.duration)).alias("p50_min"))
    else:
        if counts is None:
            minutes = value_counts(trips.select(F.col(spec.duration).alias("minutes")), "minutes")
        else:
            minutes = coarser_counts(counts, "minutes")
        mid = quantiles_of_counts(minutes, "minutes", {"p50_min": 0.5}).select(F.round("p50_min", 1))
    if stations is None:
        active = active_stations(trips, spec)
    else:
        active = stations.agg(F.count_if(F.col("starts") > 0))
    return row.select(
        "n_rides", "n_member", "n_casual", "n_classic", "n_electric", "avg_min",
        mid.scalar().alias("p50_min"),
        active.scalar().alias("active_stations"),
        "electric_offstation_pct",
        F.col("_peak.date").cast("string").alias("peak_date"),
        (-F.col("_peak.neg_n")).alias("peak_day_rides"), "n_days",
    )
