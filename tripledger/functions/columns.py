"""Column builders: calendar fields, reject predicates, buckets, ratios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.spec import DURATION_EDGES, DURATION_LABELS, CleanRules, DateWindow, TripSpec


# --- time ------------------------------------------------------------------

def wall_clock(text: Column) -> Column:
    """Timestamp text as wall-clock time; null when it cannot be parsed."""
    return text.try_cast("timestamp_ntz")


def wall_seconds(ts: Column) -> Column:
    """Whole seconds on the wall clock, fractions cut, independent of any zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def parse_times(df: DataFrame, spec: TripSpec) -> DataFrame:
    return df.withColumns({
        spec.start_ts: wall_clock(F.col(spec.start_text)),
        spec.end_ts: wall_clock(F.col(spec.end_text)),
    })


def with_duration(df: DataFrame, spec: TripSpec) -> DataFrame:
    """Minutes between the whole start second and the whole end second."""
    seconds = wall_seconds(F.col(spec.end_ts)) - wall_seconds(F.col(spec.start_ts))
    return df.withColumn(spec.duration, seconds / F.lit(60.0))


def iso_dow(ts: Column) -> Column:
    """Monday 1 … Sunday 7."""
    return (F.weekday(ts) + 1).cast("int")


def is_weekend(dow: Column) -> Column:
    return dow >= 6


def day_type(dow: Column) -> Column:
    return F.when(dow == 6, "saturday").when(dow == 7, "sunday").otherwise("weekday")


def with_calendar(df: DataFrame, spec: TripSpec) -> DataFrame:
    ts = F.col(spec.start_ts)
    return df.withColumns({
        spec.date: F.to_date(ts),
        spec.hour: F.hour(ts),
        spec.dow: iso_dow(ts),
        spec.day_type: day_type(iso_dow(ts)),
    })


def in_window(date: Column, window: DateWindow) -> Column:
    """Both ends included."""
    return date.between(F.lit(window.first).cast("date"), F.lit(window.last).cast("date"))


def hour_band(hour: Column, first: int, last: int) -> Column:
    """Hours ``first`` … ``last`` inclusive, wrapping midnight when first > last."""
    if first <= last:
        return hour.between(first, last)
    return (hour >= first) | (hour <= last)


# --- reject predicates (null-safe: unknown counts as bad) --------------------

def is_bad_time(spec: TripSpec) -> Column:
    return F.col(spec.start_ts).isNull() | F.col(spec.end_ts).isNull()


def is_bad_duration(spec: TripSpec, rules: CleanRules = CleanRules()) -> Column:
    d = F.col(spec.duration)
    return F.coalesce((d <= rules.min_exclusive) | (d > rules.max_inclusive), F.lit(True))


def is_bad_enum(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


# --- buckets -----------------------------------------------------------------

def bucket_ord(value: Column, edges: Sequence[float] = DURATION_EDGES) -> Column:
    """Index of the half-open interval a value falls in; null stays null."""
    expr = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("int"))
    for i, upper in enumerate(edges):
        expr = expr.when(value < upper, F.lit(i))
    return expr.otherwise(F.lit(len(edges)))


def bucket_label(ordinal: Column, labels: Sequence[str] = DURATION_LABELS) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), ordinal + 1)


def bucketize(
    df: DataFrame, value: str,
    edges: Sequence[float] = DURATION_EDGES, labels: Sequence[str] = DURATION_LABELS,
) -> DataFrame:
    return (
        df.withColumn("bucket_ord", bucket_ord(F.col(value), edges))
        .withColumn("bucket", bucket_label(F.col("bucket_ord"), labels))
    )


# --- counts, ratios, measures -------------------------------------------------

def share(num: Column, den: Column, scale: float = 100.0, digits: int = 1) -> Column:
    """``scale * num / den`` rounded half up; 0 when the denominator is 0 or null."""
    ratio = F.try_divide(num.cast("double") * F.lit(float(scale)), den.cast("double"))
    return F.round(F.coalesce(ratio, F.lit(0.0)), digits)


def measure_for(rider: str, total: str, member: str, spec: TripSpec) -> Column:
    """A total, its member part, or the rest, according to the rider filter."""
    t, m = F.col(total), F.coalesce(F.col(member), F.lit(0))
    if rider == spec.member:
        return m
    return t - m if rider == spec.casual else t


def offstation(spec: TripSpec) -> Column:
    """Returned away from a station: the destination is missing."""
    return F.col(spec.destination).isNull()


def with_offstation(df: DataFrame, spec: TripSpec, name: str = "offstation") -> DataFrame:
    return df.withColumn(name, offstation(spec))


def bubble_weight(starts: Column) -> Column:
    return F.sqrt(starts.cast("double"))


def corridor_weight(n: Column) -> Column:
    """``max(1, log2(n) - 3)``; an empty corridor gets the minimum weight."""
    return F.greatest(F.lit(1.0), F.when(n > 0, F.log2(n.cast("double"))).otherwise(0.0) - 3)


def corridor_label(origin_name: Column, destination_name: Column) -> Column:
    return F.concat_ws(" → ", origin_name, destination_name)


def apply_scenario(value: Column, arm: Column, factor: Column | float, treat: str = "treat") -> Column:
    """Project a multiplicative effect onto one arm."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.when(arm == treat, value * factor).otherwise(value)
