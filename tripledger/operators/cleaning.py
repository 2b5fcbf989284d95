"""From raw trips to clean trips, with a first-match quality audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.spec import CleanRules, TripSpec


def prepare(raw: DataFrame, spec: TripSpec) -> DataFrame:
    """Parse times and derive the duration, where the input does not bring them."""
    if spec.start_ts not in raw.columns:
        raw = C.parse_times(raw, spec)
    if spec.duration not in raw.columns:
        raw = C.with_duration(raw, spec)
    return raw


def _rejects(spec: TripSpec, rules: CleanRules) -> tuple[Column, Column, Column]:
    return (
        C.is_bad_time(spec),
        C.is_bad_duration(spec, rules),
        C.is_bad_enum([spec.rider, spec.vehicle]),
    )


def audit_class(spec: TripSpec, rules: CleanRules = CleanRules()) -> Column:
    """The first rule a row breaks, or ``good``."""
    bad_time, bad_duration, bad_enum = _rejects(spec, rules)
    return (
        F.when(bad_time, "bad_time").when(bad_duration, "bad_duration")
        .when(bad_enum, "bad_enum").otherwise("good")
    )


def keep_good(df: DataFrame, spec: TripSpec, rules: CleanRules = CleanRules()) -> DataFrame:
    bad_time, bad_duration, bad_enum = _rejects(spec, rules)
    return df.where(~bad_time & ~bad_duration & ~bad_enum)


def dedup(df: DataFrame, key: str, order: Sequence[str] | None = None, within: str | None = None) -> DataFrame:
    """One row per key: the smallest by ``order`` (default: all other columns), nulls first.

    An aggregate rather than a window: copies of a hot key are reduced to one on
    the map side, so they never meet in one task. Null keys count as one key. ``within`` names a column that the key
    determines; where a join has dealt the rows by it, none moves, and copies meet where that join put them. It is not part of the result.
    """
    rest = [c for c in df.columns if c not in (key, within)]
    first = list(order or rest)
    packed = F.min(F.struct(*first, *[c for c in rest if c not in first])).alias("_row")
    keys = [within, key] if within else [key]
    return df.groupBy(*keys).agg(packed).select(
        *[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns if c != within])


def clean(
    raw: DataFrame, spec: TripSpec, rules: CleanRules = CleanRules(),
    order: Sequence[str] | None = None, within: str | None = None,
) -> DataFrame:
    """Clean trips: filtered, one row per trip id, with calendar fields.

    Calendar fields are derived after the shuffle of the de-duplication, which then
    moves only source columns. ``within``: a column that the id of a good row determines (see :func:`dedup`).
    """
    source = _source_columns(spec)
    good = keep_good(prepare(raw, spec), spec, rules).select(*source, *([within] if within else []))
    one_each = dedup(good, spec.trip_id, order or [spec.start_ts, spec.end_ts], within)
    return C.with_calendar(one_each, spec).select(*spec.clean_columns())


def _source_columns(spec: TripSpec) -> list[str]:
    """Clean columns that are not derived after the shuffle."""
    derived = {spec.date, spec.hour, spec.dow, spec.day_type}
    return [c for c in spec.clean_columns() if c not in derived]


def _class_counts() -> list[Column]:
    return [F.count("*").alias("n_raw"), *[
        F.count_if(F.col("_cls") == c).alias(f"n_{c}") for c in ("bad_time", "bad_duration", "bad_enum", "good")]]


def _per_id(raw: DataFrame, spec: TripSpec, rules: CleanRules) -> DataFrame:
    """Row counts by audit class for each trip id."""
    cls = audit_class(spec, rules)
    return prepare(raw, spec).select(F.col(spec.trip_id), cls.alias("_cls")).groupBy(spec.trip_id).agg(*_class_counts())


def _audit_counts(spec: TripSpec) -> list[Column]:
    """The audit from counts per trip id."""
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    kept = F.count_if(F.col("n_good") > 0)
    return [
        total("n_raw").alias("n_raw"),
        F.count(spec.trip_id).alias("n_distinct_ride_id"),
        total("n_bad_time").alias("dropped_bad_time"),
        total("n_bad_duration").alias("dropped_bad_duration"),
        total("n_bad_enum").alias("dropped_bad_enum"),
        kept.alias("n_clean"),
        (total("n_good") - kept).alias("n_removed_as_duplicate"),
    ]


def clean_audited(
    raw: DataFrame, spec: TripSpec, audit: Observation, rules: CleanRules = CleanRules(),
    order: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of :func:`clean`; running them leaves the counts of :func:`quality_audit` in ``audit``.

    The shuffle that de-duplicates also carries the counts by class of each trip id, so nothing is read or
    parsed twice. An id without a good row has counts alone and ends here. The counts are taken in front of later shuffles:
    where a task of that stage runs again because its output was lost, its counts come in twice. Compare
    ``n_clean`` with the rows written, as the clean stage does.
    """
    source = _source_columns(spec)
    rows = prepare(raw, spec).withColumn("_cls", audit_class(spec, rules))
    key = spec.trip_id
    rest = [c for c in source if c != key]
    first = list(order or [spec.start_ts, spec.end_ts])
    packed = F.struct(*first, *[c for c in rest if c not in first])
    per_id = rows.select(*source, "_cls").groupBy(key).agg(
        *_class_counts(), F.min(F.when(F.col("_cls") == "good", packed)).alias("_row"))
    kept = per_id.observe(audit, *_audit_counts(spec)).where(F.col("_row").isNotNull())
    one_each = kept.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in source])
    return C.with_calendar(one_each, spec).select(*spec.clean_columns())


def quality_audit(raw: DataFrame, spec: TripSpec, rules: CleanRules = CleanRules()) -> DataFrame:
    """One row of counts, each raw row counted under the first rule it breaks.

    Counting per trip id first gives distinct ids, clean rows and removed copies
    from the same shuffle, without a second pass or an expanded distinct count.
    """
    return _per_id(raw, spec, rules).agg(*_audit_counts(spec))


def quality_report(audit: DataFrame, year: int | None, rules: CleanRules = CleanRules()) -> DataFrame:
    """The audit row with duplicates, drop rate and the rules applied, as one record."""
    return audit.select(
        F.lit(year).cast("int").alias("year"),
        "n_raw", "n_distinct_ride_id",
        "dropped_bad_time", "dropped_bad_duration", "dropped_bad_enum",
        (F.col("n_raw") - F.col("n_distinct_ride_id")).alias("n_duplicate_rides"),
        "n_removed_as_duplicate", "n_clean",
        C.share(F.col("n_raw") - F.col("n_clean"), F.col("n_raw"), 100, 3).alias("drop_rate_pct"),
        F.struct(
            F.lit(f"({rules.min_exclusive:g}, {rules.max_inclusive:g}] minutes").alias("duration"),
            F.lit("one row kept per trip id").alias("dup"),
            F.lit("missing stations and coordinates are kept as null").alias("null_station_keep"),
        ).alias("rules"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, …"""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key).agg(F.count("*").alias("copies"))
        .groupBy("copies").agg(F.count("*").alias("n_keys"))
    )


def distinct_count(df: DataFrame, key: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(count.alias("n_distinct"))
