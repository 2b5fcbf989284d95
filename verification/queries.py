"""Registered queries: every operator over the given tables, as (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.operators import cleaning, experiment as E, metrics as M, ranking as K
from tripledger.operators import resampling as R
from tripledger.operators import slices as S
from tripledger.operators import statistics as T
from tripledger.plans import stages
from tripledger.session import shared_folder
from tripledger.sources import landing, tables
from tripledger.sources.adapters import EVENT_SPEC, ORDER_SPEC, event_trips, raw_order_trips
from tripledger.spec import DateWindow, TripSpec

PRE1 = DateWindow("pre1", "2024-01-01", "2024-01-10")
PRE2 = DateWindow("pre2", "2024-01-11", "2024-01-20")
POST = DateWindow("post", "2024-01-21", "2024-01-30")
POOL_MIN = 30
OD_MIN = 30

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles to six places, no negative zero."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    return fn


# --- layers ------------------------------------------------------------------------------

def clean_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good trips have an order, so their id names it, and the join by order has dealt them already."""
    return cleaning.clean(raw_order_trips(spark, sf_dir), ORDER_SPEC, within="order_key")


def _scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{run}/{sf_dir.strip('/').replace('/', '_')}/{name}"


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean order trips as a stored table, written by the first query that needs it.

    Metrics are defined over the stored clean layer, not over the cleaning itself. Tasks write their own months: gathering
    those would move every wide row once more.
    """
    path = _scratch(spark, sf_dir, "clean_orders")
    if not tables.path_exists(spark, f"{path}/_SUCCESS"):
        tables.write_trips(clean_orders(spark, sf_dir), path, ["month"], rebalance=False)
    return tables.read_trips(spark, path)


def _fresh(spark: SparkSession, name: str) -> str:
    """A folder of this call alone: what an earlier call returned is still read from its own."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fact_cube(event_trips(spark, sf_dir), EVENT_SPEC)


def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fact_cube(stored_orders(spark, sf_dir), ORDER_SPEC)


def event_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.daily_summary(event_trips(spark, sf_dir), EVENT_SPEC)


def event_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.duration_hist(event_trips(spark, sf_dir), EVENT_SPEC)


def order_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.station_profile(stored_orders(spark, sf_dir), ORDER_SPEC)


def order_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.od_flows(
        stored_orders(spark, sf_dir), ORDER_SPEC, order_stations(spark, sf_dir), OD_MIN)


def order_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kpi(stored_orders(spark, sf_dir), ORDER_SPEC)


def build_event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.build_panel(
        event_trips(spark, sf_dir), EVENT_SPEC, "origin", PRE1, PRE2, POST, POOL_MIN)


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    path = _scratch(spark, sf_dir, name)
    if not tables.path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a stored table, as the experiment stage keeps it."""
    return _stored(spark, sf_dir, "panel", lambda: build_event_panel(spark, sf_dir))


def event_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms as a stored table: assignment happens once, all readouts use it."""
    return _stored(
        spark, sf_dir, "arms", lambda: E.block_randomise(event_panel(spark, sf_dir)))


def event_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    return E.scenario_panel(panel, event_arms(spark, sf_dir), E.cuped_fit(panel))


# --- cleaning and sources -------------------------------------------------------------------

@query
def clean_trips(spark, sf_dir):
    return clean_orders(spark, sf_dir)


@query
def audit_classes(spark, sf_dir):
    raw = cleaning.prepare(raw_order_trips(spark, sf_dir), ORDER_SPEC)
    return raw.groupBy(cleaning.audit_class(ORDER_SPEC).alias("audit_class")).agg(
        F.count("*").alias("n"))


@query
def quality_report(spark, sf_dir):
    audit = cleaning.quality_audit(raw_order_trips(spark, sf_dir), ORDER_SPEC)
    return cleaning.quality_report(audit, 2024).select("*", "rules.*").drop("rules")


@query
def dup_keys(spark, sf_dir):
    return cleaning.duplicate_keys(raw_order_trips(spark, sf_dir), ORDER_SPEC.trip_id)


@query
def distinct_trips(spark, sf_dir):
    return cleaning.distinct_count(raw_order_trips(spark, sf_dir), ORDER_SPEC.trip_id)


@query
def approx_distinct_trips(spark, sf_dir):
    return cleaning.distinct_count(raw_order_trips(spark, sf_dir), ORDER_SPEC.trip_id, True)


def landed_events(spark: SparkSession, sf_dir: str) -> str:
    """Events as landed CSV files: quoted fields, text timestamps, one directory per period."""
    root = _scratch(spark, sf_dir, "landed_events")
    if not tables.path_exists(spark, f"{root}/_SUCCESS"):
        ev = event_trips(spark, sf_dir)
        none = F.lit(None).cast("string")
        end = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))
        ev.select(
            F.col("event_id").cast("string").alias("ride_id"),
            F.col("vehicle_class").alias("rideable_type"),
            F.when(F.col("event_id") % 97 == 0, "not a time").otherwise(F.col("ts").cast("string"))
            .alias("started_at"),
            end.cast("string").alias("ended_at"),
            none.alias("start_station_name"), F.col("origin").alias("start_station_id"),
            none.alias("end_station_name"), F.col("destination").alias("end_station_id"),
            F.col("value").alias("start_lat"), (-F.col("value")).alias("start_lng"),
            F.lit(None).cast("double").alias("end_lat"), F.lit(None).cast("double").alias("end_lng"),
            F.col("rider_class").alias("member_casual"),
            F.lit(2024).alias("year"), F.col("period").alias("month"),
        ).write.mode("overwrite").option("header", True).option("quoteAll", True) \
            .option("nullValue", "").option("emptyValue", "").partitionBy("year", "month").csv(root)
    return root


@query
def landing_audit(spark, sf_dir):
    return landing.landing_audit(spark, landed_events(spark, sf_dir)).agg(
        F.sum("n_rows").alias("n_rows"), F.count_if(~F.col("ok")).alias("n_bad_files"),
        F.max(F.size("missing")).alias("max_missing"))


@query
def landing_audit_quoted(spark, sf_dir):
    """Records, where fields hold line breaks and quotes: physical lines are more than twice as many."""
    root = _scratch(spark, sf_dir, "landed_notes")
    if not tables.path_exists(spark, f"{root}/_SUCCESS"):
        note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('a "b"\n'), "origin", F.lit("\n\nc"))) \
            .otherwise("plain")
        event_trips(spark, sf_dir).select("event_id", note.alias("note"), "rider_class", "period") \
            .write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"') \
            .partitionBy("period").csv(root)
    files = landing.landing_audit(spark, root, ["event_id", "note", "rider_class", "extra"])
    return files.groupBy(F.regexp_extract("file", r"period=(\d+)", 1).cast("int").alias("period")).agg(
        F.sum("n_rows").alias("n_rows"), F.max(F.array_join("missing", ",")).alias("missing"))


@query
def landing_audit_periods(spark, sf_dir):
    """Verdicts of the single files, by the period of their folder."""
    files = landing.landing_audit(spark, landed_events(spark, sf_dir))
    return files.groupBy(F.regexp_extract("file", r"month=(\d+)", 1).cast("int").alias("month")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.size("missing")).alias("n_missing"),
        F.bool_and("ok").alias("all_ok"))


@query
def clean_stage_report(spark, sf_dir):
    """The record that the clean stage leaves beside its output."""
    report = stages.clean_stage(spark, landed_events(spark, sf_dir), _fresh(spark, "clean_stage"), 2024)
    return report.select("*", "rules.*").drop("rules")


@query
def metric_stage_tables(spark, sf_dir):
    """Row counts of the tables that the metric stage writes."""
    root = _fresh(spark, "metric_stage")
    stages.metric_stage(stored_orders(spark, sf_dir), root, ORDER_SPEC, min_n=OD_MIN)
    counts = [tables.read_metric(spark, root, name).agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
              for name in ("cube", "daily", "kpi", "monthly", "stations", "od")]
    return reduce(DataFrame.unionByName, counts)


@query
def read_fallback(spark, sf_dir):
    """Trips that have not been built are read from the fallback."""
    stored_orders(spark, sf_dir)
    trips = tables.read_trips(
        spark, _fresh(spark, "nothing_here"), fallback=_scratch(spark, sf_dir, "clean_orders"))
    return trips.select("trip_key", "month", "days_open")


@query
def landed_clean(spark, sf_dir):
    """CSV scan, parsing, whole-second durations and cleaning in one."""
    spec = TripSpec()
    raw = landing.read_trips_csv(spark, landed_events(spark, sf_dir))
    return cleaning.clean(raw, spec).select(
        F.col("ride_id").cast("bigint").alias("ride_id"), "member_casual", "duration_min",
        "date", "hour", "dow", "day_type", "month", "year", "start_station_id", "start_lat")


@query
def partition_filtered_read(spark, sf_dir):
    trips = tables.of_periods(stored_orders(spark, sf_dir), ORDER_SPEC, [1, 7])
    return trips.select("trip_key", "month", "days_open")


@query
def metric_round_trip(spark, sf_dir):
    """The cube written as Parquet, JSON and CSV and read back from JSON."""
    root = _fresh(spark, "metrics")
    tables.write_metric(event_cube(spark, sf_dir), root, "cube")
    return tables.read_metric(spark, root, "cube", "json")


@query
def metric_round_trip_csv(spark, sf_dir):
    root = _fresh(spark, "metrics_csv")
    tables.write_metric(event_cube(spark, sf_dir), root, "cube", ["csv"])
    return tables.read_metric(spark, root, "cube", "csv")


@query
def metric_order(spark, sf_dir):
    """Places of the days in the table, stored by falling number of trips, as each format keeps them."""
    root = _fresh(spark, "metrics_ordered")
    days = M.daily_summary(event_trips(spark, sf_dir), EVENT_SPEC)
    tables.write_metric(days, root, "daily", order=[F.desc("n"), "date"])
    placed = [tables.read_ordered(spark, root, "daily", fmt).select(F.lit(fmt).alias("format"), "date", "n", "position")
              for fmt in ("parquet", "json", "csv")]
    return reduce(DataFrame.unionByName, placed)


@query
def sample_trips(spark, sf_dir):
    picked = tables.sample_trips(
        event_trips(spark, sf_dir), EVENT_SPEC, [1, 3], 0.1, 42, by_key=True)
    return picked.select("event_id", "period", "value")


@query
def sample_native(spark, sf_dir):
    picked = tables.sample_trips(stored_orders(spark, sf_dir), ORDER_SPEC, [1, 7], 0.1, 42)
    return picked.select("trip_key", "month", "days_open")


# --- metric tables ---------------------------------------------------------------------------

@query
def fact_cube(spark, sf_dir):
    return event_cube(spark, sf_dir)


@query
def cube_from_facts(spark, sf_dir):
    """The cube over facts already summed to calendar grain."""
    facts = M.compact_facts(M.trip_facts(event_trips(spark, sf_dir), EVENT_SPEC))
    return M.fact_cube(facts, EVENT_SPEC)


@query
def cube_rollups(spark, sf_dir):
    cube = S.with_weekend(event_cube(spark, sf_dir))
    return S.rollup_cube(cube, ["member", "weekend", "hour"])


@query
def cube_grouping_sets(spark, sf_dir):
    return S.cube_grouping_sets(
        event_cube(spark, sf_dir),
        [["month"], ["hour"], ["dow", "hour"], ["month", "member", "bike"], ["member", "bike"], []])


@query
def period_summary(spark, sf_dir):
    return M.period_summary(stored_orders(spark, sf_dir), ORDER_SPEC)


@query
def period_summary_approx(spark, sf_dir):
    return M.period_summary(stored_orders(spark, sf_dir), ORDER_SPEC, median="approx")


@query
def daily_summary(spark, sf_dir):
    return event_daily(spark, sf_dir)


@query
def duration_hist(spark, sf_dir):
    return event_hist(spark, sf_dir)


@query
def bucket_labels(spark, sf_dir):
    return M.bucket_labels(event_hist(spark, sf_dir))


@query
def station_profile(spark, sf_dir):
    return order_stations(spark, sf_dir)


@query
def station_profile_full(spark, sf_dir):
    return M.station_profile(stored_orders(spark, sf_dir), ORDER_SPEC, how="full")


@query
def od_flows(spark, sf_dir):
    return order_od(spark, sf_dir)


@query
def kpi(spark, sf_dir):
    return order_kpi(spark, sf_dir)


@query
def kpi_approx(spark, sf_dir):
    return M.kpi(stored_orders(spark, sf_dir), ORDER_SPEC, median="approx")


# --- dashboard and report -----------------------------------------------------------------------

@query
def heat_week_hour(spark, sf_dir):
    return S.week_heat(event_cube(spark, sf_dir))


@query
def heat_week_hour_slice(spark, sf_dir):
    return S.week_heat(event_cube(spark, sf_dir), 2, "member")


@query
def kpi_cards(spark, sf_dir):
    daily = M.daily_summary(stored_orders(spark, sf_dir), ORDER_SPEC)
    return S.kpi_cards(order_cube(spark, sf_dir), daily, order_kpi(spark, sf_dir))


@query
def kpi_cards_period_rider(spark, sf_dir):
    daily = M.daily_summary(stored_orders(spark, sf_dir), ORDER_SPEC)
    return S.kpi_cards(
        order_cube(spark, sf_dir), daily, order_kpi(spark, sf_dir), 3, "casual")


@query
def monthly_stack(spark, sf_dir):
    return S.monthly_stack(order_cube(spark, sf_dir))


@query
def monthly_stack_sparse(spark, sf_dir):
    """Events fill three periods only; the others are zero."""
    return S.monthly_stack(event_cube(spark, sf_dir), "member")


@query
def monthly_stack_short_axis(spark, sf_dir):
    """Periods beyond the axis are kept."""
    return S.monthly_stack(order_cube(spark, sf_dir), periods=6)


@query
def daily_split(spark, sf_dir):
    return S.daily_split(event_daily(spark, sf_dir), "casual")


@query
def hour_curves(spark, sf_dir):
    return S.hour_curves(event_cube(spark, sf_dir))


@query
def hour_avg(spark, sf_dir):
    return S.hour_avg(event_cube(spark, sf_dir), 1, "member")


@query
def bucket_by_rider(spark, sf_dir):
    return S.bucket_by_rider(event_hist(spark, sf_dir), 2)


@query
def top_stations(spark, sf_dir):
    return S.top_stations(order_stations(spark, sf_dir), 15, "casual")


@query
def net_extremes(spark, sf_dir):
    return S.net_extremes(order_stations(spark, sf_dir), 6, "member")


@query
def top_corridors(spark, sf_dir):
    return S.top_corridors(order_od(spark, sf_dir), 60, "casual")


@query
def station_map(spark, sf_dir):
    return S.station_map(order_stations(spark, sf_dir), "member")


@query
def station_bbox(spark, sf_dir):
    return S.bbox(order_stations(spark, sf_dir))


@query
def net_scale(spark, sf_dir):
    return S.net_scale(order_stations(spark, sf_dir), "casual")


@query
def class_structure(spark, sf_dir):
    return S.class_structure(event_cube(spark, sf_dir), 2)


@query
def avg_grid(spark, sf_dir):
    return S.avg_grid(event_cube(spark, sf_dir))


@query
def share_by_daytype(spark, sf_dir):
    return S.share_by_daytype(event_daily(spark, sf_dir))


@query
def share_by_period(spark, sf_dir):
    return S.share_by_period(event_cube(spark, sf_dir))


@query
def first_last_share(spark, sf_dir):
    return S.first_last_share(order_cube(spark, sf_dir))


@query
def peak_hours(spark, sf_dir):
    cube = event_cube(spark, sf_dir)
    return S.peak_hour(cube).withColumn("scope", F.lit("weekday")).unionByName(
        S.peak_hour(cube, (6, 10)).withColumn("scope", F.lit("weekday morning")))


@query
def busiest_day_by_type(spark, sf_dir):
    return K.arg_extreme(event_daily(spark, sf_dir), "n", "date", group=["day_type"])


@query
def insight(spark, sf_dir):
    return S.insight(order_kpi(spark, sf_dir))


@query
def narrative_numbers(spark, sf_dir):
    return S.narrative_numbers(
        order_cube(spark, sf_dir), order_stations(spark, sf_dir), order_od(spark, sf_dir))


# --- description and tests ---------------------------------------------------------------------------

@query
def describe_by(spark, sf_dir):
    return T.describe_by(event_trips(spark, sf_dir), "value", ["rider_class"])


@query
def describe_periods(spark, sf_dir):
    """Two periods described as one group."""
    two = tables.of_periods(stored_orders(spark, sf_dir), ORDER_SPEC, [1, 7])
    return T.describe_by(two, "days_open")


@query
def group_stats(spark, sf_dir):
    return T.group_stats(
        event_trips(spark, sf_dir), "value", ["vehicle_class", "rider_class"])


@query
def row_numbers(spark, sf_dir):
    """Position of every event in the order of value."""
    return K.row_numbers(
        event_trips(spark, sf_dir).select("event_id", "value"), ["value", "event_id"])


@query
def density_hist(spark, sf_dir):
    return T.density_hist(event_trips(spark, sf_dir), "value", "rider_class")


@query
def welch_t(spark, sf_dir):
    return T.welch_t(event_trips(spark, sf_dir), "value", "rider_class", "member", "casual")


@query
def mann_whitney(spark, sf_dir):
    return T.mann_whitney(event_trips(spark, sf_dir), "value", "rider_class", "member", "casual")


@query
def bootstrap_diff(spark, sf_dir):
    return R.bootstrap_diff(
        event_trips(spark, sf_dir), "value", "event_id", "rider_class", "member", "casual")


@query
def bootstrap_vs_welch(spark, sf_dir):
    """Whether the spread of the replicates is the standard error of the difference, within a tenth."""
    ev = event_trips(spark, sf_dir)
    member_or_casual = ("value", "event_id", "rider_class", "member", "casual")
    few = R.fixed_subsample(
        ev.select("event_id", "rider_class", "value"), "event_id", "rider_class",
        ("member", "casual"), 500, E.SEED)

    def agrees(form, rows, m):
        se = T.welch_t(rows, "value", "rider_class", "member", "casual", p=False).select("se").scalar()
        ratio = F.col("boot_sd") / se
        return R.bootstrap_diff(ev, *member_or_casual, m=m).select(
            F.lit(form).alias("form"), (F.abs(ratio - 1) < 0.1).alias("agrees"))

    return agrees("all rows", ev, None).unionByName(agrees("sub-sample", few, 500))


def _weekend_hours(spark, sf_dir):
    return event_trips(spark, sf_dir).select(
        C.is_weekend(F.col("dow")).alias("weekend"), "hour")


@query
def chi2_hours(spark, sf_dir):
    return T.chi2_independence(_weekend_hours(spark, sf_dir), "weekend", "hour")


@query
def hour_share(spark, sf_dir):
    return T.within_share(T.contingency(_weekend_hours(spark, sf_dir), "weekend", "hour"), "weekend")


@query
def chi2_2x2_yates(spark, sf_dir):
    return T.chi2_independence(event_trips(spark, sf_dir), "rider_class", "vehicle_class")


@query
def stratified_diff(spark, sf_dir):
    return T.stratified_diff(
        event_trips(spark, sf_dir), "value", "vehicle_class", "rider_class",
        "electric_bike", "classic_bike", ("member", "casual"))


def _by_day_part(spark, sf_dir):
    """Electric against classic in five parts of the day."""
    ev = event_trips(spark, sf_dir).withColumn("day_part", F.floor(F.col("hour") / 5).cast("int"))
    return T.stratified_means(ev, "value", "vehicle_class", "day_part", "electric_bike", "classic_bike")


@query
def stratified_diff_k(spark, sf_dir):
    return _by_day_part(spark, sf_dir)


@query
def stratified_verdict_k(spark, sf_dir):
    return T.stratified_verdict(_by_day_part(spark, sf_dir))


# --- experiment ------------------------------------------------------------------------------------------

@query
def select_pool(spark, sf_dir):
    return E.select_pool(event_trips(spark, sf_dir), EVENT_SPEC, "origin", PRE1, POOL_MIN)


@query
def pool_trips(spark, sf_dir):
    """Trips per origin and destination, for origins in the pool."""
    ev = event_trips(spark, sf_dir)
    pool = E.select_pool(ev, EVENT_SPEC, "origin", PRE1, POOL_MIN)
    pairs = ev.groupBy("origin", "destination").agg(F.count("*").alias("n"))
    return E.in_pool(pairs, pool, "origin")


@query
def unit_daily_mean(spark, sf_dir):
    ev = event_trips(spark, sf_dir)
    active = E.unit_daily_mean(ev, EVENT_SPEC, "origin", POST)
    calendar = E.unit_daily_mean(ev, EVENT_SPEC, "origin", POST, calendar_days=True)
    return active.join(calendar.withColumnRenamed("y", "y_calendar"), "unit")


@query
def common_units(spark, sf_dir):
    ev = event_trips(spark, sf_dir).where(F.col("vehicle_class") == "classic_bike")
    return E.common_units(
        [E.select_pool(ev, EVENT_SPEC, "origin", w, 12) for w in (PRE1, PRE2, POST)])


@query
def pool_panel(spark, sf_dir):
    return build_event_panel(spark, sf_dir)


@query
def panel_summary(spark, sf_dir):
    return E.panel_summary(event_panel(spark, sf_dir))


@query
def cuped(spark, sf_dir):
    return E.cuped_fit(event_panel(spark, sf_dir))


@query
def cuped_adjusted(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    return E.cuped_apply(panel, E.cuped_fit(panel)).select("unit", "y_adj")


@query
def power_table(spark, sf_dir):
    return E.power_summary(E.cuped_fit(event_panel(spark, sf_dir)))


@query
def mde_curve(spark, sf_dir):
    return E.mde_curve(E.cuped_fit(event_panel(spark, sf_dir)))


@query
def aa_splits(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    return E.aa_splits(E.cuped_apply(panel, E.cuped_fit(panel)), "y_adj").select(
        "iteration", "n_a", "n_b", "diff", "t", "df", "p")


@query
def aa_calibration(spark, sf_dir):
    panel = event_panel(spark, sf_dir)
    return E.aa_calibration(E.cuped_apply(panel, E.cuped_fit(panel)), "y_adj")


@query
def randomisation_gap(spark, sf_dir):
    return E.randomisation_gap(event_panel(spark, sf_dir), "y_pre1")


@query
def pair_neighbours(spark, sf_dir):
    return E.pair_neighbours(event_panel(spark, sf_dir), "y_pre1")


@query
def block_randomise(spark, sf_dir):
    return E.block_randomise(build_event_panel(spark, sf_dir))


@query
def srm(spark, sf_dir):
    return E.srm(event_arms(spark, sf_dir))


@query
def baseline_gap(spark, sf_dir):
    return E.baseline_gap(event_panel(spark, sf_dir), event_arms(spark, sf_dir))


@query
def readout(spark, sf_dir):
    return E.readout(event_assigned(spark, sf_dir), "y_adj")


@query
def readout_unadjusted(spark, sf_dir):
    return E.readout(event_assigned(spark, sf_dir), "y_scn")


@query
def bootstrap_ratio(spark, sf_dir):
    return R.bootstrap_ratio(event_assigned(spark, sf_dir), "unit", "arm", "y_adj")


def _changes(spark, sf_dir):
    return E.unit_duration_change(
        event_trips(spark, sf_dir), EVENT_SPEC, "origin", event_arms(spark, sf_dir), PRE1, POST)


@query
def did(spark, sf_dir):
    return E.did(_changes(spark, sf_dir))


@query
def bootstrap_did(spark, sf_dir):
    return R.bootstrap_unit_diff(_changes(spark, sf_dir), "unit", "arm", "change")


def _rate(spark, sf_dir):
    return E.rate_guardrail(
        event_trips(spark, sf_dir), EVENT_SPEC, "origin", event_arms(spark, sf_dir), POST)


@query
def rate_guardrail(spark, sf_dir):
    return _rate(spark, sf_dir)


@query
def guardrails(spark, sf_dir):
    return E.guardrails(E.did(_changes(spark, sf_dir)), _rate(spark, sf_dir))


def _decision(spark, sf_dir):
    assigned = event_assigned(spark, sf_dir)
    return E.decision_table(
        E.readout(assigned, "y_adj"), E.readout(assigned, "y_scn"),
        E.did(_changes(spark, sf_dir)), _rate(spark, sf_dir),
        E.power_summary(E.cuped_fit(event_panel(spark, sf_dir))))


@query
def decision_table(spark, sf_dir):
    return _decision(spark, sf_dir)


@query
def launch_decision(spark, sf_dir):
    return E.launch_decision(E.srm(event_arms(spark, sf_dir)), _decision(spark, sf_dir))


def _experiment(spark, sf_dir):
    """Folder with the record and the decision table of the experiment stage."""
    root = _fresh(spark, "experiment")
    plan = stages.ExperimentPlan(PRE1, PRE2, POST, min_n=POOL_MIN, iterations=200, gap_iterations=50)
    stages.experiment_stage(event_trips(spark, sf_dir), root, plan, EVENT_SPEC, unit="origin")
    return root


@query
def experiment_record(spark, sf_dir):
    doc = spark.read.json(f"{_experiment(spark, sf_dir)}/ab_tests.json")
    return doc.select(
        "data_scope.n_rides", "ab_design.srm.n_treat", "ab_design.srm.n_control",
        "data_scope.window_first", "data_scope.pool_min_starts")


@query
def experiment_decision_csv(spark, sf_dir):
    """The decision table as the experiment stage writes it, read back from CSV."""
    like = _decision(spark, sf_dir)
    return spark.read.schema(like.schema).option("header", True).csv(f"{_experiment(spark, sf_dir)}/ab_decision.csv")


# --- bounds of the approximate forms --------------------------------------------------------------

@query
def approx_medians_within(spark, sf_dir):
    """Whether the rank of sketched medians is off by a thousandth of the rows and one at most; null month: overall."""
    trips = stored_orders(spark, sf_dir)
    value, n = F.col(ORDER_SPEC.duration), F.count("*")
    # tables keep one decimal
    below, upto = F.count_if(value < F.col("p50_min") - 0.05), F.count_if(value <= F.col("p50_min") + 0.05)
    within = ((below <= 0.501 * n + 1) & (upto >= 0.499 * n - 1)).alias("within")
    medians = M.period_summary(trips, ORDER_SPEC, median="approx").select("month", "p50_min")
    by_month = trips.join(medians, "month").groupBy("month").agg(within)
    whole = M.kpi(trips, ORDER_SPEC, median="approx").select("p50_min").scalar()
    overall = trips.withColumn("p50_min", whole).agg(within).select(F.lit(None).cast("int").alias("month"), "within")
    return by_month.unionByName(overall)


@query
def approx_distinct_within(spark, sf_dir):
    """Whether the sketched count is within three relative standard deviations (0.05) of the exact one."""
    raw = raw_order_trips(spark, sf_dir)
    exact = cleaning.distinct_count(raw, ORDER_SPEC.trip_id).scalar()
    sketch = cleaning.distinct_count(raw, ORDER_SPEC.trip_id, True)
    return sketch.select((F.abs(F.col("n_distinct") / exact - 1) < 0.15).alias("within"))


@query
def sample_native_within(spark, sf_dir):
    """Sampled rows that are not rows of the two periods, and whether their number is within five deviations."""
    trips = stored_orders(spark, sf_dir)
    source = tables.of_periods(trips, ORDER_SPEC, [1, 7])
    n = source.agg(F.count("*")).scalar()
    picked = tables.sample_trips(trips, ORDER_SPEC, [1, 7], 0.1, 42).select("trip_key")
    inside = source.select(F.col("trip_key").alias("key"))
    counts = picked.join(inside, F.col("trip_key") == F.col("key"), "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("n_outside"))
    return counts.select(
        "n_outside", (F.abs(F.col("n") - 0.1 * n) <= 5 * F.sqrt(0.09 * n)).alias("size_within"))
