"""The three batch stages: raw to clean, clean to metrics, clean to experiment results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.operators import cleaning, experiment as E, metrics as M
from tripledger.operators import resampling as R
from tripledger.operators import statistics as S
from tripledger.sources import landing, tables
from tripledger.spec import CleanRules, DateWindow, TripSpec

METRIC_TABLES = ("kpi", "cube", "monthly", "daily", "dur_hist", "stations", "od")


# --- clean ------------------------------------------------------------------------------

def clean_stage(
    spark: SparkSession, raw_root: str, out: str, year: int, spec: TripSpec = TripSpec(),
    rules: CleanRules = CleanRules(),
) -> DataFrame:
    """One year of landed CSV to partitioned Parquet, plus the quality record beside it.

    Only the year's partitions are read and replaced; other years of the output stay. One pass over the raw
    files: the audit is observed while the rows are written. Where it does not agree with the rows written, because a lost task was
    counted twice, or has nothing to say, because the year has no files, it is taken by a pass of its own.
    """
    raw = landing.read_trips_csv(spark, raw_root).where(F.col(spec.year) == year)
    seen = Observation("audit")
    written = tables.write_trips(
        cleaning.clean_audited(raw, spec, seen, rules), out, [spec.year, spec.period], replace_touched_only=True, count=True)
    counts = seen.get
    if counts.get("n_clean") == written:
        audit = spark.range(1).select(*[F.lit(n).cast("bigint").alias(c) for c, n in counts.items()])
    else:
        audit = cleaning.quality_audit(raw, spec, rules)
    report = cleaning.quality_report(audit, year, rules)
    tables.write_record(report, f"{out}/_quality.json")
    return spark.read.json(f"{out}/_quality.json")


# --- metrics -----------------------------------------------------------------------------

def metric_stage(
    trips: DataFrame, root: str, spec: TripSpec = TripSpec(),
    min_n: int = 100, top: int = 1000, formats: Sequence[str] = ("json", "csv"),
) -> None:
    """All seven metric tables from four scans of the trips.

    The first two store reductions whose size does not follow the number of trips:
    facts at calendar grain, which give the counts of five tables, and trips per
    period and duration, which give all medians. Stations and flows take a scan each.
    """
    spark = trips.sparkSession

    def reduced(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    facts = reduced("_facts", M.compact_facts(M.trip_facts(trips, spec)))
    counts = reduced("_minute_counts", M.minute_counts(trips, spec))

    def store(name: str, df: DataFrame, *order) -> None:
        tables.write_metric(df, root, name, formats, order)

    store("cube", M.fact_cube(facts, spec), "month", "dow", "hour", "member", "bike")
    store("monthly", M.period_summary(trips, spec, facts=facts, counts=counts), "month")
    store("daily", M.daily_summary(facts, spec), "date")
    store("dur_hist", M.duration_hist(facts, spec), "member", "bike", "bucket_ord", "month")
    store("stations", M.station_profile(trips, spec), F.desc("starts"), "station_id")
    stations = tables.read_metric(spark, root, "stations")
    store("od", M.od_flows(trips, spec, stations, min_n, top), F.desc("n"), "start_id", "end_id")
    store("kpi", M.kpi(trips, spec, facts=facts, counts=counts, stations=stations))


def read_metrics(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: tables.read_metric(spark, root, name) for name in METRIC_TABLES}


# --- experiment ----------------------------------------------------------------------------

@dataclass(frozen=True)
class ExperimentPlan:
    """Windows, thresholds and resampling sizes of one experiment."""

    pre1: DateWindow
    pre2: DateWindow
    post: DateWindow
    min_n: int = 300
    alpha: float = E.ALPHA
    power: float = E.POWER
    seed: int = E.SEED
    iterations: int = 2000
    gap_iterations: int = 200
    subsample: int | None = None
    planned_max: int | None = None
    max_did: float = 0.5
    max_worse: float = 0.05


def test_results(trips: DataFrame, spec: TripSpec, plan: ExperimentPlan) -> dict[str, DataFrame]:
    """The three observational tests, one row each."""
    m, c = spec.member, spec.casual
    weekend = trips.select(C.is_weekend(F.col(spec.dow)).alias("weekend"), spec.hour)
    return {
        "rider_duration": S.welch_t(trips, spec.duration, spec.rider, m, c, alpha=plan.alpha),
        "rider_duration_rank": S.mann_whitney(trips, spec.duration, spec.rider, m, c),
        "rider_duration_bootstrap": R.bootstrap_diff(
            trips, spec.duration, spec.trip_id, spec.rider, m, c,
            plan.subsample, plan.iterations, plan.seed, plan.alpha),
        "daytype_hour": S.chi2_independence(weekend, "weekend", spec.hour),
        "vehicle_confound": S.stratified_diff(
            trips, spec.duration, spec.vehicle, spec.rider, spec.electric, spec.classic, (m, c)),
    }


def experiment_results(
    panel: DataFrame, arms: DataFrame, changes: DataFrame, rate: DataFrame, plan: ExperimentPlan,
) -> dict[str, DataFrame]:
    """Design checks and readout over stored unit tables; the trips are not read here."""
    fit = E.cuped_fit(panel)
    power = E.power_summary(
        fit, alpha=plan.alpha, power=plan.power, planned_max=plan.planned_max)
    assigned = E.scenario_panel(panel, arms, fit)
    primary, unadjusted = E.readout(assigned, "y_adj"), E.readout(assigned, "y_scn")
    did = E.did(changes)
    srm = E.srm(arms, alpha=plan.alpha)
    adjusted = E.cuped_apply(panel, fit)
    decision = E.decision_table(
        primary, unadjusted, did, rate, power, plan.max_did, plan.max_worse, plan.alpha)
    return {
        "panel": E.panel_summary(panel),
        "power": power,
        "aa": E.aa_calibration(adjusted, "y_adj", plan.iterations, plan.alpha, plan.seed),
        "srm": srm,
        "randomisation_gap": E.randomisation_gap(
            panel, "y_pre1", iterations=plan.gap_iterations, seed=plan.seed,
            planned_max=plan.planned_max),
        "baseline_gap": E.baseline_gap(panel, arms),
        "primary": primary,
        "primary_bootstrap": R.bootstrap_ratio(
            assigned, "unit", "arm", "y_adj", plan.iterations, plan.seed, plan.alpha),
        "unadjusted": unadjusted,
        "did": did,
        "did_bootstrap": R.bootstrap_unit_diff(
            changes, "unit", "arm", "change", plan.iterations, plan.seed, plan.alpha),
        "off_rate": rate,
        "guardrails": E.guardrails(did, rate, plan.max_did, plan.max_worse, plan.alpha),
        "launch": E.launch_decision(srm, decision),
        "decision": decision,
    }


def experiment_stage(
    trips: DataFrame, root: str, plan: ExperimentPlan, spec: TripSpec = TripSpec(),
    unit: str | None = None,
) -> None:
    """Run tests and experiment; write one nested record and the decision table.

    Panel, arms and guardrail inputs are stored first, one scan of the trips each:
    all later steps read these small tables, and a lost executor never makes them
    differ between steps.
    """
    unit = unit or spec.origin
    spark = trips.sparkSession

    def stored(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    panel = stored("_panel", E.build_panel(
        trips, spec, unit, plan.pre1, plan.pre2, plan.post, plan.min_n))
    arms = stored("_arms", E.block_randomise(panel, seed=plan.seed))
    changes = stored("_changes", E.unit_duration_change(
        trips, spec, unit, arms, plan.pre1, plan.post))
    rate = stored("_rate", E.rate_guardrail(trips, spec, unit, arms, plan.post))

    results = experiment_results(panel, arms, changes, rate, plan)
    decision = results.pop("decision")

    def nest(frames: dict[str, DataFrame]):
        return F.struct(*[
            f.select(F.struct(*f.columns)).scalar().alias(name) for name, f in frames.items()])

    record = trips.agg(F.count("*").alias("n_rides")).select(
        F.current_timestamp().alias("generated_at"),
        F.struct(
            "n_rides", F.lit(plan.post.first).alias("window_first"),
            F.lit(plan.post.last).alias("window_last"), F.lit(plan.min_n).alias("pool_min_starts"),
        ).alias("data_scope"),
        F.struct(
            F.lit(plan.alpha).alias("alpha"), F.lit(plan.power).alias("power"),
            F.lit(plan.seed).alias("seed"),
        ).alias("config"),
        nest(test_results(trips, spec, plan)).alias("tests"),
        nest(results).alias("ab_design"),
    )
    tables.write_record(record, f"{root}/ab_tests.json")
    tables.write_table_csv(decision, f"{root}/ab_decision.csv", "ord")
