"""Experiment design and readout over units such as stations.

Trips are reduced to one row per unit and day, or per unit, before anything is
joined; pools, arms and metrics then meet on unit keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.functions import exact as X
from tripledger.functions import hashing as H
from tripledger.functions.tails import chi2_pvalue, normal_quantile, t_pvalue
from tripledger.operators import resampling as R
from tripledger.operators.ranking import row_numbers
from tripledger.operators.statistics import (
    ALPHA, chi2_two_by_two, welch_t,
)
from tripledger.spec import DateWindow, TripSpec

POWER = 0.80
SEED = 20250801
SCENARIO_MARGIN = 1.25
DURATION_FACTOR = 0.98


# --- pool and panel --------------------------------------------------------------------

def _unit_days(trips: DataFrame, spec: TripSpec, unit: str, windows: Sequence[DateWindow]) -> DataFrame:
    """Trips per unit and date inside the span of the windows."""
    first, last = min(w.first for w in windows), max(w.last for w in windows)
    return (
        trips.where(F.col(unit).isNotNull())
        .where(C.in_window(F.col(spec.date), DateWindow("span", first, last)))
        .groupBy(F.col(unit).alias("unit"), F.col(spec.date).alias("date"))
        .agg(F.count("*").alias("n"))
    )


def select_pool(
    trips: DataFrame, spec: TripSpec, unit: str, window: DateWindow, min_n: int = 300,
) -> DataFrame:
    """Units with enough trips in the selection window."""
    return (
        trips.where(F.col(unit).isNotNull() & C.in_window(F.col(spec.date), window))
        .groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n_selection"))
        .where(F.col("n_selection") >= min_n)
    )


def in_pool(df: DataFrame, pool: DataFrame, unit: str) -> DataFrame:
    """Rows whose unit is in the pool. Apply to reduced rows rather than trips."""
    keys = pool.select(F.col("unit").alias("_pool_unit"))
    return df.join(keys, F.col(unit) == F.col("_pool_unit"), "left_semi")


def unit_daily_mean(
    trips: DataFrame, spec: TripSpec, unit: str, window: DateWindow, calendar_days: bool = False,
) -> DataFrame:
    """Mean trips per day of a unit, over days with trips (or over all days)."""
    days = _unit_days(trips, spec, unit, [window])
    span = F.datediff(F.lit(window.last), F.lit(window.first)) + 1
    return days.groupBy("unit").agg(
        (F.sum("n") / (span if calendar_days else F.count("*"))).alias("y"))


def common_units(panels: Sequence[DataFrame], key: str = "unit") -> DataFrame:
    """Unit ids present in every frame."""
    out = panels[0].select(key)
    for other in panels[1:]:
        out = out.intersect(other.select(key))
    return out


def build_panel(
    trips: DataFrame, spec: TripSpec, unit: str, pre1: DateWindow, pre2: DateWindow,
    post: DateWindow, min_n: int = 300, selection: DateWindow | None = None,
) -> DataFrame:
    """unit, y_pre1, y_pre2, y_post for pool units active in all three windows.

    One scan: counts per unit and day feed the pool threshold and all windows.
    """
    selection = selection or pre1
    days = _unit_days(trips, spec, unit, [pre1, pre2, post, selection])
    date, n = F.col("date"), F.col("n")

    def mean_in(w: DateWindow) -> Column:
        inside = C.in_window(date, w)
        return F.try_divide(F.sum(F.when(inside, n)), F.count_if(inside))

    return (
        days.groupBy("unit").agg(
            F.sum(F.when(C.in_window(date, selection), n)).alias("n_selection"),
            mean_in(pre1).alias("y_pre1"), mean_in(pre2).alias("y_pre2"),
            mean_in(post).alias("y_post"))
        .where(F.col("n_selection") >= min_n)
        .dropna(subset=["y_pre1", "y_pre2", "y_post"])
        .select("unit", "y_pre1", "y_pre2", "y_post")
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count("*").alias("pool_size"),
        F.avg("y_post").alias("mean_post"), F.stddev_samp("y_post").alias("sd_post"),
        F.avg("y_pre1").alias("mean_pre"), F.stddev_samp("y_pre1").alias("sd_pre"))


# --- variance reduction and power ----------------------------------------------------------

def cuped_fit(panel: DataFrame) -> DataFrame:
    """One row: slope of the second pre-window on the first, correlation, pool mean, residual sd."""
    fit = panel.agg(
        F.count("*").alias("n_units"),
        F.avg("y_pre1").alias("mu0"), F.stddev_samp("y_pre1").alias("sd0"),
        F.regr_slope("y_pre2", "y_pre1").alias("theta"), F.corr("y_pre2", "y_pre1").alias("rho"),
        F.stddev_samp("y_pre2").alias("sd_pre2"),
    )
    return fit.select(
        "n_units", "mu0", "sd0", "theta", "rho",
        (F.col("sd_pre2") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("rho") * F.col("rho"))))
        .alias("resid_sd"))


def cuped_apply(
    panel: DataFrame, fit: DataFrame, metric: str = "y_post", covariate: str = "y_pre1",
    out: str = "y_adj",
) -> DataFrame:
    """``metric - theta * (covariate - pool mean)``; centring per arm would keep the imbalance."""
    packed = fit.select(F.struct("theta", "mu0")).scalar()
    return panel.withColumn("_fit", packed).withColumn(
        out, F.col(metric) - F.col("_fit.theta") * (F.col(covariate) - F.col("_fit.mu0"))
    ).drop("_fit")


def arm_size(n_units: Column, planned_max: int | None = None) -> Column:
    """Half the units less five, at most ``planned_max``; null below twelve units."""
    half = F.floor(F.when(n_units >= 12, n_units) / 2) - 5
    size = half if planned_max is None else F.when(half > planned_max, planned_max).otherwise(half)
    return size.cast("bigint")


def _z_sum(alpha: float, power: float) -> tuple[float, float]:
    za = normal_quantile(1 - alpha / 2)
    return za, za + normal_quantile(power)


def units_needed(effect: Column, alpha: float = ALPHA, power: float = POWER) -> Column:
    """Units per arm to detect a standardised effect."""
    za, zs = _z_sum(alpha, power)
    return 2 * zs * zs / (effect * effect) + za * za / 4


def detectable_effect(n: Column, alpha: float = ALPHA, power: float = POWER) -> Column:
    """Standardised effect detectable with n units per arm, the inverse of :func:`units_needed`."""
    za, zs = _z_sum(alpha, power)
    room = n - za * za / 4
    return F.lit(zs) * F.sqrt(2 / F.when(room > 0, room))


def power_summary(
    fit: DataFrame, lift: float = 0.05, alpha: float = ALPHA, power: float = POWER,
    planned_max: int | None = None,
) -> DataFrame:
    """Units needed for a lift, planned arm size, detectable effects raw and adjusted."""
    n = F.col("n_per_arm")
    return fit.withColumn("n_per_arm", arm_size(F.col("n_units"), planned_max)).select(
        "mu0", "sd0",
        units_needed(lift * F.col("mu0") / F.col("sd0"), alpha, power).alias("n_needed"),
        "n_per_arm",
        (detectable_effect(n, alpha, power) * F.col("sd0")).alias("mde_abs"),
        (detectable_effect(n, alpha, power) * F.col("sd0") / F.col("mu0")).alias("mde_pct"),
        "theta", "rho", "resid_sd",
        (detectable_effect(n, alpha, power) * F.col("resid_sd")).alias("mde_abs_adj"),
        (detectable_effect(n, alpha, power) * F.col("resid_sd") / F.col("mu0")).alias("mde_pct_adj"))


def mde_curve(
    fit: DataFrame, first: int = 20, last: int = 800, step: int = 10,
    alpha: float = ALPHA, power: float = POWER,
) -> DataFrame:
    """Detectable relative effect by units per arm."""
    grid = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))).alias("n_per_arm")
    effect = detectable_effect(F.col("n_per_arm"), alpha, power)
    return fit.select("mu0", "sd0", grid).select(
        "n_per_arm", (effect * F.col("sd0") / F.col("mu0")).alias("mde_pct"))


# --- randomisation ----------------------------------------------------------------------------

def aa_splits(
    panel: DataFrame, metric: str, iterations: int = 2000, seed: int = SEED, p: bool = True,
) -> DataFrame:
    """Welch test per random half split (floor(n/2) units against the rest)."""
    parts = R.split_at(
        panel.select("unit", metric), "unit", iterations, seed, [lambda total: F.floor(total / 2)])
    halves = parts.withColumn("half", F.when(F.col("part") == 0, "a").otherwise("b"))
    return welch_t(halves, metric, "half", "a", "b", ["iteration"], p=p)


def aa_calibration(
    panel: DataFrame, metric: str, iterations: int = 2000, alpha: float = ALPHA, seed: int = SEED,
) -> DataFrame:
    """Share of false positives and median p over the splits."""
    return aa_splits(panel, metric, iterations, seed).agg(
        F.count("*").alias("aa_iterations"),
        F.avg((F.col("p") < alpha).cast("double")).alias("aa_fp_rate"),
        F.percentile("p", 0.5).alias("aa_p_median"))


def randomisation_gap(
    panel: DataFrame, metric: str, n_arm: int | None = None, iterations: int = 200,
    seed: int = SEED, planned_max: int | None = None,
) -> DataFrame:
    """Baseline gap between two completely randomised arms: its spread and worst case."""
    def size(total: Column) -> Column:
        return arm_size(total, planned_max) if n_arm is None else F.lit(n_arm)

    parts = R.split_at(panel.select("unit", metric), "unit", iterations, seed, [size, lambda total: 2 * size(total)], "gap")
    gaps = parts.groupBy("iteration").agg((
        F.avg(F.when(F.col("part") == 0, F.col(metric))) - F.avg(F.when(F.col("part") == 1, F.col(metric)))).alias("gap"))
    return gaps.agg(
        F.stddev_pop("gap").alias("pure_random_sd"), F.max(F.abs("gap")).alias("pure_random_max"))


def pair_neighbours(panel: DataFrame, level: str, unit: str = "unit") -> DataFrame:
    """Units ordered by level and paired with their neighbour; an odd last unit is left out."""
    ordered = row_numbers(panel.select(unit, level), [level, unit])
    return (
        ordered.withColumn("pair", F.ceil(F.col("rn") / 2))
        .where(F.col("pair") * 2 <= F.col("total"))
        .select(unit, level, "pair", (F.col("rn") % 2 == 1).alias("is_lower"))
    )


def block_randomise(
    panel: DataFrame, level: str = "y_pre1", unit: str = "unit", seed: int = SEED,
) -> DataFrame:
    """One treated and one control unit per pair, by a coin per pair."""
    coin = H.digest_coin(H.digest(seed, F.col("pair"), purpose="coin"))
    lower_treated = coin == 0
    return pair_neighbours(panel, level, unit).select(
        unit, "pair",
        F.when(F.col("is_lower") == lower_treated, "treat").otherwise("control").alias("arm"))


def srm(arms: DataFrame, ratio: float = 0.5, alpha: float = ALPHA, p: bool = True) -> DataFrame:
    """Arm sizes against the design ratio, chi-square with one degree of freedom."""
    counts = arms.agg(
        F.count_if(F.col("arm") == "treat").alias("n_treat"),
        F.count_if(F.col("arm") == "control").alias("n_control"))
    n = F.col("n_treat") + F.col("n_control")
    et, ec = n * ratio, n * (1 - ratio)
    out = counts.withColumn("srm_chi2", F.try_divide(
        F.pow(F.col("n_treat") - et, 2), et) + F.try_divide(F.pow(F.col("n_control") - ec, 2), ec))
    if p:
        out = out.withColumn("srm_p", chi2_pvalue(F.col("srm_chi2"), F.lit(1.0))).withColumn(
            "srm_ok", F.col("srm_p") > alpha)
    return out


def attach_arm(metrics: DataFrame, arms: DataFrame, unit: str = "unit") -> DataFrame:
    """Metrics of assigned units; a unit without a metric drops out of the test."""
    return arms.join(metrics, unit)


def baseline_gap(panel: DataFrame, arms: DataFrame, level: str = "y_pre1") -> DataFrame:
    def mean(arm: str) -> Column:
        return F.avg(F.when(F.col("arm") == arm, F.col(level)))
    return attach_arm(panel, arms).agg((mean("treat") - mean("control")).alias("blocked_base_gap"))


# --- readout --------------------------------------------------------------------------------------

def scenario_panel(
    panel: DataFrame, arms: DataFrame, fit: DataFrame, uplift: float | None = None,
) -> DataFrame:
    """Panel with arms, a what-if projection of the treated arm, and the adjusted metric.

    Without ``uplift`` the projection is the adjusted detectable effect times a margin.
    """
    if uplift is None:
        factor = power_summary(fit).select(1 + SCENARIO_MARGIN * F.col("mde_pct_adj")).scalar()
    else:
        factor = F.lit(1.0 + uplift)
    projected = attach_arm(panel, arms).withColumn("_factor", factor).withColumn(
        "y_scn", C.apply_scenario(F.col("y_post"), F.col("arm"), F.col("_factor"))).drop("_factor")
    return cuped_apply(projected, fit, "y_scn")


def readout(assigned: DataFrame, metric: str, p: bool = True) -> DataFrame:
    """Welch test of treat against control and the relative lift of arm means."""
    return welch_t(assigned, metric, "arm", "treat", "control", p=p).withColumn(
        "lift", F.try_divide(F.col("mean_a"), F.col("mean_b")) - 1)


def unit_duration_change(
    trips: DataFrame, spec: TripSpec, unit: str, arms: DataFrame, pre: DateWindow, post: DateWindow,
    factor: float = DURATION_FACTOR,
) -> DataFrame:
    """Change of mean minutes per assigned unit, with the projection on the treated arm."""
    minutes, date = F.col(spec.duration), F.col(spec.date)

    def mean_in(w: DateWindow) -> Column:
        return X.exact_mean(F.when(C.in_window(date, w), minutes))

    units = (
        trips.where(F.col(unit).isNotNull())
        .where(C.in_window(date, pre) | C.in_window(date, post))
        .groupBy(F.col(unit).alias("unit"))
        .agg(mean_in(pre).alias("pre"), mean_in(post).alias("post"))
    )
    after = C.apply_scenario(F.col("post"), F.col("arm"), factor)
    return attach_arm(units, arms).select("unit", "arm", (after - F.col("pre")).alias("change")) \
        .where(F.col("change").isNotNull())


def did(changes: DataFrame, p: bool = True) -> DataFrame:
    """Difference in differences with its Welch test."""
    return welch_t(changes, "change", "arm", "treat", "control", p=p).withColumnRenamed("diff", "did")


def rate_guardrail(
    trips: DataFrame, spec: TripSpec, unit: str, arms: DataFrame, window: DateWindow,
    p: bool = True,
) -> DataFrame:
    """Off-station rate by arm among electric trips, with the 2×2 chi-square."""
    by_unit = (
        trips.where(F.col(unit).isNotNull() & C.in_window(F.col(spec.date), window))
        .where(F.col(spec.vehicle) == spec.electric)
        .groupBy(F.col(unit).alias("unit"))
        .agg(F.count("*").alias("n_all"), F.count_if(C.offstation(spec)).alias("n_event"))
    )
    def total(arm: str, column: str) -> Column:
        return F.sum(F.when(F.col("arm") == arm, F.col(column))).cast("double")

    sums = attach_arm(by_unit, arms).agg(
        *[total(arm, c).alias(f"{c}_{arm}") for arm in ("treat", "control")
          for c in ("n_all", "n_event")])
    nt, nc = F.col("n_all_treat"), F.col("n_all_control")
    et, ec = F.col("n_event_treat"), F.col("n_event_control")
    out = sums.select(
        F.try_divide(et, nt).alias("rate_treat"), F.try_divide(ec, nc).alias("rate_control"),
        chi2_two_by_two(et, nt - et, ec, nc - ec).alias("chi2"), F.lit(1).alias("dof"))
    return out.withColumn("p", chi2_pvalue(F.col("chi2"), F.lit(1.0))) if p else out


def guardrails(
    did_row: DataFrame, rate_row: DataFrame, max_did: float = 0.5, max_worse: float = 0.05,
    alpha: float = ALPHA,
) -> DataFrame:
    """Both guardrail verdicts: bounded change of duration; rate not clearly worse."""
    rate = rate_row.select(F.struct("rate_treat", "rate_control", "p")).scalar()
    worse = F.col("_r.rate_treat") / F.col("_r.rate_control") - 1
    return did_row.withColumn("_r", rate).select(
        "did", F.col("p").alias("did_p"),
        F.col("_r.rate_treat").alias("rate_treat"), F.col("_r.rate_control").alias("rate_control"),
        F.col("_r.p").alias("rate_p"),
        (F.abs("did") <= max_did).alias("duration_pass"),
        ((F.col("_r.p") > alpha) | (F.col("_r.rate_treat") <= F.col("_r.rate_control"))
         | (F.abs(worse) <= max_worse)).alias("rate_pass"))


def decision_table(
    primary: DataFrame, unadjusted: DataFrame, did_row: DataFrame, rate_row: DataFrame,
    power: DataFrame, max_did: float = 0.5, max_worse: float = 0.05, alpha: float = ALPHA,
) -> DataFrame:
    """Four rows: primary metric, unadjusted reference and the two guardrails.

    The treated value of the primary row is the control mean times (1 + lift).
    """
    control = unadjusted.select("mean_b").scalar()
    mde = power.select("mde_pct_adj").scalar()

    def verdict(ok: Column, bad: str) -> Column:
        return F.when(ok, "pass").otherwise(bad)

    lift = F.col("lift")
    rows = [
        primary.withColumns({"_c": control, "_m": mde}).select(
            F.lit(1).alias("ord"), F.lit("primary: daily starts per unit, adjusted").alias("metric"),
            F.col("_c").alias("control"), (F.col("_c") * (1 + lift)).alias("treatment"),
            lift.alias("change"), "p",
            F.concat(F.lit("positive, design effect "), F.round(100 * F.col("_m"), 1).cast("string"),
                     F.lit("%")).alias("threshold"),
            verdict((F.col("p") < alpha) & (lift > 0), "fail").alias("verdict")),
        unadjusted.select(
            F.lit(2).alias("ord"), F.lit("reference: unadjusted").alias("metric"),
            F.col("mean_b").alias("control"), F.col("mean_a").alias("treatment"),
            lift.alias("change"), "p", F.lit("none").alias("threshold"),
            F.lit("not used for the decision").alias("verdict")),
        did_row.select(
            F.lit(3).alias("ord"), F.lit("guardrail: mean minutes, change before to after").alias("metric"),
            F.col("mean_b").alias("control"), F.col("mean_a").alias("treatment"),
            F.col("did").alias("change"), "p",
            F.lit(f"absolute difference at most {max_did:g} minutes").alias("threshold"),
            verdict(F.abs("did") <= max_did, "violated").alias("verdict")),
        rate_row.select(
            F.lit(4).alias("ord"), F.lit("guardrail: electric off-station rate").alias("metric"),
            F.col("rate_control").alias("control"), F.col("rate_treat").alias("treatment"),
            (F.col("rate_treat") / F.col("rate_control") - 1).alias("change"), "p",
            F.lit(f"at most {100 * max_worse:g}% worse").alias("threshold"),
            verdict(
                (F.col("p") > alpha) | (F.col("rate_treat") <= F.col("rate_control"))
                | (F.abs(F.col("rate_treat") / F.col("rate_control") - 1) <= max_worse),
                "violated").alias("verdict")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def launch_decision(srm_row: DataFrame, decision: DataFrame) -> DataFrame:
    """Launch when arms match the design, the primary metric passes and no guardrail is violated."""
    ok = srm_row.select("srm_ok").scalar()
    return decision.agg(
        F.bool_and(F.when(F.col("ord") != 2, F.col("verdict") == "pass")).alias("_pass")
    ).withColumn("_srm", ok).select((F.col("_pass") & F.col("_srm")).alias("launch"))
