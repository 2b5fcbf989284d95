import math

import pytest
from pyspark.sql import functions as F

from tests.helpers import SPEC, one, rows, trips
from tripledger.operators import experiment as E
from tripledger.spec import DateWindow

JUN = DateWindow("pre1", "2025-06-01", "2025-06-10")
JUL = DateWindow("pre2", "2025-07-01", "2025-07-10")
AUG = DateWindow("post", "2025-08-01", "2025-08-10")


def day(date, origin, n=1, minutes=10, bike="electric_bike", destination="B"):
    return [(f"{date} 08:00:00", minutes, "member", bike, origin, destination)] * n


def panel(spark, values):
    return spark.createDataFrame(values, "unit string, y_pre1 double, y_pre2 double, y_post double")


def many_units(spark, n=60):
    """Stable units: the second and third window follow the first closely."""
    data = []
    for i in range(n):
        level = 5 + 0.7 * i
        data.append((f"u{i:03d}", level, 1.1 * level + (i * 7 % 5) / 5, 1.2 * level + (i * 11 % 7) / 7))
    return panel(spark, data)


def test_mean_over_days_with_trips(spark):
    df = trips(spark, day("2025-06-03", "A", 3))
    assert one(E.unit_daily_mean(df, SPEC, "start_station_id", JUN))["y"] == 3.0
    assert one(E.unit_daily_mean(df, SPEC, "start_station_id", JUN, calendar_days=True))["y"] == 0.3


def test_windows_include_both_ends(spark):
    df = trips(spark, day("2025-06-01", "A") + day("2025-06-10", "A") + day("2025-06-11", "A"))
    assert one(E.select_pool(df, SPEC, "start_station_id", JUN, 1))["n_selection"] == 2


def test_panel_needs_the_threshold_and_all_windows(spark):
    data = day("2025-06-02", "A", 4) + day("2025-07-02", "A", 2) + day("2025-08-02", "A", 6) \
        + day("2025-08-03", "A", 2) \
        + day("2025-06-02", "B", 2) + day("2025-07-02", "B") + day("2025-08-02", "B") \
        + day("2025-06-02", "C", 4) + day("2025-07-02", "C", 1) \
        + day("2025-06-02", None, 9)
    df = trips(spark, data)
    got = rows(E.build_panel(df, SPEC, "start_station_id", JUN, JUL, AUG, 4), "unit")
    assert got == {"A": {"unit": "A", "y_pre1": 4.0, "y_pre2": 2.0, "y_post": 4.0}}
    pools = [E.select_pool(df, SPEC, "start_station_id", w, 1) for w in (JUN, JUL, AUG)]
    assert {r["unit"] for r in E.common_units(pools).collect()} == {"A", "B"}


def test_panel_equals_the_step_by_step_way(spark):
    data = []
    for i, unit in enumerate("ABCDE"):
        for month in (6, 7, 8):
            for d in range(1, 9):
                data += day(f"2025-0{month}-{d:02d}", unit, (i * d + month) % 4)
    df = trips(spark, data)
    pool = E.select_pool(df, SPEC, "start_station_id", JUN, 8)
    want = None
    for name, w in (("y_pre1", JUN), ("y_pre2", JUL), ("y_post", AUG)):
        means = E.in_pool(E.unit_daily_mean(df, SPEC, "start_station_id", w), pool, "unit")
        means = means.withColumnRenamed("y", name)
        want = means if want is None else want.join(means, "unit")
    got = E.build_panel(df, SPEC, "start_station_id", JUN, JUL, AUG, 8)
    assert rows(got, "unit") == rows(want, "unit")


def test_cuped_centres_on_the_pool_and_shrinks_the_spread(spark):
    p = many_units(spark)
    fit = E.cuped_fit(p)
    f = one(fit)
    adj = E.cuped_apply(p, fit)
    stats = one(adj.agg(F.avg("y_adj").alias("a"), F.avg("y_post").alias("b"),
                        F.stddev_samp("y_adj").alias("s"), F.stddev_samp("y_post").alias("t")))
    assert stats["a"] == pytest.approx(stats["b"])
    assert stats["s"] < 0.5 * stats["t"]
    resid = p.select((F.col("y_pre2") - f["theta"] * (F.col("y_pre1") - f["mu0"])).alias("r"))
    assert f["resid_sd"] == pytest.approx(one(resid.agg(F.stddev_samp("r").alias("s")))["s"])


def test_power_formulas_on_published_statistics(spark):
    """Published pool statistics; the closed form is within 1e-4 of the published solver."""
    fit = spark.createDataFrame(
        [(391, 41.59981170137594, 33.57065887500566, 1.0600735008473747, 0.9938941935120601,
          3.9507382974617316)],
        "n_units long, mu0 double, sd0 double, theta double, rho double, resid_sd double")
    got = one(E.power_summary(fit, planned_max=180))
    assert got["n_per_arm"] == 180
    assert got["n_needed"] == pytest.approx(4090.115822367798, rel=1e-4)
    assert got["mde_pct"] == pytest.approx(0.2389562173367606, rel=1e-4)
    assert got["mde_abs_adj"] == pytest.approx(1.1698443905735718, rel=1e-4)
    curve = rows(E.mde_curve(fit), "n_per_arm")
    assert len(curve) == 79 and curve[180]["mde_pct"] == pytest.approx(got["mde_pct"])
    back = spark.range(1).select(E.units_needed(E.detectable_effect(F.lit(180.0))).alias("n"))
    assert one(back)["n"] == pytest.approx(180)


def test_aa_false_positive_rate_is_near_alpha(spark):
    p = many_units(spark)
    got = one(E.aa_calibration(E.cuped_apply(p, E.cuped_fit(p)), "y_adj", 600))
    assert got["aa_iterations"] == 600
    assert abs(got["aa_fp_rate"] - 0.05) <= 3 * math.sqrt(0.05 * 0.95 / 600)
    assert 0.4 < got["aa_p_median"] < 0.6
    sizes = one(E.aa_splits(p, "y_pre1", 1, p=False))
    assert (sizes["n_a"], sizes["n_b"]) == (30, 30)


def test_odd_pool_leaves_one_unit_out_everywhere(spark):
    p = many_units(spark, 5)
    arms = E.block_randomise(p)
    got = rows(arms, "unit")
    assert len(got) == 4 and "u004" not in got
    assert sorted((r["pair"], r["arm"]) for r in got.values()) == [
        (1, "control"), (1, "treat"), (2, "control"), (2, "treat")]
    assert one(E.srm(arms))["srm_p"] == 1.0
    assert E.attach_arm(p, arms).count() == 4


def test_blocking_beats_complete_randomisation(spark):
    p = many_units(spark)
    arms = E.block_randomise(p)
    gap = one(E.baseline_gap(p, arms))["blocked_base_gap"]
    pure = one(E.randomisation_gap(p, "y_pre1"))
    assert abs(gap) < 0.2 * pure["pure_random_sd"]
    assert pure["pure_random_max"] > pure["pure_random_sd"]
    assert rows(arms, "unit") == rows(E.block_randomise(p.repartition(6)), "unit")


def test_srm_detects_a_bad_split(spark):
    arms = spark.createDataFrame([("treat",)] * 140 + [("control",)] * 60, "arm string")
    got = one(E.srm(arms))
    assert got["srm_chi2"] == pytest.approx(32.0) and not got["srm_ok"]
    assert one(E.srm(arms, ratio=0.7))["srm_ok"]


def test_scenario_moves_the_treated_arm_only_and_is_detected(spark):
    p = many_units(spark)
    arms, fit = E.block_randomise(p), E.cuped_fit(p)
    s = E.scenario_panel(p, arms, fit, uplift=0.1)
    joined = s.join(p.select("unit", F.col("y_post").alias("before")), "unit")
    for r in joined.collect():
        assert r["y_scn"] == pytest.approx(r["before"] * (1.1 if r["arm"] == "treat" else 1))
    adjusted, raw = one(E.readout(s, "y_adj")), one(E.readout(s, "y_scn"))
    assert adjusted["p"] < 0.05 < raw["p"]
    assert adjusted["lift"] == pytest.approx(0.1, abs=0.05)


def test_did_drops_units_without_both_windows(spark):
    data = day("2025-06-02", "A", 2, 10) + day("2025-08-02", "A", 1, 20) \
        + day("2025-06-02", "B", 1, 10) + day("2025-08-02", "B", 1, 12) \
        + day("2025-06-02", "C", 1, 10) + day("2025-06-02", "D", 1, 10) + day("2025-08-02", "D", 1, 10)
    arms = spark.createDataFrame(
        [("A", 1, "treat"), ("B", 1, "control"), ("C", 2, "treat"), ("D", 2, "control")],
        "unit string, pair int, arm string")
    ch = E.unit_duration_change(trips(spark, data), SPEC, "start_station_id", arms, JUN, AUG, factor=0.5)
    assert {k: v["change"] for k, v in rows(ch, "unit").items()} == {"A": 0.0, "B": 2.0, "D": 0.0}
    assert one(E.did(ch))["did"] == -1.0


def test_rate_guardrail_counts_electric_trips_of_assigned_units(spark):
    data = day("2025-08-02", "A", 30, destination=None) + day("2025-08-02", "A", 70) \
        + day("2025-08-02", "B", 20, destination=None) + day("2025-08-02", "B", 80) \
        + day("2025-08-02", "A", 50, bike="classic_bike", destination=None) \
        + day("2025-08-02", "unassigned", 50, destination=None) + day("2025-06-02", "B", 40)
    arms = spark.createDataFrame([("A", 1, "treat"), ("B", 1, "control")], "unit string, pair int, arm string")
    got = one(E.rate_guardrail(trips(spark, data), SPEC, "start_station_id", arms, AUG))
    assert (got["rate_treat"], got["rate_control"]) == (0.3, 0.2)
    assert got["chi2"] == pytest.approx(200 * (abs(30 * 80 - 70 * 20) - 100) ** 2 / (100 * 100 * 50 * 150))


@pytest.mark.parametrize("did, treat, control, p, want", [
    (0.5, 0.30, 0.29, 0.001, (True, True)), (-0.51, 0.1049, 0.1, 0.001, (False, True)),
    (0.0, 0.12, 0.1, 0.2, (True, True)), (0.0, 0.12, 0.1, 0.01, (True, False)),
    (0.0, 0.05, 0.1, 0.001, (True, True)),
])
def test_guardrail_limits(spark, did, treat, control, p, want):
    d = spark.createDataFrame([(did, 0.5)], "did double, p double")
    r = spark.createDataFrame([(treat, control, p)], "rate_treat double, rate_control double, p double")
    got = one(E.guardrails(d, r))
    assert (got["duration_pass"], got["rate_pass"]) == want


def test_decision_table_on_published_figures(spark):
    """Published readout figures."""
    columns = "mean_a double, mean_b double, p double, lift double"
    primary = spark.createDataFrame([(46.4, 44.8, 0.0027028926532997825, 0.03550684969670659)], columns)
    raw = spark.createDataFrame([(46.3, 44.8, 0.6613092845434293, 0.03411887824409132)], columns)
    did = spark.createDataFrame(
        [(-0.65, -0.19, 0.006553223032522965, -0.4624173311809385)],
        "mean_a double, mean_b double, p double, did double")
    rate = spark.createDataFrame(
        [(0.2914101563629007, 0.2900557812822808, 0.42963314611980463)],
        "rate_treat double, rate_control double, p double")
    power = spark.createDataFrame([(0.028121386677692064,)], "mde_pct_adj double")
    table = E.decision_table(primary, raw, did, rate, power)
    got = rows(table, "ord")
    assert [got[i]["verdict"] for i in (1, 3, 4)] == ["pass"] * 3
    assert got[1]["treatment"] == pytest.approx(44.8 * 1.03550684969670659)
    assert got[4]["change"] == pytest.approx(0.00467, abs=1e-5)
    srm = spark.createDataFrame([(True,)], "srm_ok boolean")
    assert one(E.launch_decision(srm, table))["launch"]
    assert not one(E.launch_decision(srm.select(F.lit(False).alias("srm_ok")), table))["launch"]
    worse = rows(E.decision_table(primary, raw, did.withColumn("did", F.lit(-0.6)), rate, power), "ord")
    assert worse[3]["verdict"] == "violated"


def test_planned_size_has_no_maximum_of_its_own(spark):
    sizes = spark.createDataFrame([(11,), (12,), (500,), (1001,)], "n int").select(
        E.arm_size(F.col("n")).alias("free"), E.arm_size(F.col("n"), 180).alias("most")).collect()
    assert [tuple(r) for r in sizes] == [(None, None), (1, 1), (245, 180), (495, 180)]


def test_gap_of_many_units_uses_them_all(spark):
    """With 500 units the arms have 245 each: the spread is that of means of 245, not of 180."""
    df = panel(spark, [(f"u{i}", float(i % 50), 1.0, 1.0) for i in range(500)])
    got = one(E.randomisation_gap(df, "y_pre1", iterations=400))["pure_random_sd"]
    sd = math.sqrt((50 ** 2 - 1) / 12)
    assert abs(got / (sd * math.sqrt(2 / 245 * (1 - 0.0)) ) - 1) < 0.12
