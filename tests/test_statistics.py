import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import one, rows
from tripledger.functions import columns as C
from tripledger.functions import hashing as H
from tripledger.functions import tails
from tripledger.operators import resampling as R
from tripledger.operators import statistics as S
from tripledger.operators.selection import rank_parts

# Published sufficient statistics and results of the yearly analysis.
PUBLISHED = {
    "n_a": 3552569, "n_b": 1994811, "mean_a": 11.952487383074054, "mean_b": 19.133347770791318,
    "t": -242.2995905396965, "d": -0.2520419089887307,
    "ci": (-7.238946444349003, -7.122774331085524), "chi2": 305833.4646948993, "v": 0.2348002441486553,
    "n": 5547380,
}


def frame(spark, a, b):
    return spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b],
                                 "g string, v double")


def java_tails(spark):
    return spark._jvm.org.apache.commons.math3.distribution


def test_tail_probabilities_against_the_jvm_library(spark):
    dist = java_tails(spark)
    for t in (0.0, 0.3, 1.96, 4.2, 12.0):
        for df in (1.0, 2.5, 30.0, 4000.0):
            want = 2 * dist.TDistribution(df).cumulativeProbability(-t)
            assert tails.t_two_sided([t], [df])[0] == pytest.approx(want, rel=1e-8, abs=1e-12)
    for x in (0.0, 0.2, 3.84, 20.5, 60.0):
        for dof in (1.0, 2.0, 23.0, 200.0):
            want = 1 - dist.ChiSquaredDistribution(dof).cumulativeProbability(x)
            assert tails.chi2_upper([x], [dof])[0] == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert tails.t_two_sided([-242.3], [3e6])[0] == 0.0
    assert tails.chi2_upper([305833.0], [23.0])[0] == 0.0
    assert math.isnan(tails.t_two_sided([float("nan")], [3.0])[0])


def test_published_identities(spark):
    """t and d follow from the published means and interval."""
    p = PUBLISHED
    diff = p["mean_a"] - p["mean_b"]
    se = (p["ci"][1] - p["ci"][0]) / (2 * tails.normal_quantile(0.975))
    assert diff / se == pytest.approx(p["t"], rel=1e-9)
    assert math.sqrt(p["chi2"] / p["n"]) == pytest.approx(p["v"], rel=1e-9)


def test_welch_against_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.gamma(2, 5, 180), rng.gamma(2, 6, 90)
    got = one(S.welch_t(frame(spark, a, b), "v", "g", "a", "b"))
    qa, qb = a.var(ddof=1) / 180, b.var(ddof=1) / 90
    assert got["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(qa + qb))
    assert got["df"] == pytest.approx((qa + qb) ** 2 / (qa ** 2 / 179 + qb ** 2 / 89))
    pooled = math.sqrt((179 * a.var(ddof=1) + 89 * b.var(ddof=1)) / 268)
    assert got["cohen_d"] == pytest.approx((a.mean() - b.mean()) / pooled)
    assert got["ci_lo"] < got["diff"] < got["ci_hi"]


@pytest.mark.parametrize("a, b", [([3, 3, 3], [3, 3]), ([1], [2, 3]), ([], [1, 2])])
def test_welch_is_null_without_variation_or_values(spark, a, b):
    got = one(S.welch_t(frame(spark, a, b), "v", "g", "a", "b"))
    assert got["t"] is None and got["p"] is None


def test_welch_with_one_constant_group(spark):
    assert one(S.welch_t(frame(spark, [3, 3, 3], [1, 2, 4]), "v", "g", "a", "b"))["t"] is not None


def test_mann_whitney_with_ties_against_brute_force(spark):
    rng = random.Random(9)
    a = [rng.randint(0, 6) for _ in range(70)]
    b = [rng.randint(1, 8) for _ in range(50)]
    got = one(S.mann_whitney(frame(spark, a, b), "v", "g", "a", "b"))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["u"] == pytest.approx(u)
    pooled = a + b
    tie = sum(pooled.count(v) ** 3 - pooled.count(v) for v in set(pooled))
    assert got["tie_term"] == tie
    n = len(pooled)
    sd = math.sqrt(70 * 50 / 12 * (n + 1 - tie / (n * (n - 1))))
    z = (max(u, 3500 - u) - 1750 - 0.5) / sd
    assert got["z"] == pytest.approx(z)
    assert got["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_mann_whitney_of_equal_groups_has_p_one(spark):
    assert one(S.mann_whitney(frame(spark, [1, 2, 3], [1, 2, 3]), "v", "g", "a", "b"))["p"] == 1.0


def table(spark, cells):
    return spark.createDataFrame([(r, c, n) for (r, c), n in cells.items()], "r string, c string, n long")


def test_chi2_two_by_two_uses_yates(spark):
    cells = {("x", "u"): 12, ("x", "v"): 5, ("y", "u"): 7, ("y", "v"): 9}
    got = one(S.chi2_from_counts(table(spark, cells), "r", "c"))
    n, det = 33, abs(12 * 9 - 5 * 7)
    want = n * (det - n / 2) ** 2 / (17 * 16 * 19 * 14)
    assert got["dof"] == 1 and got["chi2"] == pytest.approx(want)


def test_chi2_two_by_three_does_not_and_counts_empty_cells(spark):
    cells = {("x", "u"): 12, ("x", "v"): 5, ("y", "u"): 7, ("y", "w"): 9}
    got = one(S.chi2_from_counts(table(spark, cells), "r", "c"))
    grid = np.array([[12, 5, 0], [7, 0, 9]], float)
    e = grid.sum(1, keepdims=True) * grid.sum(0) / grid.sum()
    want = ((grid - e) ** 2 / e).sum()
    assert got["dof"] == 2 and got["chi2"] == pytest.approx(want)
    assert got["cramers_v"] == pytest.approx(math.sqrt(want / 33))
    assert got["p"] == pytest.approx(math.exp(-want / 2))


def test_yates_never_overshoots(spark):
    cells = {("x", "u"): 10, ("x", "v"): 10, ("y", "u"): 10, ("y", "v"): 10}
    assert one(S.chi2_from_counts(table(spark, cells), "r", "c"))["chi2"] == 0.0


def test_within_share(spark):
    got = S.within_share(table(spark, {("x", "u"): 1, ("x", "v"): 3, ("y", "u"): 5}), "r")
    assert rows(got, "r", "c")["x", "v"]["share"] == 0.75
    assert rows(got, "r", "c")["y", "u"]["share"] == 1.0


def strat(spark, cells):
    data = [(arm, s, float(v)) for (arm, s), vals in cells.items() for v in vals]
    df = spark.createDataFrame(data, "arm string, s string, v double")
    return one(S.stratified_diff(df, "v", "arm", "s", "e", "c", ("m", "k")))


def test_reversal_of_pooled_and_stratified_differences(spark):
    got = strat(spark, {("e", "m"): [1] * 9, ("c", "m"): [2], ("e", "k"): [10], ("c", "k"): [11] * 9})
    assert got["diff_overall"] < 0 and got["diff_stratum_0"] == -1 and not got["simpson_reversed"]
    flipped = strat(spark, {("e", "m"): [3] * 9, ("c", "m"): [2], ("e", "k"): [12], ("c", "k"): [11] * 9})
    assert flipped["diff_overall"] < 0 < flipped["diff_stratum_0"]
    assert flipped["simpson_reversed"] and flipped["all_reversed"]
    assert flipped["mix_a"] == pytest.approx(0.1)
    mixed = strat(spark, {("e", "m"): [1, 1], ("c", "m"): [9], ("e", "k"): [9], ("c", "k"): [8]})
    assert mixed["simpson_reversed"] and not mixed["all_reversed"]


def test_any_number_of_strata(spark):
    cells = {("e", "m"): [3] * 9, ("c", "m"): [2], ("e", "k"): [12], ("c", "k"): [11] * 9,
             ("e", None): [5], ("c", None): [4], ("e", "alone"): [7], ("other", "m"): [900]}
    df = spark.createDataFrame([(a, s, float(v)) for (a, s), vs in cells.items() for v in vs] + [("e", "m", None)],
                               "arm string, s string, v double")
    means = S.stratified_means(df, "v", "arm", "s", "e", "c")
    got = rows(means, "pooled", "s")
    assert set(got) == {(False, "m"), (False, "k"), (False, None), (False, "alone"), (True, None)}
    assert got[False, "k"]["diff"] == 1 and got[False, "alone"]["diff"] is None and got[False, "alone"]["n_b"] == 0
    assert got[True, None]["n_a"] == 12 and got[True, None]["share_a"] == 1
    assert sum(r["share_a"] for k, r in got.items() if not k[0]) == pytest.approx(1)
    verdict = one(S.stratified_verdict(means))
    assert verdict["n_strata"] == 3 == verdict["n_positive"] and verdict["diff_overall"] < 0
    assert verdict["simpson_reversed"] and verdict["all_reversed"]
    empty = one(S.stratified_verdict(S.stratified_means(df.where("false"), "v", "arm", "s", "e", "c")))
    assert empty["n_strata"] == 0 and not empty["simpson_reversed"] and not empty["all_reversed"]


def test_two_strata_agree_with_the_general_form(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        data = [(str(a), str(s), float(v)) for a, s, v in
                zip(rng.choice(["e", "c"], 60), rng.choice(["m", "k"], 60), rng.normal(0, 3, 60).round(2))]
        df = spark.createDataFrame(data, "arm string, s string, v double")
        old = one(S.stratified_diff(df, "v", "arm", "s", "e", "c", ("m", "k")))
        means = S.stratified_means(df, "v", "arm", "s", "e", "c")
        new, strata = one(S.stratified_verdict(means)), rows(means, "s")
        assert (strata["m"]["diff"], strata["k"]["diff"]) == (old["diff_stratum_0"], old["diff_stratum_1"])
        assert all(new[c] == old[c] for c in ("diff_overall", "simpson_reversed", "all_reversed"))


def test_describe_and_density(spark):
    rng = np.random.default_rng(1)
    v = rng.gamma(2, 8, 400).round(2)
    df = frame(spark, v[:250], v[250:])
    got = rows(S.describe_by(df, "v", ["g"]), "g")["a"]
    assert got["sd"] == pytest.approx(v[:250].std(ddof=1))
    assert got["p90"] == pytest.approx(np.percentile(v[:250], 90))
    whole = one(S.describe_by(df, "v"))
    assert whole["n"] == 400 and whole["p50"] == pytest.approx(np.median(v))
    dens = rows(S.density_hist(df.union(frame(spark, [60.0], [])), "v", "g"), "g", "bin")
    want, _ = np.histogram(np.append(v[:250], 60.0), bins=np.arange(0, 60.5, 1.5), density=True)
    assert [dens["a", i]["density"] for i in range(40)] == pytest.approx(list(want))


# --- resampling ------------------------------------------------------------------------

def test_poisson_weights_have_mean_and_variance_one(spark):
    from tripledger.functions import hashing as H
    h = (F.xxhash64("id") % H.P + H.P) % H.P
    got = one(spark.range(200_000).select(R.poisson_weight(h).alias("w")).agg(
        F.avg("w").alias("m"), F.var_samp("w").alias("v")))
    assert got["m"] == pytest.approx(1, abs=0.02) and got["v"] == pytest.approx(1, abs=0.03)


def test_subsample_is_exact_without_replacement_and_repeatable(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "a").otherwise("b").alias("g"))
    pick = R.fixed_subsample(df, "id", "g", ("a", "b"), 300, 1)
    got = pick.collect()
    assert len({r["id"] for r in got}) == 600
    assert sum(r["g"] == "a" for r in got) == 300
    again = R.fixed_subsample(df.repartition(7), "id", "g", ("a", "b"), 300, 1).collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}
    small = R.fixed_subsample(df, "id", "g", ("a", "b"), 2000, 1).groupBy("g").count()
    assert rows(small, "g")["b"]["count"] == 1000


def test_bootstrap_interval_is_near_the_analytic_one(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, rng.gamma(2, 5, 1500), rng.gamma(2, 6, 1500)).withColumn(
        "id", F.monotonically_increasing_id())
    w = one(S.welch_t(df, "v", "g", "a", "b"))
    b = one(R.bootstrap_diff(df, "v", "id", "g", "a", "b", m=5000, iterations=400))
    assert b["boot_sd"] == pytest.approx(w["se"], rel=0.15)
    assert b["ci_lo"] == pytest.approx(w["ci_lo"], abs=0.3 * w["se"] + 0.1)
    assert b["boot_mean"] == pytest.approx(w["diff"], abs=0.2 * w["se"])


def test_unit_bootstrap_spread(spark):
    rng = np.random.default_rng(3)
    data = [(f"u{i}", "treat" if i % 2 else "control", float(10 + i % 2 + rng.normal())) for i in range(80)]
    df = spark.createDataFrame(data, "unit string, arm string, y double")
    w = one(S.welch_t(df, "y", "arm", "treat", "control"))
    d = one(R.bootstrap_unit_diff(df, "unit", "arm", "y", iterations=500))
    assert d["boot_sd"] == pytest.approx(w["se"], rel=0.2)
    ratio = one(R.bootstrap_ratio(df, "unit", "arm", "y", iterations=500))
    assert ratio["ci_lo"] < w["mean_a"] / w["mean_b"] - 1 < ratio["ci_hi"]


def test_permutations_cover_all_positions_evenly(spark):
    units = spark.createDataFrame([(f"u{i}",) for i in range(11)], "unit string")
    got = R.permute(units, "unit", 300, 5)
    per_iter = got.groupBy("iteration").agg(
        F.count_distinct("rn").alias("k"), F.max("rn").alias("m"), F.max("total").alias("t"))
    assert per_iter.where("k = 11 and m = 11 and t = 11").count() == 300
    mean = rows(got.groupBy("unit").agg(F.avg("rn").alias("m")), "unit")
    assert all(abs(v["m"] - 6) < 0.9 for v in mean.values())


def test_splits_are_those_of_the_full_order(spark):
    """Ranks inside, below and beyond the rows, several at once; the order is that of permute."""
    units = spark.createDataFrame([(f"u{i}", float(i)) for i in range(23)], "unit string, y double").repartition(3)
    want = rows(R.permute(units, "unit", 40, 5), "iteration", "unit")
    ranks = [lambda total: F.floor(total / 2), lambda total: total - 3]
    got = rows(R.split_at(units, "unit", 40, 5, ranks), "iteration", "unit")
    assert len(got) == 40 * 23
    assert all(got[k]["part"] == (w["rn"] > 11) + (w["rn"] > 20) for k, w in want.items())
    ends = [lambda total: F.lit(0), lambda total: total, lambda total: total + 5]
    assert {r["part"] for r in R.split_at(units, "unit", 3, 5, ends).collect()} == {1}
    assert {r["part"] for r in R.split_at(units, "unit", 3, 5, [lambda total: F.lit(None).cast("bigint")]).collect()} == {None}
    assert R.split_at(units.limit(0), "unit", 3, 5, ranks).count() == 0


def test_splits_break_ties_by_unit(spark):
    df = spark.createDataFrame([(0, 5, u) for u in "dbca"] + [(0, 2 ** 31 - 2, "e"), (0, 0, "f")], "iteration long, h long, unit string")
    got = {r["unit"]: r["part"] for r in rank_parts(df, "h", "unit", [lambda n: F.lit(3), lambda n: F.lit(4)], 6).collect()}
    assert got == {"f": 0, "a": 0, "b": 0, "c": 1, "d": 2, "e": 2}


def test_splits_need_no_order(spark):
    units = spark.range(50).select(F.col("id").alias("unit"), F.col("id").cast("double").alias("y"))
    q = R.split_at(units, "unit", 20, 1, [lambda total: F.floor(total / 2)]).groupBy("iteration", "part").agg(F.avg("y"))
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_weighted_sums_are_those_of_exploded_rows(spark):
    """Sums of large and negative whole numbers under Poisson weights, digit by digit."""
    rng = np.random.default_rng(2)
    data = [(bool(k % 2), int(rng.integers(1, 10**9)), int(rng.integers(-10**17, 10**17)), int(rng.integers(1, H.P)), int(rng.integers(H.P)))
            for k in range(1500)]
    cells = spark.createDataFrame(data, "is_a boolean, n long, ticks long, sl long, of long").repartition(3)
    cells = cells.withColumn("ticks", F.col("ticks").cast("decimal(20,0)"))
    got = cells.mapInArrow(R.weighted_sums(30), "iteration long, is_a boolean, n long, ticks decimal(38,0)").groupBy("iteration", "is_a").agg(
        F.sum("n").alias("n"), F.sum("ticks").alias("ticks"))
    bounds = R.poisson_thresholds()
    for r in got.collect():
        w = [(sum(((sl * (2 * r["iteration"] + 1) + of) % H.P) >= b for b in bounds), n, t) for a, n, t, sl, of in data if a == r["is_a"]]
        assert (r["n"], int(r["ticks"])) == (sum(k * n for k, n, _ in w), sum(k * t for k, _, t in w))
    assert got.count() == 60


def test_share_and_helpers(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (2, 3)], "a int, b int")
    got = [r[0] for r in df.select(C.share(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 33.3, 66.7]
    assert json.loads(df.select(F.to_json(F.struct(C.corridor_weight(F.col("b")).alias("w")))).first()[0])["w"] == 1.0


def test_bootstrap_of_a_small_sample_of_many_rows(spark):
    """The spread of the replicates does not collapse when the sub-sample is a tiny part of the data."""
    m, n = 40, 4_000_000
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        df = spark.range(2 * n).select(
            "id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
            (F.xxhash64("id") % 1000).cast("double").alias("v"))
        sample = R.fixed_subsample(df, "id", "g", ("a", "b"), m, 7)
        se = S.welch_t(sample, "v", "g", "a", "b", p=False).head()["se"]
        sd = R.bootstrap_diff(df, "v", "id", "g", "a", "b", m=m, iterations=2000, seed=7).head()["boot_sd"]
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
    assert m / n <= 1e-5 and abs(sd / se - 1) < 0.15


def test_bootstrap_uses_all_rows(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") < 10_000, "a").otherwise("b").alias("g"), (F.col("id") % 10).cast("double").alias("v"))
    got = R.bootstrap_diff(df, "v", "id", "g", "a", "b", iterations=400, cells=500).head()
    se = S.welch_t(df, "v", "g", "a", "b", p=False).head()["se"]
    assert abs(got["boot_mean"]) < 4 * se and abs(got["boot_sd"] / se - 1) < 0.15


def test_poisson_bounds_leave_nothing():
    bounds = R.poisson_thresholds()
    assert bounds[-1] >= H.P - 1 and bounds == sorted(bounds)


@pytest.mark.parametrize("df", [3, 50, 1e4, 1e7, 1e9, 1e12])
def test_t_tail_at_any_df(df):
    t = np.array([0.0, 1e-4, 0.5, 1.96, 4.0, 8.0])
    p = tails.t_two_sided(t, np.full_like(t, df))
    assert p[0] == 1 and np.all(np.diff(p) < 0)
    if df >= 1e4:  # the normal limit and its first two corrections
        z = tails.normal_two_sided(t)
        density = np.exp(-t * t / 2) / np.sqrt(2 * np.pi)
        first = density * (t + t ** 3) / (2 * df)
        second = density * (3 * t ** 7 - 7 * t ** 5 - 5 * t ** 3 - 3 * t) / (48 * df ** 2)
        assert np.allclose(p, z + first + second, rtol=1e-6, atol=1e-11)


def test_t_tail_has_no_step_at_the_limit():
    t = np.array([0.3, 1.0, 1.7, 1.8, 2.5, 5.0])
    below, above = (tails.t_two_sided(t, np.full_like(t, df)) for df in (1e6, 1e6 + 1))
    assert np.allclose(below, above, rtol=0, atol=2e-11)


def test_known_t_tails():
    assert np.allclose(tails.t_two_sided([12.706204736], [1]), 0.05, atol=1e-10)
    assert np.allclose(tails.t_two_sided([2.085963447], [20]), 0.05, atol=1e-9)
