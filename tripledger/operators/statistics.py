"""Statistical tests as aggregations: no test ever holds the observations.

Each test reduces trips to moments, counts or value frequencies in one pass;
the statistic is arithmetic on the few rows left. p-values come from the Arrow
helpers in :mod:`tripledger.functions.tails` and touch only those rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions import exact as X
from tripledger.functions.tails import chi2_pvalue, normal_pvalue, normal_quantile, t_pvalue
from tripledger.operators.narrowing import histogram, narrowed
from tripledger.operators.ranking import join_on, prefix_sums

ALPHA = 0.05


# --- description -------------------------------------------------------------------

def _described(df: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Moments and quantiles from one histogram and the values next to the wanted ranks: two scans."""
    v = F.col(value)
    hist = histogram(df, value, by, [
        F.sum(X.whole_part(v)).alias("whole"), F.sum(X.tick_part(v)).alias("ticks"),
        F.avg(v).alias("mean"), F.var_pop(v).alias("var")])
    n, group = F.col("n"), Window.partitionBy(*by)
    centred = hist.withColumn("_mean", F.sum(n * F.col("mean")).over(group) / F.sum("n").over(group))
    gap = F.col("mean") - F.col("_mean")
    size = F.sum("n")
    moments = centred.groupBy(*by).agg(
        size.alias("n"),
        F.try_divide(X.join_parts(F.sum("whole"), F.sum("ticks")).cast("double"), size.cast("double")).alias("mean"),
        F.sqrt(F.sum(n * (F.col("var") + gap * gap)) / F.when(size > 1, size - 1)).alias("sd"),
        F.min("lo").alias("min"), F.max("hi").alias("max"))
    q = narrowed(df, hist, value, probs, by)
    if by:
        return join_on(moments, q, by)
    packed = q.select(F.struct(*probs)).scalar()
    return moments.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("_q", packed).select(
        "n", "mean", "sd", "min", "max", *[F.col(f"_q.{p}").alias(p) for p in probs])


def group_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean and exact median per group with a value."""
    return _described(df, value, by, {"median": 0.5}).select(*by, "n", "mean", "median")


def describe_by(
    df: DataFrame, value: str, by: Sequence[str] = (), probs: dict[str, float] | None = None,
) -> DataFrame:
    """Count, mean, sample sd, min, exact quantiles, max per group with a value."""
    probs = probs or {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    return _described(df, value, by, probs).select(*by, "n", "mean", "sd", "min", *probs, "max")


def density_hist(
    df: DataFrame, value: str, by: str, lo: float = 0.0, hi: float = 60.0, width: float = 1.5,
) -> DataFrame:
    """Density per fixed-width bin and group; the last bin includes ``hi``, empty bins are 0."""
    n_bins = round((hi - lo) / width)
    v = F.col(value)
    binned = df.where(v.between(lo, hi)).select(
        by, F.least(F.lit(n_bins - 1), F.floor((v - lo) / width)).cast("int").alias("bin"))
    counts = binned.groupBy(by, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("total")).select(
        by, "total", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return join_on(totals, counts, [by, "bin"], "left").select(
        by, "bin", (F.col("bin") * width + lo).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("total") * width)).alias("density"))


# --- two groups -----------------------------------------------------------------------

def two_sample_moments(
    df: DataFrame, value: str, group: str, a: object, b: object, by: Sequence[str] = (),
) -> DataFrame:
    """n, mean and sample variance of both groups side by side."""
    def of(label: object) -> Column:
        return F.when(F.col(group) == label, F.col(value))

    aggs = []
    for side, label in (("a", a), ("b", b)):
        aggs += [F.count(of(label)).alias(f"n_{side}"), F.avg(of(label)).alias(f"mean_{side}"),
                 F.var_samp(of(label)).alias(f"var_{side}")]
    return df.groupBy(*by).agg(*aggs)


def welch_from_moments(m: DataFrame, alpha: float = ALPHA, p: bool = True) -> DataFrame:
    """Welch t, degrees of freedom, Cohen's d and normal interval of the mean difference.

    Null where a group has fewer than two values or neither group varies.
    """
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    va, vb = F.col("var_a"), F.col("var_b")
    enough = (F.col("n_a") > 1) & (F.col("n_b") > 1)
    z = normal_quantile(1 - alpha / 2)
    qa, qb = va / na, vb / nb
    out = m.withColumns({
        "diff": F.col("mean_a") - F.col("mean_b"),
        "se": F.when(enough, F.sqrt(qa + qb)),
    })
    se = F.col("se")
    pooled = F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))
    spread = F.when(enough & (se > 0), se)
    out = out.withColumns({
        "t": F.col("diff") / spread,
        "df": F.when(spread.isNotNull(), F.pow(qa + qb, 2) / (
            F.pow(qa, 2) / (na - 1) + F.pow(qb, 2) / (nb - 1))),
        "cohen_d": F.when(spread.isNotNull(), F.col("diff") / pooled),
        "ci_lo": F.col("diff") - se * z,
        "ci_hi": F.col("diff") + se * z,
    })
    return out.withColumn("p", t_pvalue(F.col("t"), F.col("df"))) if p else out


def welch_t(
    df: DataFrame, value: str, group: str, a: object, b: object, by: Sequence[str] = (),
    alpha: float = ALPHA, p: bool = True,
) -> DataFrame:
    """Welch test of ``a`` against ``b``, per ``by`` group if given."""
    return welch_from_moments(two_sample_moments(df, value, group, a, b, by), alpha, p)


def group_rank_sum(df: DataFrame, value: str, group: str, a: object, b: object) -> DataFrame:
    """One row: sizes, rank sum of ``a`` with mid-ranks, and the tie term.

    Ranks come from running totals over value frequencies. Rank sums reach the
    square of the row count, hence decimals.
    """
    g = F.col(group)
    counts = (
        df.where(F.col(value).isNotNull() & g.isin(a, b)).groupBy(value)
        .agg(F.count("*").alias("n_value"), F.count_if(g == a).alias("n_in_a"))
    )
    ranked = prefix_sums(counts, [value], "n_value")
    t = F.col("n_value").cast("double")
    twice_mid = (F.col("before") * 2 + F.col("n_value") + 1).cast("decimal(19,0)")
    return ranked.agg(
        F.sum("n_in_a").alias("n_a"), (F.sum("n_value") - F.sum("n_in_a")).alias("n_b"),
        (F.sum(F.col("n_in_a").cast("decimal(19,0)") * twice_mid).cast("double") / 2)
        .alias("rank_sum_a"),
        F.sum(t * t * t - t).alias("tie_term"),
    )


def mann_whitney(
    df: DataFrame, value: str, group: str, a: object, b: object, p: bool = True,
) -> DataFrame:
    """Mann-Whitney U, two-sided, normal limit with tie and continuity correction."""
    ranks = group_rank_sum(df, value, group, a, b)
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("rank_sum_a") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.try_divide(F.col("tie_term"), n * (n - 1))))
    out = ranks.withColumn("u", u).withColumn(
        "z", (F.greatest(F.col("u"), na * nb - F.col("u")) - na * nb / 2 - 0.5)
        / F.when(sd > 0, sd))
    if p:
        out = out.withColumn("p", F.when(F.col("z") <= 0, 1.0).otherwise(normal_pvalue(F.col("z"))))
    return out


# --- tables --------------------------------------------------------------------------

def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.groupBy(row, col).agg(F.count("*").alias("n"))


def _with_margin(counts: DataFrame, key: str, *margins: Column) -> DataFrame:
    """Aggregates per key beside every cell; no key's cells meet in one task."""
    per_key = counts.groupBy(F.col(key).alias("_key")).agg(*margins)
    return counts.join(per_key, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def within_share(counts: DataFrame, row: str, n: str = "n") -> DataFrame:
    """Each cell's part of its row total."""
    return _with_margin(counts, row, F.sum(n).alias("_total")).withColumn(
        "share", F.col(n) / F.col("_total")).drop("_total")


def chi2_from_counts(counts: DataFrame, row: str, col: str, p: bool = True) -> DataFrame:
    """Pearson chi-square of a long table, with Cramér's V.

    Yates' correction applies to 2×2 tables only. Cells that do not occur count as
    zero without being created: their expected counts are what the others leave.
    """
    n = F.col("n").cast("double")
    total = counts.agg(F.sum("n").cast("double")).scalar()
    cells = _with_margin(counts, row, F.sum("n").cast("double").alias("_r"), F.count("*").alias("_kr"))
    cells = _with_margin(cells, col, F.sum("n").cast("double").alias("_c"), F.count("*").alias("_kc"))
    cells = cells.withColumn("_n", total).withColumn("_e", F.col("_r") * F.col("_c") / F.col("_n"))
    gap = F.abs(n - F.col("_e"))
    sums = cells.agg(
        F.max("_n").alias("n"), F.count("*").alias("k"),
        F.count_distinct(row).alias("n_rows"), F.count_distinct(col).alias("n_cols"),
        F.sum(gap * gap / F.col("_e")).alias("pearson"), F.sum("_e").alias("e_seen"),
        F.max(gap).alias("gap"),
        F.sum(1 / (F.col("_r") * F.col("_kr"))).alias("inv_rows"),
        F.sum(1 / (F.col("_c") * F.col("_kc"))).alias("inv_cols"),
    )
    rows, cols = F.col("n_rows"), F.col("n_cols")
    unseen = F.when(F.col("k") < rows * cols, F.col("n") - F.col("e_seen")).otherwise(0.0)
    yates = F.pow(F.greatest(F.col("gap") - 0.5, F.lit(0.0)), 2) * F.col("n") \
        * F.col("inv_rows") * F.col("inv_cols")
    dof = (rows - 1) * (cols - 1)
    out = sums.select(
        F.col("n").cast("bigint").alias("n"), dof.alias("dof"),
        F.when(dof == 1, yates).otherwise(F.col("pearson") + unseen).alias("chi2"),
        F.least(rows, cols).alias("_m"),
    ).withColumn(
        "cramers_v", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("_m") - 1)))
    ).drop("_m")
    return out.withColumn("p", chi2_pvalue(F.col("chi2"), F.col("dof").cast("double"))) if p else out


def chi2_two_by_two(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected chi-square of the table ((a, b), (c, d)); null if a margin is empty."""
    n = a + b + c + d
    gap = F.try_divide(F.abs(a * d - b * c), n)
    spread = F.try_divide(n, (a + b) * (c + d)) * F.try_divide(n, (a + c) * (b + d)) * n
    return F.pow(F.greatest(gap - 0.5, F.lit(0.0)), 2) * spread


def chi2_independence(df: DataFrame, row: str, col: str, p: bool = True) -> DataFrame:
    return chi2_from_counts(contingency(df, row, col), row, col, p)


# --- pooled against stratified ----------------------------------------------------------

def stratified_diff(
    df: DataFrame, value: str, arm: str, stratum: str, a: object, b: object,
    strata: tuple[object, object],
) -> DataFrame:
    """Mean difference ``a - b`` overall and inside two strata, with the class mix.

    ``simpson_reversed`` compares the pooled sign with "any stratum positive";
    ``all_reversed`` asks that every stratum point the other way.
    """
    v = F.col(value)
    cells = df.where(v.isNotNull()).groupBy(arm, stratum).agg(
        F.count("*").alias("n"),
        F.sum(X.whole_part(v)).alias("whole"), F.sum(X.tick_part(v)).alias("ticks"))

    def mean(arm_label: object, stratum_label: object | None = None) -> Column:
        cond = F.col(arm) == arm_label
        if stratum_label is not None:
            cond = cond & (F.col(stratum) == stratum_label)
        total = X.join_parts(F.sum(F.when(cond, F.col("whole"))), F.sum(F.when(cond, F.col("ticks"))))
        return F.try_divide(total.cast("double"), F.sum(F.when(cond, F.col("n"))).cast("double"))

    def mix(arm_label: object) -> Column:
        in_arm = F.col(arm) == arm_label
        return F.try_divide(
            F.sum(F.when(in_arm & (F.col(stratum) == strata[1]), F.col("n"))).cast("double"),
            F.sum(F.when(in_arm, F.col("n"))).cast("double"))

    s0, s1 = strata
    row = cells.agg(
        mean(a).alias("mean_a"), mean(b).alias("mean_b"),
        (mean(a, s0) - mean(b, s0)).alias("diff_stratum_0"),
        (mean(a, s1) - mean(b, s1)).alias("diff_stratum_1"),
        mix(a).alias("mix_a"), mix(b).alias("mix_b"),
    ).withColumn("diff_overall", F.col("mean_a") - F.col("mean_b"))
    up = F.col("diff_overall") > 0
    up0, up1 = F.col("diff_stratum_0") > 0, F.col("diff_stratum_1") > 0
    return row.withColumns({
        "simpson_reversed": up != (up0 | up1),
        "all_reversed": (up != up0) & (up != up1),
    })


def stratified_means(
    df: DataFrame, value: str, arm: str, stratum: str, a: object, b: object,
) -> DataFrame:
    """Mean difference ``a - b`` in each stratum and, marked ``pooled``, over all of them.

    Any number of strata: rows fall to a cell per arm and stratum first, and grouping sets over the cells
    give strata and pooled row together. ``share_a`` and ``share_b`` are the parts of an arm's rows that lie in the
    stratum. A null stratum is one of its own; where an arm is missing the difference is null.
    """
    v = F.col(value)
    cells = df.where(v.isNotNull() & F.col(arm).isin(a, b)).groupBy(arm, stratum).agg(
        F.count("*").alias("n"),
        F.sum(X.whole_part(v)).alias("whole"), F.sum(X.tick_part(v)).alias("ticks"))

    def of(label: object, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(arm) == label, F.col(c))), F.lit(0))

    def mean(label: object) -> Column:
        return F.try_divide(
            X.join_parts(of(label, "whole"), of(label, "ticks")).cast("double"), of(label, "n").cast("double"))

    def share(label: object) -> Column:
        whole = cells.where(F.col(arm) == label).agg(F.sum("n").cast("double")).scalar()
        return F.try_divide(of(label, "n").cast("double"), whole)

    return cells.groupingSets([[F.col(stratum)], []], F.col(stratum)).agg(
        (F.grouping(stratum) == 1).alias("pooled"), of(a, "n").alias("n_a"), of(b, "n").alias("n_b"),
        mean(a).alias("mean_a"), mean(b).alias("mean_b"), (mean(a) - mean(b)).alias("diff"),
        share(a).alias("share_a"), share(b).alias("share_b"))


def stratified_verdict(means: DataFrame) -> DataFrame:
    """One row from :func:`stratified_means`: does the pooled sign hold inside the strata?

    ``simpson_reversed`` compares the pooled sign with "any stratum positive"; ``all_reversed`` asks that every
    stratum point the other way. Strata that lack an arm say nothing; without any other both are false.
    """
    inner = ~F.col("pooled") & F.col("diff").isNotNull()
    up = F.col("diff") > 0
    counts = means.agg(
        F.count_if(inner).alias("n_strata"), F.count_if(inner & up).alias("n_positive"),
        F.max(F.when(F.col("pooled"), F.col("diff"))).alias("diff_overall"))
    pooled_up, any_up = F.col("diff_overall") > 0, F.col("n_positive") > 0
    some, against = F.col("n_strata") > 0, F.when(pooled_up, F.col("n_strata") - F.col("n_positive")) \
        .otherwise(F.col("n_positive"))
    return counts.withColumns({
        "simpson_reversed": F.coalesce(some & (pooled_up != any_up), F.lit(False)),
        "all_reversed": F.coalesce(some & (against == F.col("n_strata")), F.lit(False)),
    })
