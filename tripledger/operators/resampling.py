"""Bootstrap, permutation splits and fan-out over iterations.

Iterations multiply rows by ``explode`` on already reduced data. Randomness is a
function of keys, see :mod:`tripledger.functions.hashing`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.functions import hashing as H
from tripledger.operators.ranking import row_numbers
from tripledger.operators.selection import rank_parts

def poisson_thresholds() -> list[int]:
    """Integer bounds on 0 … P that cut it into Poisson(1) weights 0, 1, 2, … until nothing is left of it."""
    cdf, bounds, k = 0.0, [], 0
    while not bounds or bounds[-1] < H.P - 1:
        cdf += math.exp(-1) / math.factorial(k)
        bounds.append(math.floor(H.P * cdf))
        k += 1
    return bounds


def poisson_weight(h: Column) -> Column:
    expr = None
    for k, bound in enumerate(poisson_thresholds()):
        expr = F.when(h < bound, k) if expr is None else expr.when(h < bound, k)
    return expr.otherwise(len(poisson_thresholds())).cast("bigint")


#: Cells whose weights a task holds at a time, and bits of a part of a sum: their products stay below 2**53.
WEIGHT_BLOCK, PART_BITS = 512, 20


def weighted_sums(iterations: int):
    """mapInArrow function: per iteration and side the sums of n and ticks of the batch's cells, under Poisson weights.

    A task keeps one array of sums over all iterations instead of a row per cell and iteration. Whole numbers are cut into
    parts of ``PART_BITS`` bits, so that products of matrices of doubles are exact.
    """
    bounds = np.array(poisson_thresholds(), np.int64)
    steps = np.arange(iterations, dtype=np.int64) * 2 + 1
    # the weight by the leading bits of a value; where a bound lies within, the weight is looked up
    shift, table = 15, np.searchsorted(bounds, np.arange(1 << 16, dtype=np.int64) << 15, side="right")
    mixed = np.zeros(1 << 16, bool)
    mixed[bounds >> shift] = True

    def weights(slope: np.ndarray, offset: np.ndarray) -> np.ndarray:
        h = (slope[:, None] * steps + offset[:, None]) % H.P
        lead = h >> shift
        out = table[lead].astype(np.float64)
        edge = mixed[lead]
        out[edge] = np.searchsorted(bounds, h[edge], side="right")
        return out

    def parts(column: pa.Array) -> tuple[list[int], np.ndarray]:
        values = np.array([int(v) for v in column.to_pylist()], object)
        places = []
        # the last part keeps the sign
        while not places or values.max() >= 1 << PART_BITS or values.min() < -1 << PART_BITS:
            places.append((values & ((1 << PART_BITS) - 1)).astype(np.float64))
            values = values >> PART_BITS
        places.append(values.astype(np.float64))
        return [PART_BITS * k for k in range(len(places))], np.stack(places, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bool, np.ndarray] = {}
        for batch in batches:
            side = batch.column("is_a").to_numpy(zero_copy_only=False).astype(bool)
            slope, offset = (batch.column(c).to_numpy() for c in ("sl", "of"))
            (n_at, n), (t_at, ticks) = (parts(batch.column(c)) for c in ("n", "ticks"))
            cells = np.hstack([n, ticks])
            for mine in (False, True):
                rows = np.flatnonzero(side == mine)
                for k in range(0, len(rows), WEIGHT_BLOCK):
                    block = rows[k:k + WEIGHT_BLOCK]
                    found = (weights(slope[block], offset[block]).T @ cells[block]).astype(np.int64).astype(object)
                    sums = np.stack([sum(found[:, j] << at for j, at in enumerate(n_at)),
                                     sum(found[:, len(n_at) + j] << at for j, at in enumerate(t_at))])
                    totals[mine] = totals[mine] + sums if mine in totals else sums
        for mine, (n, ticks) in totals.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(iterations)), pa.array(np.full(iterations, mine)), pa.array(n.tolist(), pa.int64()),
                pa.array(ticks.tolist(), pa.decimal128(38, 0))], ["iteration", "is_a", "n", "ticks"])
    return run


def fan_out(
    df: DataFrame, iterations: int, name: str = "iteration", width: int | None = None,
) -> DataFrame:
    """Every row once per iteration 0 … iterations-1, spread over the cluster first.

    The input is small and may sit in a partition or two; the work after the
    fan-out is ``iterations`` times larger and should not. ``width`` is the number of
    partitions, that of a shuffle unless given.
    """
    width = width or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, last = F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint")
    return df.repartition(width, *df.columns).withColumn(name, F.explode(F.sequence(first, last)))


def fixed_subsample(
    df: DataFrame, key: str, group: str, labels: Sequence[object], m: int, seed: int,
) -> DataFrame:
    """``m`` rows per group without replacement: those with the smallest picks.

    Digests are uniform, so a threshold read off the group size lets only slightly
    more than ``m`` rows through the scan; the window that makes the size exact
    sees just those. Adds ``dig``.
    """
    rows = df.where(F.col(group).isin(*labels)).withColumn(
        "dig", H.digest(seed, F.col(key), purpose="pick"))
    sizes = df.agg(*[F.count_if(F.col(group) == g).alias(f"g{i}") for i, g in enumerate(labels)])
    packed = sizes.select(F.struct("*")).scalar()
    # eight standard deviations and a margin: fewer than m pass once in 10**15 samples
    enough = m + 8.0 * math.sqrt(m) + 64.0
    size = F.lit(None).cast("bigint")
    for i, g in enumerate(labels):
        size = F.when(F.col(group) == g, F.col(f"_sizes.g{i}")).otherwise(size)
    passed = (
        rows.withColumn("_sizes", packed)
        .where(H.digest_pick(F.col("dig")) * size <= enough).drop("_sizes")
    )
    rank = F.row_number().over(Window.partitionBy(group).orderBy(
        H.digest_pick(F.col("dig")), "dig", key))
    return passed.withColumn("_rank", rank).where(F.col("_rank") <= m).drop("_rank")


def interval(df: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over iterations (as many values as iterations)."""
    lo, hi = alpha / 2, 1 - alpha / 2
    return df.agg(
        F.count(value).alias("iterations"), F.avg(value).alias("boot_mean"),
        F.stddev_samp(value).alias("boot_sd"),
        F.percentile(value, lo).alias("ci_lo"), F.percentile(value, hi).alias("ci_hi"))


def bootstrap_diff(
    df: DataFrame, value: str, key: str, group: str, a: object, b: object,
    m: int | None = None, iterations: int = 2000, seed: int = 20250801, alpha: float = 0.05,
    cells: int = 50_000,
) -> DataFrame:
    """Interval of the mean difference by a Poisson bootstrap over all rows.

    Rows fall at random into ``cells`` cells per group, and a cell keeps its count and sum:
    one aggregation, whatever the number of rows. Each cell gets a Poisson(1) weight
    per iteration, and a replicate is the ratio of the weighted sums: tasks keep one array of sums over the iterations. Sums are whole
    numbers, so replicates are the same however the rows were split.
    Given ``m``, only a sub-sample of ``m`` rows per group is used.
    """
    rows = df.select(key, group, value).where(F.col(group).isin(a, b))
    if m:
        rows = fixed_subsample(rows, key, group, (a, b), m, seed).drop("dig")
    cell = H.digest_cell(H.digest(seed, F.col(key), purpose="cell"), cells).alias("cell")
    sums = rows.where(F.col(value).isNotNull()).groupBy((F.col(group) == a).alias("is_a"), cell).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.floor(F.col(value) * 1e6 + 0.5).cast("decimal(20,0)")).alias("ticks"))
    dig = H.digest(seed, F.col("is_a"), F.col("cell"), purpose="weight")
    keyed = sums.select("is_a", "n", "ticks", H.slope(dig).alias("sl"), H.offset(dig).alias("of"))
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = keyed.repartition(width, "sl", "of").mapInArrow(
        weighted_sums(iterations), "iteration long, is_a boolean, n long, ticks decimal(38,0)")

    def mean(side: Column) -> Column:
        ticks, n = F.sum(F.when(side, F.col("ticks"))), F.sum(F.when(side, F.col("n")))
        return F.try_divide(ticks.cast("double"), n.cast("double")) / 1e6

    replicates = drawn.groupBy("iteration").agg(
        (mean(F.col("is_a")) - mean(~F.col("is_a"))).alias("diff"))
    return interval(replicates, "diff", alpha)


def resampled_means(
    units: DataFrame, unit: str, arm: str, value: str, iterations: int, seed: int,
) -> DataFrame:
    """Mean of n-of-n draws with replacement, per arm and iteration.

    Units are numbered inside their arm, in the order of their digests; slot ``j`` of
    an iteration draws a number, and an equi-join on (arm, number) fetches the value.
    """
    known = units.where(F.col(value).isNotNull()).select(
        unit, arm, value, H.digest(seed, F.col(unit), purpose="slot").alias("_d"))
    numbered = row_numbers(
        known, ["_d", unit], by=[arm], bucket=F.conv(F.substring("_d", 1, 2), 16, 10).cast("int"))
    dig = H.digest(seed, F.col(arm), F.col("rn"), purpose="draw")
    slots = numbered.select(
        F.col(arm).alias("_arm"), "total", H.slope(dig).alias("sl"), H.offset(dig).alias("of"))
    draws = fan_out(slots, iterations).select(
        "_arm", "iteration",
        (H.iteration_value(F.col("sl"), F.col("of"), F.col("iteration")) % F.col("total") + 1)
        .alias("_rn"))
    hits = draws.join(
        numbered.select(arm, "rn", value),
        (F.col("_arm") == F.col(arm)) & (F.col("_rn") == F.col("rn")))
    return hits.groupBy("iteration", arm).agg(F.avg(value).alias("mean"))


def _paired(means: DataFrame, arm: str, treat: str, control: str) -> DataFrame:
    def of(label: str) -> Column:
        return F.max(F.when(F.col(arm) == label, F.col("mean")))
    return means.groupBy("iteration").agg(of(treat).alias("mt"), of(control).alias("mc"))


def bootstrap_ratio(
    units: DataFrame, unit: str, arm: str, value: str, iterations: int = 2000,
    seed: int = 20250801, alpha: float = 0.05, treat: str = "treat", control: str = "control",
) -> DataFrame:
    """Interval of the relative lift, ratio of arm means minus one."""
    means = _paired(resampled_means(units, unit, arm, value, iterations, seed), arm, treat, control)
    return interval(means.select((F.col("mt") / F.col("mc") - 1).alias("lift")), "lift", alpha)


def bootstrap_unit_diff(
    units: DataFrame, unit: str, arm: str, value: str, iterations: int = 2000,
    seed: int = 20250801, alpha: float = 0.05, treat: str = "treat", control: str = "control",
) -> DataFrame:
    """Interval of the difference of arm means."""
    means = _paired(resampled_means(units, unit, arm, value, iterations, seed), arm, treat, control)
    return interval(means.select((F.col("mt") - F.col("mc")).alias("diff")), "diff", alpha)


def permute(
    units: DataFrame, unit: str, iterations: int, seed: int, purpose: str = "split",
) -> DataFrame:
    """A random order of all units per iteration: ``rn`` of ``total``; another one for another purpose.

    The order key is uniform, so its leading part is a balanced bucket and no
    iteration is sorted in one task once it is large.
    """
    dig = H.digest(seed, F.col(unit), purpose=purpose)
    keyed = units.withColumns({"sl": H.slope(dig), "of": H.offset(dig)})
    h = H.iteration_value(F.col("sl"), F.col("of"), F.col("iteration"))
    ordered = fan_out(keyed, iterations).withColumn("_h", h).drop("sl", "of")
    return row_numbers(
        ordered, ["_h", unit], by=["iteration"],
        bucket=F.floor(F.col("_h") / (H.P / 64.0)).cast("int")).drop("_h")


def split_at(
    units: DataFrame, unit: str, iterations: int, seed: int, ranks: Sequence[Callable[[Column], Column]],
    purpose: str = "split",
) -> DataFrame:
    """All units per iteration, with ``part``: how many of the ranks a unit is beyond in the order of :func:`permute`.

    ``ranks`` are positions as functions of the number of units. Nothing is ordered, see :mod:`tripledger.operators.selection`.
    """
    dig = H.digest(seed, F.col(unit), purpose=purpose)
    keyed = units.withColumns({"sl": H.slope(dig), "of": H.offset(dig)})
    h = H.iteration_value(F.col("sl"), F.col("of"), F.col("iteration"))
    rows = fan_out(keyed, iterations).withColumn("_h", h).drop("sl", "of")
    return rank_parts(rows, "_h", unit, ranks, units.count()).drop("_h")
