"""Ranks, running totals and exact quantiles without a one-task sort.

A window over a whole table, or over one hot group, puts all its rows in one
task. Here the order axis is first cut into buckets by split points, as many as
the rows of a group ask for, in two levels where one does not suffice; totals per
bucket are small enough to add up in one place, and rows are only sorted inside
their bucket. Split points come from the rows with the smallest hashes, a
sample that is the same on every run, so the branches of the plan that use them
always agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.operators.narrowing import histogram, narrowed


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
    never_null: Sequence[str] = (),
) -> DataFrame:
    """Join on keys that may be null, keeping one copy of each key.

    Keys known to be set compare plainly, which lets a shuffle on them be reused.
    """
    marked = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [
        left[k] == marked[f"_r_{k}"] if k in never_null else left[k].eqNullSafe(marked[f"_r_{k}"])
        for k in keys
    ]
    return left.join(marked, on, how).drop(*[f"_r_{k}" for k in keys])


#: Rows of a bucket, about; buckets of a level; sampled rows for each split point.
BUCKET_ROWS, FAN, OVERSAMPLE = 50_000, 1024, 32


def _split_level(df: DataFrame, order: Sequence[str], by: Sequence[str], bucket_rows: int, out: str) -> DataFrame:
    """Add the number of split points of the group at or below a row, below ``FAN``.

    A group has a split point for each ``bucket_rows`` of its rows, at equal distances in its own sample, so that a
    group in a narrow range is cut as finely as any. Rows find their bucket by binary search, one column expression per halving.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    # Reading the weight keeps this branch equal to its siblings, so they share one shuffle.
    keys = df.where(F.col("_w") >= 0).select(*by, key.alias("_k"))
    n = F.count(F.lit(1))
    sizes = keys.groupBy(*by).agg(n.alias("_n"), F.least(F.ceil(n / bucket_rows), F.lit(FAN)).alias("_want"))
    drawn = F.pmod(F.xxhash64("_k"), F.lit(1 << 31)) * F.col("_n") < F.col("_want") * OVERSAMPLE * (1 << 31)
    if by:
        sample = join_on(keys, sizes.where("_want > 1"), by).where(drawn)
    else:
        sample = keys.withColumn("_s", sizes.select(F.struct("_n", "_want")).scalar()).withColumns(
            {"_n": F.col("_s._n"), "_want": F.col("_s._want")}).drop("_s").where(drawn & (F.col("_want") > 1))
    sample = sample.groupBy(*by).agg(F.sort_array(F.collect_list("_k")).alias("_sample"), F.max("_want").alias("_want"))
    places = F.sequence(F.lit(1).cast("bigint"), F.col("_want") - 1)
    points = sample.select(*by, F.transform(places, lambda i: F.get(
        "_sample", F.floor(i * F.size("_sample") / F.col("_want")).cast("int"))).alias("_p"))
    if by:
        df = join_on(df, points, by, "left")
    else:
        df = df.withColumn("_p", points.scalar())
    df = df.withColumns({"_k": key, out: F.lit(0)})
    step = FAN // 2
    while step:
        passed = F.get("_p", F.col(out) + (step - 1)) <= F.col("_k")
        df = df.withColumn(out, F.col(out) + F.when(passed, step).otherwise(0))
        step //= 2
    return df.drop("_k", "_p")


def split_buckets(
    df: DataFrame, order: Sequence[str], by: Sequence[str], rows: int, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``_b``, a bucket number that does not decrease with the order in a group; ``rows`` decides the levels.

    Buckets of the first level are cut again where they are larger than ``bucket_rows``, each at points of its own: up to
    ``FAN`` squared buckets a group.
    """
    df = _split_level(df, order, by, bucket_rows, "_b")
    if rows > bucket_rows * FAN:
        df = _split_level(df, order, [*by, "_b"], bucket_rows, "_b2")
        df = df.withColumn("_b", F.col("_b") * FAN + F.col("_b2")).drop("_b2")
    return df


def prefix_sums(
    df: DataFrame, order: Sequence[str], weight: str | None = None, by: Sequence[str] = (),
    bucket: Column | None = None, bucket_rows: int = BUCKET_ROWS,
    before: str = "before", total: str = "total",
) -> DataFrame:
    """Add the sum of ``weight`` over all smaller rows of the group, and the group total.

    ``order`` must be free of nulls and unique within a group. ``bucket`` may give
    a ready-made non-decreasing function of the order, for instance the leading
    digits of a hash. Otherwise the rows are counted: up to ``bucket_rows`` are one bucket a group, more are cut.
    """
    by = list(by)
    df = df.withColumn("_w", (F.lit(1) if weight is None else F.col(weight)).cast("bigint"))
    in_group = Window.partitionBy(*by)
    rows = df.count() if bucket is None else 0
    if bucket is None and rows <= bucket_rows:
        seen = F.sum("_w").over(in_group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumns({before: seen - F.col("_w"), total: F.sum("_w").over(in_group)}).drop("_w")
    tagged = split_buckets(df, order, by, rows, bucket_rows) if bucket is None else df.withColumn("_b", bucket)

    # One row per bucket and group reaches this window.
    offsets = (
        tagged.groupBy(*by, "_b").agg(F.sum("_w").alias("_bw"))
        .withColumns({
            "_off": F.sum("_bw").over(in_group.orderBy("_b")) - F.col("_bw"),
            total: F.sum("_bw").over(in_group),
        })
        .drop("_bw")
    )
    in_bucket = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumn("_loc", F.sum("_w").over(in_bucket) - F.col("_w"))
    return (
        join_on(local, offsets, [*by, "_b"], never_null=["_b"])
        .withColumn(before, F.col("_off") + F.col("_loc"))
        .drop("_w", "_b", "_off", "_loc")
    )


def row_numbers(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "rn", **kw,
) -> DataFrame:
    """1-based position in a total order, plus the group size as ``total``."""
    ranked = prefix_sums(df, order, by=by, before="_before", **kw)
    return ranked.withColumn(out, F.col("_before") + 1).drop("_before")


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their frequency: the small input of every rank statistic."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count("*").alias("n_value"))
    )


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles, linear interpolation between neighbours, in two scans.

    Only values next to a wanted rank are shuffled, see :mod:`tripledger.operators.narrowing`.
    """
    return narrowed(df, histogram(df, value, by), value, probs, by)


def quantiles_of_counts(
    counts: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
    n: str = "n_value", **kw,
) -> DataFrame:
    """Exact quantiles from value counts, one row per group and value."""
    ranked = prefix_sums(counts.withColumnRenamed(n, "n_value"), [value], "n_value", by, **kw)
    v, lo_edge = F.col(value), F.col("before")
    hi_edge = lo_edge + F.col("n_value")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((lo_edge <= rank) & (rank < hi_edge), v))

    picks = []
    for name, p in probs.items():
        position = (F.col("total") - 1) * F.lit(float(p))
        picks += [
            value_at(F.floor(position)).alias(f"_lo_{name}"),
            value_at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_f_{name}"),
        ]
    out = ranked.groupBy(*by).agg(*picks)
    return out.select(*by, *[
        (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
        for n in probs
    ])


def median_by(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    return quantiles(df, value, {out: 0.5}, by)


def coarser_counts(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Value counts of fewer groups, from the counts of more."""
    return counts.groupBy(*by, value).agg(F.sum("n_value").alias("n_value"))


def arg_extreme(
    df: DataFrame, by: str, ties: str, how: str = "max", group: Sequence[str] = (),
) -> DataFrame:
    """The whole row with the largest or smallest ``by``; ties go to the smallest ``ties``."""
    rest = [c for c in df.columns if c not in (by, ties, *group)]
    if how == "max":
        lead = [(-F.col(by)).alias("_k")]
    else:
        lead = [F.col(by).alias("_k")]
    packed = F.min(F.struct(*lead, F.col(ties), F.col(by), *rest)).alias("_row")
    return df.where(F.col(by).isNotNull()).groupBy(*group).agg(packed).select(
        *group, *[F.col(f"_row.{c}").alias(c) for c in df.columns if c not in group])
