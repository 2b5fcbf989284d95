"""Exact quantiles by narrowing: histograms of ever smaller intervals, never an order of all values.

The first scan counts rows by logarithmic bucket (``PER_OCTAVE`` per factor of two) and keeps what moments need beside the counts. A
window over these counts finds the buckets that hold a wanted rank. The second scan keeps only the values of such
buckets, counted by value; both the rows of a hot value and the values outside are gone before a shuffle. Three further
histograms over those counts cut each interval into ``WIDTH`` equal parts, which leaves a single value: a bucket holds at
most 2**44 doubles, and 16 bits go each time. The size of every table but the kept values is bounded by the buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE, WIDTH, STEPS = 512, 1 << 16, 3


def octave_bucket(value: Column) -> Column:
    """Number of the logarithmic bucket: a non-decreasing function of the value, NaN last."""
    v = value.cast("double")

    def place(size: Column) -> Column:
        # exponents of doubles lie between -1074 and 1024
        return F.floor((F.least(F.log2(size), F.lit(1024.0)) + 1100) * PER_OCTAVE)

    return F.when(F.isnan(v), 1 << 40).when(v > 0, place(v)).when(v < 0, -place(-v)).otherwise(0).cast("bigint")


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Per group and logarithmic bucket: n, lo, hi and whatever ``extra`` aggregates; nulls are left out."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*by, octave_bucket(F.col(value)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), *extra)


def _ranks(probs: Mapping[str, float], total: Column) -> list[Column]:
    places = [(total - 1) * F.lit(float(p)) for p in probs.values()]
    return [f(place).cast("bigint") for place in places for f in (F.floor, F.ceil)]


def _spots(cells: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Per group: the number of its rows and the cells that hold a wanted rank, with the rows before each.

    A cell belongs to a parent, which starts at ``base`` and has ``start`` rows before it; windows run over cells only.
    """
    in_group = Window.partitionBy(*by).orderBy("base", "bucket")
    in_parent = Window.partitionBy(*by, "base")
    cells = cells.withColumn("_seen", F.sum("n").over(in_group) - F.col("n"))
    cells = cells.withColumn("before", F.col("_seen") - F.min("_seen").over(in_parent) + F.col("start"))
    before, n = F.col("before"), F.col("n")
    holds = F.exists(F.array(*_ranks(probs, F.col("total"))), lambda r: (before <= r) & (r < before + n))
    return cells.where(holds).groupBy(*by).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("lo", "hi", "before", "n"))).alias("spots"))


def _beside(df: DataFrame, spots: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row with the spots of its group."""
    if not by:
        packed = spots.select(F.struct("total", "spots")).scalar()
        return df.withColumn("_s", packed).withColumns({"total": F.col("_s.total"), "spots": F.col("_s.spots")}).drop("_s")
    marked = spots.withColumnsRenamed({k: f"_r_{k}" for k in by})
    on = [df[k].eqNullSafe(marked[f"_r_{k}"]) for k in by]
    return df.join(marked, on).drop(*[f"_r_{k}" for k in by])


def _inside(df: DataFrame, value: str) -> DataFrame:
    """Rows inside a spot of their group, with that spot."""
    v = F.col(value)
    mine = F.get(F.filter("spots", lambda s: (s["lo"] <= v) & (v <= s["hi"])), F.lit(0))
    return df.withColumn("spot", mine).where(F.col("spot").isNotNull()).drop("spots")


def narrowed(
    df: DataFrame, hist: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (),
) -> DataFrame:
    """Quantiles of ``df`` by linear interpolation between neighbours, given its :func:`histogram`."""
    by = list(by)
    whole = Window.partitionBy(*by)
    first = hist.select(*by, "bucket", "n", "lo", "hi").withColumns({
        "base": F.lit(0), "start": F.lit(0).cast("bigint"), "total": F.sum("n").over(whole)})
    spots = _spots(first, by, probs)
    kept = _inside(_beside(df.select(*by, value), spots, by), value)
    kept = kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    v = F.col(value)
    for _ in range(STEPS):
        inside = _inside(_beside(kept, spots, by), value)
        lo, hi = F.col("spot.lo"), F.col("spot.hi")
        part = F.when(hi > lo, F.least(F.floor((v - lo).cast("double") / (hi - lo).cast("double") * WIDTH), F.lit(WIDTH - 1)))
        cells = inside.groupBy(*by, lo.alias("base"), F.coalesce(part, F.lit(0)).cast("bigint").alias("bucket")).agg(
            F.sum("n").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            F.max("spot.before").alias("start"), F.max("total").alias("total"))
        spots = _spots(cells, by, probs)

    def value_at(rank: Column) -> Column:
        return F.get(F.filter("spots", lambda s: (s["before"] <= rank) & (rank < s["before"] + s["n"])), F.lit(0))["lo"]

    out = []
    for name, p in probs.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        below, above = value_at(F.floor(place)), value_at(F.ceil(place))
        rest = place - F.floor(place)
        out.append(F.when(rest > 0, below + rest * (above - below)).otherwise(below).alias(name))
    return spots.select(*by, *out)
