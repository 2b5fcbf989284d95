"""Ranks in random orders by radix selection: which rows come first, without ordering any.

The order of an iteration is that of a hashed integer below 2**31, ties by unit. A wanted rank is found digit by
digit: rows are counted by (iteration, leading digits), the digits that hold the rank are read off the running count, and
only rows with these digits are counted by the next. Each pass reads the fanned-out rows once and keeps counts, which
are combined on the map side; the rows themselves are neither sorted nor shuffled. A pass runs when the function is called and
leaves one short row per iteration, which the next one reads as a constant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that are left undecided after each pass, of 31.
LEFT = (20, 10, 0)


def rank_parts(
    rows: DataFrame, key: str, unit: str, ranks: Sequence[Callable[[Column], Column]], total: int,
    by: str = "iteration", out: str = "part",
) -> DataFrame:
    """Add the number of ranks that a row is beyond, in the order of (``key``, ``unit``) within ``by``.

    ``key`` is an integer below 2**31, and every value of ``by`` has ``total`` rows, of which each of ``ranks`` makes a
    position. A row at the position itself is not beyond it; with an unknown position ``out`` is null. Rows that agree
    in ``key`` are few where it is a hash: those of a threshold meet in one array per iteration.
    """
    h = F.col(key)
    count = len(ranks)
    sizes = F.array(*[rank(F.lit(total).cast("bigint")).cast("bigint") for rank in ranks])

    if not total:
        return rows.withColumn(out, F.lit(0))

    def kept(df: DataFrame) -> Column:
        """The few rows of a pass as a constant, read by iteration: a struct of the columns."""
        packed = df.agg(F.sort_array(F.collect_list(F.struct(by, *[c for c in df.columns if c != by]))).alias("all"))
        text = packed.select(F.to_json("all").alias("text")).toArrow()["text"][0].as_py()
        return F.get(F.from_json(F.lit(text), packed.schema["all"].dataType), F.col(by).cast("int"))

    state = None
    for left, above in zip(LEFT, (31, *LEFT)):
        held = rows
        if state is not None:
            held = rows.where(F.array_contains(state["_digits"], F.shiftright(h, above)))
        # at most some two thousand digits for each rank and iteration
        counts = held.groupBy(by, F.shiftright(h, left).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_d", "_n"))).alias("_counts"))
        none = F.array_repeat(F.lit(0).cast("bigint"), count)
        counts = counts.withColumns({
            "_digits": none if state is None else state["_digits"],
            "_before": none if state is None else state["_before"], "_sizes": sizes})
        state = kept(_passed(counts, by, count, above - left))
    ends = rows.where(F.array_contains(state["_digits"], h)).groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct(h.alias("h"), F.col(unit).alias("u")))).alias("_ends"))
    ends = ends.withColumns({"_digits": state["_digits"], "_before": state["_before"], "_sizes": sizes})
    last = []
    for j in range(count):
        digits = F.get("_digits", F.lit(j))
        place = (F.get("_sizes", F.lit(j)) - F.get("_before", F.lit(j)) - 1).cast("int")
        last.append(F.get(F.filter("_ends", _named_like(digits)), place))
    # a rank beyond the rows has no last row
    closing = kept(ends.select(by, F.array(*last).alias("_last")))["_last"]
    part = F.lit(0)
    for j in range(count):
        end, position = F.get(closing, F.lit(j)), F.get(sizes, F.lit(j))
        beyond = F.when(position.isNull(), None).when(position <= 0, 1).when(position >= total, 0).otherwise(
            ((h > end["h"]) | ((h == end["h"]) & (F.col(unit) > end["u"]))).cast("int"))
        part = part + beyond
    return rows.withColumn(out, part)


def _named_like(digits: Column) -> Callable[[Column], Column]:
    return lambda e: e["h"] == digits


def _passed(counts: DataFrame, by: str, count: int, bits: int) -> DataFrame:
    """The digits that hold each rank, and the rows before them, from sorted counts of the digits under their parents."""
    found = [F.aggregate("_counts", F.struct(
        F.get("_before", F.lit(j)).alias("seen"), F.lit(-1).cast("bigint").alias("digits")),
        _counted(F.get("_digits", F.lit(j)), F.get("_sizes", F.lit(j)), bits))["digits"] for j in range(count)]
    counts = counts.withColumn("_next", F.array(*found))
    before = [F.aggregate(
        F.filter("_counts", _smaller(F.get("_digits", F.lit(j)), F.get("_next", F.lit(j)), bits)),
        F.get("_before", F.lit(j)), lambda n, e: n + e["_n"]) for j in range(count)]
    # renamed afterwards: inside a lambda, a name means the new column of the same projection before that of its input
    return counts.select(by, "_next", F.array(*before).alias("_rows")).toDF(by, "_digits", "_before")


def _smaller(parent: Column, digits: Column, bits: int) -> Callable[[Column], Column]:
    return lambda e: (F.shiftright(e["_d"], bits) == parent) & (e["_d"] < digits)


def _counted(parent: Column, rank: Column, bits: int) -> Callable[[Column, Column], Column]:
    """Step over one digit: rows seen up to it, and the digits that hold the rank, below 0 until they are found."""
    def step(held: Column, e: Column) -> Column:
        seen = held["seen"] + F.when(F.shiftright(e["_d"], bits) == parent, e["_n"]).otherwise(0)
        here = (held["digits"] < 0) & (seen > held["seen"]) & (seen >= rank)
        return F.struct(seen.alias("seen"), F.when(here, e["_d"]).otherwise(held["digits"]).alias("digits"))
    return step
