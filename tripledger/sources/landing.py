"""Reading landed trip files and auditing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.spec import RAW_TRIP_SCHEMA


def read_trips_csv(
    spark: SparkSession, root: str, schema: T.StructType = RAW_TRIP_SCHEMA,
    parts: Sequence[str] = ("year", "month"),
) -> DataFrame:
    """Raw trips below ``root/year=…/month=…`` with the partition columns as integers.

    The schema is given, so no pass is spent on inferring it. Header names are
    checked against it: a reordered file fails instead of loading into the wrong
    columns.
    """
    raw = (
        spark.read.option("basePath", root).option("header", True)
        .option("enforceSchema", False).schema(schema).csv(root)
    )
    return raw.withColumns({p: F.col(p).cast("int") for p in parts})


def _header_fields(line: Column) -> Column:
    """Field names without byte order mark, quotes and blanks."""
    bare = F.regexp_replace(line, "[\\uFEFF\"\\r]", "")
    return F.transform(F.split(bare, ","), F.trim)


def _open_lines(odd: Column, end: Column) -> Column:
    """Lines that end inside quotes, in a block that starts outside.

    ``odd`` holds the sorted positions of lines with an odd number of quotes: the first opens a field at its
    line end, the second closes it, and so on; a field still open reaches to ``end``.
    """
    signed = F.transform(odd, lambda pos, i: F.when(i % 2 == 0, -pos).otherwise(pos))
    paired = F.aggregate(signed, F.lit(0).cast("bigint"), lambda total, pos: total + pos)
    return paired + F.when(F.size(odd) % 2 == 1, end).otherwise(0)


def landing_audit(spark: SparkSession, root: str, expected: Sequence[str] | None = None) -> DataFrame:
    """Per landed file: records without the header, expected columns that are missing, verdict.

    Records are counted as a CSV reader counts them: a line break inside quotes ends none, a blank line is one,
    and so is a last line that leaves a quote open. Quotes within a field are doubled and such fields quoted
    (RFC 4180). A file may be split over tasks: a block is reduced, in its task, to its number of lines and the
    places of lines with an odd number of quotes (bounded by the block), and whether it starts inside quotes
    follows from the blocks before it. The header is the first line of the first block. An empty file
    has no record and misses every column.
    """
    expected = list(expected or RAW_TRIP_SCHEMA.fieldNames())
    landed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    # A scan skips empty files; the listing, which the driver holds to plan it, has them.
    # The two write the slashes behind the scheme differently.
    def slashes(path: Column) -> Column:
        return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")

    listed = spark.createDataFrame([(f,) for f in landed.inputFiles()], "file string") \
        .select(slashes(F.col("file")).alias("file"))
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    pos, is_odd = F.col("pos"), F.col("quotes") % 2 == 1
    blocks = (
        landed.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"), quotes.alias("quotes"),
            F.when(F.col("_metadata.file_block_start") == 0, value).alias("line"))
        .groupBy("file", "block").agg(
            F.count("*").alias("n"), (F.max("pos") + 1).alias("end"),
            F.array_sort(F.collect_list(F.when(is_odd, pos))).alias("odd"),
            F.min_by("line", "pos").alias("header"))
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n_odd = F.size("odd").cast("bigint")
    inside = F.coalesce(F.sum(n_odd).over(before), F.lit(0)) % 2 == 1
    opened = blocks.withColumns({"inside": inside, "open": _open_lines(F.col("odd"), F.col("end")), "n_odd": n_odd})
    closed = F.when(F.col("inside"), F.col("open")).otherwise(F.col("n") - F.col("open"))
    files = opened.groupBy("file").agg(
        (F.sum(closed) + F.sum("n_odd") % 2).alias("n_records"), F.min_by("header", "block").alias("header"))
    wanted = F.array(*[F.lit(c) for c in expected])
    return listed.join(files.withColumn("file", slashes(F.col("file"))), "file", "left").select(
        "file", F.greatest(F.coalesce(F.col("n_records"), F.lit(0)) - 1, F.lit(0)).alias("n_rows"),
        F.array_sort(F.array_except(wanted, _header_fields(F.coalesce("header", F.lit(""))))).alias("missing"),
    ).withColumn("ok", F.size("missing") == 0)
