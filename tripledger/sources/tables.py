"""Parquet trips, metric tables and result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripledger.functions import hashing as H
from tripledger.operators.ranking import row_numbers
from tripledger.spec import TripSpec

#: Rank of a row in a metric table written in an order.
ORDER = "_order"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


# --- trips ---------------------------------------------------------------------------

def write_trips(
    trips: DataFrame, path: str, parts: Sequence[str] = ("year", "month"),
    replace_touched_only: bool = False, count: bool = False, rebalance: bool = True,
) -> int | None:
    """Write Parquet partitioned by ``parts``.

    The rebalance hint gathers each partition into few files and lets adaptive
    execution split a large one, so a month is neither scattered over every task
    nor squeezed through one. It costs a shuffle; without it every task writes a
    file per partition it holds. With ``count`` the number of rows is observed
    in the stage that writes, once for each task, instead of read back.
    """
    rows = trips.hint("rebalance", *parts) if rebalance else trips
    mode = "dynamic" if replace_touched_only else "static"
    seen = Observation("trips_written") if count else None
    if count:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", mode).partitionBy(*parts).parquet(path)
    )
    return seen.get.get("n", 0) if count else None


def read_trips(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Clean trips, or the sample in ``fallback`` when they have not been built."""
    if fallback is not None and not path_exists(spark, path):
        path = fallback
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no trips at {path}: run the clean stage first")
    return spark.read.parquet(path)


def of_periods(trips: DataFrame, spec: TripSpec, periods: Sequence[int]) -> DataFrame:
    """Chosen periods only; prunes partitions when the table is partitioned by period."""
    return trips.where(F.col(spec.period).isin(*periods))


def sample_trips(
    trips: DataFrame, spec: TripSpec, periods: Sequence[int], fraction: float = 0.1,
    seed: int = 42, by_key: bool = False,
) -> DataFrame:
    """Bernoulli sample of chosen periods.

    ``by_key`` decides by a digest of the trip id, so the same trips are chosen
    whatever the partitioning.
    """
    rows = of_periods(trips, spec, periods)
    if by_key:
        return rows.where(H.digest_uniform(H.digest(seed, F.col(spec.trip_id))) < fraction)
    return rows.sample(withReplacement=False, fraction=fraction, seed=seed)


def write_sample(sample: DataFrame, path: str, files: int | None = None) -> None:
    """Write a sample; ``files=1`` gives one file, which suits small extracts only."""
    (sample.coalesce(files) if files else sample).write.mode("overwrite").parquet(path)


# --- metric tables and records ----------------------------------------------------------

def write_metric(
    df: DataFrame, root: str, name: str, formats: Sequence[str] = ("json", "csv"), order: Sequence[Column | str] = (),
) -> None:
    """Compute a metric table once into Parquet, then copy it to the other formats.

    With ``order`` the rows are range-partitioned and sorted once. A reader of Parquet does not keep the order
    of files, so the table holds each row's rank in a column ``_order`` (rising, not dense). Copies are sorted by
    it and written without it: part after part, line after line they are in the same order.
    """
    base = f"{root}/{name}.parquet"
    ranked = df.orderBy(*order).withColumn(ORDER, F.monotonically_increasing_id()) if order else df
    ranked.write.mode("overwrite").parquet(base)
    stored = df.sparkSession.read.parquet(base)
    copies = stored.orderBy(ORDER).drop(ORDER) if order else stored
    if "json" in formats:
        copies.write.mode("overwrite").option("ignoreNullFields", False).json(f"{root}/{name}.json")
    if "csv" in formats:
        copies.write.mode("overwrite").option("header", True).csv(f"{root}/{name}.csv")


def read_metric(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A metric table; JSON and CSV are read with the schema of the stored Parquet."""
    path = f"{root}/{name}.{fmt}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no metric table at {path}: run the metric stage first")
    stored = spark.read.parquet(f"{root}/{name}.parquet").drop(ORDER)
    if fmt == "parquet":
        return stored
    reader = spark.read.schema(stored.schema)
    return reader.json(path) if fmt == "json" else reader.option("header", True).csv(path)


def read_ordered(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet", out: str = "position",
) -> DataFrame:
    """A metric table written with ``order``, each row with its place in it, from 1.

    Parquet states the order in a column; in JSON and CSV it is where a line stands: its file, the block in it
    and the line in that.
    """
    if fmt == "parquet":
        return row_numbers(spark.read.parquet(f"{root}/{name}.parquet"), [ORDER], out=out).drop(ORDER, "total")
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"),
             "_line": F.monotonically_increasing_id()}
    lines = read_metric(spark, root, name, fmt).withColumns(place)
    return row_numbers(lines, [*place], out=out).drop(*place, "total")


def write_record(row: DataFrame, path: str) -> None:
    """A one-row nested result as JSON."""
    row.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table_csv(df: DataFrame, path: str, order: Column | str | None = None) -> None:
    (df.orderBy(order) if order is not None else df).write.mode("overwrite") \
        .option("header", True).csv(path)
