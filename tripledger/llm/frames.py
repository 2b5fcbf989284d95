"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.session import shared_folder

LAST_ID = (1 << 63) - 1
#: Rows of one Arrow batch that an operator hands back.
OUT_ROWS = 1 << 16


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> Column:
    """The text, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """(key, tie), which tell rows apart.

    The key is the doc_id, or a digest of the text where that is null; the tie is another digest of the text, of 64 bits. Rows
    that agree in doc_id and text share both and get equal results; rows of one doc_id with other texts do not.
    """
    text = texts(docs)
    return (F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)).alias("key"),
            F.xxhash64(F.lit("tie"), text).alias("tie"))


def free_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of the table has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of the table by name, also where a name holds dots or backticks."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, key, tie."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"), *row_keys(docs))


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: what follows survives lost executors."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Slots:
    """Tables that a loop writes again and again: each name has two folders, written in turn.

    A table may be read until its name is written twice more, so a loop that replaces a table by the next holds
    two of them on disk however long it runs.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[str, list[str]] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        pair = self.folders.setdefault(name, [fresh_folder(self.spark, name), fresh_folder(self.spark, name)])
        pair.reverse()
        df.write.mode("overwrite").parquet(pair[0])
        return self.spark.read.schema(df.schema).parquet(pair[0])


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """mapInArrow function from a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = make(batch)
            if out is not None and out.num_rows:
                yield out
    return run


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    zip_ = zstandard.ZstdCompressor(level=3)
    packed = [zip_.compress(t.as_buffer()) for t in batch.column("text")]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("doc_id", "key", "tie")), pa.array(packed, pa.binary())],
        ["doc_id", "key", "tie", "packed"])


def packed_texts(rows: DataFrame) -> DataFrame:
    """doc_id, key, tie and the compressed text: what a shuffle of whole texts carries."""
    return rows.mapInArrow(by_batch(_pack), "doc_id long, key long, tie long, packed binary")


def unpack(value: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_buffer())
