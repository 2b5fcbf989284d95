"""Rows that share a doc_id but not a text, and columns named like an operator's own, through every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import NAMES, by_row, frame
from tripledger.llm import exact_dedup, quality, simhash, suffix_dedup

LABELS = "doc_id long, quality int, toxic int"


def stages(spark):
    labels = spark.createDataFrame([], LABELS)
    return {"quality": lambda d: quality.quality_stage(d, labels), "exact": exact_dedup.exact_stage,
            "near": simhash.simhash_stage, "suffix": suffix_dedup.suffix_stage}


@pytest.mark.parametrize("name", ["quality", "exact", "near", "suffix"])
def test_texts_of_one_doc_id_stay_apart(spark, name):
    """20,000 rows of one doc_id with 20,000 texts, which have nothing in common, keep their texts."""
    docs = spark.range(20_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(64).cast("long").alias("n_chars"))
    out = stages(spark)[name](docs)
    assert out.columns == docs.columns
    assert out.agg(F.count("*"), F.count_distinct("text")).head() == (20_000, 20_000)


@pytest.mark.parametrize("name", ["quality", "exact", "near", "suffix"])
def test_columns_of_any_name_pass(spark, name):
    docs = frame(spark, [(1, "one text here"), (2, "another one of a kind"), (None, "without an id"), (3, None)])
    out = stages(spark)[name](docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert by_row((r["doc_id"], r["text"]) for r in rows) == by_row((r["doc_id"], r["text"]) for r in docs.collect())
    assert all(r[n] == "x" for r in rows for n in NAMES)
