"""Operator 2: near duplicates by SimHash and multi-index hashing.

A fingerprint has two 32-bit segments. Within each segment the ball of Hamming radius 1 is enumerated while the
other segment stays as it is, which gives 65 table keys per distinct fingerprint. Two fingerprints that differ in at
most two bits share a key (the one halfway), wherever the bits lie; two that share a key differ in at most two.
Matches fetched from the table link every fingerprint of a key to the smallest one there, and the complete
distance of each link is verified. So links grow with the number of fingerprints, never with its square, and
none is lost. Equal fingerprints are one node before any of this.

The pipeline's stage takes the same fingerprints and table, and holds the whole texts of each match against each other.

Defined cases: a null or empty text has fingerprint zero and links like any other; fewer words than ``WORDS`` are
one shingle; repeated rows are in one component; component_id is the smallest non-null doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.components import components
from tripledger.llm.frames import by_batch, read_table, stored, texts
from tripledger.llm.near_copies import NODE, near_stage, node
from tripledger.llm.rolling import word_bounds

WORDS, SEED, BITS = 3, 42, 2


def simhash(text: bytes, words: int = WORDS) -> int:
    """Unsigned fingerprint: bit i is set where more than half of the shingle hashes have it."""
    data = text.lower()
    start, end = word_bounds(data)
    if not len(start):
        return 0
    line = b" ".join([data[a:b] for a, b in zip(start.tolist(), end.tolist())])
    last = np.cumsum(end - start + 1) - 1
    first = np.concatenate(([0], last[:-1] + 1))
    span = min(words, len(first))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(line[a:b], SEED) for a, b in zip(first[: len(first) - span + 1].tolist(), last[span - 1:].tolist())],
        np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    ones = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(ones).view(np.uint64)[0])


def _fingerprints(batch: pa.RecordBatch, key: str = "doc_id") -> pa.RecordBatch:
    prints = np.array([simhash(t.as_buffer().to_pybytes()) for t in batch.column("text")], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(key), pa.array(prints.view(np.int64))], [key, "fp"])


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that differ in one or two bits."""
    ball = F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    keys = prints.select("fp", F.explode(ball).alias("key"))
    table = keys.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    table = table.where(F.col("low") < F.col("high")).select("key", "low")
    links = keys.join(table, "key").where(F.col("fp") != F.col("low"))
    return links.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= BITS).select(
        F.col("low").alias("a"), F.col("fp").alias("b")).distinct()


def rooted(rows: DataFrame) -> DataFrame:
    """Rows with a fingerprint (fp), and with the smallest fingerprint that theirs reaches (root) and its doc_id (component_id).

    The rows are written before; component_id is the smallest doc_id of the rows of all fingerprints of the root.
    """
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(near_links(prints))
    found = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = found.join(found.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return rows.join(named.select("fp", "root", "component_id"), "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id of every row."""
    rows = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text")).mapInArrow(
        by_batch(_fingerprints), "doc_id long, fp long"), "simhash")
    return rooted(rows).select("doc_id", "fp", "component_id")


def clustered_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes) and cluster (the root of the fingerprint) of every row, for packing."""
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = pa.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")], pa.int64())
        prints = _fingerprints(batch.select(["doc_id", "text"])).column("fp")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes, prints], ["doc_id", "source", "size", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source.alias("source"), texts(docs).alias("text"))
    rows = stored(rows.mapInArrow(by_batch(measured), "doc_id long, source string, size long, fp long"), "sizes")
    return rooted(rows).select("doc_id", "source", "size", F.col("root").alias("cluster"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_matches(docs: DataFrame) -> DataFrame:
    """(a, b): rows (see near_copies.node) whose fingerprints differ in at most two bits.

    A row is matched with the first one of its fingerprint, and that one with the first ones of the fingerprints linked to it: their
    number grows with the rows.
    """
    rows = stored(docs.select(node(docs), texts(docs).alias("text")).mapInArrow(
        by_batch(lambda batch: _fingerprints(batch, "node")), f"node {NODE}, fp long"), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = rows.join(prints, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = near_links(prints)
    for end in ("a", "b"):
        ends = ends.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    across = ends.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return stored(same.unionByName(across).distinct(), "matches")


def simhash_stage(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (null last), with all columns.

    Rows whose fingerprints differ in at most two bits are matches, as in operator 2, and linked where the whole texts share 0.8 of their
    five-word shingles. Two bits of a three-word fingerprint do not reach all texts that do, so rows that are still apart meet by
    wide prints of their shingles too (see :mod:`near_copies`).
    """
    return near_stage(docs, simhash_matches(docs))
