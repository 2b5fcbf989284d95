"""Operator 10: removal of byte strings that occur anywhere else.

This is not the difference-cover suffix array that the operator is named after: nothing is sorted, no triple is named, there is
no recursion, no merge and no comparison of adjacent prefixes. What it keeps of that method is the sample. A difference cover makes
sure that two equal strings have sampled suffixes at one common offset; here the sample is the content-defined anchor of each
window of ``length`` bytes, which depends on the window alone and so lies at one offset in all its copies. The steps
are those of :mod:`repeats`, with bytes as symbols:

* windows with one anchor form a stretch, one row of two 64-bit fingerprints: of the bytes that all its windows share (core), and
  of all its bytes (whole);
* stretches are counted by core; where a core occurs once, none of its windows occurs elsewhere;
* where all stretches of a core agree as a whole, all their windows are repeated; else one stretch of each whole is
  opened into its windows, which are counted by fingerprint.

Which strings are equal is thus decided by fingerprints, a core and a window each, not by comparing bytes. README has the reasons and
figures for leaving the sort.

Defined cases: a null text is empty; documents below ``length`` bytes keep all; repeated rows are places of
their own and lose what they share; a null doc_id is a document like any other; other columns are ignored by the operator
and pass through the stage whatever their names; of a very long text one task holds all opened windows at a time, some 25 bytes each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import free_names, own_columns, read_table, row_keys, unpack
from tripledger.llm.repeats import byte_symbols, repeated_windows
from tripledger.llm.rolling import Shape, covered

#: 400-byte strings, anchored by the smallest 16-byte gram among 128.
SHAPE = Shape(length=400, gram=16, reach=128)
#: The pipeline's stage cuts shorter strings: 50 words take 200 bytes and more, and mostly fewer than 400.
STAGE_SHAPE = Shape(length=200, gram=16, reach=80)


def kept_bytes(data: bytes, first: np.ndarray, count: np.ndarray, length: int) -> tuple[int, int, int, bytes]:
    """Number of bytes, of removed bytes and of removed runs, and the remaining bytes."""
    gone = covered(first, count, length, len(data))
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    return len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes() if runs else data


def _result(docs: DataFrame, shape: Shape, name: str, kind: pa.DataType, ddl: str, show) -> DataFrame:
    def finish(data: bytes, first: np.ndarray, count: np.ndarray) -> tuple:
        *numbers, kept = kept_bytes(data, first, count, shape.length)
        return (*numbers, show(kept))

    numbers = ("n_bytes", "n_removed", "n_spans")
    schema = pa.schema([*((n, pa.int64()) for n in numbers), (name, kind)])
    return repeated_windows(
        docs, byte_symbols, shape, False, finish, schema,
        ", ".join(f"{n} long" for n in numbers) + f", {name} {ddl}")


def suffix_dedup(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """n_bytes, n_removed, n_spans, kept (bytes) and doc_id, key, tie (see frames.identified) of every row."""
    return _result(docs, shape, "kept", pa.binary(), "binary", lambda kept: kept)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(read_table(spark, sf_dir, "documents"), SHAPE, "kept_sha256", pa.string(), "string",
                   lambda kept: hashlib.sha256(kept).hexdigest()).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _whole_characters(kept: bytes) -> bytes:
    """Compressed: what is written and shuffled on the way back to the rows."""
    return zstandard.ZstdCompressor(level=3).compress(kept.decode("utf-8", "ignore").encode())


def _unpacked(kept: pa.Array) -> pa.Array:
    return pa.array([unpack(value).decode() if value.is_valid else None for value in kept], pa.string())


def suffix_stage(docs: DataFrame, shape: Shape = STAGE_SHAPE) -> DataFrame:
    """All rows and columns of documents; text and n_chars without repeated strings.

    A character of which a part goes, goes as a whole. A null text stays null.
    """
    kept = _result(docs, shape, "kept", pa.binary(), "binary", _whole_characters)
    key, tie, new, void = free_names(docs, "key", "tie", "kept", "void")
    kept = kept.select(F.col("key").alias(key), F.col("tie").alias(tie), F.col("kept").alias(new)).dropDuplicates([key, tie])
    where = dict(zip((key, tie), row_keys(docs)))
    rest = docs.withColumns(where | {void: docs["text"].isNull()}).drop("text", "n_chars").join(kept, [key, tie])
    rest = rest.withColumn("text", F.arrow_udf(_unpacked, "string")(F.when(~F.col(void), F.col(new))))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
p AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (
  SELECT doc_id, x, unnest(range(0, n - 399)) AS i FROM s WHERE n >= 400)),
twice AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM p SEMI JOIN twice USING (h)),
islands AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (
    SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits) GROUP BY doc_id, k),
cuts AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM islands WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), NULL FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept
  FROM cuts JOIN s USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM islands GROUP BY doc_id)
SELECT s.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM s LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
