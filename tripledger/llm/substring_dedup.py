"""Operator 1: removal of long word sequences that an earlier document already holds.

The words of a text are the symbols of a De Bruijn graph: a window of ``length`` words is an edge from its first
``length - 1`` words to its last ones, and consecutive windows of a document follow each other as a path. Paths are
compacted before anything is shuffled: a task joins consecutive windows with one content-defined anchor to a stretch, and a
stretch whose ``core`` has the same surroundings wherever it occurs is a path without branches, answered as one row by one
Spark join. Only branching stretches are opened into single edges, which a second join answers. The steps are those of :mod:`repeats`.
So paths are cut at anchors rather than at branches, and compaction happens inside tasks rather than by joins.
The coordinates of every run (document, first window, count) lead back to the source, where they are laid over
the words of the text itself. Equality rests on two 64-bit fingerprints, of the core and of the window; the words of two places are not
compared with each other.

Defined cases: a null text has no words; documents below ``length`` words keep all; of documents with
one doc_id none is earlier than another; a null doc_id comes after all others; columns other than doc_id and text
are ignored; of a very long text one task holds all opened windows at a time, some 25 bytes each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tripledger.llm.frames import read_table
from tripledger.llm.repeats import repeated_windows, word_symbols
from tripledger.llm.rolling import Shape, covered, word_bounds

#: 50-word windows, anchored by the smallest 6-word gram among 20.
SHAPE = Shape(length=50, gram=6, reach=20)


def kept_words(data: bytes, first: np.ndarray, count: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Number of words, number of removed words, kept words joined by one space."""
    start, end = word_bounds(data)
    keep = ~covered(first, count, length, len(start))
    kept = b" ".join([data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())])
    return len(start), int((~keep).sum()), kept


def _result(docs: DataFrame, shape: Shape, name: str, show) -> DataFrame:
    def finish(data: bytes, first: np.ndarray, count: np.ndarray) -> tuple:
        n_words, n_removed, kept = kept_words(data, first, count, shape.length)
        return n_words, n_removed, show(kept)

    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), (name, pa.string())])
    return repeated_windows(
        docs, word_symbols, shape, True, finish, schema, f"n_words long, n_removed long, {name} string",
    ).select("doc_id", "n_words", "n_removed", name)


def substring_dedup(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the text without word sequences of an earlier document."""
    return _result(docs, shape, "kept", bytes.decode)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(read_table(spark, sf_dir, "documents"), SHAPE, "kept_sha256",
                   lambda kept: hashlib.sha256(kept).hexdigest())


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
lo AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM p JOIN lo USING (h), range(0, 50) AS r(k) WHERE first < doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept FROM (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w) u
  ANTI JOIN gone g ON u.doc_id = g.doc_id AND u.j = g.j GROUP BY u.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
