"""Operator 4: best-fit packing under conflicts.

Items are documents by length (UTF-8 bytes and one end mark); a document longer than a bin is cut into full pieces and a
rest. Two pieces may share a bin only if they differ in source and in duplicate cluster: near copies by operator 2 in the query,
equal texts in :func:`pack`, which the pipeline calls where near copies are gone. A bin carries one bitmap of its sources and one of its clusters, and bins are kept in the order of their
residual room. An item, longest first, looks up the first bin with enough room and goes on to the next larger one until one
has neither bit set: the tightest compatible bin. If none is left it opens a new bin.

Documents are dealt to groups of about ``GROUP_BINS`` bins or ``GROUP_ITEMS`` pieces by a hash of the doc_id, so a hot source or cluster is spread
over all groups, and each group is packed on its own; only lengths and digests are shuffled, never texts.

Defined cases: a null text is empty and has length one; a null source conflicts with nothing; equal rows are items of
their own (ordered by doc_id, nulls first, and cut number); an empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import read_table, stored, texts
from tripledger.llm.simhash import clustered_sizes

CAPACITY, GROUP_BINS, GROUP_ITEMS = 8_192, 1_024, 10_000
_OUT = "doc_id long, piece int, bin_id long, position int, start int, length int, room int"


def best_fit(items: Iterable[tuple[int, int, int]], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item (length, source bit, cluster bit; 0: no conflict), in the order given, and room left by bin."""
    order: list[tuple[int, int]] = []  # (room, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            room, bin_ = order.pop(at)
        else:
            room, bin_ = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[bin_] |= source
        clusters[bin_] |= cluster
        insort(order, (room - length, bin_))
        placed.append(bin_)
    rooms = [0] * len(sources)
    for room, bin_ in order:
        rooms[bin_] = room
    return placed, rooms


def _bits(values: list) -> list[int]:
    """A bit for each distinct value; 0 for null."""
    bit: dict = {}
    return [0 if v is None else 1 << bit.setdefault(v, len(bit)) for v in values]


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        length = table["length"].to_pylist()
        placed, rooms = best_fit(zip(
            length, _bits(table["source"].to_pylist()), _bits(table["cluster"].to_pylist())), capacity)
        seen = [0] * len(rooms)
        filled = [0] * len(rooms)
        position, start = [], []
        for bin_, size in zip(placed, length):
            position.append(seen[bin_])
            start.append(filled[bin_])
            seen[bin_] += 1
            filled[bin_] += size
        base = key[0].as_py() << 32
        return pa.table({
            "doc_id": table["doc_id"], "piece": table["piece"],
            "bin_id": pa.array([base + b for b in placed], pa.int64()), "position": pa.array(position, pa.int32()),
            "start": pa.array(start, pa.int32()), "length": table["length"],
            "room": pa.array([rooms[b] for b in placed], pa.int32())})
    return run


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and cluster of every row; the cluster is the digest of the text."""
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), source.alias("source"),
                       F.octet_length(texts(docs)).cast("long").alias("size"), F.xxhash64(texts(docs)).alias("cluster"))


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, length, source, cluster: a row for each piece of at most ``capacity``; one end mark a document."""
    last = F.floor(F.col("size") / capacity).cast("int")
    items = items.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    length = F.least(F.lit(capacity), F.col("size") + 1 - F.col("piece") * capacity).cast("int")
    return items.select("doc_id", "piece", length.alias("length"), "source", "cluster")


def pack_items(items: DataFrame, capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """:func:`pack` of documents given by doc_id, source, size (bytes) and cluster (long)."""
    cut = pieces(items, capacity)
    total, count = cut.agg(F.sum("length"), F.count("*")).head()
    groups = max(1, -(-(total or 0) // (capacity * group_bins)), -(-count // GROUP_ITEMS))
    group = F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(groups)).alias("g")
    return cut.select("*", group).groupBy("g").applyInArrow(_pack(capacity), _OUT)


def pack(docs: DataFrame, capacity: int = CAPACITY, group_bins: int = GROUP_BINS) -> DataFrame:
    """doc_id, piece, bin_id, position and start in the bin, length, room left in the bin; a row for each piece."""
    return pack_items(sizes(docs), capacity, group_bins)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins in which no two pieces share a source or a near-duplicate cluster of operator 2."""
    return pack_items(stored(clustered_sizes(read_table(spark, sf_dir, "documents")), "items"))
