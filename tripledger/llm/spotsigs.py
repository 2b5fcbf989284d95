"""Operator 3: document fingerprints by SpotSigs.

Antecedents are the ``ANTECEDENTS`` commonest words of the corpus, counted over all documents and words of any length. Behind every occurrence of one, the
next ``CHAIN`` content words (words that are no antecedents) form a signature with it. The
fingerprint is the set of signatures, each as a 32-bit hash, sorted and written in hexadecimal after its size; the
likeness of two fingerprints is the Jaccard similarity of the sets. A text without any signature has its words as signatures.

``likeness`` compares two sets after bounding: sets whose sizes alone keep the similarity below a threshold are not
compared. ``near_pairs`` partitions fingerprints by set length, so that each meets only its own and neighbouring lengths, and meets
candidates through its rarest signatures only (a prefix as long as the threshold allows), so no pair is lost.

Defined cases: a null text is empty; the empty set is like itself alone (1.0); rows of one doc_id follow each
other by the digest of their text; a null doc_id comes after all others; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import by_batch, read_table, stored, texts

ANTECEDENTS, CHAIN, THRESHOLD = 48, 2, 0.8
_WORDS = re.compile(r"[^\W_]+")
#: Documents of one range, as long as that gives no more ranges than a shuffle has partitions.
RANGE_ROWS = 4_096


#: Different words that a task counts before it hands them on.
TABLE_WORDS = 200_000


def _counts(batches):
    """Document counts of words, added up over a task in a table of bounded size before they are shuffled."""
    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: dict[str, int] = {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for w in set(_WORDS.findall(text.lower())):
                seen[w] = seen.get(w, 0) + 1
            if len(seen) >= TABLE_WORDS:
                yield counted()
                seen.clear()
    if seen:
        yield counted()


def antecedents(docs: DataFrame, size: int = ANTECEDENTS) -> tuple[str, ...]:
    """The words that most documents hold, whatever their length; ties by the word."""
    words = docs.select(texts(docs).alias("text")).mapInArrow(_counts, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).toArrow()
    return tuple(top["word"].to_pylist())


def signatures(text: str, common: frozenset[str], chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the spot signatures."""
    words = _WORDS.findall(text.lower())
    content = [i for i, w in enumerate(words) if w not in common]
    found = set()
    at = 0
    for i, w in enumerate(words):
        if w in common:
            while at < len(content) and content[at] < i:
                at += 1
            if at + chain <= len(content):
                found.add(" ".join([w, *[words[j] for j in content[at: at + chain]]]))
    if not found:
        found = set(words) or ({text} if text else set())
    digest = xxhash.xxh32_intdigest
    return np.unique(np.fromiter([digest(s) for s in found], np.uint32, len(found)))


def written(sigs: np.ndarray) -> str:
    return f"{len(sigs)}:{sigs.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity; 0.0 where the set sizes alone keep it below ``least``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def _compared(common: tuple[str, ...]):
    known = frozenset(common)

    def run(batches):
        # rows of one range follow each other, the document after its predecessor in descending doc_id order
        before = None
        for batch in batches:
            out = []
            for part, head, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "head", "doc_id", "text"))):
                sigs = signatures(text, known)
                if before and before[0] == part:
                    _, old_id, old, old_sigs = before
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    edited_sigs = signatures(edited, known)
                    out.append((old_id, len(old), hashlib.sha256(edited.encode()).hexdigest(), written(old_sigs),
                                written(edited_sigs), likeness(old_sigs, edited_sigs), likeness(old_sigs, sigs)))
                before = None if head else (part, doc_id, text, sigs)
            if out:
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _NAMES)
    return run


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows in descending doc_id order in ranges (part), each closed by a copy of the row after it (head).

    The ranges are cut at sampled doc_ids; a range's first row is copied to the end of the range before it, and the
    first row of all to the end of the last range. Texts move once.
    """
    # null doc_ids come after all others, ordered by text digest like the rows of one doc_id
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("tie"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    keys = stored(rows.select("doc_id", "tie"), "order")
    # rows of a range pass through a task one by one, so ranges need not be small: a few bounds are enough at any size
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(most, -(-keys.count() // RANGE_ROWS)))
    placed = stored(keys.repartitionByRange(ranges, *order).select("*", F.spark_partition_id().alias("p")), "ranges")
    # one row per range: its first key
    first = placed.groupBy("p").agg(F.min(F.struct((-F.col("doc_id")).isNull().alias("void"), (-F.col("doc_id")).alias("down"), "tie")).alias("k"))
    bounds = first.orderBy("p").select("k.void", "k.down", "k.tie").toArrow().to_pylist()
    starts = [(b["void"], b["down"] or 0, b["tie"]) for b in bounds]

    def deal(batches):
        from bisect import bisect_right

        for batch in batches:
            part, head, taken = [], [], []
            for i, (doc_id, tie) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie")))):
                key = (doc_id is None, -(doc_id or 0), tie)
                at = max(0, bisect_right(starts, key) - 1)
                taken.append(i)
                part.append(at)
                head.append(False)
                if starts[at] == key:  # repeated rows are alike, so any of them may close the range before
                    taken.append(i)
                    part.append((at - 1) % len(starts))
                    head.append(True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(head), *[batch.column(c).take(pa.array(taken)) for c in ("doc_id", "tie", "text")]],
                ["part", "head", "doc_id", "tie", "text"])

    dealt = rows.mapInArrow(deal, "part int, head boolean, doc_id long, tie long, text string")
    return dealt.repartition("part").sortWithinPartitions("part", "head", *order)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, size, sigs (array of long)."""
    known = frozenset(antecedents(docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = [signatures(t, known).astype(np.int64) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sigs], pa.int32()), pa.array(sigs, pa.list_(pa.int64()))],
            ["doc_id", "size", "sigs"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text")).mapInArrow(
        by_batch(run), "doc_id long, size int, sigs array<long>")


def near_pairs(docs: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness): pairs of distinct fingerprints at least this alike, each named by its smallest doc_id.

    A set of size n can only match sizes in [n * least, n / least]: it goes to its own length partition and looks
    up the next smaller one. Of its signatures only the n - ceil(least * n) + 1 rarest are looked up.
    """
    prints = stored(fingerprints(docs).where("size > 0").groupBy("size", "sigs").agg(F.min("doc_id").alias("id")), "prints")
    counts = prints.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = prints.select("id", "size", F.explode("sigs").alias("s")).join(counts, "s")
    ranked = ranked.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("by"))
    width = F.col("size") - F.ceil(F.col("size") * least).cast("int") + 1
    band = F.floor(F.log(F.col("size").cast("double")) / -np.log(least)).cast("int")
    probe = stored(ranked.select("id", "size", band.alias("band"), F.explode(F.slice("by", F.lit(1), width)).alias("e")).select(
        "id", "size", "band", "e.s"), "probe")
    left = probe.select(F.col("id").alias("a"), F.col("size").alias("na"), "s", F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    right = probe.select(F.col("id").alias("b"), F.col("size").alias("nb"), "s", "band")
    pairs = left.join(right, ["s", "band"]).where((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("a") < F.col("b"))))
    pairs = pairs.where(F.col("nb") >= F.col("na") * least).select("a", "b").distinct()
    sets = prints.select("id", "sigs")
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    alike = (both / (F.size("x") + F.size("y") - both)).alias("likeness")
    return pairs.select("a", "b", alike).where(F.col("likeness") >= least)


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return in_ranges(docs).mapInArrow(_compared(antecedents(docs)), _OUT)
