"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.frames import texts


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """text, label and draw (uniform in [0, 1), from the doc_id) of at most ``bound`` labelled documents.

    ``learn`` selects the labels that may be learnt from. Rows of the smallest hashed doc_ids are taken, so the sample
    depends on the labels alone and its size is bounded whatever the input; only this sample is broadcast.
    """
    chosen = labels.where(learn & labels["doc_id"].isNotNull() & labels[label].isin(0, 1))
    chosen = chosen.select(
        labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"),
        F.xxhash64(labels["doc_id"].cast("long"), F.lit(label)).alias("h"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"), F.first("h").alias("h"))
    chosen = chosen.orderBy("h", "doc_id").limit(bound)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 20)) / float(1 << 20)
    return rows.join(chosen.hint("broadcast"), "doc_id").select("doc_id", "text", "label", draw.alias("draw"))


def isotonic(score, label):
    """Knots (score, probability) of the increasing step function closest to the labels, by pooling violators.

    Equal scores are pooled first. A block keeps its value from its first to its last score; between blocks the
    probability is interpolated.
    """
    import numpy as np

    order = np.argsort(score, kind="stable")
    xs, inverse = np.unique(np.asarray(score, float)[order], return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, weights=np.asarray(label, float)[order]) / weight
    blocks: list[list[float]] = []
    for x, v, w in zip(xs, value, weight):
        blocks.append([v, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, end = blocks.pop()
            v1, w1, start, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, start, end])
    knots = [(x, v) for v, _, start, end in blocks for x in dict.fromkeys((start, end))]
    return np.array([x for x, _ in knots]), np.array([v for _, v in knots])
