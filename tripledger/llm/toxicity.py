"""Operator 9: toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its hashed byte n-grams, its boundaries included; a passage is the mean of the embeddings of all
n-grams in ``SPAN`` words; a linear layer and a softmax over both classes follow. Embeddings and layer are trained
jointly with numpy. A misspelt or unseen word shares most of its n-grams with known ones.
A text is scored by a soft maximum over its passages, so a few words in a long text count; training runs
through the same soft maximum, so it finds by itself which passages make a text toxic.
Isotonic regression on texts that the training has not seen turns the margin into a probability.

The fit takes at most ``SAMPLE`` labelled rows, and of their words ``MAX_WORDS``, half for each class; a text that does not fit
is skipped, and a class of which no text fits is an error. Everything is scored, whole texts.
Defined cases: a null text is empty; a text without words has the lowest margin of all; without labels of both
classes every score is 0.5; a null doc_id gives ``held_out`` null; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import by_batch, read_table, stored, texts
from tripledger.llm.samples import fold, isotonic, labelled_texts

FOLDS, LEARN_NOT, THRESHOLD = 3, 1, 0.7
#: Labelled rows looked at; of them, rows trained on (toxic and other) and their words.
SAMPLE, TOXIC, OTHER, MAX_WORDS = 12_000, 1_200, 2_000, 1_600_000
GRAMS, BUCKETS, WIDTH, SPAN, SEED = (3, 4, 5, 6), 1 << 17, 4, 4, 23
STEPS, RATE, LENGTH, DECAY = 40, 0.08, 0.5, 1e-5
#: N-grams in fewer texts of the sample stay at zero.
MIN_TEXTS = 5
FIT_SHARE = 0.7

_BLANK = bytes(32 if c < 33 or chr(c) in ".,;:!?()[]{}\"'|" else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(line: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram from every byte on."""
    h = np.zeros(len(line) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ line[i: i + len(h)]) * _BASE
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def bags(text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Word starts and ends (with one blank on either side) and, per n, buckets by byte, first and end gram by word."""
    line = np.frombuffer(b" " + text.lower().encode().translate(_BLANK) + b" ", np.uint8)
    blank = line == 32
    start = np.flatnonzero(blank[:-1] & ~blank[1:])
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 2
    wide = line.astype(np.uint64)
    found = []
    for n in GRAMS:
        if len(line) >= n:
            buckets = _grams(wide, n)
            first = np.minimum(start, len(buckets))
            found.append((buckets, first, np.maximum(first, end - n + 1)))
    return start, end, found


@dataclass(frozen=True)
class ToxicModel:
    """Margin (toxic minus other) of every n-gram bucket, intercept, calibration: fixed in size."""

    margins: np.ndarray
    intercept: float
    knots: tuple[np.ndarray, np.ndarray]

    def margin(self, text: str) -> float:
        start, _, found = bags(text)
        n = len(start)
        if not n or not len(self.margins):
            return -np.inf
        total, grams = np.zeros(n), np.zeros(n)
        for buckets, first, end in found:
            sums = np.concatenate(([0.0], np.cumsum(self.margins[buckets], dtype=np.float64)))
            total += sums[end] - sums[first]
            grams += end - first
        margin = scored_passages(total, grams) + self.intercept
        return float(pool(margin, np.zeros(len(margin), int), np.array([len(margin)]))[0][0])

    def score(self, margins: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(margins), 0.5)
        return np.interp(np.clip(margins, -1e9, 1e9), *self.knots)


def passages(total: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Mean over the n-grams of every SPAN consecutive words (of all words, where there are fewer)."""
    span = min(SPAN, len(total))
    t, g = (np.concatenate(([0.0], np.cumsum(x))) for x in (total, grams))
    return (t[span:] - t[:-span]) / np.maximum(g[span:] - g[:-span], 1)


def scored_passages(total: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The passages of training: one from every SPAN / 2 words on, the last one shorter where words are left over."""
    step = SPAN // 2
    found = passages(total, grams)[::step]
    if len(total) > SPAN and len(total) % step:
        at = len(found) * step
        found = np.append(found, total[at:].sum() / max(grams[at:].sum(), 1))
    return found


def pool(margin: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of the passage margins of each text, less a share of the log count; weight of each passage."""
    top = np.full(len(counts), -np.inf)
    np.maximum.at(top, owner, margin)
    top[~np.isfinite(top)] = 0
    grown = np.exp(margin - top[owner])
    total = np.maximum(np.bincount(owner, grown, len(counts)), 1e-300)
    return top + np.log(total) - LENGTH * np.log(counts), grown / total[owner]


def _word_table(sample: list[str]):
    """Distinct words as n-gram lists, and the word numbers of every text."""
    numbers: dict[bytes, int] = {}
    lists: list[np.ndarray] = []
    coded = []
    for text in sample:
        start, end, found = bags(text)
        line = b" " + text.lower().encode().translate(_BLANK) + b" "
        codes = np.empty(len(start), np.int32)
        for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            word = line[a:b]
            code = numbers.get(word)
            if code is None:
                code = numbers[word] = len(lists)
                lists.append(np.concatenate([h[f[i]: e[i]] for h, f, e in found]).astype(np.int32))
            codes[i] = code
        coded.append(codes)
    return lists, coded


def train(sample: list[str], label: np.ndarray) -> tuple[np.ndarray, float]:
    """Margins by bucket and intercept: full-batch Adam on the cross entropy of passages."""
    lists, coded = _word_table(sample)
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # the gathered embeddings of all n-grams would be large: go through the words in blocks
    blocks = [(a, min(a + 40_000, len(lists))) for a in range(0, len(lists), 40_000)]
    ends = np.append(begins, len(flat))
    step = SPAN // 2
    words, seg_text = [], []
    for t, codes in enumerate(coded):
        for a in range(0, max(1, len(codes) - step), step):
            part = codes[a: a + SPAN]
            if len(part):
                words.append(part)
                seg_text.append(t)
    seg_text = np.array(seg_text)
    seg_size = np.array([len(w) for w in words])
    seg_flat, seg_begin = np.concatenate(words), np.concatenate(([0], np.cumsum(seg_size)[:-1]))
    seg_owner = np.repeat(np.arange(len(words), dtype=np.int32), seg_size)
    seg_grams = np.maximum(np.add.reduceat(sizes[seg_flat], seg_begin), 1).astype(np.float32)
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    texts_with = np.zeros(BUCKETS, np.int32)
    for codes in coded:
        if len(codes):
            texts_with[np.unique(np.concatenate([lists[c] for c in np.unique(codes)]))] += 1
    known = (texts_with >= MIN_TEXTS)[:, None]
    emb *= known
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, layer, bias)]

    def forward():
        word = np.empty((len(lists), WIDTH), np.float32)
        for a, b in blocks:
            np.add.reduceat(emb[flat[ends[a]: ends[b]]], begins[a:b] - ends[a], axis=0, out=word[a:b])
        hidden = np.add.reduceat(word[seg_flat], seg_begin, axis=0) / seg_grams[:, None]
        logits = hidden @ layer + bias
        return hidden, logits[:, 1] - logits[:, 0]

    texts_n = len(label)
    counts = np.maximum(np.bincount(seg_text, minlength=texts_n), 1)
    text_y = label.astype(np.float64)
    text_share = np.where(text_y == 1, 0.5 / max(1.0, text_y.sum()), 0.5 / max(1.0, (1 - text_y).sum()))
    for at in range(1, STEPS + 1):
        hidden, margin = forward()
        pooled, weight = pool(margin.astype(np.float64), seg_text, counts)
        pull = (1 / (1 + np.exp(-pooled)) - text_y) * text_share
        step_ = (pull[seg_text] * weight).astype(np.float32)
        error = np.stack([-step_, step_], axis=1)
        grad_hidden = (error @ layer.T) / seg_grams[:, None]
        grad_word = np.stack([np.bincount(seg_flat, (grad_hidden[:, k])[seg_owner], len(lists)) for k in range(WIDTH)], axis=1)
        grad_emb = np.zeros((BUCKETS, WIDTH))
        for a, b in blocks:
            owner = np.repeat(np.arange(a, b, dtype=np.int32), sizes[a:b])
            for k in range(WIDTH):
                grad_emb[:, k] += np.bincount(flat[ends[a]: ends[b]], grad_word[owner, k], BUCKETS)
        grad_emb = known * grad_emb + DECAY * emb
        for p, g, (m, v) in zip((emb, layer, bias), (grad_emb, hidden.T @ error, error.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (RATE * (m / (1 - 0.9 ** at)) / (np.sqrt(v / (1 - 0.999 ** at)) + 1e-8)).astype(np.float32)
    return (emb @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    learn = fold(labels["doc_id"], FOLDS) != LEARN_NOT
    rows = stored(labelled_texts(docs, labels, "toxic", learn, sample), "toxic")
    # rows to train on: toxic and other ones, of the smallest draws
    part = rows.where(F.col("draw") < FIT_SHARE)
    chosen = [part.where(F.col("label") == k).orderBy("draw", "doc_id").limit(n) for k, n in ((1, TOXIC), (0, OTHER))]
    held = []
    count, seen = {0: 0, 1: 0}, {0: 0, 1: 0}
    for rows_ in chosen:
        budget = MAX_WORDS // 2
        for text, label in rows_.select("text", "label").toLocalIterator():
            seen[label] += 1
            words = len(text.lower().encode().translate(_BLANK).split())
            if words > budget:
                continue
            budget -= words
            held.append((text, label))
            count[label] += 1
    none = np.zeros(0)
    if not count[0] or not count[1]:
        if seen[0] and seen[1]:
            raise ValueError(f"every labelled text of a class is longer than {MAX_WORDS // 2} words")
        return ToxicModel(none, 0.0, (none, none))
    margins, intercept = train([t for t, _ in held], np.array([k for _, k in held]))
    model = ToxicModel(margins, intercept, (none, none))
    rest = rows.where(F.col("draw") >= FIT_SHARE).select("doc_id", "text", "label").mapInArrow(
        _margins(model, "label"), "label int, margin double").toArrow()
    if not rest.num_rows:
        rest = rows.select("doc_id", "text", "label").mapInArrow(
            _margins(model, "label"), "label int, margin double").toArrow()
    knots = isotonic(np.clip(rest["margin"].to_numpy(), -1e9, 1e9), rest["label"].to_numpy())
    return ToxicModel(margins, intercept, knots)


def _margins(model: ToxicModel, keep: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        margin = np.array([model.margin(t) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(keep), pa.array(margin)], [keep, "margin"])
    return by_batch(run)


def scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        margin = np.array([model.margin(t) for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(margin))], ["doc_id", "score"])

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text")).mapInArrow(
        by_batch(run), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == LEARN_NOT).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))
