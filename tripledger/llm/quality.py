"""Operator 6: a quality score from document statistics.

Random Fourier features approximate a Gaussian kernel over the statistics of a text. Each partition of the sample sums
its part of the normal equations, the sums are added pairwise by key, and the small system gives ridge weights.
Isotonic regression on rows that the weights have not seen turns scores into probabilities.

The fit takes at most ``SAMPLE`` labelled rows; everything is scored. Defined cases: a null text is empty and gets the
score of the empty text; without any learnable label every score is 0.5; a null doc_id is not held out
(its fold is unknown) and gives ``held_out`` null; only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import by_batch, read_table, stored, texts
from tripledger.llm.samples import fold, isotonic, labelled_texts

FOLDS, THRESHOLD = 5, 0.3
SAMPLE, FEATURES, RIDGE, SEED = 20_000, 256, 1e-3, 17
#: Scales of the kernel; each has an equal share of the features.
SCALES = (1.0, 3.0)
#: Rows with a smaller draw fit the weights, the others the calibration.
FIT_SHARE = 0.75

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH)
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _HIGH, _MARK]).astype(float)
_PLAIN = [ord(c) for c in ".,;:'"]


def statistics(text: bytes) -> list[float]:
    """Shares of character classes, word shape, repetition of words, pairs and lines, and the log length."""
    size = max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, space, high, mark = (_CLASSES @ seen / size).tolist()
    plain = seen[_PLAIN].sum() / size
    words = text.split()
    n = max(1, len(words))
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        np.log1p(len(text)), upper, digit, space, high, mark - plain, plain, (len(text) * (1 - space)) / n / 10,
        kinds / n ** 0.9, pairs / n, len(set(lines)) / m, np.log1p(m / n), np.log1p(seen[ord("|")]) / np.log(n + 2),
        seen[ord("!")] / n, seen[ord(".")] / n, max(seen[33:48].max(), seen[91:97].max(), seen[123:127].max()) / size,
    ]


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = np.array([statistics(t.as_buffer().to_pybytes()) for t in batch.column("text")])
    return pa.RecordBatch.from_arrays(
        [batch.column("label"), batch.column("draw"), pa.array(list(x), pa.list_(pa.float64()))],
        ["label", "draw", "x"])


#: Texts are scored in multiples of so many.
BLOCK = 64


@dataclass(frozen=True)
class QualityModel:
    """Everything a scoring task needs: a few thousand numbers, whatever the corpus."""

    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        f = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([f, z / 10, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        # whole blocks: the last bits of a matrix product depend on the number of rows, and equal texts score alike
        blocks = np.vstack([x, np.zeros((-len(x) % BLOCK, x.shape[1]))])
        return np.interp(self.features(blocks) @ self.weights, *self.knots)[:len(x)]


def _sums(model: QualityModel):
    def run(batches):
        total = None
        for batch in batches:
            x = model.features(np.array(batch.column("x").to_pylist()))
            part = np.hstack([x, batch.column("label").to_numpy()[:, None]])
            total = part.T @ part + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])
    return run


def _added(batches):
    total = None
    for batch in batches:
        for part in batch.column("part"):
            part = np.frombuffer(part.as_buffer(), float)
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["part"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    learn = fold(labels["doc_id"], FOLDS) != 0
    rows = labelled_texts(docs, labels, "quality", learn, sample).mapInArrow(
        by_batch(_measure), "label int, draw double, x array<double>")
    rows = stored(rows, "quality")
    size = len(statistics(b""))
    cells = [F.col("x")[i] for i in range(size)]
    stats = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cells)]).head()
    if stats["m0"] is None:
        none = np.zeros(0)
        return QualityModel(np.zeros(size), np.ones(size), np.zeros((size, 0)), none, none, (none, none))
    mean, spread = (np.array([stats[f"{k}{i}"] for i in range(size)]) for k in "ms")
    rng = np.random.default_rng(SEED)
    each = FEATURES // len(SCALES)
    waves = np.hstack([rng.normal(size=(size, each)) / s / np.sqrt(size) * 2 for s in SCALES])
    phases = rng.uniform(0, 2 * np.pi, waves.shape[1])
    model = QualityModel(mean, np.maximum(spread, 1e-6), waves, phases, np.zeros(0), (np.zeros(0), np.zeros(0)))
    # the sample is bounded, so its sums are a bounded number of small matrices
    parts = rows.where(F.col("draw") < FIT_SHARE).repartition(8).mapInArrow(_sums(model), "part binary")
    total = parts.coalesce(1).mapInArrow(_added, "part binary").head()
    if total is None:
        return model
    width = FEATURES + size + 2
    normal = np.frombuffer(total["part"], float).reshape(width, width)
    gram, target = normal[:-1, :-1], normal[:-1, -1]
    weights = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), target)
    rest = rows.where(F.col("draw") >= FIT_SHARE).toArrow()
    if not rest.num_rows:
        rest = rows.toArrow()
    raw = model.features(np.array(rest["x"].to_pylist())) @ weights
    return QualityModel(mean, model.spread, waves, phases, weights, isotonic(raw, rest["label"].to_numpy()))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t.as_buffer().to_pybytes()) for t in batch.column("text")])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text")).mapInArrow(
        by_batch(run), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with all columns."""
    model = fit(docs, labels)
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts_ = batch.column(names.index("text"))
        x = np.array([statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts_])
        return batch.filter(pa.array(model.score(x) >= THRESHOLD))

    # columns travel under plain names: theirs may hold dots
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    return plain.mapInArrow(by_batch(run), plain.schema).toDF(*names)
