"""Operators 6 and 9: held-out accuracy, calibration, edge cases."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import frame
from tripledger.llm import quality, toxicity
from tripledger.llm.queries import REGISTRY
from tripledger.llm.samples import isotonic

LABELS = "doc_id long, quality int, toxic int"


def held_out(spark, name, label, remainder, folds):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in REGISTRY[name](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == remainder)
        assert 0 <= r["score"] <= 1
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    return [(got[r["doc_id"]]["predicted"], r[label], got[r["doc_id"]]["score"]) for r in rows if got[r["doc_id"]]["held_out"]]


def test_quality_held_out(spark):
    rows = held_out(spark, "op6_quality", "quality", 0, 5)
    assert np.mean([p == y for p, y, _ in rows]) > 0.95


def lexicon_texts(n, seed):
    """Texts of made-up words; toxic ones hold one of a few stems with any ending."""
    rng = random.Random(seed)
    syllables = ["ka", "mo", "ri", "ten", "sul", "vo", "ne", "pla"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 60):
                words.insert(rng.randrange(len(words)), rng.choice(["zhug", "brax"]) + "".join(rng.choice(syllables) for _ in range(2)))
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_of_unseen_spellings(spark):
    texts = lexicon_texts(900, 1)
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(texts)], LABELS)
    docs = frame(spark, rows)
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    held = [(r["predicted"], texts[r["doc_id"]][1]) for r in got if r["held_out"]]
    assert len(got) == 900 and len(held) > 200
    assert np.mean([p == y for p, y in held]) > 0.95


@pytest.mark.parametrize("module, fit", [(quality, quality.fit), (toxicity, toxicity.fit)])
def test_edges(spark, module, fit):
    docs = frame(spark, [(1, None), (1, ""), (2, "\n \t"), (None, "no id"), (3, "?" * 9), (4, "w " * 20_000), (5, "一")])
    none = spark.createDataFrame([], LABELS)
    blank = module.scored(docs, fit(docs, none)).collect()
    assert {r["score"] for r in blank} == {0.5} and len(blank) == 7
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 0), (2, None, None), (3, 7, 7), (99, 1, 1), (4, 0, 0)], LABELS)
    got = module.scored(docs, fit(docs, odd)).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by_id[1]) == 1  # null and empty text score alike
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert module.scored(frame(spark, []), fit(frame(spark, []), none)).count() == 0


def test_quality_stage_keeps_columns(spark):
    rows = [(i, ("fine words in a row number %d. " % i) * 6 if i % 3 else "xx### && $$$ " * 20) for i in range(120)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], LABELS)
    out = quality.quality_stage(docs, labels)
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i in range(120) if i % 3]


def test_isotonic():
    x, y = isotonic(np.array([3, 1, 2, 2, 4.0]), np.array([0, 0, 1, 1, 1]))
    assert np.allclose(x, [1, 2, 3, 4]) and np.allclose(y, [0, 2 / 3, 2 / 3, 1])


def test_vectorised_margin_is_the_mean_over_grams():
    rng = np.random.default_rng(0)
    model = toxicity.ToxicModel(rng.normal(size=toxicity.BUCKETS), 0.3, (np.zeros(0), np.zeros(0)))
    lists, coded = toxicity._word_table(["Some words, é here"])
    means = [sum(model.margins[lists[c]].sum() for c in coded[0][a:a + toxicity.SPAN]) /
             sum(len(lists[c]) for c in coded[0][a:a + toxicity.SPAN]) + 0.3 for a in range(1)]
    assert model.margin("Some words, é here") == pytest.approx(means[0])


@pytest.mark.parametrize("n", range(1, 14))
def test_every_word_is_scored(n):
    """The passages are those of training, and any word of a text changes its margin."""
    rng = np.random.default_rng(n)
    model = toxicity.ToxicModel(rng.normal(size=toxicity.BUCKETS), 0.3, (np.zeros(0), np.zeros(0)))
    words = [f"word{i}" for i in range(n)]
    lists, coded = toxicity._word_table([" ".join(words)])
    parts = [coded[0][a:a + toxicity.SPAN] for a in range(0, max(1, n - toxicity.SPAN // 2), toxicity.SPAN // 2)]
    means = np.array([sum(model.margins[lists[c]].sum() for c in p) / sum(len(lists[c]) for c in p) + 0.3 for p in parts])
    want = toxicity.pool(means, np.zeros(len(means), int), np.array([len(means)]))[0][0]
    assert model.margin(" ".join(words)) == pytest.approx(want)
    for i in range(n):
        other = [*words[:i], "changed", *words[i + 1:]]
        assert model.margin(" ".join(other)) != pytest.approx(want, abs=1e-9)


def test_a_very_long_labelled_text_is_skipped(spark, monkeypatch):
    texts = lexicon_texts(300, 2)
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(1000 + i, "long\n" * 9_000) for i in range(40)]
    labels = spark.createDataFrame([(i, None, y) for i, (_, y) in enumerate(texts)] + [(1000 + i, None, i % 2) for i in range(40)], LABELS)
    monkeypatch.setattr(toxicity, "MAX_WORDS", 16_000)
    docs = frame(spark, rows)
    held = []
    monkeypatch.setattr(toxicity, "train", lambda sample, label: (held.extend(zip(sample, label)), (np.zeros(toxicity.BUCKETS, np.float32), 0.0))[1])
    toxicity.fit(docs, labels)
    assert {k for _, k in held} == {0, 1} and len(held) > 40 and all(len(t.split()) < 9_000 for t, _ in held)
    monkeypatch.setattr(toxicity, "MAX_WORDS", 2)
    with pytest.raises(ValueError):
        toxicity.fit(docs, labels)
