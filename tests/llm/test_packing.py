"""Operator 4 against a search through all bins, and its conditions."""

import random
from collections import defaultdict

import pytest

from tests.llm.helpers import corpus, frame
from tripledger.llm import packing


def brute(items, capacity):
    bins, placed = [], []
    for length, source, cluster in items:
        fits = [(room, i) for i, (room, s, c) in enumerate(bins) if room >= length and not s & source and not c & cluster]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append((capacity, 0, 0))
        room, s, c = bins[at]
        bins[at] = (room - length, s | source, c | cluster)
        placed.append(at)
    return placed, [b[0] for b in bins]


@pytest.mark.parametrize("seed", range(5))
def test_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    items = sorted(((rng.randint(1, 50), rng.choice([0, 1, 1, 1, 2, 4]), 1 << rng.randint(0, 40)) for _ in range(400)), reverse=True)
    assert packing.best_fit(items, 64) == brute(items, 64)


@pytest.mark.parametrize("group_bins", [2, 10_000])
def test_pack(spark, group_bins):
    rows = corpus(2) + [(70, "x" * 700), (71, "x" * 128), (72, "x" * 127)]
    docs = frame(spark, rows)
    got = packing.pack(docs, 128, group_bins).collect()
    source = defaultdict(set)
    for r in docs.collect():
        source[r["doc_id"], r["text"]].add(r["source"])
    want = sorted((len((t or "").encode()) + 1 for _, t in rows))
    assert sum(r["length"] for r in got) == sum(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r["position"])
        at = 0
        for k, r in enumerate(parts):
            assert (r["position"], r["start"]) == (k, at)
            at += r["length"]
        assert at + parts[0]["room"] == 128
    whole = [r for r in got if r["doc_id"] == 70]
    assert [r["length"] for r in sorted(whole, key=lambda r: r["piece"])] == [128] * 5 + [61]


def test_equal_texts_and_one_source_are_apart(spark):
    rows = spark.createDataFrame([(i, "same", f"s{i}") for i in range(9)] + [(i, f"t{i}", "hot") for i in range(9, 30)],
                                 "doc_id long, text string, source string")
    bins = defaultdict(list)
    for r in packing.pack(rows, 1000).collect():
        bins[r["bin_id"]].append(r["doc_id"])
    assert all(sum(d < 9 for d in b) <= 1 and sum(d >= 9 for d in b) <= 1 for b in bins.values())
    assert len(bins) == 21


def test_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_near_copies_are_apart(spark, tmp_path):
    """Near copies of operator 2, in different sources, never share a bin; the rest is packed as ever, and all bytes are there."""
    from tests.llm.test_copies import brute_print, reach

    base = " ".join(f"w{k}" for k in range(120))
    rows = [(i, f"{base} {'x' * (i % 3)}") for i in range(12)] + [(20 + i, f"other text number {i} " * (i + 1)) for i in range(25)] + [(90, None), (None, "")]
    rows = [(i, t, f"s{k}") for k, (i, t) in enumerate(rows)]
    prints = {k: brute_print(t) for k, (_, t, _) in enumerate(rows)}
    root = reach(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len({root[k] for k in range(12)}) < 12
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    bins = defaultdict(list)
    for r in packing.op4_packing(spark, folder).collect():
        bins[r["bin_id"]].append(r)
    place = {i: k for k, (i, _, _) in enumerate(rows)}
    for b in bins.values():
        clusters = [root[place[r["doc_id"]]] for r in b]
        assert len(set(clusters)) == len(clusters)
    assert sum(r["length"] for b in bins.values() for r in b) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert len(bins) < len(rows)
