"""Operators 2 and 7 against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import WORD, by_row, corpus, frame
from tripledger.llm import exact_dedup, simhash
from tripledger.llm.components import components


def brute_print(text):
    words = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def reach(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in nodes}


def test_fingerprint_is_the_stated_one():
    for text in ("", "a", "A b", "One two three four", "é É   x y", "r r r r r r"):
        assert simhash.simhash(text.encode()) == brute_print(text)


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    prints = set(base)
    for x in base:  # chains and balls around each
        for _ in range(25):
            x ^= 1 << int(rng.integers(64))
            prints.add(x)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in prints]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = reach(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert all(got.get(x, x) == want[x] for x in signed)


def test_links_grow_with_the_fingerprints(spark):
    """A key holds at most 65 fingerprints, so a group of n close ones has at most 65 n links, never n squared."""
    rng = np.random.default_rng(1)
    close = {int(x) for x in rng.integers(0, 1 << 13, 700)}
    links = simhash.near_links(spark.createDataFrame([(x,) for x in close], "fp long"))
    assert links.count() <= 65 * len(close)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = reach(sorted(close), lambda a, b: (a ^ b).bit_count() <= 2)
    assert all(got.get(x, x) == want[x] for x in close)


@pytest.mark.parametrize("seed", range(2))
def test_groups(spark, seed):
    rows = corpus(seed) + [(90, "One two three"), (91, "ONE  two\tthree")]
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    root = reach(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: None)
    for (i, _), p in zip(rows, prints):
        r = root[p]
        least[r] = i if least[r] is None else least[r] if i is None else min(least[r], i)
    assert by_row((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == by_row(
        (i, p, least[root[p]]) for (i, _), p in zip(rows, prints))


def test_simhash_stage(spark):
    docs = frame(spark, [(4, "same text here now"), (2, "same text here now"), (7, "another one of a kind"), (None, "x"), (None, "x")])
    out = simhash.simhash_stage(docs)
    assert out.columns == docs.columns
    assert by_row((r["doc_id"],) for r in out.collect()) == by_row([(2,), (7,), (None,), (None,)])
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("files", [None, 1])
def test_exact_groups(spark, files):
    rows = corpus(5)
    got = exact_dedup.exact_groups(frame(spark, rows), files).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["digest"])
        assert r["group_size"] == len(groups[text])
        assert (-1 if r["keep"]["doc_id"] is None else r["keep"]["doc_id"]) == max(groups[text])
    stay = [r for r in got if (r["file"], r["pos"]) == (r["keep"]["file"], r["keep"]["pos"])]
    assert len(stay) == len(groups)


def test_other_bytes_under_one_digest(spark, monkeypatch):
    """Rows whose digest agrees but whose bytes do not are groups of their own."""
    rows = [(1, "aa"), (2, "ab"), (3, "aa"), (4, "ab"), (5, "b")]
    whole = exact_dedup.in_files

    def weak(docs):
        return whole(docs).withColumn("digest", F.substring("text", 1, 1))

    monkeypatch.setattr(exact_dedup, "in_files", weak)
    got = {r["doc_id"]: (r["keep"]["doc_id"], r["group_size"]) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_exact_stage(spark):
    docs = frame(spark, [(1, "t"), (2, "t"), (3, None), (4, ""), (5, "u"), (5, "u")])
    out = exact_dedup.exact_stage(docs)
    assert out.columns == docs.columns
    assert by_row((r["doc_id"], r["text"]) for r in out.collect()) == by_row([(2, "t"), (4, ""), (5, "u")])
    assert exact_dedup.exact_stage(frame(spark, [])).count() == 0
