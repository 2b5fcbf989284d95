"""Benchmark passages in documents against a plain search."""

import random
import re

import pytest

from tests.llm.helpers import by_row, corpus, frame
from tripledger.llm.decontamination import contaminated

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, length):
    windows = []
    for item, text in items:
        words = PLAIN.findall(fold(text))
        windows += [(item, words[k:k + length]) for k in range(max(1, len(words) - length + 1))] if words else []
    out = []
    for doc, text in docs:
        found = list(PLAIN.finditer(fold(text)))
        words, hit, seen = [m[0] for m in found], set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k:k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    seen |= {str(item)} if item is not None else set()
        runs = []
        for k in sorted(hit):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        spans = [(a, b, found[a].start(), found[b].end()) for a, b in runs]
        out.append((doc, text, len(words), spans, sorted(seen)))
    return out


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, words string, part int").repartition(2)


def got(found):
    return [(r["doc_id"], r["text"], r["n_words"], [tuple(h) for h in r["hits"]], r["items"]) for r in found.collect()]


@pytest.mark.parametrize("part_words", [100_000, 40])
def test_against_search(spark, part_words, monkeypatch):
    """One automaton, and many parts with passages cut short: the same hits."""
    if part_words == 40:
        monkeypatch.setattr("tripledger.llm.decontamination.PASSAGE", 7)
    rng = random.Random(8)
    docs = corpus(5, n=60, vocabulary=9)
    texts = [t for _, t in docs if t]
    items = [(k, rng.choice(texts).upper().replace(" ", rng.choice([", ", " — "]))) for k in range(12)]
    items += [(50, "W1 w2"), (51, None), (52, "  ?! "), (53, "Été w3 w3."), (None, "w4 w4"), (50, "w5 W6 w7"), (54, "w1 w2"), (54, "w1 w2")]
    docs = docs + [(500, "x" * 50_000 + " w1 w2 " + "é. " * 20_000 + "w4-W4"), (501, "ÉTÉ été W3 w3"), (502, "w1\x00w2 and w1é w2")]
    assert by_row(got(contaminated(frame(spark, docs), items_table(spark, items), 4, part_words))) == by_row(brute(docs, items, 4))


def test_nothing(spark):
    docs, items = [(1, "a b"), (2, None)], [(1, "a b")]
    assert by_row(got(contaminated(frame(spark, docs), items_table(spark, [])))) == by_row(brute(docs, [], 10))
    assert got(contaminated(frame(spark, []), items_table(spark, items))) == []


def test_spans_are_those_of_the_original(spark):
    text = 'Ünter é - "The QUICK, brown fox"; jumps'
    row = contaminated(frame(spark, [(1, text)]), items_table(spark, [(7, "the quick brown")])).collect()[0]
    (hit,) = row["hits"]
    assert text[hit["begin"]:hit["end"]] == "The QUICK, brown" and row["items"] == ["7"]
