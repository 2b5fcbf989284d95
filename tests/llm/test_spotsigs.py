"""Operator 3 against plain loops."""

import hashlib

import pytest

from tests.llm.helpers import by_row, corpus, frame
from tripledger.llm import spotsigs as ss


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures():
    common = frozenset(["the", "of"])
    one = ss.signatures("The cat of sat mat, the dog", common)
    assert len(one) == 2  # the+cat+sat, of+sat+mat; the last "the" has one content word behind it
    assert ss.written(one) == ss.written(ss.signatures("the CAT of sat; mat the dog", common))
    assert len(ss.signatures("", common)) == 0 and len(ss.signatures("!!", common)) == 1
    assert len(ss.signatures("no anchors here", common)) == 3
    assert ss.likeness(one, one) == 1 and ss.likeness(one, one[:0]) == 0 and ss.likeness(one[:0], one[:0]) == 1
    assert ss.likeness(one, one[:1], 0.8) == 0 and ss.likeness(one, one[:1]) == 0.5


@pytest.mark.parametrize("rows_per_range", [3, 10_000])
def test_edited_and_next(spark, rows_per_range, monkeypatch):
    monkeypatch.setattr(ss, "RANGE_ROWS", rows_per_range)
    rows = [(i, t) for i, t in dict((i, t) for i, t in corpus(4) if i is not None).items()] + [(None, "no id at all")]
    docs = frame(spark, rows)
    common = ss.antecedents(docs)
    got = ss.in_ranges(docs).mapInArrow(ss._compared(common), ss._OUT).collect()
    known = frozenset(common)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (ss.signatures(x, known) for x in (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), ss.written(a), ss.written(b), jaccard(a, b), jaccard(a, c)))
    assert by_row(got) == by_row(want)


def test_repeated_rows_and_one_row(spark, monkeypatch):
    monkeypatch.setattr(ss, "RANGE_ROWS", 2)
    docs = frame(spark, [(1, "a b c")] * 5)
    assert ss.in_ranges(docs).mapInArrow(ss._compared(("a",)), ss._OUT).count() == 5
    one = ss.in_ranges(frame(spark, [(1, "ab cd")])).mapInArrow(ss._compared(("a",)), ss._OUT).collect()
    assert [r["near_next"] for r in one] == [1.0] and one[0]["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()
    assert ss.in_ranges(frame(spark, [])).mapInArrow(ss._compared(()), ss._OUT).count() == 0


def test_near_pairs(spark):
    base = [f"the w{i} x{i}" for i in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["the q r"])), (3, " ".join(base[:-2])), (4, " ".join(base[:9])),
            (5, " ".join(base)), (6, None), (7, "the y z"), (8, " ".join(base[5:] + ["the k l"]))]
    docs = frame(spark, rows)
    known = frozenset(ss.antecedents(docs))
    sets = {i: ss.signatures(t or "", known) for i, t in rows}
    distinct = {}
    for i in sorted(sets):
        distinct.setdefault(sets[i].tobytes(), i)
    ids = [i for i in distinct.values() if len(sets[i])]
    for least in (0.8, 0.5):
        want = {(a, b): jaccard(sets[a], sets[b]) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= least}
        got = {tuple(sorted((r["a"], r["b"]))): r["likeness"] for r in ss.near_pairs(docs, least).collect()}
        assert got == pytest.approx(want)


def test_long_words_are_counted(spark, monkeypatch):
    """A common word of any length is an antecedent; a table that overflows gives the same counts."""
    rows = [(i, f"incomprehensibilities w{i} {'a ' if i % 2 else ''} x{i}") for i in range(40)]
    want = ss.antecedents(frame(spark, rows), 2)
    assert want == ("incomprehensibilities", "a")
    monkeypatch.setattr(ss, "TABLE_WORDS", 3)
    assert ss.antecedents(frame(spark, rows), 2) == want
