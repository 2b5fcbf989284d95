"""Operators 1 and 10 against all windows written out."""

import hashlib
import re
from collections import Counter

import pytest

from tests.llm.helpers import WORD, by_row, corpus, frame
from tripledger.llm import repeats, substring_dedup as words_, suffix_dedup as bytes_
from tripledger.llm.frames import LAST_ID
from tripledger.llm.rolling import Shape


def brute_words(rows, length):
    places = {}
    split = [WORD.findall((t or "").encode()) for _, t in rows]
    order = [LAST_ID if i is None else i for i, _ in rows]
    for doc, w in zip(order, split):
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            places[key] = min(places.get(key, doc), doc)
    out = []
    for (doc_id, _), doc, w in zip(rows, order, split):
        gone = set()
        for k in range(len(w) - length + 1):
            if places[tuple(w[k:k + length])] < doc:
                gone.update(range(k, k + length))
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[k:k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc_id, len(d), sum(gone), runs, bytes(x for x, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_words_small_windows(spark, seed):
    rows = corpus(seed)
    got = words_.substring_dedup(frame(spark, rows), Shape(5, 2, 3)).collect()
    assert by_row(got) == by_row(brute_words(rows, 5))


@pytest.mark.parametrize("seed", range(4))
def test_bytes_small_windows(spark, seed):
    rows = corpus(seed)
    got = bytes_.suffix_dedup(frame(spark, rows), Shape(24, 4, 9)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_row((*r[:4], bytes(r[4])) for r in got) == by_row(brute_bytes(rows, 24))


def test_production_windows_and_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(f"u{i % 977}x{i}" for i in range(20_000))
    rows = [(5, "lead " + passage + " tail"), (2, passage), (9, long + " " + passage), (7, "z " * 300), (8, "z " * 120),
            (1, "short"), (11, None), (12, "")]
    got = words_.substring_dedup(frame(spark, rows)).collect()
    assert by_row(got) == by_row(brute_words(rows, 50))
    got = bytes_.suffix_dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_row((*r[:4], bytes(r[4])) for r in got) == by_row(brute_bytes(rows, 400))


def test_many_copies_in_a_hot_group(spark):
    text = " ".join(f"c{i}" for i in range(90))
    rows = [(i, f"h{i} {text} t{i}") for i in range(60)]
    got = words_.substring_dedup(frame(spark, rows)).collect()
    assert by_row(got) == by_row(brute_words(rows, 50))
    assert sum(r["n_removed"] > 0 for r in got) == 59


def test_one_row_repeated_without_an_id(spark):
    text = " ".join(f"d{i}" for i in range(80))
    rows = [(None, text)] * 40 + [(1, text + " end")]
    got = bytes_.suffix_dedup(frame(spark, rows), Shape(24, 4, 9)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert by_row((*r[:4], bytes(r[4])) for r in got) == by_row(brute_bytes(rows, 24))
    assert by_row(words_.substring_dedup(frame(spark, rows)).collect()) == by_row(brute_words(rows, 50))


def test_empty_table(spark):
    empty = frame(spark, [])
    assert words_.substring_dedup(empty).count() == 0
    assert bytes_.suffix_dedup(empty).count() == 0
    assert bytes_.suffix_stage(empty).count() == 0


def test_stage_keeps_columns_and_whole_characters(spark):
    shared = "é" * 250
    rows = [(1, "a" + shared + "b"), (2, "ü" + shared + "c"), (3, None), (4, "plain")]
    docs = frame(spark, rows)
    out = bytes_.suffix_stage(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {1: ("ab", 2), 2: ("üc", 2), 3: (None, None), 4: ("plain", 5)}


def test_single_wholes_need_no_join_and_texts_are_packed(spark, monkeypatch):
    """One passage in 60 unlike texts and twice in another: every whole at its ends occurs once, and its count states its row."""
    written, own = {}, repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name: written.setdefault(name, own(df, name)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"left {i * 7919} {passage} right {i * 104729}") for i in range(60)] + [(60, f"{passage} é {passage} é")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["text"] for r in bytes_.suffix_stage(docs, Shape(40, 8, 16)).collect()}
    assert got == {r[0]: r[4].decode("utf-8", "ignore") for r in brute_bytes(rows, 40)}
    assert dict(written["once"].dtypes)["kept"] == "binary"
    single = written["wholes"].where("k = 1").select("key", "tie", "first", "count", "core").collect()
    assert len(single) > 60
    assert set(map(tuple, single)) <= set(map(tuple, written["shared"].select("key", "tie", "first", "count", "core").collect()))


@pytest.mark.parametrize("copies", [12, 48])
def test_join_of_copies_puts_out_one_row_for_a_whole(spark, monkeypatch, copies):
    """A passage in many texts with two endings: its stretches branch there, and each whole has as many copies as texts."""
    written, joined, own, join = {}, [], repeats.stored, type(frame(spark, [])).join
    monkeypatch.setattr(repeats, "stored", lambda df, name: written.setdefault(name, own(df, name)))

    def watched(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on and list(on)[:2] == ["core", "whole"]:
            joined.append(out)
        return out

    monkeypatch.setattr(type(frame(spark, [])), "join", watched)
    passage, ends = " ".join(f"p{i}" for i in range(40)), [" ".join(f"{x}{i}" for i in range(40)) for x in "ab"]
    rows = [(i, f"left{i * 7919} {passage} {ends[i % 2]} right{i * 104729}") for i in range(copies)]

    def check(got, expected):
        assert by_row(got) == by_row(expected)
        copied = written["wholes"].where("k > 1").selectExpr("count(*) AS n", "sum(k) AS k").head()
        assert copied["n"] > 0 and copied["k"] >= copied["n"] * copies / 4
        assert joined.pop().count() == copied["n"] and not joined
        written.clear()

    got = bytes_.suffix_dedup(frame(spark, rows), Shape(40, 8, 16)).collect()
    check([(r["doc_id"], *r[:3], bytes(r["kept"])) for r in got], brute_bytes(rows, 40))
    check(words_.substring_dedup(frame(spark, rows), Shape(12, 3, 5)).collect(), brute_words(rows, 12))


def test_copies_in_rows_of_one_id(spark):
    """The first owner of a whole may have it in many rows: one doc_id or none, and twice in one text."""
    passage, ends = " ".join(f"p{i}" for i in range(30)), [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(i % 3 or None, f"l{i} {passage} {ends[i % 2]} m{i} {passage} {ends[i % 3]} r{i}") for i in range(18)] + [(1, passage)] * 2
    got = bytes_.suffix_dedup(frame(spark, rows), Shape(40, 8, 16)).collect()
    assert by_row((r["doc_id"], *r[:3], bytes(r["kept"])) for r in got) == by_row(brute_bytes(rows, 40))
    assert by_row(words_.substring_dedup(frame(spark, rows), Shape(12, 3, 5)).collect()) == by_row(brute_words(rows, 12))


def test_query_digest(spark):
    rows = brute_words([(1, "a  b\tc")], 50)
    assert rows == [(1, 3, 0, "a b c")]
    got = words_._result(frame(spark, [(1, "a  b\tc")]), words_.SHAPE, "d", lambda k: hashlib.sha256(k).hexdigest()).head()
    assert got["d"] == hashlib.sha256(b"a b c").hexdigest()


def test_passages_by_length(spark):
    """Passages of 50 to 120 words, each in two unrelated documents: the stage removes them, op10 only what has 400 bytes."""
    import random
    from pathlib import Path

    import duckdb

    table = "/root/testdata/sf0.001/documents.parquet"
    if not Path(table).exists():
        pytest.skip("test tables are not here")
    pool = [w for (t,) in duckdb.sql(f"SELECT text FROM '{table}' WHERE len(text) > 400 ORDER BY doc_id").fetchall() for w in t.split()]
    rng = random.Random(4)

    def words(n):
        return " ".join(rng.choice(pool) for _ in range(n))

    rows, planted = [], []
    for length in (50, 60, 80, 120):
        for _ in range(30):
            passage = words(length)
            for _ in range(2):
                planted.append((length, len(rows), passage))
                rows.append((len(rows), f"{words(40)} {passage} {words(40)}"))
    shares = {}
    for name, shape in (("op10", bytes_.SHAPE), ("stage", bytes_.STAGE_SHAPE)):
        kept = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in bytes_.suffix_dedup(frame(spark, rows), shape).collect()}
        for length in (50, 60, 80, 120):
            mine = [passage not in kept[i] for n, i, passage in planted if n == length]
            shares[name, length] = sum(mine) / len(mine)
    print(shares)
    assert all(shares["stage", n] >= 0.9 for n in (50, 60, 80, 120))
    assert shares["op10", 120] == 1.0 and shares["op10", 50] < 0.1
