"""Operator 11: passages of benchmark questions and answers in documents, by one Aho-Corasick automaton.

Texts of both sides are normalised alike: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters. Every word of
the benchmark is a symbol, and every window of ``LENGTH`` consecutive words of an item (an item of fewer words is one window)
is a pattern over these symbols. A document becomes one symbol per word, one further symbol standing for all words that no
item has, and the automaton reads it once. A match ends at a word, and the bounds of the words lead back to the characters of the original.

The automaton is built in each task from the patterns' words, which the driver sends along. Items of at most ``PART_WORDS`` words
together are one automaton; a larger benchmark is cut into passages (which overlap, so that no window is lost) and dealt
into parts of about that size, and the documents are scanned once for each part, with what was found so far
carried along. So the memory of a task stays bounded and the result is the same.

Defined cases: a null text, on either side, has no words; items with one item_id are one item; a null item_id
marks words as hit but is no item that could be listed; repeated documents each get their row; equal windows of several items
count for all of them; other columns are ignored; without any item nothing is hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import read_table, stored, texts

LENGTH = 10
#: Benchmark words of one automaton, about; each gives at most ``LENGTH`` nodes.
PART_WORDS = 100_000
#: Words of a benchmark passage, without those that it shares with the next.
PASSAGE = 1000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACE = np.frombuffer(_FOLD, np.uint8) == 32
_STATE = "n_words long, hits array<struct<first: int, last: int, begin: int, end: int>>, items array<string>"
_ROW = f"doc_id long, text string, {_STATE}"
_HIT = pa.struct([(n, pa.int32()) for n in ("first", "last", "begin", "end")])


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First character of every word and the one behind its last, counted in characters of the original."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = _SPACE[raw]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    characters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return characters[turns[0::2]], characters[turns[1::2]]


class Automaton:
    """Patterns over word symbols, and the items that hold each."""

    def __init__(self, passages: list[tuple[str | None, list[bytes]]], length: int):
        self.symbols: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for item, words in passages:
            line = "".join([self.symbols.setdefault(w, chr(len(self.symbols) + 1)) for w in words])
            for k in range(max(1, len(line) - length + 1)):
                owners.setdefault(line[k:k + length], set()).add(item)
        self.found = ahocorasick.Automaton()
        for pattern, items in owners.items():
            self.found.add_word(pattern, (len(pattern), items))
        self.found.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs (first, last) of words that lie in a match, rising and apart, and the items with a match."""
        symbol = self.symbols.get
        runs: list[list[int]] = []
        items: set = set()
        for end, (size, owners) in self.found.iter("".join([symbol(w, "\0") for w in words])):
            first = end - size + 1
            while runs and first <= runs[-1][0]:
                runs.pop()
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = end
            else:
                runs.append([first, end])
            items |= owners
        return [(a, b) for a, b in runs], items


def merged(runs: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Union of runs (first, last, begin, end), rising and apart."""
    out: list[list[int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1] + 1:
            out[-1][1], out[-1][3] = max(out[-1][1], run[1]), max(out[-1][3], run[3])
        else:
            out.append(list(run))
    return [tuple(r) for r in out]


def _scan(passages: list[tuple[str | None, list[bytes]]], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(passages, length) if passages else None
        for batch in batches:
            sizes, hits, items = [], [], []
            for text, old, known in zip(batch.column("text"), batch.column("hits"), batch.column("items")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = normalised(data)
                runs, found = automaton.scan(words) if automaton and words else ([], set())
                if runs:
                    begin, end = word_bounds(data)
                    runs = [(a, b, int(begin[a]), int(end[b])) for a, b in runs]
                    runs = merged(runs + [tuple(h.values()) for h in old.as_py()])
                    hits.append([dict(zip(("first", "last", "begin", "end"), r)) for r in runs])
                    items.append(sorted({*known.as_py(), *found} - {None}))
                else:
                    hits.append(old.as_py())
                    items.append(known.as_py())
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(_HIT)),
                pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "hits", "items"])
    return run


def passages(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """item_id (string), n, words (array): the items in passages of ``PASSAGE`` words and the length - 1 that follow."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id"), batch.column("text")):
                words = normalised(text.as_buffer().to_pybytes()) if text.is_valid else []
                last = max(1, len(words) - length + 1) if words else 0
                rows += [(item.as_py(), words[k:k + PASSAGE + length - 1]) for k in range(0, last, PASSAGE)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([[w.decode() for w in r[1]] for r in rows], pa.list_(pa.string()))], ["item_id", "n", "words"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), texts(items).alias("text"))
    return rows.mapInArrow(cut, "item_id string, n long, words array<string>")


def contaminated(docs: DataFrame, items: DataFrame, length: int = LENGTH, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, text, n_words, hits and items of every document.

    A hit is a run of words inside matches: its first and last word, counted from 0, and its characters begin <= c < end. items are
    the sorted item_ids with a match.
    """
    cut = stored(passages(items, length), "passages")
    total = cut.agg(F.sum("n")).head()[0] or 0
    parts = math.ceil(total / part_words)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(max(1, parts))))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first: int, last: int, begin: int, end: int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for part in range(max(1, parts)):
        if part:
            rows = stored(rows, "scanned")
        mine = [(r["item_id"], [w.encode() for w in r["words"]]) for r in dealt.where(F.col("part") == part).toArrow().to_pylist()]
        rows = rows.mapInArrow(_scan(mine, length), _ROW)
    return rows


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS line FROM (
  SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
p AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS line FROM (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM w)
  WHERE len(words) >= size)),
m AS (SELECT p.doc_id, p.i, p.size, w.item_id FROM p JOIN w USING (size, line)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, range(0, 10) AS r(k) WHERE k < size GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
