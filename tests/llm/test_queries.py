"""Registered queries on the smallest tables, and the pipeline stage by stage against plain computations."""

import hashlib
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tests.llm.helpers import by_row
from tests.llm.test_copies import brute_print, reach
from tests.llm.test_near_copies import groups
from tests.llm.test_repeats import brute_bytes, brute_words
from tripledger.llm import quality
from tripledger.llm.frames import stored
from tripledger.llm.queries import ORACLE, REGISTRY

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


def digest(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, rows):
    want = [(*r[:3], digest(r[3])) for r in brute_words(rows, 50)]
    assert by_row(REGISTRY["op1_substring_dedup"](spark, SMALL).collect()) == by_row(want)


def test_op10(spark, rows):
    want = [(*r[:4], digest(r[4])) for r in brute_bytes(rows, 400)]
    assert by_row(REGISTRY["op10_suffix_dedup"](spark, SMALL).collect()) == by_row(want)


def test_op2(spark, rows):
    prints = {i: brute_print(t) for i, t in rows}
    root = reach(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    want = [(i, f"{prints[i]:016x}", root[i]) for i in prints]
    assert by_row(REGISTRY["op2_simhash"](spark, SMALL).collect()) == by_row(want)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    assert by_row(REGISTRY[name](spark, SMALL).collect()) == by_row(con.execute(ORACLE[name]).fetchall())


def test_whole_tables(spark, rows):
    """One row per document from the queries that are not compared here."""
    for name in ("op3_spotsigs", "op5_token_files", "op6_quality", "op8_sentencepiece", "op9_toxicity"):
        got = [r["doc_id"] for r in REGISTRY[name](spark, SMALL).select("doc_id").collect()]
        assert sorted(got) == sorted(i for i, _ in rows), name


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SMALL), "step"))
    given, good, single, apart, cut, bins = [s.collect() for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert not any("pandas" in n for n in names)

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    scores = quality.scored(docs, quality.fit(docs, labels)).collect()
    keep = {r["doc_id"] for r in scores if r["predicted"]}
    assert by_row(good) == by_row(r for r in given if r["doc_id"] in keep)

    last = {}
    for r in good:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert by_row(single) == by_row(r for r in good if last[r["text"]] == r["doc_id"])

    root = groups([(r["doc_id"], r["text"]) for r in single])
    assert by_row(apart) == by_row(r for r in single if root[r["doc_id"]] == r["doc_id"])

    left = {r[0]: r[4].decode("utf-8", "ignore") for r in brute_bytes([(r["doc_id"], r["text"]) for r in apart], 200)}
    assert by_row(cut) == by_row((r["doc_id"], left[r["doc_id"]], r["lang"], r["source"], len(left[r["doc_id"]])) for r in apart)

    assert {r["doc_id"] for r in bins} == {r["doc_id"] for r in cut}
    assert by_row(corpus_pipeline.run(spark, SMALL).collect()) == by_row(bins)
