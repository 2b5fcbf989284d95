"""Operators 5 and 8 against the libraries."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import by_row, corpus, frame
from tripledger.llm import sentencepiece_ids as sp, token_files as tf

ODD = ["", " ", "  ", "a  b", " a", "a ", "a\n b", "▁a ▁", "a\tb  \n", "x " * 5, "é ﬁ 　 b", "a  b", "\n", "  a   b  ",
       "'s 't a's", "<|endoftext|> a <|endoftext|>b", "a\x1c b \x1c", "日本 語", "a\x00b", "\x01a b", "a \x01b", "a\u3000 b", "a \u2003b", "a\x85 b", "x\n\n y", "A" * 5000, "word " * 4000]


def library_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tf.tokenizer_path())
    return [e.ids + [tf.END] for e in model.encode_batch(texts, add_special_tokens=False)]


def test_sentencepiece(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    rows = list(enumerate(ODD)) + [(100, None), (None, "null id"), (1, "again")] + corpus(1)
    encoded = sp.encode(frame(spark, rows))
    want = [(i, model.encode(t or "")) for i, t in rows]
    assert by_row((r["doc_id"], r["ids"]) for r in encoded.collect()) == by_row(want)
    assert by_row(sp.decode(encoded).collect()) == by_row((i, model.decode(ids)) for i, ids in want)


def test_chunk_table_starts_anew(monkeypatch):
    from tripledger.llm import chunks

    monkeypatch.setattr(chunks, "KEPT", 3)
    monkeypatch.setattr(chunks, "SLICE", 10)
    table = chunks.ChunkTable("^$|  ", "", str.split, lambda new: [np.array([len(c)] * 2, "<u4").tobytes() for c in new])
    texts = ["a bb ccc", "", "dddd a", "bb bb", "ccc  eeeee a", "a", "x  y", "zz"]
    got = {int(r): ids[x:y].tolist() for rows, ids, ends in table.slices(pa.array(texts)) for r, x, y in zip(rows, ends, ends[1:])}
    assert [got[r] for r in range(len(texts))] == [[len(w) for w in t.split() for _ in "12"] for t in texts]


def test_token_files(spark, tmp_path):
    rows = list(enumerate(ODD)) + [(100, None), (None, "null id"), (1, "again"), (-3, "negative")]
    folder = str(tmp_path / "ids")
    tf.write_ids(frame(spark, rows), folder)
    got = sorted(tf.read_ids(spark, folder).collect(), key=lambda r: r["start"])
    ids = {(i, t): x for (i, t), x in zip(rows, library_ids([t or "" for _, t in rows]))}
    assert [-10**9 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(
        -10**9 if i is None else i for i, _ in rows)
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    want = by_row((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ids.items())
    assert by_row((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert tf.read_document(spark, folder, 17) == [ids[17, ODD[17]]]
    assert len(tf.read_document(spark, folder, 1)) == 2 and tf.read_document(spark, folder, 999) == []


def test_token_files_of_nothing(spark, tmp_path):
    tf.write_ids(frame(spark, []), str(tmp_path / "none"))
    assert tf.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_shared_dictionary_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_DOCUMENTS", 7)
    rows = [(i, f"the quick brown fox number {i} " + "jumps over the lazy dog " * (i % 5)) for i in range(300)]
    folder = str(tmp_path / "many")
    tf.write_ids(frame(spark, rows), folder)
    assert len(spark.read.parquet(f"{folder}/dictionary").head()["bytes"]) > 0
    got = {r["doc_id"]: r for r in tf.read_ids(spark, folder).collect()}
    start = 0
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        start += len(ids)
    assert tf.read_document(spark, folder, 123) == [library_ids([rows[123][1]])[0]]
    shards = spark.read.parquet(f"{folder}/shards")
    assert shards.where("min_id <= 123 and max_id >= 123").count() == 1 < shards.count()
    bad = shards.limit(1).toArrow().to_pylist()[0] | {"dictionary": "other"}
    with pytest.raises(ValueError):
        list(tf._read(b"", "this")([pa.RecordBatch.from_pylist([bad])]))


def test_given_documents(spark):
    """Both encoders on whole documents of the test tables, against the libraries."""
    import hashlib
    from pathlib import Path

    import sentencepiece

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: ids for r, ids in zip(docs, library_ids([r["text"] or "" for r in docs]))}
    start = 0
    for r in sorted(tf.op5_token_files(spark, folder).collect(), key=lambda r: r["doc_id"]):
        ids = want[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    model = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    got = {r["doc_id"]: r for r in sp.op8_sentencepiece(spark, folder).collect()}
    for r in docs:
        ids = model.encode(r["text"] or "")
        row = got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
