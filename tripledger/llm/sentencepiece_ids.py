"""Operator 8: SentencePiece encoding and decoding through a distinct-chunk table.

A chunk is a run of whitespace markers with the word after it. Where no piece of the model holds a marker behind
another character, no piece crosses the start of a chunk, so a text's ids are those of its chunks one after
another. This is checked when the model is loaded. Each slice of texts is cut into chunks, distinct chunks are segmented once
(a task remembers them from slice to slice), and ids are joined back by position. Nothing is shuffled.

Defined cases: a null text is empty and has no ids; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tripledger.llm.chunks import ChunkTable
from tripledger.llm.frames import read_table, texts

MODEL = "piece_bpe_32k.model"
_MARK = "▁"
_CHUNK = re.compile(f"[ {_MARK}]+[^ {_MARK}]*")
#: Texts that blanks alone do not cut into chunks.
_ODD = f"^$|^ | $|  |{_MARK}"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """Chunks of a text without the first marker of each: the library puts that one back."""
    return [c[1:] for c in _CHUNK.findall(" " + text)] if text else []


@lru_cache(maxsize=2)
def _loaded(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if any(_MARK in model.id_to_piece(i).lstrip(_MARK) for i in range(size)):
        raise ValueError("pieces of this model cross whitespace markers")
    alone = model.encode("a ")[len(model.encode("a")):]  # a marker without a word

    def encode(chunks: list[str]) -> list[bytes]:
        return [np.array(ids or alone, "<u4").tobytes() for ids in model.encode(chunks, num_threads=1)]

    return model, ChunkTable(_ODD, "", cut, encode), pa.array([f"{i}," for i in range(size)], pa.large_string())


def _encoded(path: str):
    def run(batches):
        _, table, _ = _loaded(path)
        for batch in batches:
            for rows, ids, ends in table.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(ids.astype("int32")))],
                    ["doc_id", "ids"])
    return run


def _digests(path: str):
    def run(batches):
        model, table, names = _loaded(path)
        for batch in batches:
            for rows, ids, ends in table.slices(batch.column("text")):
                decimals = names.take(pa.array(ids))
                at = memoryview(decimals.buffers()[1]).cast("q")
                data = memoryview(decimals.buffers()[2] or b"")
                joined, decoded = [], []
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    joined.append(hashlib.sha256(data[at[x]: at[y] - 1] if y > x else b"").hexdigest())
                    decoded.append(hashlib.sha256(model.decode(ids[x:y].tolist()).encode()).hexdigest() if y > x
                                   else hashlib.sha256(b"").hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array(ends[1:] - ends[:-1]), pa.array(joined), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids."""
    return _rows(docs).mapInArrow(_encoded(path or model_path()), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    where = path or model_path()

    def run(batches):
        model, _, _ = _loaded(where)
        for batch in batches:
            texts_ = [model.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts_, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(read_table(spark, sf_dir, "documents")).mapInArrow(
        _digests(model_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
