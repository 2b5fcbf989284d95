"""Operator 5: token ids in files, one compressed frame per document.

Format. A folder holds ``dictionary`` (one row: zstandard dictionary and its SHA-256) and ``shards``, both Parquet, so that
any store Spark can write will do. A shard is one row: its place (part, seq), the dictionary's hash, the bytes per
id, ``doc_ids`` (ascending over all shards, nulls first), ``offsets`` (of each document's frame, and the end),
``counts`` (ids of each document) and ``frames``. A frame is the document's ids as little-endian integers, compressed
on its own with the shared dictionary; one document is read from its slice of ``frames`` alone.

The dictionary is trained on the serialized ids of at most ``SAMPLE`` documents (the smallest hashed doc_ids), each cut at
``SAMPLE_BYTES``; everything else covers all documents.

Defined cases: a null text is empty and gives the end id alone; null doc_ids come first; rows of one doc_id are
kept side by side in any order; an empty table gives no shards; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.llm.chunks import ChunkTable
from tripledger.llm.frames import by_batch, fresh_folder, read_table, stored, texts

TOKENIZER, END = "byte_bpe_50k.json", 2
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2_000, 8_192, 65_536, 3
#: Distinct pieces in one call of the tokenizer.
RUN = 100
SHARD_BYTES, SHARD_DOCUMENTS = 4 << 20, 20_000

_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: A chunk with this mark is taken as it stands; any other stands behind a blank.
_AS_IS = "\x01"
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"^ | $|{_WHITE} | {_WHITE}|{_AS_IS}"
_SHARD = ("part int, seq int, dictionary string, width int, tokens long, min_id long, max_id long, doc_ids array<long>, "
          "offsets array<long>, counts array<long>, frames binary")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """Pieces of a text cut before each single blank between two other characters, where a word always starts."""
    return [_AS_IS + piece for piece in _SAFE.split(text)]


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[ChunkTable, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    # a special token stands alone whatever its neighbours, so it can hold pieces apart within one call
    apart = [(i, t.content) for i, t in model.get_added_tokens_decoder().items()
             if t.special and not (t.lstrip or t.rstrip or t.single_word)][:1]

    def ids_of(texts_: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(texts_, add_special_tokens=False)]

    def encode(chunks: list[str]) -> list[bytes]:
        pieces = [c[1:] if c[:1] == _AS_IS else " " + c for c in chunks]
        if not apart or any(apart[0][1] in p for p in pieces):
            return [np.array(ids, "<u4").tobytes() for ids in ids_of(pieces)]
        number, mark = apart[0]
        runs = ids_of([mark.join(pieces[i: i + RUN]) for i in range(0, len(pieces), RUN)])
        ids = np.concatenate([np.array([*run, number], "<u4") for run in runs])
        ends = (4 * np.flatnonzero(ids == number)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends)]

    return ChunkTable(_ODD, _AS_IS, cut, encode), 2 if model.get_vocab_size() <= 1 << 16 else 4


def _serialized(path: str, batches):
    """(doc_ids, list of serialized id arrays, ids by document) by slice."""
    table, width = _loaded(path)
    for batch in batches:
        for rows, ids, ends in table.slices(batch.column("text")):
            ids = ids.astype(f"<u{width}")
            last = np.array([END], f"<u{width}").tobytes()
            yield (batch.column("doc_id").take(pa.array(rows)),
                   [ids[x:y].tobytes() + last for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())],
                   ends[1:] - ends[:-1] + 1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), texts(docs).alias("text"))


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """Dictionary from a bounded sample; empty where the sample is too small to train on.

    A sampled document gives ``SAMPLE_BYTES`` of ids from a place of its text that its doc_id decides by hash, so a long document is not known by
    its beginning alone.
    """
    def run(batches):
        for doc_ids, arrays, _ in _serialized(path, batches):
            yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in arrays], pa.binary())], ["ids"])

    ids = _rows(docs).where("doc_id IS NOT NULL").select("doc_id").distinct()
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit("dictionary")), "doc_id").limit(SAMPLE)
    window = 8 * SAMPLE_BYTES
    places = F.greatest(F.length("text") - F.lit(window), F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), places.cast("long")).cast("int") + 1
    texts_ = _rows(docs).select("doc_id", F.substring("text", start, F.lit(window)).alias("text"))
    chosen = texts_.join(ids.hint("broadcast"), "doc_id").mapInArrow(run, "ids binary").toArrow()
    sample = sorted(chosen["ids"].to_pylist())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressed(path: str, dictionary: bytes):
    def run(batches):
        packer = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for doc_ids, arrays, counts in _serialized(path, batches):
            frames = [packer.compress(x) for x in arrays]
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(counts), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])
    return run


def _shards(digest: str, width: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def shard():
            doc_ids, counts, frames = zip(*held)
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
            known = [d for d in doc_ids if d is not None] or [None]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([digest]),
                 pa.array([width], pa.int32()), pa.array([sum(counts)], pa.int64()),
                 pa.array([known[0]], pa.int64()), pa.array([known[-1]], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary())],
                ["part", "seq", "dictionary", "width", "tokens", "min_id", "max_id", "doc_ids", "offsets", "counts", "frames"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "frame"))):
                if held and (size + len(row[2]) > SHARD_BYTES or len(held) >= SHARD_DOCUMENTS):
                    yield shard()
                    held, size, seq = [], 0, seq + 1
                held.append(row)
                size += len(row[2])
        if held:
            yield shard()
    return run


def write_ids(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode every text and write the files in ascending doc_id order."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    frames = stored(_rows(docs).mapInArrow(_compressed(path, dictionary), "doc_id long, n long, frame binary"), "frames")
    ordered = frames.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_shards(digest, _loaded(path)[1]), _SHARD).write.parquet(f"{folder}/shards")


def _read(dictionary: bytes, digest: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["dictionary"] != digest:
                raise ValueError("shard and dictionary do not belong together")
            before, frames = 0, memoryview(row["frames"])
            for doc_id, a, b in zip(row["doc_ids"], row["offsets"], row["offsets"][1:]):
                ids = np.frombuffer(opener.decompress(frames[a:b]), f"<u{row['width']}").astype("<u4")
                out.append((row["part"], row["seq"], doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                before += len(ids)
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)],
            ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])
    return by_batch(run)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    held = spark.read.parquet(f"{folder}/dictionary").head()
    dictionary = bytes(held["bytes"])
    if hashlib.sha256(dictionary).hexdigest() != held["sha256"]:
        raise ValueError("the dictionary is damaged")
    shards = spark.read.parquet(f"{folder}/shards")
    sizes = shards.select("part", "seq", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # one row per written partition
    parts = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    within = Window.partitionBy("part").orderBy("seq")
    bases = sizes.select("part", "seq", (F.sum("tokens").over(within) - F.col("tokens")).alias("inner")).join(
        parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    rows = shards.select("part", "seq", "dictionary", "width", "doc_ids", "offsets", "frames").mapInArrow(
        _read(dictionary, held["sha256"]),
        "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of the rows of one doc_id; only their frames are decompressed.

    Shards are in the order of doc_id and state their smallest and largest, so the statistics of the files leave the
    shards, and mostly the one file, that may hold it.
    """
    held = spark.read.parquet(f"{folder}/dictionary").head()
    data = zstandard.ZstdCompressionDict(bytes(held["bytes"])) if held["bytes"] else None
    opener = zstandard.ZstdDecompressor(dict_data=data)
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.col("doc_ids")[i] == doc_id))
    rows = spark.read.parquet(f"{folder}/shards").where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))
    rows = rows.where(F.array_contains("doc_ids", doc_id))
    rows = rows.select("width", "frames", "offsets", at.alias("i")).select(
        "width", F.expr("substring(frames, cast(offsets[i] + 1 as int), cast(offsets[i + 1] - offsets[i] as int))").alias("frame"))
    return [np.frombuffer(opener.decompress(bytes(r["frame"])), f"<u{r['width']}").tolist() for r in rows.toLocalIterator()]


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "ids")
    write_ids(read_table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder)
