"""Windows of symbols that occur more than once in a corpus, exactly and without a row per window.

1. Every document is cut into stretches (see :mod:`rolling`): about one row per ``reach / 2`` windows.
2. Stretches are counted by ``core`` with map-side partial sums. A core that occurs once ends here: none of its
   windows can occur elsewhere.
3. Where all stretches of a core are equal as a whole, the path does not branch and all its windows share one answer.
4. Where they differ, equal wholes still share one answer; one stretch of each remaining whole is opened into its
   windows, which are counted by name. A whole that occurs once needs no join: its count has seen its row. Of a whole
   that occurs more often a join looks up the stretches of one document, whatever the number of copies.

No step holds a group in memory: groups are counted by aggregation, and joins meet one counted row per key on
one side, so that a hot key can be split on the other. What belongs to one row is gathered as a set, so repeats of
the row do not lengthen it. Whole texts move once, compressed; only documents
with opened stretches move again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm import rolling
from tripledger.llm.frames import LAST_ID, OUT_ROWS, identified, packed_texts, stored, unpack
from tripledger.llm.rolling import Shape

Symbols = Callable[[bytes], np.ndarray]
#: Result columns of one document from its bytes and the (first, count) of its repeated windows.
Finish = Callable[[bytes, np.ndarray, np.ndarray], tuple]

_STRETCH = "key long, tie long, doc long, first int, count int, core long, whole long"
_NAMES = "array<struct<pos: int, own: boolean, name: long, side: int>>"


def byte_symbols(data: bytes) -> np.ndarray:
    return rolling.byte_symbols(data)


def word_symbols(data: bytes) -> np.ndarray:
    return rolling.word_symbols(data)[0]


def _cut(symbols: Symbols, shape: Shape):
    names = ["key", "tie", "doc", "first", "count", "core", "whole"]
    types = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64]

    def packed(parts: list) -> pa.RecordBatch:
        columns = (np.concatenate(c).astype(t, copy=False) for c, t in zip(zip(*parts), types))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            where = (batch.column(c).to_numpy() for c in ("key", "tie", "doc"))
            for key, tie, doc, text in zip(*where, batch.column("text")):
                found = rolling.stretches(symbols(text.as_buffer().to_pybytes()), shape)
                size = len(found[0])
                if size:
                    parts.append([np.full(size, x) for x in (key, tie, doc)] + list(found))
                    rows += size
                if rows >= OUT_ROWS:
                    yield packed(parts)
                    parts, rows = [], 0
        if parts:
            yield packed(parts)
    return run


def _fields(value: pa.Scalar, *names: str) -> list[np.ndarray]:
    if not value.is_valid:
        return [np.zeros(0, np.int64) for _ in names]
    return [value.values.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _first_pass(symbols: Symbols, shape: Shape, finish: Finish, schema: pa.Schema):
    """Finished documents, and what is still needed of those with opened stretches."""
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))
    own_columns = [("doc_id", pa.int64()), ("key", pa.int64()), ("tie", pa.int64())]
    full = pa.schema([*schema, *own_columns, ("packed", pa.binary()), ("runs", run_type)])
    unfinished = [None] * len(schema)

    def opened(data: bytes, first, count, own, core) -> list[np.ndarray]:
        pos = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
        names = rolling.window_names(symbols(data), shape)[pos]
        return [pos.astype(np.int32), np.repeat(own, count), names, np.repeat(core.astype(np.int32), count)]

    def packed_rows(rows: list[tuple], cells: list[list[np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(c[0]) if c else 0 for c in cells])
        parts = [c for c in cells if c] or [[np.zeros(0, t) for t in (np.int32, bool, np.int64, np.int32)]]
        struct = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(c)) for c in zip(*parts)], ["pos", "own", "name", "side"])
        names = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), struct)
        batch = _batch(rows, full)
        return pa.RecordBatch.from_arrays([*batch.columns, names], [*full.names, "names"])

    def run(batches):
        for batch in batches:
            rows, cells, size = [], [], 0
            columns = [batch.column(c) for c in ("doc_id", "key", "tie", "packed", "parts")]
            for doc_id, key, tie, packed, parts in zip(*columns):
                data = unpack(packed)
                first, count, state, core = _fields(parts, "first", "count", "state", "core")
                open_ = state != 0
                done = ~open_ & ~np.isin(first, first[state == 2])
                who = (doc_id.as_py(), key.as_py(), tie.as_py())
                if not open_.any():
                    rows.append((*finish(data, first, count), *who, None, None))
                    cells.append([])
                else:
                    runs = [{"first": a, "count": b} for a, b in zip(first[done].tolist(), count[done].tolist())]
                    rows.append((*unfinished, *who, packed.as_py(), runs))
                    cells.append(opened(data, first[open_], count[open_], state[open_] == 2, core[open_]))
                    size += len(cells[-1][0])
                if size + len(rows) >= OUT_ROWS:
                    yield packed_rows(rows, cells)
                    rows, cells, size = [], [], 0
            if rows:
                yield packed_rows(rows, cells)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _last_pass(finish: Finish, schema: pa.Schema):
    full = pa.schema([*schema, ("doc_id", pa.int64()), ("key", pa.int64()), ("tie", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, tie, packed, runs, found in zip(
                    *(batch.column(c) for c in ("doc_id", "key", "tie", "packed", "runs", "found"))):
                first, count = _fields(runs, "first", "count")
                more = np.array(found.as_py() or (), np.int64)
                rows.append((*finish(unpack(packed), np.append(first, more),
                                     np.append(count, np.ones(len(more), np.int64))),
                             doc_id.as_py(), key.as_py(), tie.as_py()))
            if rows:
                yield _batch(rows, full)
    return run


def repeated_windows(
    docs: DataFrame, symbols: Symbols, shape: Shape, earlier: bool, finish: Finish, schema: pa.Schema, ddl: str,
) -> DataFrame:
    """What ``finish`` makes of every document and its repeated windows; doc_id, key and tie follow.

    ``earlier``: windows that also start in a document with a smaller doc_id (null ids come last and are
    equal). Otherwise: windows that also start anywhere else, repeated rows included.
    ``schema`` and ``ddl`` describe the columns of ``finish``.
    """
    rows = identified(docs)
    cut = rows.select("key", "tie", (F.coalesce("doc_id", F.lit(LAST_ID)) if earlier else F.lit(0).cast("long")).alias("doc"),
                      "text").mapInArrow(_cut(symbols, shape), _STRETCH)
    counts = [F.min("doc").alias("lo"), F.max("doc").alias("hi")] if earlier else [F.count(F.lit(1)).alias("n")]
    counted = cut.groupBy("core").agg(*counts, F.min("whole").alias("w0"), F.max("whole").alias("w1"))
    counted = counted.where("lo < hi" if earlier else "n > 1").select(
        "core", F.col("lo" if earlier else "n").alias("least"), (F.col("w0") == F.col("w1")).alias("straight"))
    # written first, as the wholes below, so that the join meets two plain exchanges and a hot core can be split
    counted = stored(counted, "cores")
    shared = stored(cut.join(counted, "core"), "shared")

    where = ("key", "tie", "first", "count")
    repeated = shared.where("doc > least") if earlier else shared
    branching = shared.where("NOT straight")
    # a whole that occurs once is the one row that its count has seen; of a copied one only the rows of its first owner
    # are looked up, so that what the join puts out does not grow with the number of copies
    row = ("key", "tie", "doc", "first", "count", "least")
    owner = "doc" if earlier else "key"
    wholes = stored(branching.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("k"), *[F.min(c).alias(c) for c in row]), "wholes")
    single = wholes.where("k = 1").select("core", "k", *row)
    copied = branching.select(*row, "core", "whole").join(
        wholes.where("k > 1").select("core", "whole", "k", owner), ["core", "whole", owner])
    # state 0: repeated, unless a 2 says otherwise; 1: opened to be met by others; 2: opened to be answered
    asked = F.col("doc") > F.col("least") if earlier else F.col("k") == 1
    opened = single.unionByName(copied.select(*single.columns)).select(
        *where, "core", F.when(asked, 2).otherwise(1).alias("state"))
    parts = repeated.select(*where, F.lit(0).cast("long").alias("core"), F.lit(0).alias("state")).unionByName(opened)
    parts = parts.groupBy("key", "tie").agg(F.collect_set(F.struct("first", "count", "state", "core")).alias("parts"))
    own = "doc_id long, key long, tie long"
    once = stored(
        packed_texts(rows).join(parts, ["key", "tie"], "left").mapInArrow(
            _first_pass(symbols, shape, finish, schema),
            f"{ddl}, {own}, packed binary, runs array<struct<first: int, count: int>>, names {_NAMES}"), "once")

    waiting = once.where("packed IS NOT NULL")
    windows = waiting.select("doc_id", "key", "tie", F.explode("names").alias("w")).select(
        "key", "tie", "w.*", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"))
    counts = F.min("doc") if earlier else F.count(F.lit(1))
    names = windows.groupBy("name", "side").agg(counts.alias("seen"))
    if not earlier:
        names = names.where("seen > 1")
    found = windows.where("own").join(names, ["name", "side"])
    if earlier:
        found = found.where("seen < doc")
    found = found.groupBy("key", "tie").agg(F.collect_set("pos").alias("found"))
    rest = waiting.drop("names").join(found, ["key", "tie"], "left").mapInArrow(
        _last_pass(finish, schema), f"{ddl}, {own}")
    return once.where("packed IS NULL").select(*rest.columns).unionByName(rest)
