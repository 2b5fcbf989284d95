"""Operator 7: exact duplicates by a stateful stream.

Rows arrive as a stream of keys: digest of the text, doc_id, and the place of the content (file and row within it).
The state, kept in RocksDB and never expired, holds per digest the identifier and place of the row that stays and the
number of rows. Sums are combined before the shuffle, so a text that fills a third of the corpus sends one
row per task. Digests with more than one row are hits; their rows are fetched and compared byte by byte with the
content at the place of the retained row, and rows of other content form groups of their own.

Defined cases: a null text equals an empty one; the row with the largest doc_id stays, a null doc_id being the
smallest; of repeated rows with one doc_id the one at the last place stays alone; nothing else of the row matters, and other
columns pass through the stage whatever their names; very long texts travel whole, and only where they are hits.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import free_names, fresh_folder, own_columns, read_table, stored, texts

#: State on disk; stores do not reserve disk space ahead, which costs each some 4 MB whatever it holds.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_WHO = ("doc_id", "file", "pos")


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest and the place (file, pos) of every row; rows that lie in no file are written to one."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(
        [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos")]))
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), "file", "pos")


def in_files(docs: DataFrame) -> DataFrame:
    try:
        return located(docs)
    except AnalysisException:
        return located(stored(docs.select("doc_id", "text"), "content"))


def retained(keys: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """State of the stream over written keys: digest, n, keep (doc_id, file, pos of the row that stays)."""
    spark = keys.sparkSession
    source, state = fresh_folder(spark, "keys"), fresh_folder(spark, "state")
    keys.write.parquet(source)
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        reader = spark.readStream.schema(keys.schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        stream = reader.parquet(source).groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct(*_WHO)).alias("keep"))
        query = (stream.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", state).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    held = spark.read.format("statestore").load(state)
    n, keep = held.schema["value"].dataType.names
    return held.select("key.digest", F.col(f"value.{n}").alias("n"), F.col(f"value.{keep}").alias("keep"))


def exact_groups(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, file, pos, digest, keep (struct), group_size of every row."""
    rows = in_files(docs)
    keys = rows.select("digest", *_WHO)
    state = stored(retained(keys, files_per_batch), "retained")
    hits = state.where("n > 1")
    # whole texts move once; from here on only those of hits do
    members = stored(rows.join(hits.select("digest", "keep"), "digest"), "members")
    kept = members.where((F.col("file") == F.col("keep.file")) & (F.col("pos") == F.col("keep.pos")))
    kept = kept.select("digest", F.col("text").alias("kept_text"))
    checked = members.join(kept, "digest").select(
        *_WHO, "digest",
        F.when(F.col("text") == F.col("kept_text"), "").otherwise(F.sha2(F.col("text").cast("binary"), 512)).alias("other"))
    checked = stored(checked, "checked")
    # written first, so that the join meets two plain exchanges and a hot text can be split
    groups = stored(checked.groupBy("digest", "other").agg(
        F.max(F.struct(*_WHO)).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    twins = checked.join(groups, ["digest", "other"]).select(*_WHO, "digest", "keep", "group_size")
    single = state.where("n = 1").select(
        "keep.doc_id", "keep.file", "keep.pos", "digest", "keep", F.col("n").alias("group_size"))
    return single.unionByName(twins)


def _stays():
    return (F.col("file") == F.col("keep.file")) & (F.col("pos") == F.col("keep.pos"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", _stays().alias("kept"),
        F.col("digest").alias("text_sha256"))


def exact_stage(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns."""
    names = free_names(docs, "file", "pos")
    place = [F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_path", "row_index"), names)]
    try:
        placed = docs.select("*", *place)
    except AnalysisException:
        docs = stored(docs, "content")
        placed = docs.select("*", *place)
    keep = exact_groups(docs).where(_stays()).select(*[F.col(c).alias(n) for c, n in zip(("file", "pos"), names)])
    return placed.join(keep, names, "left_semi").select(*own_columns(docs))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
