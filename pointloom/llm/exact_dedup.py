"""Exact deduplication as a stateful stream.

The documents arrive as a stream of (digest, id, locator), in micro-batches of bounded bytes. A keyed state on disk (the
RocksDB state store) keeps for each digest, without expiry, the identifier that stays, a locator of its content and
how many rows came; every batch updates it. The state's updates go to a table in the shared folder, keyed by batch, so
that a batch that is run again replaces its own output. With a state folder that the caller names, checkpoint, state
and updates stay there, and a later call reads only files that are new since.

Hits are checked over the full bytes: the content that a digest's locator names is read, and every row that came with
the digest is held against it. Should two texts ever share a digest, the text itself becomes part of the key.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, exists, maybe_broadcast, whole

#: Bytes of input that a micro-batch takes at most (a file is never split over batches).
BATCH_BYTES = 256 << 30
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: logs are not allocated ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a store is closed when its task has committed, so memory does not grow with the number of partitions
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    had = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, lowercase hex."""
    return F.sha2(text, 256)


def locator(rows: DataFrame) -> Column:
    """Where a row's content is: its file (hashed path) and its place in it."""
    at = rows.metadataColumn("_metadata")  # also where the table has a column of this name
    return F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))


def _arrivals(source: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return source.select(F.unhex(digest(whole(text_col))).alias("digest"), F.struct(F.col(id_col).alias("doc_id"), locator(source).alias("at")).alias("holder"))


def keyed_state(source: DataFrame, at: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs the stream over all that is new and returns its state: digest, holder (largest id, with locator), n.

    source: a streaming DataFrame over files. at: the folder of checkpoint, state and updates, old or new.
    """
    spark, out = source.sparkSession, f"{at}/updates"
    state = _arrivals(source, id_col, text_col).groupBy("digest").agg(F.max("holder").alias("holder"), F.count(F.lit(1)).alias("n"))

    def put(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with _settings(spark, _STATE):
        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        run.awaitTermination()
    kind = "digest binary, holder struct<doc_id: {}, at: struct<file: bigint, row: bigint>>, n bigint".format(source.schema[id_col].dataType.simpleString())
    if not exists(spark, out):
        return spark.createDataFrame([], kind)
    updates = spark.read.schema(kind + ", batch int").parquet(out)
    if len(updates.select("batch").distinct().take(2)) < 2:
        return updates.drop("batch")
    # holder and n only grow, so the last update of a digest has the largest of both
    return updates.groupBy("digest").agg(F.max("holder").alias("holder"), F.max("n").alias("n"))


def torn_digests(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of hits that stand for two texts: the content at the locator is held against all rows that came with it.

    Rows of a digest are reduced to their least and greatest text ahead of the shuffle, which meets hot groups first.
    """
    known = maybe_broadcast(hits, 120)
    content = rows.select("at", "_text").join(known.select("digest", F.col("holder.at").alias("at")), "at").select("digest", F.col("_text").alias("_content"))
    came = rows.select("digest", "_text").join(known.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("_text").alias("low"), F.max("_text").alias("high"))
    return came.join(content.hint("merge"), "digest").where("low <> _content OR high <> _content").select("digest")


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, bytes_per_batch: int | None = BATCH_BYTES, state_dir: str | None = None) -> DataFrame:
    """Deduplicates the documents of a Parquet table by their whole texts, as a stream of its files.

    One row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256. Texts are equal
    when their bytes are; null counts as empty. Of equal texts the largest id stays; of repeated rows with that
    id, the one that lies last (by file hash and row) is kept, so exactly one row of a group has kept = true. A
    null id is the smallest. Other columns are ignored, whatever their names. An empty table gives no rows.

    state_dir: a folder for the state, in a store that all executors share. A call with the same folder goes on from
    it: files that an earlier call read are not read again by the stream, and no file may have gone since.
    """
    stage = Stage(spark, "exact")
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    elif bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    # as a pattern, the path may name one file as well as a folder
    state = keyed_state(reader.parquet(f"{path[:-1]}[{path[-1]}]"), state_dir or stage.path("state"), id_col=id_col, text_col=text_col)
    hits = stage.table(state.where(F.col("n") > 1), "hits")
    rows = table.select(F.unhex(digest(whole(text_col))).alias("digest"), F.col(id_col).alias("doc_id"), locator(table).alias("at"), whole(text_col).alias("_text"))
    if not stage.table(torn_digests(rows, hits), "torn").isEmpty():
        return _by_bytes(rows)
    joined = rows.select("digest", "doc_id", "at").join(maybe_broadcast(hits, 120), "digest", "left")
    return joined.select(
        "doc_id", F.when(F.col("holder").isNull(), F.col("doc_id")).otherwise(F.col("holder.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("holder").isNull() | (F.col("holder") == F.struct(F.col("doc_id"), F.col("at")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_bytes(rows: DataFrame) -> DataFrame:
    """The same with the text as part of the key, for tables in which a digest stands for two texts."""
    groups = rows.groupBy("digest", "_text").agg(F.max(F.struct("doc_id", "at")).alias("holder"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, ["digest", "_text"]).select(
        "doc_id", F.col("holder.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("holder") == F.struct(F.col("doc_id"), F.col("at"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""
