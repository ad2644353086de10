"""Exact deduplication as a stateful stream with disk-backed keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm.common import Lineage, ascii_lower, attach, new_folder, whole_text

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """Stable identifier, locator (file and row in it) and normalised text of every row."""
    return spark.read.parquet(path).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        ascii_lower(whole_text()).alias("norm"))


def fold_stream(spark: SparkSession, arrivals: str, state: str, batch_bytes: int = 64 << 30) -> None:
    """Run the digests below ``arrivals`` through the keyed state in ``state`` until none is left.

    One state row per digest, never expired, kept in RocksDB and saved to
    ``state`` after each micro-batch: the identifier and locator that stay, and
    how many rows arrived. A second call with the same folders takes up only
    files that are new. Copies are combined before the shuffle, so a digest
    with very many rows costs a row per task.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Else every partition's store sets 4 MB aside for its journal, however little it holds.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    arrived = (
        session.readStream.schema("doc_id long, file string, row long, digest binary")
        .option("maxBytesPerTrigger", batch_bytes).parquet(arrivals))
    kept = arrived.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("group_size"))
    query = (
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: digest, kept (doc_id, file, row), group_size."""
    rows = spark.read.format("statestore").load(state)
    largest, count = rows.schema["value"].dataType.names
    return rows.select("key.digest", F.col(f"value.{largest}").alias("kept"), F.col(f"value.{count}").alias("group_size"))


def deduplicate(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 64 << 30) -> DataFrame:
    """Every row of the Parquet table at ``path`` with the row of its equals that stays.

    Texts are equal when they agree after lower-casing A-Z only; null counts as
    empty. Of equal texts the row with the largest doc_id stays (a null doc_id
    is the smallest; rows that repeat a doc_id: the later locator). Rows whose
    digest has been seen are hits: their whole texts are fetched by locator and
    compared, and a digest shared by different texts is split. An empty table
    gives an empty result. Other columns are ignored.

    Columns: doc_id, file, row, digest, kept (doc_id, file, row), group_size.
    """
    lineage = Lineage(spark)
    texts = _texts(spark, path)
    rows = lineage.cut(texts.select("doc_id", "file", "row", digest(F.col("norm")).alias("digest")))
    state = new_folder(spark, "digests")
    if rows.isEmpty():
        return rows.withColumns({"kept": F.struct("doc_id", "file", "row"), "group_size": F.lit(0).cast("long")})
    fold_stream(spark, rows._cut_path, state, batch_bytes)
    groups = lineage.cut(read_state(spark, state))

    hits = rows.join(groups.where("group_size > 1").select("digest"), "digest", "left_semi")
    hits = lineage.cut(hits.select("file", "row", "digest"))
    copies = attach(texts, hits, ["file", "row"])
    apart = copies.groupBy("digest", "norm").agg(F.lit(1).alias("n")).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    apart = lineage.cut(apart)
    placed = rows.join(groups, "digest")
    if apart.isEmpty():
        lineage.release(rows, groups)
        return placed
    # Different texts under one digest: place their rows by the text itself.
    copies = attach(texts, lineage.cut(hits.join(apart, "digest", "left_semi")), ["file", "row"])
    split = copies.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("kept"), F.count(F.lit(1)).alias("group_size"))
    return placed.join(apart, "digest", "left_anti").unionByName(copies.join(split, ["digest", "norm"]).select(placed.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select(
        "doc_id", F.col("kept.doc_id").alias("keep_id"), "group_size",
        F.struct("doc_id", "file", "row").eqNullSafe(F.col("kept")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


#: Reference SQL of the query.
SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
