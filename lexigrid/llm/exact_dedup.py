"""Exact dedup: a streaming keyed state without expiry, kept on disk, and a check of full bytes on every hit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialised, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: RocksDB as the store, its changes written rather than whole snapshots, no disk set aside for logs of small stores.
STATE_SETTINGS = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: How many parts the rows of one hot text are dealt to, and the share of all rows from which a text is hot.
SALTS, HEAVY_PARTS = 256, 1000


def _digest(text, bits: int):
    """The SHA-256 of the text (null: of the empty text), or its first `bits` bits (a weak digest, for tests of collisions)."""
    full = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.unhex(full if bits == 256 else F.substring(full, 1, bits // 4))


def _glob(path: str) -> str:
    """The path as a pattern that matches only itself: streams take single files by pattern only."""
    return re.sub(r"(.)(/*)$", r"[\1]\2", path)


def update_state(spark: SparkSession, path: str, state: str, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, files_per_batch: int | None = None) -> None:
    """Run all files under `path` that the state at `state` hasn't seen through the keyed state, then stop.

    For each digest the state (RocksDB on the executors' disks, its changes and snapshots under `state` in the shared
    folder) keeps the largest id with the content locator (file, row) of that row, and the number of rows. It has no
    watermark and never expires. Rows are combined before the shuffle, so a text that a third of all rows hold sends
    one row per task. A later call with more files goes on where this one ended; so does a call after a crash.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(spark.read.parquet(path).schema)
        source = source.option("maxFileAge", "36500d")  # files older than the newest one seen count as well
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        rows = source.parquet(_glob(path)).select(
            _digest(F.col(text_col), digest_bits).alias("digest"),
            F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        )
        ledger = rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count("*").alias("n"))
        query = ledger.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: digest, keep (id, file, row), n."""
    found = spark.read.format("statestore").load(state)
    keep, n = found.schema["value"].dataType.names
    return found.select("key.digest", F.col(f"value.{keep}").alias("keep"), F.col(f"value.{n}").alias("n"))


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, state: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """One row for each row of the parquet table at `path`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are. Of equal texts the row with the largest id stays; among repeated rows
    with that id, the one latest by (file, row), so exactly one row of a group is kept.

    Null texts count as empty, empty texts are equal to each other, a null id is below any other (a group of null ids
    keeps one of them, keep_id null). Very long texts are only hashed and compared. An empty table gives no rows;
    other columns, whatever their names, are not read.

    On a digest that several rows share the full bytes are compared, within (digest, salt) first: a digest with at
    least a thousandth of all rows is spread over SALTS parts, and at most a thousand digests can be so heavy, so their
    list is broadcast. Should digests collide, the rows in question are grouped anew by their bytes.
    """
    if not spark.read.parquet(path).take(1):
        return _empty(spark, spark.read.parquet(path).schema[id_col].dataType)
    state = state or scratch(spark, "dedup-state")
    update_state(spark, path, state, id_col=id_col, text_col=text_col, digest_bits=digest_bits, files_per_batch=files_per_batch)
    ledger = read_state(spark, state)
    total, rows = ledger.agg(F.sum("n")).first()[0], spark.read.parquet(path).count()
    if total != rows:
        raise RuntimeError(f"the state counts {total} rows, the table has {rows}")
    heavy_from = max(2, -(-total // HEAVY_PARTS))
    heavy = F.broadcast(ledger.where(F.col("n") >= heavy_from).select(F.col("digest").alias("hot")))  # HEAVY_PARTS rows at most

    def salted(entries: DataFrame) -> DataFrame:
        salts = F.when(F.col("n") >= heavy_from, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return entries.withColumn("salt", F.explode(salts))

    rows = spark.read.parquet(path).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), _digest(F.col(text_col), digest_bits).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    rows = rows.join(heavy, F.col("digest") == F.col("hot"), "left")
    rows = rows.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("row", "doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))

    # sorted by digest whatever the sizes: whole texts meet here, which no broadcast should decide
    hits = salted(ledger.where("n > 1").select("digest", "n")).drop("n").hint("merge")
    bytes_of = rows.select("digest", "salt", "hot", "text").join(hits, ["digest", "salt"])
    ends = bytes_of.groupBy("digest", "salt").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.first("hot").isNotNull().alias("spread"))
    ends = ends.select("digest", (F.col("low") != F.col("high")).alias("differs"), F.when(F.col("spread"), F.col("low")).alias("low"), F.when(F.col("spread"), F.col("high")).alias("high"))
    ends = ends.groupBy("digest").agg(F.max("differs").alias("differs"), F.min("low").alias("low"), F.max("high").alias("high"))
    collided = materialised(ends.where("differs or low <> high").select("digest"), "dedup-collided")
    parts = rows.drop("text", "hot") if digest_bits == 256 else rows.drop("hot")
    if collided.take(1):
        clashing = F.broadcast(collided) if collided.count() <= 10_000 else collided
        again = rows.join(clashing, "digest", "left_semi")
        own = again.groupBy("digest", "text").agg(F.max(F.struct(F.col("doc_id").alias("id"), "file", "row")).alias("keep"), F.count("*").alias("n"))
        fixed = again.join(own, ["digest", "text"]).select("doc_id", "file", "row", "keep", "n", F.sha2("text", 256).alias("text_sha256"))
        parts = parts.join(clashing, "digest", "left_anti")
        whole = fixed
    else:
        whole = None
    sha = F.lower(F.hex("digest")) if digest_bits == 256 else F.sha2("text", 256)
    out = parts.join(salted(ledger), ["digest", "salt"]).select("doc_id", "file", "row", "keep", "n", sha.alias("text_sha256"))
    if whole is not None:
        out = out.unionByName(whole)
    stays = F.col("doc_id").eqNullSafe(F.col("keep.id")) & (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return out.select("doc_id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "text_sha256")


def _empty(spark: SparkSession, kind) -> DataFrame:
    return spark.range(0).select(F.col("id").cast(kind).alias("doc_id"), F.col("id").cast(kind).alias("keep_id"), F.col("id").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
