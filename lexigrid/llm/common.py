"""Helpers shared by the training-data operators: tables, shared storage, bounded broadcasts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: The contracts' word: a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as one str.translate table, for Python code.
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
TO_SPACE = str.maketrans({c: " " for c in WORD_SPACE[1:]})


def words_of(text: str) -> list[str]:
    """Words of a text in the sense of WORD (str.split() alone would also split at other Unicode spaces)."""
    return [w for w in text.translate(TO_SPACE).split(" ") if w]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables that the innermost `passing` block deletes.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def dropped(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def materialised(df: DataFrame, what: str, lasting: bool = False) -> DataFrame:
    """Cut the lineage with a table in the shared folder: it survives lost executors, and later jobs only read it.

    In a `passing` block the table goes with the block, unless it is `lasting`.
    """
    path = scratch(df.sparkSession, what)
    if not lasting and (paths := _passing.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Free what ended jobs hold: Spark deletes their shuffle files and broadcasts when the driver collects its garbage, by itself twice an hour only."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """At its end the tables that were materialised in the block are deleted: only its lasting ones may be read after it."""
    token = _passing.set([])
    try:
        yield
    finally:
        paths = _passing.get()
        _passing.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        tidy(spark)


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int, by: list[str], how: str = "inner", parts: int = 1000) -> DataFrame:
    """Join on a key (of one column or several) where a few keys may hold most rows of `left`, without a hot task and with one pass over `left`.

    `right` has each key once, few narrow columns, and in `weight` the number of rows of `left` with that key. At most
    `parts` keys can hold a `parts`-th of `total` rows or more each: their list is broadcast, of a proven size. Rows of
    `left` with such a key are dealt, by the columns `by`, to so many parts that each has about half of that share, and
    its one row in `right` is copied to each. `weight` isn't in the result. Null keys find no partner.
    """
    limit = max(2, -(-int(total) // parts))
    salts = F.ceil(F.col(weight) * 2 / limit).cast("int")
    keys = [key] if isinstance(key, str) else key
    heavy = F.broadcast(right.where(F.col(weight) >= limit).select(*[F.col(k).alias(f"__{k}") for k in keys], salts.alias("__salts")))
    left = left.join(heavy, reduce(and_, (F.col(k) == F.col(f"__{k}") for k in keys)), "left")
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("__salts")).cast("int")).otherwise(0)
    left = left.withColumn("__salt", salt).drop(*[f"__{k}" for k in keys], "__salts")
    copies = F.when(F.col(weight) >= limit, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return left.join(right.withColumn("__salt", F.explode(copies)).drop(weight), [*keys, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long): one row (node, root) for each node, root its component's smallest node.

    Alternating large-star and small-star steps; each keeps the number of edges linear and ends in stars around the
    smallest node. Neighbourhoods are never collected: a step needs the smallest neighbour of each node only, a
    map-side combined minimum, joined back to the edges (a hot node's rows are split by the skewed-join rule).
    Lineage is cut in the shared folder after each round. Self-loops and repeated edges are allowed; nulls are dropped.
    """
    now = edges.where("a is not null and b is not null and a <> b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialised(now, "edges")
    digest = _digest(now)
    while True:  # each round shortens every path, so it ends after about log(nodes) of them
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = down.join(least, F.col("a") == F.col("k")).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = small.select("e.a", "e.b").where("a <> b").distinct()
        after = materialised(after, "edges")
        before, digest = digest, _digest(after)
        dropped(now)
        now = after
        if digest == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def prefix_sums(df: DataFrame, group: str, order: list[str], size: str, out: str, bucket: str) -> DataFrame:
    """`out`: the sum of `size` over the rows before this one in its group, by (`bucket`, *`order`).

    Two levels: within (group, bucket), then over the buckets' sums; no group is ever sorted in one task.
    """
    inner = W.partitionBy(group, bucket).orderBy(*order)
    rows = df.withColumn("__in", F.sum(size).over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
    sums = df.groupBy(group, bucket).agg(F.sum(size).alias("__sum"))
    over = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)
    sums = sums.select(F.col(group).alias("__g"), F.col(bucket).alias("__b"), (F.sum("__sum").over(over) - F.col("__sum")).alias("__before"))
    rows = rows.join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return rows.withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before", "__g", "__b")


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Parts of a batch whose texts hold about `limit` bytes (one row at least), so that memory doesn't follow row counts."""
    at = batch.schema.get_field_index(column)
    lengths = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
