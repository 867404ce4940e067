"""Tables that are replaced by key, in versions: each write adds what it changes, readers see whole versions only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import file_system


def upserted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key the one latest by `order`: the last write wins.

    Combined before the shuffle, so a key with very many rows sends one from each task. Of rows that tie in `order` the
    greatest by the other columns, in their order, stays (these must be comparable: no maps).
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max(F.struct(F.col(order), *rest)).alias("__last"))
    return last.select(*[F.col(c) if c == key else F.col(f"__last.{c}").alias(c) for c in rows.columns])


class KeyedStore:
    """A table with one group of rows for each key (a document, or a document's vector entries) under a path.

    A version is a manifest: a base table and the changes since, each with the rows that a write brought and the keys
    that it replaced or removed. A manifest is created once its files are whole, so a failed write changes nothing, and
    of two writers of one version the second fails. After COMPACT changes the table is written anew; what no manifest
    but old ones names is removed by `vacuum`. Versions count from 1.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _versions(self) -> list[int]:
        fs, where = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}").first()[0])

    def _commit(self, manifest: dict) -> int:
        version = self.version() + 1
        fs, where = file_system(self.spark, f"{self.path}/manifests/{version}")
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return version

    def _write(self, rows: DataFrame, what: str) -> str:
        name = f"{what}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def table(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, the last one by default."""
        version = version or self.version()
        if not version:
            raise ValueError("nothing has been saved yet")
        manifest = self._manifest(version)
        changes = [self._read(c["keys"]).withColumn("__n", F.lit(i)) for i, c in enumerate(manifest["changes"])]
        if not changes:
            return self._read(manifest["base"])
        touched = changes[0]
        for c in changes[1:]:
            touched = touched.unionByName(c)
        last = touched.groupBy(self.key).agg(F.max("__n").alias("__last"))
        base = self._read(manifest["base"])
        out = base.join(last, self.key, "left_anti")
        new = None
        for i, c in enumerate(manifest["changes"]):
            if c["rows"]:
                rows = self._read(c["rows"]).withColumn("__n", F.lit(i))
                new = rows if new is None else new.unionByName(rows)
        if new is None:
            return out
        new = new.join(last, self.key).where("__n = __last").select(*base.columns)
        return out.select(*base.columns).unionByName(new)

    def _change(self, keys: DataFrame, rows: DataFrame | None) -> int:
        version = self.version()
        manifest = self._manifest(version)
        change = {"rows": None if rows is None else self._write(rows, "rows"), "keys": None}
        own = keys if change["rows"] is None else self._read(change["rows"])
        change["keys"] = self._write(own.select(self.key).distinct(), "keys")
        version = self._commit(manifest | {"changes": [*manifest["changes"], change]})
        return self.compact() if len(manifest["changes"]) + 1 >= self.COMPACT else version

    def save(self, rows: DataFrame) -> int:
        """Replace the rows of the keys in `rows`; the new version. It costs what it writes, whatever the table holds."""
        if not self.version():
            return self._commit({"base": self._write(rows, "base"), "changes": []})
        return self._change(rows, rows)

    def delete(self, keys: DataFrame) -> int:
        return self._change(keys, None)

    def compact(self) -> int:
        """The same table as one base; a version of its own."""
        return self._commit({"base": self._write(self.table(), "base"), "changes": []})

    def vacuum(self, keep: int = 2) -> None:
        """Remove the manifests but the last `keep`, and the tables that only they name."""
        versions = self._versions()
        used = set()
        for v in versions[-keep:]:
            manifest = self._manifest(v)
            used |= {manifest["base"], *(n for c in manifest["changes"] for n in c.values() if n)}
        for v in versions[:-keep]:
            fs, where = file_system(self.spark, f"{self.path}/manifests/{v}")
            fs.delete(where, False)
        fs, where = file_system(self.spark, self.path)
        for status in fs.listStatus(where):
            if (name := status.getPath().getName()) not in used and name != "manifests":
                fs.delete(status.getPath(), True)

    def get(self, value) -> DataFrame:
        if value is None:
            raise ValueError("a key is needed")
        return self.table().where(F.col(self.key) == value)

    def contains(self, value) -> bool:
        return bool(self.get(value).take(1))

    def size(self) -> int:
        return self.table().select(self.key).distinct().count()

    def for_each(self, work) -> None:
        """Run `work` (an iterator of rows) on each partition of the table."""
        self.table().foreachPartition(work)
