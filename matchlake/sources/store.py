"""Keyed tables of Parquet in buckets of the key: a write makes new files for the buckets it touches and a new manifest.

A manifest names the files of every bucket; it is written beside the others and put in place by one rename, so readers of
an older one are not disturbed and a write that fails leaves the table as it was. Files that the newest KEEP manifests don't
name are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests, with their files, that are kept for readers that have begun.
KEEP = 2


class DuplicateKeyError(ValueError):
    """A row to be added has a key that is there already."""


class KeyedTable:
    """Rows with a unique key under a folder of any file system that Spark can write; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        fs, target = self._fs(f"{self.path}/manifests/{version}.json")
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _newest(self) -> dict:
        done = self._versions()
        return self._manifest(done[-1]) if done else {"files": {}, "rows": {}}

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        paths = sorted({p for b, p in manifest["files"].items() if only is None or int(b) in only})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def read(self) -> DataFrame:
        return self._read(self._newest())

    def _commit(self, manifest: dict) -> None:
        version = max(self._versions(), default=0) + 1
        fs, part = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        if not fs.rename(part, self._fs(f"{self.path}/manifests/{version}.json")[1]):
            raise OSError(f"{self.path}: version {version} could not be put in place")
        old = self._versions()[:-KEEP]
        named = {p.split("/")[0] for v in self._versions()[-KEEP:] for p in self._manifest(v)["files"].values()}
        for v in old:
            for folder in {p.split("/")[0] for p in self._manifest(v)["files"].values()} - named:
                fs.delete(self._fs(f"{self.path}/{folder}")[1], True)
            fs.delete(self._fs(f"{self.path}/manifests/{v}.json")[1], False)

    def _write(self, rows: DataFrame, touched: set[int], manifest: dict) -> None:
        """``rows`` are all rows of the ``touched`` buckets from now on."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket(F.col(self.key))).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        done = self.spark.read.schema(f"{self.schema}, __bucket int").parquet(f"{self.path}/{name}")
        counts = {r["__bucket"]: r["count"] for r in done.groupBy("__bucket").count().collect()}  # a row a bucket
        files = {b: p for b, p in manifest["files"].items() if int(b) not in touched} | {str(b): f"{name}/__bucket={b}" for b in counts}
        sizes = {b: n for b, n in manifest["rows"].items() if int(b) not in touched} | {str(b): n for b, n in counts.items()}
        self._commit({"files": files, "rows": sizes})

    def get(self, *keys) -> DataFrame:
        """Rows with these keys, out of the buckets that may hold them."""
        where = self.spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("k")).select(self._bucket(F.col("k")).alias("b")).distinct().collect()
        return self._read(self._newest(), {r.b for r in where}).where(F.col(self.key).isin(*keys))

    def has(self, column: str, value) -> bool:
        """Whether a row has ``value`` in a column, such as a provider's own id."""
        return not self.read().where(F.col(column) == F.lit(value)).isEmpty()

    def count(self) -> int:
        return sum(self._newest()["rows"].values())

    def add(self, rows: DataFrame, unique: list[str] | None = None) -> int:
        """Append rows with new keys and return their number. A key that is there already, or twice in ``rows``, raises and
        nothing is written; so does, with ``unique``, a combination of those columns under another key."""
        rows = rows.select(*self.read().columns)
        for names in ([self.key], *([unique] if unique else [])):
            if not rows.groupBy(*names).count().where("count > 1").isEmpty() or not rows.join(self.read(), names, "left_semi").isEmpty():
                raise DuplicateKeyError(f"{self.path}: {', '.join(names)} is there already")
        return self.upsert(rows)

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those with their key and are added where there is none; returns how many were added. Of equal keys in
        ``rows`` one is taken. Only the buckets of these keys are read and written."""
        manifest = self._newest()
        rows = rows.select(*self.read().columns).dropDuplicates([self.key]).persist()
        try:
            touched = {r.b for r in rows.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()}  # at most one a bucket
            if not touched:
                return 0
            before = sum(n for b, n in manifest["rows"].items() if int(b) in touched)
            self._write(self._read(manifest, touched).join(rows.select(self.key), self.key, "left_anti").unionByName(rows), touched, manifest)
            return sum(n for b, n in self._newest()["rows"].items() if int(b) in touched) - before
        finally:
            rows.unpersist()

    def replace(self, rows: DataFrame) -> None:
        """Rows replace those with their key; a key that isn't there raises."""
        if not rows.join(self.read(), self.key, "left_anti").isEmpty():
            raise KeyError(f"{self.path}: a key is not there")
        self.upsert(rows)

    def clear(self) -> None:
        self._commit({"files": {}, "rows": {}})
