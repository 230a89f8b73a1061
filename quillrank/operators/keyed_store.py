"""The record store as files: keyed, incremental, and safe to feed again.

Records lie in buckets by a hash of their key. A batch reads and rewrites only the buckets that it touches, under a folder of its own version, and then commits a manifest that names
the folder of every bucket. Readers follow the newest manifest, so they see all of a batch or nothing of it. A batch that comes again with a version already committed changes nothing; one
that failed before its commit is simply written anew. Files that neither the newest nor the manifest before it names are removed.

    path/data/v=<version>/bucket=<b>/*.parquet      records
    path/_manifest/<version>.json                   the folder of each bucket, and the batch's counters
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import store


class KeyedStore:
    """A store at a path of any of Spark's file systems. One writer at a time; any number of readers.

    `buckets` is fixed when the store is made: as many as its final size needs to keep a bucket within one task. The manifest, `buckets` numbers, is all that passes through the driver.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "dedupe_key", buckets: int = 64, refreshed: tuple[str, ...] = store.REFRESHED) -> None:
        self.spark, self.path, self.key, self.refreshed = spark, path.rstrip("/"), key, refreshed
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        newest = self.manifest()
        self.buckets = newest["of"] if newest else buckets

    def versions(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, the newest by default; None for an empty store."""
        known = self.versions()
        if version is None and not known:
            return None
        raw = self._fs.open(self._file(known[-1] if version is None else version))
        try:
            return json.loads(bytes(raw.readAllBytes()))
        finally:
            raw.close()

    def _file(self, version: int, name: str = "{:012d}.json"):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, name.format(version))

    def _commit(self, manifest: dict) -> None:
        """Writes the manifest beside its place and renames it, which readers see at once or not at all."""
        own = self._file(manifest["version"], "." + uuid.uuid4().hex)
        out = self._fs.create(own, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(own, self._file(manifest["version"])):
            self._fs.delete(own, False)
            raise RuntimeError(f"version {manifest['version']} was committed by another writer")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict | None, schema: StructType | None, wanted: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"]) if manifest else schema
        folders = sorted(f"{self.path}/data/v={v}/bucket={b}" for b, v in (manifest or {"buckets": {}})["buckets"].items() if wanted is None or int(b) in wanted)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """All records, as of the newest version or the one before it. An empty store can't be read: it has no columns yet."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"no batch has been merged into {self.path}")
        return self._read(found, None)

    def get(self, *keys: str) -> DataFrame:
        """The records of a few keys, from their buckets alone."""
        listed = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} string")
        wanted = {r[0] for r in listed.select(self._bucket()).distinct().collect()}
        found = self.manifest()
        return self._read(found, None, wanted).where(F.col(self.key).isin(*keys)) if found else listed.limit(0)

    def merge(self, records: DataFrame, version: int, order: Column) -> dict:
        """The store after an upsert of the records in `order` (see store.upsert); returns the batch's counters.

        Records without a key are counted as errors and left out. An empty batch commits a version without data. A version at or below the newest one is not written again; its counters are
        those of its first time.
        """
        newest = self.manifest()
        if newest and version <= newest["version"]:
            return self.manifest(version)["counts"] if version in self.versions() else newest["counts"]
        began, names = time.time(), [c for c in records.columns if not newest or c in StructType.fromJson(newest["schema"]).names]
        rows = records.withColumn("_order", order).persist()
        try:
            touched = {r["b"]: r["n"] for r in rows.groupBy(F.when(F.col(self.key).isNotNull(), self._bucket()).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each bucket
            errors, counts = touched.pop(None, 0), {"inserted": 0, "updated": 0}
            schema = StructType.fromJson(newest["schema"]) if newest else records.select(*names).schema
            if touched:
                old, seen = self._read(newest, schema, set(touched)), Observation()
                merged = store.upsert(old, rows, self.key, F.col("_order"), self.refreshed, flags=True)
                new = F.col("_n").isNotNull() & F.col("_old").isNull()
                merged = merged.observe(seen, F.count_if(new).alias("inserted"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).drop("_old", "_n").withColumn("bucket", self._bucket())
                merged.repartition(len(touched), "bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
                counts = {"inserted": seen.get["inserted"], "updated": seen.get["rows"] - seen.get["inserted"]}
        finally:
            rows.unpersist()
        counts |= {"fetched": sum(touched.values()) + errors, "errors": errors, "buckets": len(touched), "milliseconds": int(1000 * (time.time() - began))}
        folders = (newest["buckets"] if newest else {}) | {str(b): version for b in touched}
        self._commit({"version": version, "of": self.buckets, "schema": schema.jsonValue(), "buckets": folders, "counts": counts, "at": int(time.time())})
        self._sweep()
        return counts

    def _sweep(self) -> None:
        """Removes what the two newest manifests don't name. An older manifest's files are swept once, when it drops out."""
        known = self.versions()
        if len(known) < 3:
            return
        kept = {(b, v) for n in known[-2:] for b, v in self.manifest(n)["buckets"].items()}
        for b, v in self.manifest(known[-3])["buckets"].items():
            if (b, v) not in kept:
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/v={v}/bucket={b}"), True)

    def history(self) -> DataFrame:
        """One row per batch: version, at (seconds), fetched, inserted, updated, errors, buckets and milliseconds."""
        kept = ("fetched", "inserted", "updated", "errors", "buckets", "milliseconds")
        rows = [(m["version"], m["at"], *(m["counts"][k] for k in kept)) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("version", "at", *kept)))
