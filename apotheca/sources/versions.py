"""Tables that change by batches: buckets of keys, of which a batch rewrites only those that it touches.

A version is a small file that names a folder for each bucket; it is committed by one rename, so readers see a batch
whole or not at all. Versions are numbered by the batch, so a batch that is delivered again changes nothing.
The driver holds a line for each bucket, and their number is fixed when a table is made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apotheca.sources.store import _files, _last_version


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def version(self) -> int:
        return _last_version(self.spark, self.path)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        files, hadoop = _files(self.spark, self.path)
        stream = files.open(hadoop(f"{self.path}/versions/{version:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): f for b, f in json.loads(text).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        folders = self.folders(version)
        found = [f"{self.path}/{f}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found)

    def merge(self, changes: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int] | None:
        """combine(rows, changes) in place of the rows of all buckets that ``changes`` touches; returns these buckets.

        ``changes`` have the table's keys. A batch that was merged before, or that is older than one that was, is left out.
        """
        last = self.version()
        if batch + 1 <= last:
            return None
        changes = changes.persist()
        try:
            touched = sorted(r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect())
            folder = f"rows-{uuid.uuid4().hex}"
            if touched:
                rows = combine(self.read(touched, last), changes).select(*self.schema.names)
                # Salted by whole rows, so that a bucket, or one common key, is several tasks; each writes at most a file for each bucket.
                dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket", F.pmod(F.hash(*self.schema.names), F.lit(4)))
                dealt.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            self._commit({**{b: f for b, f in self.folders(last).items() if b not in touched}, **self._written(folder, touched)}, batch + 1)
        finally:
            changes.unpersist()
        return touched

    def _written(self, folder: str, touched: list[int]) -> dict[int, str]:
        files, hadoop = _files(self.spark, self.path)
        return {b: f"{folder}/bucket={b}" for b in touched if files.exists(hadoop(f"{self.path}/{folder}/bucket={b}"))}

    def _commit(self, folders: dict[int, str], version: int) -> None:
        files, hadoop = _files(self.spark, self.path)
        draft, final = hadoop(f"{self.path}/versions/_{uuid.uuid4().hex}"), hadoop(f"{self.path}/versions/{version:012d}")
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")

    def vacuum(self, keep: int = 2) -> None:
        """Delete folders that none of the last ``keep`` versions names, and the versions before these."""
        files, hadoop = _files(self.spark, self.path)
        if not files.exists(hadoop(f"{self.path}/versions")):
            return
        known = sorted(int(n) for s in files.listStatus(hadoop(f"{self.path}/versions")) if (n := s.getPath().getName()).isdigit())
        kept: dict[str, set[str]] = {}
        for v in known[-keep:]:
            for folder, part in (f.split("/") for f in self.folders(v).values()):
                kept.setdefault(folder, set()).add(part)
        for status in files.listStatus(hadoop(self.path)):
            name = status.getPath().getName()
            if name.startswith("rows-") and name not in kept:
                files.delete(status.getPath(), True)
            elif name.startswith("rows-"):
                for part in files.listStatus(status.getPath()):
                    if part.getPath().getName().startswith("bucket=") and part.getPath().getName() not in kept[name]:
                        files.delete(part.getPath(), True)
        for v in known[:-keep]:
            files.delete(hadoop(f"{self.path}/versions/{v:012d}"), False)
