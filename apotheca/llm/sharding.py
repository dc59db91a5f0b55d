"""Shards of a growing table: small appends, size-tiered compaction, versioned manifests.

``append`` writes arrivals as small immutable Parquet files. ``compact`` puts files into tiers by size; a tier below the
target with at least ``fanout`` files is merged into files of about the target size. Every change makes a new
manifest, which lists all live files and is committed by renaming a finished file to the next version's name. The
rename fails if another writer was first, so readers see a version whole or not at all, and old versions stay readable
until ``vacuum``.

All rows move through DataFrame reads and writes: a merge is a scan, a narrow coalesce and a write, with no shuffle, so
one source with most of the rows is only more files. The driver handles the manifest, a line per file.

Defined results: rows are kept as they are, with all columns, nulls and repeats, whatever their names. An empty
table makes a version without files, which reads back as an empty table of the same schema. Arrivals that are null
go together. Texts are never cut. The rename is atomic on HDFS and on local and other file systems that rename
atomically.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARRIVAL = "__arrival"


class CommitConflict(RuntimeError):
    """Another writer has committed this version first; read it and try again."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class ShardStore:
    """A table under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4):
        self.spark, self.root, self.target_bytes, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    # Files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    @property
    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    # Manifests

    def latest(self) -> int:
        """The last committed version, 0 if there is none."""
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return 0
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.latest() if version is None else version
        if not version:
            return Manifest(0, "", ())
        stream = self._files.open(self._path(self._manifest_path(version)))
        try:
            lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()
        return Manifest(version, lines[0], tuple(Shard(**json.loads(line)) for line in lines[1:]))

    def commit(self, before: Manifest, schema: str, shards: list[Shard]) -> Manifest:
        """Make ``shards`` the version after ``before``, or raise CommitConflict if that version exists."""
        after, files = Manifest(before.version + 1, schema, tuple(sorted(shards, key=lambda s: s.path))), self._files
        final, draft = self._path(self._manifest_path(after.version)), self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(bytearray("\n".join([schema, *(json.dumps(s.__dict__) for s in after.shards)]).encode()))
        stream.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise CommitConflict(str(after.version))
        return after

    # Rows

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not paths:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind))
        return self.spark.read.schema(kind).parquet(*paths)

    def _written(self, folder: str, schema: str) -> list[Shard]:
        """The files under a folder with their rows and sizes, from their footers."""
        rows = self._load([folder], schema).groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n"))
        return [Shard(r["file_path"], r["n"], r["file_size"]) for r in rows.collect()]

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; ``shard_col`` adds the path of the file that holds each."""
        found = self.manifest(version)
        df = self._load([s.path for s in found.shards], found.schema)
        names = [f"`{f['name']}`" for f in json.loads(found.schema)["fields"]]
        if shard_col is None:
            return df.select(*names)
        return df.select(*names, (F.col("_metadata.file_path") if found.shards else F.lit(None).cast("string")).alias(shard_col))

    def append(self, rows: DataFrame, arrival: Column | None = None) -> Manifest:
        """Write rows as small files, those of an arrival apart from others, and commit them. Nothing is shuffled."""
        before, folder, schema = self.manifest(), f"{self.root}/shards/{uuid.uuid4().hex}", json.dumps(rows.schema.jsonValue())
        if before.version and T.StructType.fromJson(json.loads(before.schema)).simpleString() != rows.schema.simpleString():
            raise ValueError("rows of another schema")
        writer = rows.write if arrival is None else rows.withColumn(_ARRIVAL, arrival).write.partitionBy(_ARRIVAL)
        writer.parquet(folder)
        try:
            added = self._written(folder, schema)
        except PySparkException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            added = []
        return self.commit(before, before.schema or schema, [*before.shards, *(s for s in added if s.rows)])

    def tiers(self, found: Manifest) -> dict[int, list[Shard]]:
        """Files below half of the target by tier: tier t holds sizes from target / 2 / fanout ** (t + 1) up to target / 2 / fanout ** t."""
        out: dict[int, list[Shard]] = {}
        for shard in found.shards:
            tier, above = 0, self.target_bytes / 2 / self.fanout
            while shard.bytes < above and tier < 12:
                tier, above = tier + 1, above / self.fanout
            if shard.bytes < self.target_bytes / 2:
                out.setdefault(tier, []).append(shard)
        return out

    def compact(self) -> Manifest:
        """Merge tiers, smallest sizes first, until none has ``fanout`` files; each merge is a version of its own."""
        found = self.manifest()
        while full := [t for t, shards in self.tiers(found).items() if len(shards) >= self.fanout]:
            merged = self.tiers(found)[max(full)]
            folder, files = f"{self.root}/shards/{uuid.uuid4().hex}", max(1, -(-sum(s.bytes for s in merged) // self.target_bytes))
            names = [f"`{f['name']}`" for f in json.loads(found.schema)["fields"]]
            self._load([s.path for s in merged], found.schema).select(*names).coalesce(files).write.parquet(folder)
            gone = {s.path for s in merged}
            found = self.commit(found, found.schema, [*(s for s in found.shards if s.path not in gone), *(s for s in self._written(folder, found.schema) if s.rows)])
        return found

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete older versions and the files that only they list; returns how many files went."""
        last, files = self.latest(), self._files
        live = {s.path for v in range(max(1, last - keep_versions + 1), last + 1) for s in self.manifest(v).shards}
        gone = set()
        for version in range(last - keep_versions, 0, -1):
            if not files.exists(self._path(self._manifest_path(version))):
                break
            gone |= {s.path for s in self.manifest(version).shards} - live
            files.delete(self._path(self._manifest_path(version)), False)
        for path in gone:
            files.delete(self._path(path), False)
        return len(gone)
