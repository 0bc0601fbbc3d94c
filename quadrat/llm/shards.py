"""Sharding by size-tiered compaction under versioned manifests.

A store is a folder of immutable Parquet shards and of manifests, one small JSON
file a version, that list the live shards and the schema. append() writes
arrivals as they are partitioned, one small shard a task, without a shuffle, and
commits a version with them added. compact() sorts live shards into tiers, each
FAN_IN times as large as the one below; the shards of a tier that has FAN_IN or
more of them, all smaller than the target, are merged into files of about the
target size, each tier by itself, so that only runs of similar size are merged
and a large shard isn't rewritten for the sake of small ones. Merging is a scan
that packs whole shards into tasks of the target size, without a shuffle.

Commits are optimistic: a manifest is written aside and moved to its number, which
fails if that number exists. A writer that loses reads the new version and commits
its change on top of it, if that still holds; compact() raises Conflict if a shard
that it merged is gone, append() only after RETRIES losses. The move must be atomic
and never overwrite: on a local disk it is a hard link, on HDFS-like file systems
their rename. On object stores that copy and delete instead (NOT_ATOMIC), opening
a store raises unless the caller warrants that it is the only writer.

The schema of a store grows: a column that an append adds is null in the rows
before, one that it lacks is null in its own rows. An append that gives a column
another type, or two columns whose names differ by case only, raises SchemaChange
and changes nothing.

Readers see one version, whole. A writer announces its folder under `pending`
before it writes; vacuum() removes shards that no kept manifest names, but spares
folders that are announced and shards or manifests that were in use less than
`older_than` seconds ago. Announcements of lost jobs count for `abandoned` seconds.

Defined results: all columns, whatever their names, and all rows, nulls, empty and
very long texts and repeated rows included, are kept as they are; ties in size are
merged in the order of path; an empty append commits a version without new
shards; an empty store reads as no rows of the first append's schema, one without
any append as no columns.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 4
TARGET_BYTES = 128 << 20
SMALLEST = 64 << 10
#: Commits that a writer tries before it gives up.
RETRIES = 20
#: Seconds for which readers may use a version after it was replaced.
OLDER_THAN = 24 * 3600
#: Seconds after which an announced folder without a commit counts as lost.
ABANDONED = 7 * 24 * 3600
#: Schemes of stores whose rename isn't atomic.
NOT_ATOMIC = frozenset("s3 s3a s3n gs oss cos cosn obs swift wasb wasbs ks3 tos".split())


class Conflict(RuntimeError):
    """Another writer has committed a version that this change doesn't fit."""


class SchemaChange(ValueError):
    """The appended columns contradict the store's."""


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, those of old first, all nullable."""
    fields = {f.name.lower(): T.StructField(f.name, f.dataType, True) for f in (old or [])}
    for f in new:
        known = fields.setdefault(f.name.lower(), T.StructField(f.name, f.dataType, True))
        if known.name != f.name or T.StructType([known]).simpleString() != T.StructType([f]).simpleString():
            raise SchemaChange(f"column {known.name} {known.dataType.simpleString()} can't become {f.name} {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


def packs(sizes: list[int], target: int) -> int:
    """Tasks into which a scan packs whole files, largest first, up to the target size each."""
    n, room = 0, 0
    for s in sorted(sizes, reverse=True):
        if not n or s > room:
            n, room = n + 1, target
        room -= s
    return n


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, only_writer: bool = False) -> None:
        self.spark, self.folder, self.target, self.fan_in = spark, folder.rstrip("/"), target_bytes, fan_in
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme in NOT_ATOMIC and not only_writer:
            raise ValueError(f"renames on {self._scheme} aren't atomic, so writers could lose each other's versions; pass only_writer=True if there is one writer")

    # -- manifests

    def _names(self, folder: str) -> list:
        path = self._path(f"{self.folder}/{folder}")
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._names("manifests")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "schema", "shards": [{"path", "bytes", "rows", "level"}]}"""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "schema": None, "shards": []}
            version = known[-1]
        stream = self._fs.open(self._path(f"{self.folder}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, base: dict, schema: str | None, shards: list[dict]) -> dict:
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        aside = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        name = self._path(f"{self.folder}/manifests/{new['version']:012d}.json")
        try:
            self._move(aside, name)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or isinstance(e, FileExistsError):
                raise Conflict(f"version {new['version']} is taken") from e
            raise
        finally:
            self._fs.delete(aside, False)
        return new

    def _move(self, aside, name) -> None:
        """Give the file its name, unless that is taken."""
        if self._scheme == "file":  # a rename on a local disk would replace the other's file
            os.link(aside.toUri().getPath(), name.toUri().getPath())
            return
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(aside, name, never)

    def _change(self, change: Callable[[dict], tuple[str | None, list[dict]]]) -> dict:
        """Commit what change makes of the last version, again on the next one if another writer was first."""
        for k in range(RETRIES):
            base = self.manifest()
            made = change(base)
            try:
                return self._commit(base, *made)
            except Conflict:
                if k == RETRIES - 1:
                    raise
        raise AssertionError

    # -- shards

    def _write(self, df: DataFrame, level: int, batch: str) -> list[dict]:
        """Write df into the announced folder; an entry for each file with rows."""
        path = f"{self.folder}/shards/{batch}"
        df.write.option("compression", "zstd").parquet(path)
        files = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")}
        if not files:
            return []
        back = self.spark.read.schema(df.schema).parquet(path)
        meta = back.groupBy(back.metadataColumn("_metadata")["file_name"].alias("name")).agg(F.count("*").alias("rows"))
        rows = {r.name: r.rows for r in meta.toLocalIterator()}
        return [{"path": f"{path}/{n}", "bytes": b, "rows": rows[n], "level": level} for n, b in sorted(files.items()) if rows.get(n)]

    def _announced(self, df: DataFrame, level: int, change: Callable[[dict, list[dict]], tuple[str | None, list[dict]]]) -> dict:
        """Write df as shards and commit them; nothing of them stays if that fails."""
        batch = uuid.uuid4().hex
        mark = self._path(f"{self.folder}/pending/{batch}")
        self._fs.create(mark, False).close()
        try:
            made = self._write(df, level, batch)
            return self._change(lambda base: change(base, made))
        except BaseException:
            self._fs.delete(self._path(f"{self.folder}/shards/{batch}"), True)
            raise
        finally:
            self._fs.delete(mark, False)

    def append(self, df: DataFrame) -> dict:
        """Add the rows of df as small shards, one for each of its partitions."""

        def added(base: dict, made: list[dict]) -> tuple[str, list[dict]]:
            return merged_schema(_schema(base), df.schema).json(), base["shards"] + made

        added(self.manifest(), [])  # raises before anything is written
        return self._announced(df, 0, added)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fan_in)))

    def due(self, shards: list[dict]) -> list[list[dict]]:
        """The shards of each tier that is to be merged, smallest tier first."""
        tiers: dict[int, list[dict]] = defaultdict(list)
        for s in sorted(shards, key=lambda s: s["path"]):
            if s["bytes"] < self.target * 3 // 4:
                tiers[self.tier(s["bytes"])].append(s)
        many = [t for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]
        # where two don't fit the target size together, merging leaves as many files as before
        return [t for t in many if packs([s["bytes"] for s in t], self.target) < len(t)]

    def compact(self) -> dict:
        """Merge tiers until none is due; the last manifest."""
        while True:
            base = self.manifest()
            due = self.due(base["shards"])
            if not due:
                return base
            for run in due:
                self._merge(run, base["schema"])

    def _merge(self, run: list[dict], schema: str) -> dict:
        """One task reads whole shards up to the target size and writes one file."""
        gone = {s["path"] for s in run}

        def replaced(base: dict, made: list[dict]) -> tuple[str, list[dict]]:
            if not gone <= {s["path"] for s in base["shards"]}:
                raise Conflict("another writer has replaced the merged shards")
            return base["schema"], [s for s in base["shards"] if s["path"] not in gone] + made

        # settings of a session of its own, so that queries beside it keep theirs
        session = self.spark.newSession()
        for k, v in self.spark.conf.getAll.items():
            if self.spark.conf.isModifiable(k):
                session.conf.set(k, v)
        total = sum(s["bytes"] for s in run)
        for k, v in {"spark.sql.files.maxPartitionBytes": self.target, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": max(1, total // self.target)}.items():
            session.conf.set(k, str(v))
        return self._announced(_rows(session, run, schema), 1 + max(s["level"] for s in run), replaced)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["shards"]:
            return self.spark.createDataFrame([], _schema(m) or T.StructType())
        return _rows(self.spark, m["shards"], m["schema"])

    def vacuum(self, keep: int = 1, older_than: float = OLDER_THAN, abandoned: float = ABANDONED) -> int:
        """Delete shards that nobody can be using; how many.

        Kept are the last `keep` manifests, those that were the last one less than
        older_than seconds ago, the shards that kept ones name, folders that
        writers have announced, and whatever is younger than older_than seconds.
        """
        now = time.time()
        old = lambda s, seconds: s.getModificationTime() / 1000 <= now - seconds
        # in this order a folder is announced or committed by the time that is looked at
        batches = self._names("shards")
        files = {b.getPath().getName(): [s for s in self._fs.listStatus(b.getPath()) if s.getPath().getName().endswith(".parquet")] for b in batches}
        marks = self._names("pending")
        pending = {s.getPath().getName() for s in marks if not old(s, abandoned)}
        known = self.versions()
        ended = {v: self._fs.getFileStatus(self._path(f"{self.folder}/manifests/{w:012d}.json")) for v, w in zip(known, known[1:])}
        expired = [v for v in known[: max(0, len(known) - max(keep, 1))] if old(ended[v], older_than)]
        live = {s["path"] for v in known if v not in expired for s in self.manifest(v)["shards"]}
        for v in expired:
            self._fs.delete(self._path(f"{self.folder}/manifests/{v:012d}.json"), False)
        gone = 0
        for b in batches:
            name = b.getPath().getName()
            if name in pending or not old(b, older_than) or not all(old(s, older_than) for s in files[name]):
                continue
            names = {f"{self.folder}/shards/{name}/{s.getPath().getName()}" for s in files[name]}
            for n in names - live:
                self._fs.delete(self._path(n), False)
                gone += 1
            if not names & live:
                self._fs.delete(b.getPath(), True)
        for s in marks:
            if old(s, abandoned):
                self._fs.delete(s.getPath(), False)
        return gone


def _schema(manifest: dict) -> T.StructType | None:
    return T.StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else None


def _rows(spark: SparkSession, shards: list[dict], schema: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[s["path"] for s in shards])


def sharded(docs: DataFrame, folder: str, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Append docs to the store in `folder` and compact it; old versions stay until a vacuum()."""
    store = ShardStore(docs.sparkSession, folder, target_bytes)
    store.append(docs)
    store.compact()
    return store
