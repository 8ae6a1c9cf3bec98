"""A versioned archive store: immutable Parquet tables and one manifest for each version.

A commit writes new tables beside the old ones and then creates the next
version's manifest, which fails if another writer was first. A snapshot reads
the tables of one manifest, so all its relations belong together and later
commits don't touch it. Files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BOUNDS, CALLER_ROWS, CLOCK_OFFSETS, DOCUMENTS, KEYS, SEGMENT_INDEXES, SEGMENTS, SOURCES, WAL, Archive

FORMAT, VERSION = "tidemark-archive", 1
DEFAULTS = {
    "sources": SOURCES, "segments": SEGMENTS, "payload": "source_id BIGINT, stream STRING, seq BIGINT, ts BIGINT", "wal": WAL, "segment_indexes": SEGMENT_INDEXES,
    "clock_offsets": CLOCK_OFFSETS, "caller_rows": CALLER_ROWS, "documents": DOCUMENTS, "bounds": BOUNDS,
}
RELATIONS = [f.name for f in fields(Archive)]
#: Payload files are laid out by stream, so reads of a stream or of pruned segments skip the rest.
PARTITIONED = {"payload": KEYS}
WRITE_OPTIONS = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"}


class StoreError(RuntimeError):
    """What a store refuses."""


class AlreadyExists(StoreError):
    pass


class NotAnArchive(StoreError):
    pass


class UnsupportedSchema(StoreError):
    pass


class Conflict(StoreError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Append:
    """Rows that a commit adds to a relation, where a bare DataFrame replaces it."""

    rows: DataFrame


RUN = 256  # segments


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that must not exist, whole or not at all."""
        held = self.path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(held, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            # A rename onto a name that exists fails here, and with NONE atomically where the file system can.
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf).rename(held, self.path(name), self._options())
        except Exception as e:
            self.fs.delete(held, False)
            raise Conflict(f"{name} exists") from e

    def _options(self):
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE
        return options

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()


def _laid_out(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a stream together, in runs of RUN segments so that no stream is one task, sorted by time so that files and row groups can be skipped by it."""
    run = [F.expr(f"seq div {RUN}")] if "seq" in rows.columns else []
    return rows.repartition(*keys, *run).sortWithinPartitions(*keys, *(["ts"] if "ts" in rows.columns else []))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root)
        if sniff(spark, root) == "absent":
            raise NotAnArchive(f"{root} holds no archive")
        if sniff(spark, root) == "unsupported":
            raise UnsupportedSchema(f"{root} is of another version")

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> "Store":
        files = _Files(spark, root)
        if files.names("manifests"):
            raise AlreadyExists(f"{root} holds an archive already")
        files.fs.mkdirs(files.path("manifests"))
        files.create("manifests/00000000.json", json.dumps({"format": FORMAT, "schema": VERSION, "version": 0, "tables": {}, "notes": {}}))
        return cls(spark, root)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        at = max(self.versions()) if version is None else version
        return json.loads(self.files.read(f"manifests/{at:08d}.json"))

    def snapshot(self, version: int | None = None) -> Archive:
        """All relations as of one version, the newest unless another is named."""
        tables = self.manifest(version)["tables"]
        return Archive(**{name: self._table(name, tables.get(name, [])) for name in RELATIONS})

    def _table(self, name: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], DEFAULTS[name])
        # Parts of one schema are one scan, however many commits made them.
        alike: dict[str, list[str]] = {}
        for p in parts:
            alike.setdefault(p["schema"], []).append(f"{self.root}/data/{p['path']}")
        frames = [self._scan(name, schema, paths) for schema, paths in alike.items()]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def _scan(self, name: str, schema: str, paths: list[str]) -> DataFrame:
        if name not in PARTITIONED:
            return self.spark.read.schema(schema).parquet(*paths)
        # Partition columns are found below each part's folder, which therefore is a base of its own.
        frames = [self.spark.read.schema(schema).option("basePath", path).parquet(path) for path in paths]
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def commit(self, changes: Mapping[str, DataFrame | Append], expected: int | None = None, notes: Mapping[str, str] | None = None) -> int:
        """The version made of the newest, or `expected`, and the changes; Conflict if that isn't the newest any more."""
        base = self.manifest(expected)
        if expected is not None and expected != max(self.versions()):
            raise Conflict(f"version {expected} isn't the newest")
        tables = dict(base["tables"])
        for name, change in changes.items():
            if name not in RELATIONS:
                raise ValueError(f"an archive has no relation {name}")
            rows = change.rows if isinstance(change, Append) else change
            path = f"{name}/{uuid.uuid4().hex}"
            writer = rows.write.options(**WRITE_OPTIONS)
            if name in PARTITIONED:
                rows = _laid_out(rows, PARTITIONED[name])
                writer = rows.write.options(**WRITE_OPTIONS).partitionBy(*PARTITIONED[name])
            writer.parquet(f"{self.root}/data/{path}")
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
            tables[name] = [*(tables.get(name, []) if isinstance(change, Append) else []), {"path": path, "schema": ddl}]
        version = base["version"] + 1
        self.files.create(f"manifests/{version:08d}.json", json.dumps({"format": FORMAT, "schema": VERSION, "version": version, "tables": tables, "notes": {**base["notes"], **(notes or {})}}))
        return version

    def replace(self, archive: Archive, notes: Mapping[str, str] | None = None) -> int:
        """A version that holds just this archive."""
        return self.commit({name: getattr(archive, name) for name in RELATIONS}, notes=notes)

    def referenced_bytes(self, version: int | None = None) -> int:
        return sum(self.files.size(f"data/{p['path']}") for parts in self.manifest(version)["tables"].values() for p in parts)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops all versions but the newest `keep`, and the tables that no version left names. No commit may run meanwhile."""
        versions = sorted(self.versions())
        for old in versions[:-keep]:
            self.files.delete(f"manifests/{old:08d}.json")
        used = {p["path"] for v in versions[-keep:] for parts in self.manifest(v)["tables"].values() for p in parts}
        gone = [f"{name}/{path}" for name in self.files.names("data") for path in self.files.names(f"data/{name}") if f"{name}/{path}" not in used]
        for path in gone:
            self.files.delete(f"data/{path}")
        return gone

    def copy_to(self, root: str, version: int | None = None) -> "Store":
        """An exact copy of one version's files, as version 0 of another store."""
        manifest, to = self.manifest(version), _Files(self.spark, root)
        if to.names("manifests"):
            raise AlreadyExists(f"{root} holds an archive already")
        util, f = self.spark._jvm.org.apache.hadoop.fs.FileUtil, self.files
        for parts in manifest["tables"].values():
            for p in parts:
                to.fs.mkdirs(to.path(f"data/{p['path']}").getParent())
                util.copy(f.fs, f.path(f"data/{p['path']}"), to.fs, to.path(f"data/{p['path']}"), False, f.conf)
        to.fs.mkdirs(to.path("manifests"))
        to.create("manifests/00000000.json", json.dumps(manifest | {"version": 0}))
        return Store(self.spark, root)


def sniff(spark: SparkSession, root: str) -> str:
    """What lies at a path: archive, unsupported (another version's), other, absent."""
    files = _Files(spark, root)
    if not files.exists(""):
        return "absent"
    names = [n for n in files.names("manifests") if n.endswith(".json")]
    if not names:
        return "other" if files.names("") else "absent"
    try:
        manifest = json.loads(files.read(f"manifests/{names[-1]}"))
    except ValueError:
        return "other"
    if manifest.get("format") != FORMAT:
        return "other"
    return "archive" if manifest.get("schema") == VERSION else "unsupported"

