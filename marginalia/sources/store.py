"""Versioned Parquet tables: a commit writes what it changes, readers merge.

Every commit writes to a folder of its own, ``try-<id>``, and then claims the next version and renames that folder to
``v=N``.  Readers use the highest version, so they see all tables of one commit or none.  A writer that dies while writing
leaves a ``try-`` folder that nobody reads, and no claim.

A commit holds a table whole (``<table>/full``) or as a change (``<table>/rows`` and ``<table>/gone``): rows that
replace those of the same key, and keys without rows.  A table that a commit does not name stays as it was.  The table of a
version is its last whole form and the changes after it; ``compact`` writes a whole form again when changes have piled up.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import BROADCAST_BYTES

SCHEMA_VERSION = 2
STALE_SECONDS = 600
#: Changes of a table before a whole form is due.
MOST_CHANGES = 16
#: Bytes of keys in memory for a byte of compressed Parquet, at most.
_UNPACKED = 16


class StoreError(RuntimeError):
    """A store operation failed; the committed version is unchanged."""


@dataclass
class Change:
    """Rows to put in place of those with the same ``key``, and ``gone`` keys (other columns are not read) to take out.

    A key may have several rows in one change; keys are never null.  A key in both has the new rows.
    """

    key: Sequence[str]
    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, partition_by: dict[str, str] | None = None):
        """``partition_by`` names the column by whose values the files of a table are parted."""
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), partition_by or {}

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts) -> list[str]:
        return [e.getPath().getName() for e in self._fs().listStatus(self._path(*parts))]

    def versions(self) -> list[int]:
        """Numbers of the complete commits, oldest first."""
        if not self._fs().exists(self._path()):
            return []
        return sorted(int(name[2:]) for name in self._names() if name.startswith("v=") and name[2:].isdigit())

    def version(self) -> int:
        """Number of the latest complete commit, 0 for an empty store."""
        return max(self.versions(), default=0)

    def _segments(self, version: int) -> dict[str, list[tuple[int, str]]]:
        """Folders that make up each table at a version, the whole form first."""
        found: dict[str, list[tuple[int, str]]] = {}
        whole: set[str] = set()
        for v in reversed([v for v in self.versions() if v <= version]):
            for name in self._names(f"v={v}"):
                if name in whole:
                    continue
                kinds = self._names(f"v={v}", name)
                if "full" in kinds:
                    whole.add(name)
                found[name] = [(v, kind) for kind in ("full", "rows", "gone") if kind in kinds] + found.get(name, [])
        return found

    def _bytes(self, *parts) -> int:
        return self._fs().getContentSummary(self._path(*parts)).getLength()

    def _key(self, v: int, name: str) -> list[str]:
        """Key columns of a change, in the name of a folder beside its rows."""
        return next(k for k in self._names(f"v={v}", name) if k.startswith("key="))[4:].split(",")

    def _merged(self, name: str, segments: list[tuple[int, str]]) -> DataFrame:
        read = {(v, kind): self.spark.read.parquet(f"{self.root}/v={v}/{name}/{kind}") for v, kind in segments}
        parts = [df.withColumn("_seg", F.lit(v)) for (v, kind), df in read.items() if kind != "gone"]
        changes = [(v, kind) for v, kind in segments if kind != "full"]
        if not changes:
            return parts[0].drop("_seg")
        key = self._key(changes[-1][0], name)
        touched = reduce(DataFrame.unionByName, [read[v, kind].select(*key, F.lit(v).alias("_last")) for v, kind in changes])
        touched = touched.groupBy(*key).agg(F.max("_last").alias("_last"))
        # the changes are measured on disk; while they are small, the whole form is not shuffled to be read
        if _UNPACKED * sum(self._bytes(f"v={v}", name, kind) for v, kind in changes) <= BROADCAST_BYTES:
            touched = F.broadcast(touched)
        if not parts:
            return read[changes[-1]].limit(0)
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return rows.join(touched, key, "left").filter(F.col("_last").isNull() | (F.col("_seg") >= F.col("_last"))).select(
            *[c for c in rows.columns if c != "_seg"])

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of the latest (or a given) version, read lazily and pinned to it."""
        version = self.version() if version is None else version
        return {name: self._merged(name, segments) for name, segments in self._segments(version).items()} if version else {}

    def commit(self, tables: dict[str, DataFrame | Change], base: int | None = None) -> int:
        """Write tables or changes as the next version; ``base`` is the version they were derived from."""
        fs, latest = self._fs(), self.version()
        if base is not None and base != latest:
            raise StoreError("the store changed in another session; refresh and retry")
        attempt = f"try-{uuid.uuid4().hex}"
        fs.mkdirs(self._path(attempt))

        def write(name, kind, df):
            column = self.partition_by.get(name)
            # without rows there would be no folder to tell the schema
            parted = column is not None and column in df.columns and not df.isEmpty()
            out = (df.repartition(column) if parted else df).write.mode("error").option("compression", "zstd")
            (out.partitionBy(column) if parted else out).parquet(
                f"{self.root}/{attempt}/{name}/{kind}")

        known = self._segments(latest)
        for name, value in tables.items():
            if isinstance(value, Change) and value.rows is not None and not known.get(name):
                value = value.rows          # the first rows of a table are its whole form
            if isinstance(value, DataFrame):
                write(name, "full", value)
                continue
            if value.rows is not None:
                write(name, "rows", value.rows)
            if value.gone is not None:
                write(name, "gone", value.gone.select(*value.key).distinct())
            fs.mkdirs(self._path(attempt, name, "key=" + ",".join(value.key)))
        self._publish(attempt, latest + 1)
        return latest + 1

    def _publish(self, attempt: str, version: int) -> None:
        """One writer can create the claim of a version, and holds it for two renames.

        A claim left by a writer that died meanwhile is moved away under a name of one's own, which only one of several
        takers can do, and looked at once more: a fresh one that got there in between is put back.  Before the version is
        published, the claim has to carry this attempt's name still.
        """
        fs, claim, target = self._fs(), self._path(f"next-{version}"), self._path(f"v={version}")

        def stale(path) -> bool:
            return time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > STALE_SECONDS

        if fs.exists(claim) and stale(claim):
            aside = self._path(f"stale-{attempt}")
            if fs.rename(claim, aside):
                if stale(aside):
                    fs.delete(aside, False)
                else:
                    fs.rename(aside, claim)
        try:
            out = fs.create(claim, False)
        except Exception as exc:
            raise StoreError("another writer is committing; refresh and retry") from exc
        out.writeUTF(attempt)
        out.close()
        held = self._path(f"done-{attempt}")
        try:
            if self._holder(claim) != attempt or fs.exists(target) or not fs.rename(self._path(attempt), target):
                raise StoreError("the store changed in another session; refresh and retry")
        finally:
            if self._holder(claim) == attempt and fs.rename(claim, held):
                fs.delete(held, False)

    def _holder(self, claim) -> str | None:
        fs = self._fs()
        if not fs.exists(claim) or not fs.getFileStatus(claim).getLen():
            return None
        into = fs.open(claim)
        try:
            return into.readUTF()
        finally:
            into.close()

    def compact(self, most_changes: int = MOST_CHANGES) -> int:
        """Write a whole form of every table with more than ``most_changes`` changes, or whose changes have grown to half of
        the whole form; the version number, also when nothing was due."""
        version = self.version()
        due = {}
        for name, segments in self._segments(version).items():
            sizes = {kind: sum(self._bytes(f"v={v}", name, k) for v, k in segments if (k == "full") == (kind == "full")) for kind in ("full", "change")}
            changes = {v for v, kind in segments if kind != "full"}
            if len(changes) > most_changes or (len(changes) > 1 and sizes["full"] and 2 * sizes["change"] > sizes["full"]):
                due[name] = self._merged(name, segments)
        return self.commit(due, version) if due else version

    def vacuum(self) -> list[int]:
        """Delete the versions that the latest one does not read; their numbers.  Readers of those versions must be done."""
        version = self.version()
        used = {v for segments in self._segments(version).values() for v, _ in segments} | {version}
        old = [v for v in self.versions() if v not in used]
        for v in old:
            self._fs().delete(self._path(f"v={v}"), True)
        return old
