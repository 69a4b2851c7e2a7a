"""Tables of snapshots: a manifest a version names the folders that make it up.

A write puts its folders beside those of the current version and then publishes
a manifest by a rename that fails if the version is taken, so readers see the
version before or the one after, whatever fails in between. A writer's batches
are recorded in the manifest with their effect: a batch that comes again (a
stream after a restart) changes nothing. Only the parts that a write touches are
written anew. Folders that the newest ``KEPT`` manifests don't name are removed
after a write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.streaming import logs

KEPT = 2


@dataclass(frozen=True)
class Manifest:
    """``folders``: folder by name of the part that it holds. ``batches``: last batch by writer."""

    version: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Files:
    """The folder of a table, in whatever file system its address names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.path(path)
        self.fs = self.root.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.manifests = self.path(f"{path}/manifests")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.manifests):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.manifests)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def at(self, version: int):
        return self.path(f"{self.manifests}/{version:012}.json")

    def manifest(self, version: int) -> Manifest:
        stream = self.fs.open(self.at(version))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def publish(self, manifest: Manifest) -> None:
        """The manifest written under another name, then renamed: whole or not at all, and never over another."""
        draft = self.path(f"{self.manifests}/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            stream.close()
        none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
        options[0] = none
        try:
            self.context.rename(draft, self.at(manifest.version), options)
        except Exception as error:
            self.fs.delete(draft, False)
            if self.fs.exists(self.at(manifest.version)):
                raise Conflict(f"version {manifest.version} is taken") from error
            raise

    def sweep(self, kept: int = KEPT) -> None:
        """Removes old manifests, then folders that no manifest kept names. Folders of writes under way have no manifest yet, so only those of removed manifests go."""
        every = self.versions()
        used = {f for v in every[-kept:] for f in self.manifest(v).folders.values()}
        for v in every[:-kept]:
            gone = set(self.manifest(v).folders.values()) - used
            self.fs.delete(self.at(v), False)
            for folder in gone:
                self.fs.delete(self.path(f"{self.root}/{folder}"), True)


def current(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest; an empty one (version 0) where there is no table yet."""
    files = Files(spark, path)
    every = files.versions()
    return files.manifest(every[-1]) if every else Manifest()


def read(spark: SparkSession, path: str, schema: str, manifest: Manifest | None = None, parts: Iterable[str] | None = None) -> DataFrame:
    """The table as its newest manifest (or the given one) has it, or some parts of it; no rows where there is none."""
    manifest = current(spark, path) if manifest is None else manifest
    names = manifest.folders.keys() if parts is None else manifest.folders.keys() & set(parts)
    folders = [f"{path}/{manifest.folders[n]}" for n in sorted(names)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write(spark: SparkSession, path: str, before: Manifest, frames: dict[str, DataFrame], whole: bool = False, batch: tuple[str, int] | None = None) -> Manifest:
    """A version after ``before`` with these parts anew (and no others, if ``whole``)."""
    files, token = Files(spark, path), uuid.uuid4().hex
    folders = {}
    for name, df in frames.items():
        folders[name] = f"part-{token}-{name}"
        df.write.parquet(f"{path}/{folders[name]}")
    return published(files, before, folders, whole, batch)


def published(files: Files, before: Manifest, folders: dict[str, str], whole: bool, batch: tuple[str, int] | None) -> Manifest:
    batches = before.batches | ({batch[0]: batch[1]} if batch else {})
    after = replace(before, version=before.version + 1, folders=folders if whole else before.folders | folders, batches=batches)
    files.publish(after)
    files.sweep()
    return after


def replaced(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> Manifest:
    """The table that ``change`` makes of the current one."""
    before = current(spark, path)
    return write(spark, path, before, {"all": change(read(spark, path, schema, before))}, whole=True)


def truncated(spark: SparkSession, path: str, schema: str) -> Manifest:
    """A version without rows."""
    return replaced(spark, path, schema, lambda table: table.limit(0))


def added(spark: SparkSession, path: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> Manifest:
    """A version with ``rows`` more; nothing that is there is written anew."""
    before = current(spark, path)
    if batch and before.batches.get(batch[0], -1) >= batch[1]:
        return before
    return write(spark, path, before, {uuid.uuid4().hex: rows}, batch=batch)


def retained(spark: SparkSession, path: str, rows: DataFrame, order: list[str], most: int, by: str | None = None, parts: int = 16, batch: tuple[str, int] | None = None) -> Manifest:
    """Appends ``rows`` and keeps the newest ``most`` (of each ``by``), in one version.

    With ``by``, the table lies in ``parts`` by its hash, and only parts that
    ``rows`` touch are read and written. ``serial`` holds the order of writes, so
    that what a later batch brings is newer, whatever its times; within a batch
    ``order`` counts. A batch (writer, number) that the table holds already
    changes nothing.
    """
    before = current(spark, path)
    if batch and before.batches.get(batch[0], -1) >= batch[1]:
        return before
    part = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int") if by else F.lit(0)
    new = rows.withColumn("serial", F.lit(before.version + 1).cast("long")).withColumn("part", part)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields if f.name != "part")
    touched = [str(r["part"]) for r in new.select("part").distinct().collect()]  # at most ``parts``
    if not touched:
        return published(Files(spark, path), before, {}, False, batch) if batch else before
    held = read(spark, path, schema, before, touched).withColumn("part", part)
    newest: list[Column] = [F.desc("serial"), *[F.desc(o) for o in order]]
    kept = logs.retained(held.unionByName(new), newest, most, [by] if by else None)
    folder = f"part-{uuid.uuid4().hex}"
    kept.repartition(max(1, len(touched)), "part").sortWithinPartitions("part", *([by] if by else []), "serial", *order).write.partitionBy("part").parquet(f"{path}/{folder}")
    return published(Files(spark, path), before, {p: f"{folder}/part={p}" for p in touched}, False, batch)


def session_log(stream: DataFrame, path: str, checkpoint: str, session: str, order: list[str], most: int = logs.SESSION_LOGS, writer: str = "log"):
    """A stream of records appended by session: a session's records stay in the order of their batches, the newest ``most`` of each stay, and a batch that is delivered again writes nothing.

    Batches of one stream follow one another, so no record of a session can pass
    an earlier one; other streams on the same table are other ``writer``s, and a
    version that another has taken makes the batch start anew.
    """

    def put(batch: DataFrame, number: int) -> None:
        for again in range(5):
            try:
                retained(batch.sparkSession, path, batch, order, most, session, batch=(writer, number))
                return
            except Conflict:
                if again == 4:
                    raise

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
