"""Tables with keyed writes over plain Parquet: buckets by key, copied on write, and a manifest that is swapped.

A row's bucket is a hash of its key. A write reads and writes the buckets of the changed keys alone, into a new folder, and then
puts a new manifest beside the old ones: a small file that says which folder holds each bucket. Readers see one manifest, so a write that
breaks off leaves the table as it was, and of two writes at once the second one fails. Folders that no kept manifest names
are removed by ``expire``.

The manifest is put in its place by a rename that does not overwrite, which file systems such as HDFS do at once.

Defined cases: a null key is a key like any other in writes, and never matches in changes by key; of changes with equal keys the last
by ``order`` counts; an empty change rewrites nothing; deleting keys that are not there rewrites their buckets as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docketspark.operators import relational as R

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another write has changed the table since this one read it."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        """``buckets``: fixed when the table is made; one for some hundred MB is a good number."""
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.rewritten: list[tuple[int, int]] = []  # of each write the buckets and the bytes

    # --- manifests

    def _file(self, *parts: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def versions(self) -> list[int]:
        system, at = self._file("manifests")
        if not system.exists(at):
            return []
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in system.listStatus(at) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, and the folder of every bucket that has rows."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        version = found[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def _swap(self, version: int, schema: StructType, folders: dict[str, str]) -> None:
        made = json.dumps({"version": version, "buckets": self.buckets, "schema": json.loads(schema.json()), "folders": folders})
        system, draft = self._file("manifests", f".{uuid.uuid4().hex}.draft")
        out = system.create(draft, False)
        out.write(bytearray(made.encode()))
        out.close()
        _, at = self._file("manifests", f"{version}.json")
        if system.exists(at) or not system.rename(draft, at):
            system.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # --- reading

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _of(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(manifest["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        return self._of(self.manifest(version))

    def lookup(self, *key) -> DataFrame:
        """The rows of one key; one bucket is read."""
        manifest = self.manifest()
        types = {f.name: f.dataType for f in StructType.fromJson(manifest["schema"])}
        asked = [F.lit(v).cast(types[k]) for k, v in zip(self.keys, key, strict=True)]
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(*asked), F.lit(manifest["buckets"])).cast("int").alias("b")).first()["b"]
        rows = self._of(manifest, [bucket])
        for k, v in zip(self.keys, asked, strict=True):
            rows = rows.filter(F.col(k) == v)
        return rows

    # --- writing

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The rows in a new folder; which part of it holds each bucket."""
        name = uuid.uuid4().hex
        rows.withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        system, at = self._file("data", name)
        found = {f.getPath().getName().removeprefix(f"{BUCKET}="): f"{name}/{f.getPath().getName()}" for f in system.listStatus(at) if f.isDirectory()}
        self.rewritten.append((len(found), system.getContentSummary(at).getLength()))
        return found

    def create(self, rows: DataFrame) -> None:
        self._swap(1, rows.schema, self._write(rows))

    def _rewrite(self, changed: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Changes the buckets of ``changed``'s keys: at most as many numbers as there are buckets come to the driver."""
        manifest = self.manifest()
        self.buckets = manifest["buckets"]
        touched = [r[0] for r in changed.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        made = self._write(change(self._of(manifest, touched)))
        folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | made
        self._swap(manifest["version"] + 1, StructType.fromJson(manifest["schema"]), folders)

    def upsert(self, changes: DataFrame, order: Column) -> None:
        self._rewrite(changes, lambda rows: R.upsert(rows, changes, self.keys, order))

    def insert_ignore(self, rows: DataFrame) -> None:
        self._rewrite(rows, lambda there: R.insert_ignore(there, rows, self.keys))

    def guarded_update(self, changes: DataFrame, columns: list[str], verified: str) -> None:
        self._rewrite(changes, lambda rows: R.guarded_update(rows, changes, self.keys, columns, verified))

    def delete(self, gone: DataFrame) -> None:
        """Deletes the rows of the keys in ``gone``."""
        self._rewrite(gone, lambda rows: rows.join(gone.select(*self.keys), self.keys, "left_anti"))

    def expire(self, keep: int = 2) -> int:
        """Removes manifests but the last ``keep``, and the folders that none of these names; returns how many folders went."""
        last = self.versions()[-keep:]
        named = {f for v in last for f in self.manifest(v)["folders"].values()}
        for v in self.versions()[:-keep]:
            system, at = self._file("manifests", f"{v}.json")
            system.delete(at, False)
        system, at = self._file("data")
        gone = 0
        for folder in system.listStatus(at):
            parts = list(system.listStatus(folder.getPath()))
            unused = [p.getPath() for p in parts if p.isDirectory() and f"{folder.getPath().getName()}/{p.getPath().getName()}" not in named]
            gone += len(unused)
            if len(unused) == sum(p.isDirectory() for p in parts):
                system.delete(folder.getPath(), True)
            else:
                for p in unused:
                    system.delete(p, True)
        return gone


def delete_cascade(gone: DataFrame, parent: KeyedTable, children: list[KeyedTable]) -> None:
    """Deletes the parent's keys and what hangs on them, the children first. Children are bucketed by the parent's key, so only the
    buckets of these keys are rewritten; a cascade that breaks off leaves no row whose parent is gone, and can be run again."""
    for table in [*children, parent]:
        table.delete(gone.select(*table.keys))
