"""Tables with versions: segments of files that never change, a manifest for each version, and one atomic step.

    path/data/<id>/…          segments; a newer one's rows of a key stand in place of those in older ones
    path/versions/<number>    manifests: the segments of a version, oldest first

A writer writes a segment, then a manifest beside the others, and gives it the next version's name, which fails if
that name exists; then it looks at the new version and tries again, without writing its segment anew. So writers
need no lock, and a crash at any point leaves a version whole and files that no version names. A reader takes one
manifest and reads its files only; it changes nothing, and sees either all of a commit or nothing.

An upsert writes its own rows and no old ones. Which row of a key counts is decided on reading: that of the newest
segment, or in a table with an order column the last by that (nulls first, then the newest). Segments are merged once a newer one is
not much smaller than the one before, so there are few of them (their sizes are a geometric row), and a row is
rewritten a logarithmic number of times, whatever the number of batches.

The name is given by a hard link on local disks and by a rename elsewhere, which HDFS and stores with atomic renames
refuse if the target exists. Stores without that (plain object stores) are not safe for several writers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A newer segment is merged with the one before if that one is under so many times as large.
GROWTH = 4
#: Tries of a commit before other writers are blamed.
TRIES = 100
GONE = "__gone"


class Conflict(RuntimeError):
    """Others have changed what a commit was made from."""


class SnapshotTable:
    """The table at path. key: its rows' key; order: of a key's rows the last by this column counts.

    Without an order a key may have several rows, as children of a parent do, and a write replaces them all.
    A table that nothing was written to has no rows, of `schema` if it is given.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str | None = None, schema: str | StructType | None = None):
        self.spark, self.path, self.key, self.order, self.schema = spark, path.rstrip("/"), key, order, schema
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # files

    def _names(self, folder: str) -> list[str]:
        at = self._place(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._place(f"{self.path}/versions/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the manifest became the version that it says it is; no if there is one already."""
        beside, at = self._place(f"{self.path}/versions/_{uuid.uuid4().hex}"), self._place(f"{self.path}/versions/{manifest['version']:012d}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            return self._name(beside, at)
        finally:
            self._fs.delete(beside, False)

    def _name(self, beside, at) -> bool:
        if self._fs.getScheme() != "file":
            return self._fs.rename(beside, at)
        nio = self.spark._jvm.java.nio.file
        try:  # a rename on a local disk would replace the target
            nio.Files.createLink(nio.Path.of(at.toUri().getPath(), self.spark._sc._gateway.new_array(self.spark._jvm.String, 0)), nio.Path.of(beside.toUri().getPath(), self.spark._sc._gateway.new_array(self.spark._jvm.String, 0)))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise

    # versions

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest if none is named."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "segments": [], "tags": {}}
        return json.loads(self._read(f"{version:012d}"))

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """The version made by a change of the newest manifest; the newest one if the change is None."""
        for _ in range(TRIES):
            base = self.manifest()
            new = change(json.loads(json.dumps(base)))
            if new is None:
                return base["version"]
            new["version"] = base["version"] + 1
            if self._publish(new):
                return new["version"]
        raise Conflict(f"{self.path}: other writers were faster {TRIES} times")

    # reading

    def _type(self, manifest: dict) -> StructType:
        if manifest["schema"]:
            return StructType.fromJson(manifest["schema"])
        if self.schema is None:
            raise FileNotFoundError(f"{self.path}: nothing was written, and no schema is given")
        return self.schema if isinstance(self.schema, StructType) else StructType.fromDDL(self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. What is committed later does not change them."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict) -> DataFrame:
        schema = self._type(manifest)
        if not manifest["segments"]:
            return self.spark.createDataFrame([], schema)
        return self._merged(manifest["segments"], schema).filter(f"not {GONE}").drop(GONE)

    def _merged(self, segments: list[dict], schema: StructType) -> DataFrame:
        """The rows of segments that count, with those that only say that a key is gone."""
        stored = StructType(schema.fields).add(GONE, "boolean")
        parts = [self.spark.read.schema(stored).parquet(f"{self.path}/data/{s['id']}") for s in segments]
        if len(parts) == 1:
            return parts[0]
        if self.order:
            rows = reduce(DataFrame.unionByName, [p.withColumn("__n", F.lit(n)) for n, p in enumerate(parts)])
            # a key has a row in each segment at most, so no key is hot
            last = Window.partitionBy(*self.key).orderBy(F.desc_nulls_last(self.order), F.desc("__n"))
            return rows.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r", "__n")
        kept = [parts[-1]]
        for n in range(len(parts) - 2, -1, -1):
            newer = reduce(DataFrame.unionByName, [p.select(*self.key) for p in parts[n + 1 :]])
            same = reduce(lambda a, b: a & b, [parts[n][k].eqNullSafe(newer[k]) for k in self.key])
            kept.append(parts[n].join(newer, same, "left_anti"))
        return reduce(DataFrame.unionByName, kept)

    # writing

    def _segment(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        at = f"{self.path}/data/{name}"
        rows.write.parquet(at)
        size = self._fs.getContentSummary(self._place(at)).getLength()
        return {"id": name, "bytes": size}

    def _stored(self, rows: DataFrame, schema: StructType) -> DataFrame:
        named = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]
        return rows.select(*named, F.col(GONE) if GONE in rows.columns else F.lit(False).alias(GONE))

    def _done(self, manifest: dict, tag: tuple[str, int] | None) -> bool:
        return tag is not None and manifest["tags"].get(tag[0], -1) >= tag[1]

    def put(self, rows: DataFrame, touched: DataFrame | None = None, tag: tuple[str, int] | None = None) -> int:
        """rows in place of those with their keys, and nothing in place of touched keys that rows has not; the version.

        With an order, only the last row of a key is written. tag: a source and the number of its batch; a batch
        that was committed is not written again.
        """
        base = self.manifest()
        if self._done(base, tag):
            return base["version"]
        schema = StructType([f for f in rows.schema.fields if f.name != GONE]) if not base["schema"] and self.schema is None else self._type(base)
        new = self._stored(rows, schema)
        if self.order:
            last = Window.partitionBy(*self.key).orderBy(F.desc_nulls_last(self.order))
            new = new.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")
        if touched is not None:
            keys = touched.select(*[F.col(k).cast(schema[k].dataType).alias(k) for k in self.key]).distinct()
            same = reduce(lambda a, b: a & b, [keys[k].eqNullSafe(new[k]) for k in self.key])
            absent = keys.join(new.select(*self.key), same, "left_anti")
            marks = absent.select(*[F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.lit(True).alias(GONE))
            new = new.unionByName(marks)
        segment = self._segment(new)

        def change(manifest: dict) -> dict | None:
            if self._done(manifest, tag):
                return None
            manifest["schema"] = manifest["schema"] or json.loads(schema.json())
            manifest["segments"].append(segment)
            if tag:
                manifest["tags"][tag[0]] = tag[1]
            return manifest

        return self._commit(change)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """The whole table as a function of itself; made anew from the newest version if others commit meanwhile."""
        return self._replace(lambda base: change(self._rows(base)))

    def replace(self, rows: DataFrame) -> int:
        """rows as the whole table, which they may be made from."""
        return self._replace(lambda _: rows)

    def _replace(self, make: Callable[[dict], DataFrame]) -> int:
        for _ in range(TRIES):
            base = self.manifest()
            rows = make(base)
            schema = rows.schema
            new = base | {"version": base["version"] + 1, "schema": json.loads(schema.json()), "segments": [self._segment(self._stored(rows, schema))]}
            if self._publish(new):
                return new["version"]
        raise Conflict(f"{self.path}: other writers were faster {TRIES} times")

    def merge(self) -> int:
        """Makes one segment of the newest ones, as far back as one is under GROWTH times as large as those after it."""
        manifest = self.manifest()
        segments, first = manifest["segments"], len(manifest["segments"]) - 1
        size = segments[-1]["bytes"] if segments else 0
        while first > 0 and segments[first - 1]["bytes"] < GROWTH * size:
            first -= 1
            size += segments[first]["bytes"]
        run = segments[first:]
        if len(run) < 2:
            return manifest["version"]
        rows = self._merged(run, self._type(manifest))
        whole = self._segment(rows if first else rows.filter(f"not {GONE}"))

        def change(now: dict) -> dict | None:
            ids = [s["id"] for s in now["segments"]]
            if run[0]["id"] not in ids:
                return None
            at = ids.index(run[0]["id"])
            if ids[at : at + len(run)] != [s["id"] for s in run] or bool(at) != bool(first):
                return None
            now["segments"][at : at + len(run)] = [whole]
            return now

        return self._commit(change)

    def expire(self, keep: int = 5, hours: float = 24) -> None:
        """Deletes all versions but the newest, and files that none of those names and that are older than so many hours.

        A reader of an older version, or a writer that takes longer than that, would miss its files.
        """
        found = self.versions()
        left = found[-keep:]
        used = {s["id"] for v in left for s in self.manifest(v)["segments"]}
        for v in found[:-keep]:
            self._fs.delete(self._place(f"{self.path}/versions/{v:012d}"), False)
        old = (time.time() - hours * 3600) * 1000
        for folder, known in (("data", used), ("versions", {f"{v:012d}" for v in found})):
            for name in self._names(folder):
                at = self._place(f"{self.path}/{folder}/{name}")
                if name not in known and self._fs.getFileStatus(at).getModificationTime() <= old:
                    self._fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table with versions is at path."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    at = place(f"{path.rstrip('/')}/versions")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
