"""Tables of versions: each commit writes the buckets that it touches and is put in place by one exclusive file."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit has taken the version that this one was to follow."""


class VersionedTable:
    """Rows with a unique, non-null key, dealt over a fixed number of buckets by a hash of it.

    ``log`` has a small file for each version: where each bucket's rows lie, and a note. A commit writes the buckets that
    change to a folder of their own, then its log file, complete, under the next number; that fails if the number is
    taken. So a reader sees all of a commit or nothing, a commit that dies leaves the version before as it was, and
    of two that follow one version the second gets a Conflict. Older versions stay readable. Stores must be able to rename
    (or, for local folders, link) a file unless its name is taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> VersionedTable:
        """A new table at version 0 with these rows."""
        table = cls(rows.sparkSession, path)
        empty = {"schema": rows.schema.json(), "key": key, "parts": [None] * buckets}
        table._publish(0, empty | {"parts": table._write(rows, empty, range(buckets)), "note": {"action": "create"}})
        return table

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    @property
    def version(self) -> int:
        """The number of the last commit."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("log"))]
        return max(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def entry(self, version: int | None = None) -> dict:
        """The log entry of a version: schema, key, parts and note."""
        number = self.version if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/log/{number:012d}.json", wholetext=True).first()[0])

    def history(self) -> list[dict]:
        """The notes of all versions, oldest first."""
        return [self.entry(v)["note"] | {"version": v} for v in range(self.version + 1)]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        entry = self.entry(version)
        chosen = range(len(entry["parts"])) if buckets is None else buckets
        paths = [f"{self.path}/{entry['parts'][b]}" for b in chosen if entry["parts"][b]]
        kind = StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def bucket_of(self, entry: dict, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(len(entry["parts"]))).cast("int")

    def _write(self, rows: DataFrame, entry: dict, touched) -> list[str | None]:
        """The parts of a version after ``rows`` has become all of the touched buckets' rows."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self.bucket_of(entry, F.col(entry["key"])))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {f.getPath().getName() for f in self._fs.listStatus(self._at(folder))}
        parts = list(entry["parts"])
        for b in touched:
            name = f"_bucket={b}"
            parts[b] = f"{folder}/{name}" if name in there else None
        return parts

    def _publish(self, version: int, entry: dict) -> int:
        """Puts a log entry in place under its number, or raises Conflict."""
        self._fs.mkdirs(self._at("log"))
        draft, target = self._at("log", f"{uuid.uuid4().hex}.draft"), self._at("log", f"{version:012d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                local = self.spark._jvm.java.nio.file
                local.Files.createLink(local.Path.of(target.toUri().getPath(), self._none()), local.Path.of(draft.toUri().getPath(), self._none()))
            elif not self._fs.rename(draft, target):
                raise Conflict(f"version {version} is taken")
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is taken") from None
            raise
        finally:
            self._fs.delete(draft, False)
        return version

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0)

    def put(self, parent: int, rows: DataFrame, deleted: DataFrame | None = None, note: dict | None = None) -> int:
        """The version after ``parent`` in which ``rows`` are added, or take the place of those with their keys, and the
        keys of ``deleted`` are gone; its number. Only the buckets that hold one of these keys are read and written."""
        entry = self.entry(parent)
        key, kind = entry["key"], StructType.fromJson(json.loads(entry["schema"]))
        keys = rows.select(key)
        if deleted is not None:
            keys = keys.unionByName(deleted.select(key))
        touched = [r[0] for r in keys.select(self.bucket_of(entry, F.col(key))).distinct().collect()]
        kept = self.read(parent, touched).join(keys.distinct(), key, "left_anti")
        parts = self._write(kept.select(*kind.names).unionByName(rows.select(*kind.names)), entry, touched)
        return self._publish(parent + 1, entry | {"parts": parts, "note": note or {}})

    def restore(self, version: int, parent: int | None = None) -> int:
        """A new version that reads the same files as an older one."""
        parent = self.version if parent is None else parent
        return self._publish(parent + 1, self.entry(version) | {"note": {"action": "restore", "of": version}})
