"""Folders that are built once from source files and found again by later sessions, as long as those files stay."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from siltstone.sources.scratch import shared_folder


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of the files under the paths."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    for path in paths:
        at = hadoop.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def persisted(spark: SparkSession, name: str, paths: list[str], build: Callable[[str], object], base: str | None = None) -> str:
    """The folder that ``build`` has written for these source files, under ``base`` (else the shared folder). If there is
    none yet, a new one is built; a pointer file that names it is put in place by one rename when all of it is
    written, so a build that was cut off is never used, and of two at once the first to end counts."""
    hadoop, root = spark._jvm.org.apache.hadoop.fs, (base or shared_folder(spark)).rstrip("/")
    pointer = hadoop.Path(f"{root}/{name}-{fingerprint(spark, paths)}.pointer")
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        path = f"{root}/{name}-{uuid.uuid4().hex}"
        build(path)
        draft = hadoop.Path(f"{path}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(path.encode()))
        out.close()
        fs.rename(draft, pointer)
    return spark.read.text(pointer.toString()).first()[0]


def write_table(df: DataFrame, path: str, partition_by: str | None = None, options: dict[str, str] | None = None) -> None:
    """The table with its schema beside it, so that an empty one can be read again."""
    writer = df.write.options(**(options or {}))
    writer = writer.partitionBy(partition_by) if partition_by else writer
    writer.parquet(path)
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.text(f"{path}.schema")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.text(f"{path}.schema").first()[0]
    return spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(path)
