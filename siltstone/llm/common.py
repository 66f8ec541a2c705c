"""Scratch tables in the cluster's shared folder, size-checked broadcasts and streaming over sorted groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows of a few numbers each, that is broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of a side of longer rows that are broadcast.
BROADCAST_BYTES = 64 << 20


class Scratch:
    """Tables written to the folder that ``spark.checkpoint.dir`` names. Where that is unset, a local session gets a
    temporary folder, and a cluster, whose machines share none, an error.

    A written table cuts the lineage and outlives the executor that wrote it. ``drop`` deletes a table that is no
    longer read; the rest goes when the driver's JVM ends, because a returned DataFrame may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            base = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._siltstone_path = path  # keeps the id from being reused while the table lives
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(table._siltstone_path), True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """The table itself, marked for broadcast if it has at most ``rows`` rows and, where ``size`` gives the bytes of a
    row, BROADCAST_BYTES in all. Look at it only once it is written."""
    if df.limit(rows + 1).count() > rows:
        return df
    if size is not None and (df.agg(F.sum(size)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def drop_rows(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is not in the written table ``ids``; rows with a null key stay."""
    return docs.join(small(ids.select(key)), key, "left_anti")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def inner_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Every run of equal keys in a sorted stream; a run may span batches and must be bounded."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        value = table.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
        for s, e in zip(starts[:-1], starts[1:]):
            yield table.slice(s, e - s)
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def texts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Chunks (first row, UTF-8 texts; null: empty) of about ``most`` bytes; one text may exceed that."""
    part: list[bytes] = []
    first = size = 0
    for i, value in enumerate(column):
        raw = value.as_py()
        raw = b"" if raw is None else raw.encode("utf-8", "surrogatepass")
        if part and size + len(raw) > most:
            yield first, part
            part, first, size = [], i, 0
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part
