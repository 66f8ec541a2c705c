"""The first of each run of near rows, as one pass in order would keep them, found in parallel rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.scratch import broadcast_if_small, numbered, written

#: Rows whose decisions a task holds: a block of neighbours in the order.
BLOCK = 100_000


def _round(block: int):
    """(row, kept) of what can be decided: rows come by block and order, a line for each earlier neighbour that hasn't
    fallen, ``sure`` if it is kept. A row falls as soon as one earlier neighbour is kept; it is kept when none is
    left that might be. Decisions within the block count at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own = None, {}
        row, falls, waits = None, False, False
        out: tuple[list, list] = ([], [])

        def close() -> None:
            if row is not None and (falls or not waits):
                own[row] = not falls
                out[0].append(row)
                out[1].append(not falls)

        for batch in batches:
            for b, a, sure in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "sure"))):
                if b != row:
                    close()
                    row, falls, waits = b, False, False
                    if b // block != here:
                        here, own = b // block, {}
                if sure or own.get(a):
                    falls = True
                elif a not in own:
                    waits = True
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_())], ["row", "kept"])
            out = ([], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_())], ["row", "kept"])

    return run


def first_wins(rows: DataFrame, pairs: DataFrame, key: list[str], order: list[Column], block: int = BLOCK) -> DataFrame:
    """``rows`` with ``kept`` and ``leader`` (a struct of the key): going through all rows in the order, a row is kept if no
    row kept before it is near; else its leader is the first such. A kept row leads itself.

    ``rows`` have a unique key without nulls, ``order`` is total. ``pairs`` (a, b: structs of the key, either way round, may
    repeat; those of a row with itself are passed over) tells which rows are near.

    Rows are numbered by ranges. In each round, blocks of ``block`` rows are decided side by side, each in order, as far as
    their earlier neighbours are known; the others wait for the next round. Every round decides the first block that is
    open, and most of the rest with it: a chain of n rows takes n / ``block`` rounds at most, pairs in no order a few. A
    row with many neighbours is read as a stream; no group of pairs is held.
    """
    one = written(rows.select(F.struct(*key).alias("key"), *key, *[c for c in rows.columns if c not in key]), "rows")
    table = numbered(one.withColumn("_all", F.lit(0)), ["_all"], order, "row").drop("_all")
    table = written(table, "places")
    place = table.select("key", "row")
    ends = pairs.join(place.select(F.col("key").alias("a"), F.col("row").alias("i")), "a").join(place.select(F.col("key").alias("b"), F.col("row").alias("j")), "b")
    edges = ends.where("i <> j").select(F.greatest("i", "j").alias("b"), F.least("i", "j").alias("a")).distinct()
    edges = written(edges, "edges")
    later = written(edges.select(F.col("b").alias("row")).distinct(), "later")
    fallen = None
    open_ = written(_judged(edges, later), "open")
    while not open_.isEmpty():
        dealt = open_.repartition(F.floor(F.col("b") / block)).sortWithinPartitions("b")
        new = written(dealt.mapInArrow(_round(block), "row long, kept boolean"), "round")
        gone = new.where("not kept").select("row")
        fallen = gone if fallen is None else fallen.unionByName(gone)
        known = broadcast_if_small(new)
        rest = open_.select("b", "a").join(known.select(F.col("row").alias("b")), "b", "left_anti")
        rest = rest.join(known.where("not kept").select(F.col("row").alias("a")), "a", "left_anti")
        rest = written(rest, "rest")
        open_ = written(_judged(rest, written(rest.select(F.col("b").alias("row")).distinct(), "later")), "open")
    if fallen is None:
        return table.select(*rows.columns, F.lit(True).alias("kept"), F.col("key").alias("leader"))
    fallen = broadcast_if_small(written(fallen, "fallen"))
    of_kept = edges.join(fallen.withColumnRenamed("row", "a"), "a", "left_anti")
    heads = of_kept.join(fallen.withColumnRenamed("row", "b"), "b", "left_semi").groupBy(F.col("b").alias("row")).agg(F.min("a").alias("head"))
    named = written(heads, "heads").join(place.select(F.col("row").alias("head"), F.col("key").alias("leader")), "head").drop("head")
    out = table.join(named, "row", "left")
    return out.select(*rows.columns, F.col("leader").isNull().alias("kept"), F.coalesce("leader", "key").alias("leader"))


def _judged(edges: DataFrame, later: DataFrame) -> DataFrame:
    """The edges with ``sure``: whether the earlier row, which hasn't fallen, waits for no earlier neighbour itself, and so
    is kept."""
    known = broadcast_if_small(later).withColumn("waits", F.lit(True)).withColumnRenamed("row", "a")
    return edges.join(known, "a", "left").select("b", "a", F.col("waits").isNull().alias("sure"))
