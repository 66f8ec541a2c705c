"""Ranked lexical search: items times documents as a blocked product of sparse matrices, with the best of each row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch

#: Bytes of items' texts that make up one block of the left matrix, which is broadcast.
BLOCK_BYTES = 16 << 20
#: Documents whose part of the product is held at once, and shares of the tasks whose best rows meet first.
DOCUMENTS, SHARES = 8192, 64

#: Bytes of terms are ASCII letters and digits and all that is not ASCII; the others part terms. A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return raw.translate(_FOLD).split()


def _raw(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [Counter(terms(raw)) for raw in _raw(batch.column("text"))]
        names = pa.array([list(r) for r in rows], pa.list_(pa.binary()))
        times = pa.array([list(r.values()) for r in rows], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), names, times], ["item_id", "names", "times"])


@dataclass
class Block:
    """A block of items: the places of their terms, and each item's row of (term, multiplicity)."""

    ids: list[int | None]
    places: dict[bytes, int]
    rows: list[tuple[np.ndarray, np.ndarray]]


def _block(rows: list) -> Block:
    places: dict[bytes, int] = {}
    items: dict[int | None, Counter] = {}
    for r in rows:
        own = items.setdefault(r.item_id, Counter())
        for name, n in zip(r.names, r.times):
            own[places.setdefault(bytes(name), len(places))] += n
    matrix = [(np.array(list(c), dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in items.values()]
    return Block(list(items), places, matrix)


def _postings(block) -> Callable:
    """(doc_id, n, places, times) of each document with a term: n terms with repeats, and those of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = block.value.places.get
        for batch in batches:
            sizes, places, times = [], [], []
            for raw in _raw(batch.column("text")):
                found = terms(raw)
                held = Counter(map(get, found))
                held.pop(None, None)
                sizes.append(len(found))
                places.append(list(held))
                times.append(list(held.values()))
            kinds = [(pa.array(sizes, pa.int64()), "n"), (pa.array(places, pa.list_(pa.int32())), "places"),
                     (pa.array(times, pa.list_(pa.int32())), "times")]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), *(k[0] for k in kinds)], ["doc_id", *(k[1] for k in kinds)])
            yield out.filter(pa.array(np.array(sizes, dtype=np.int64) > 0))

    return run


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 * ln((2n + 2) / (2df + 1))), in doubles."""
    return np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one term adds to a document's score: grows with tf, and less so in documents longer than the mean."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _best(score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, equal ones by ascending id, null ids last."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((doc[near], null[near], -score[near]))[:k]]


def _product(shared, n_docs: int, n_terms: int, k: int, repeats: bool) -> Callable:
    """(item, doc_id, score): each item's best of the task's documents.

    The right matrix, terms times documents, is built for DOCUMENTS columns at a time, its rows sorted by term. Each
    item's row of the product is made by Gustavson's rule: the rows of its terms are merged by adding their int64
    impacts by document. The best of the row join the best of the columns before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        empty = np.empty(0, dtype=np.int64)
        best = [(empty, empty, empty.astype(bool))] * len(block.ids)
        for batch in batches:
            for s in range(0, batch.num_rows, DOCUMENTS):
                own = batch.slice(s, DOCUMENTS)
                column = own.column("doc_id")
                null = column.is_null().to_numpy(zero_copy_only=False)
                doc = column.fill_null(0).to_numpy().astype(np.int64)
                places, times = own.column("places"), own.column("times")
                sizes = places.value_lengths().to_numpy().astype(np.int64)
                term = places.flatten().to_numpy().astype(np.int64)
                tf = times.flatten().to_numpy().astype(np.int64)
                m = 100 - 90 + 90 * own.column("n").to_numpy().astype(np.int64) * n_docs // n_terms
                at = np.repeat(np.arange(len(doc)), sizes)
                value = impacts(weight[term], tf, m[at])
                order = np.argsort(term, kind="stable")
                term, at, value = term[order], at[order], value[order]
                for i, (wanted, many) in enumerate(block.rows):
                    begin, end = np.searchsorted(term, wanted), np.searchsorted(term, wanted, side="right")
                    length = end - begin
                    if not length.any():
                        continue
                    where = np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)
                    row = np.zeros(len(doc), dtype=np.int64)
                    np.add.at(row, at[where], value[where] * np.repeat(many, length) if repeats else value[where])
                    hit = np.flatnonzero(row)
                    hit = hit[_best(row[hit], doc[hit], null[hit], k)]
                    score, ids, none = (np.concatenate(x) for x in zip(best[i], (row[hit], doc[hit], null[hit])))
                    top = _best(score, ids, none, k)
                    best[i] = score[top], ids[top], none[top]
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        score, ids, none = (np.concatenate([b[j] for b in best] or [empty]) for j in range(3))
        columns = [pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _reduced(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item: first of each share of the tasks, then of all shares, so that no task gets the rows
    of all tasks."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("share", F.spark_partition_id() % SHARES)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order)))
    found = found.where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = 10, repeats: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents with the highest scores above 0, equal scores
    by ascending doc_id (nulls last); fewer where fewer have one.

    A term's weight is large where few documents hold it (``weights``), and its impact grows with its occurrences and
    falls with the document's length (``impacts``); a score sums the impacts of the item's terms, once each, or as
    often as the item has them with ``repeats``. Scores are exact 64-bit integers.

    ``docs`` (doc_id long, text) are read whole, once for each block of items; ``items`` (item_id long, text) are dealt to
    blocks of about BLOCK_BYTES by a hash, and a block's terms, counts and rows are broadcast. A task holds DOCUMENTS
    columns of the product and ``k`` rows an item. Rows of one item_id (null too) are one item. Null and empty texts have
    no terms: such documents are in no result and not counted, such items have no rows. Rows that repeat a doc_id are
    ranked each. More columns are ignored; an empty table on either side gives an empty one.
    """
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    held = given.mapInArrow(_item_terms, "item_id long, names array<binary>, times array<long>")
    size = F.aggregate("names", F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 16)
    held = scratch.save(held.where(F.size("names") > 0).withColumn("bytes", size), "items")
    blocks = -(-(held.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = _block(held.where(F.expr(f"pmod(xxhash64(item_id, 7), {blocks})") == b).orderBy("item_id").collect())
        shared = spark.sparkContext.broadcast(block)
        postings = texts.mapInArrow(_postings(shared), "doc_id long, n long, places array<int>, times array<int>")
        postings = scratch.save(postings, "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(block.places), dtype=np.int64)
        for r in postings.select(F.explode("places").alias("place")).groupBy("place").count().collect():
            df[r["place"]] = r["count"]
        both = spark.sparkContext.broadcast((block, weights(df, n_docs)))
        found = postings.mapInArrow(_product(both, n_docs, n_terms or 1, k, repeats), "item int, doc_id long, score long")
        names = spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long")
        best = scratch.save(_reduced(found, k), "best").join(F.broadcast(names), "item")
        scratch.drop(postings)
        out = best.select("item_id", "rank", "doc_id", "score") if b == 0 else out.unionByName(best.select("item_id", "rank", "doc_id", "score"))
    return out
