"""Vector codes: parts of vectors are replaced by the index of their nearest codebook entry, found in a kd-tree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, inner_name, small

#: Entries of a leaf of the tree at most, and vectors that descend it together.
LEAF, TOGETHER = 8, 8192


class KdTree:
    """A kd-tree over the rows of ``entries`` (int64). Each inner node halves its entries at the median of the component
    that spreads most; each node knows the smallest box around its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.sons: list[tuple[int, int] | None] = []
        self.held: list[np.ndarray] = []
        if len(entries):
            self._build(np.arange(len(entries)))

    def _build(self, held: np.ndarray) -> int:
        node, own = len(self.sons), self.entries[held]
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.sons.append(None)
        self.held.append(held)
        spread = self.high[node] - self.low[node]
        if len(held) > LEAF and spread.any():
            order = held[np.argsort(own[:, spread.argmax()], kind="stable")]
            half = len(order) // 2
            self.sons[node] = self._build(np.sort(order[:half])), self._build(np.sort(order[half:]))
        return node

    def _bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """The squared distance from each query to the node's box; no entry in it is nearer."""
        out = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return (out * out).sum(axis=1)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each query, the lowest among equally near ones, and its squared distance.

        Branch and bound for many queries at once: a node's queries split by which son is nearer, go there first, and to
        the other son only if its box is no farther than the best so far. A box just as far is visited too, because
        it may hold an entry with a lower index.
        """
        index = np.full(len(q), -1, dtype=np.int64)
        best = np.full(len(q), np.iinfo(np.int64).max)

        def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            still = bound <= best[rows]
            rows = rows[still]
            if not len(rows):
                return
            if self.sons[node] is None:
                held = self.held[node]
                apart = q[rows][:, None, :] - self.entries[held]
                d = np.einsum("ijk,ijk->ij", apart, apart)
                first = d.argmin(axis=1)
                d, first = d[np.arange(len(rows)), first], held[first]
                better = (d < best[rows]) | (d == best[rows]) & (first < index[rows])
                best[rows[better]], index[rows[better]] = d[better], first[better]
                return
            one, two = self.sons[node]
            to_one, to_two = self._bound(one, q[rows]), self._bound(two, q[rows])
            left = to_one <= to_two
            visit(one, rows[left], to_one[left])
            visit(two, rows[~left], to_two[~left])
            visit(two, rows[left], to_two[left])
            visit(one, rows[~left], to_one[~left])

        if len(self.entries):
            visit(0, np.arange(len(q)), np.zeros(len(q), dtype=np.int64))
        return index, best


@dataclass
class Codebooks:
    """``entries`` by part, entry and position within the part."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components in order as decimal numbers, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[KdTree]:
        return [KdTree(e) for e in self.entries]


def integers(vectors: DataFrame, scratch: Scratch, parts: int = 4, scale: int = 1024) -> tuple[DataFrame, int]:
    """(vec_id, label, ints) of the vectors that are not null and hold no null or non-finite component, written; and the
    number of components of a part.

    ``ints`` holds floor(``scale`` * x). All vectors are filled up with zeros to the length of the longest, rounded up to
    ``parts`` parts of equal length. Integers are held within the bound at which a vector's error still fits in 62 bits
    (134 million for 64 components).
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"))
    given = given.where(F.col("x").isNotNull() & ~bad)
    longest = given.agg(F.max(F.size("x"))).first()[0] or 0
    wide = max(1, -(-longest // parts))
    most = int((2**62 / (parts * wide)) ** 0.5) // 2
    ints = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    filled = F.concat(ints, F.array_repeat(F.lit(0), F.lit(parts * wide) - F.size("x")))
    return scratch.save(given.select("vec_id", "label", filled.alias("ints")), "ints"), wide


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(trees, parts: int, wide: int) -> Callable:
    """One row (part, entry, n, sums) for each entry that some part of the task's vectors is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = trees.value
        sums = np.zeros((parts, len(known[0].entries), wide), dtype=np.int64)
        counts = np.zeros(sums.shape[:2], dtype=np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, TOGETHER):
                x = _matrix(batch.column("ints").slice(s, TOGETHER))
                for p in range(parts):
                    q = x[:, p * wide : (p + 1) * wide]
                    index, _ = known[p].nearest(q)
                    order = np.argsort(index, kind="stable")
                    used, starts, n = np.unique(index[order], return_index=True, return_counts=True)
                    sums[p, used] += np.add.reduceat(q[order], starts, axis=0)
                    counts[p, used] += n
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
                   pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def fit(ints: DataFrame, wide: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks of ``ints`` (see ``integers``; written). Each part's starts as that part of the vectors with the
    ``entries`` smallest vec_ids, ascending; rows that share a vec_id by their integers, null ids last.

    In each round the trees of all codebooks are broadcast, every task sums the parts that are nearest to each entry, and
    the sums of all tasks give the entry's new place, floor(sum / count). An entry that no part is nearest to stays. The
    driver holds codebooks and their sums alone: ``parts`` * ``entries`` rows.
    """
    spark = ints.sparkSession
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    start = np.array([r.ints for r in first], dtype=np.int64).reshape(len(first), parts, wide)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if not len(first):
        return Codebooks(books)
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(wide)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast(Codebooks(books).trees())
        sums = ints.select("ints").mapInArrow(_sums(trees, parts, wide), "part int, entry int, n long, sums array<long>")
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
            books[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(wide)]
        trees.unpersist()
    return Codebooks(books)


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """``ints`` with ``code``, the index of each part's nearest entry in hexadecimal digits (two for 256 entries), and
    ``error``, the squared distances summed over the parts."""
    parts, entries, wide = books.entries.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    trees = ints.sparkSession.sparkContext.broadcast(books.trees())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, TOGETHER):
                own = batch.slice(s, TOGETHER)
                x = _matrix(own.column("ints"))
                found = [tree.nearest(x[:, p * wide : (p + 1) * wide]) for p, tree in enumerate(trees.value)]
                code = ["".join(f"{i:0{digits}x}" for i in row) for row in np.stack([f[0] for f in found], axis=1).tolist()]
                error = np.sum([f[1] for f in found], axis=0)
                columns = [own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    kind = ints.schema["label"].dataType.simpleString()
    return ints.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compressed(
    vectors: DataFrame, scratch: Scratch, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of each usable row of ``vectors`` (vec_id, embedding, label; more
    columns are ignored), and the codebooks.

    ``label_error`` is the error summed over equal labels, nulls together (at most the largest long). Errors are summed
    before they are dealt by label, so a label with a third of all rows is no hot group; the sums are broadcast if they
    are few. Rows that repeat a vec_id are coded each; those with a null one too. An empty table gives an empty one.
    """
    ints, wide = integers(vectors, scratch, parts, scale)
    books = fit(ints, wide, parts, entries, rounds)
    coded = scratch.save(encode(ints, books), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.cast("long").alias("label_error"))
    sums = small(scratch.save(sums, "sums"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def with_codes(vectors: DataFrame, scratch: Scratch, column: str = "code", **how: int) -> tuple[DataFrame, Codebooks]:
    """``vectors`` with the code of each row; null where the vector is unusable. Rows with a null vec_id get none."""
    coded, books = compressed(vectors, scratch, **how)
    key = inner_name(vectors, "coded_id")
    once = coded.groupBy(F.col("vec_id").alias(key)).agg(F.min("code").alias(column))
    kept = vectors.drop(*[c for c in vectors.columns if c.lower() == column.lower()])
    return kept.join(once, kept["vec_id"] == once[key], "left").drop(key), books
