"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one vector kept a group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from siltstone.llm.common import Scratch, forest, grouped, small
from siltstone.llm.components import connected_components

#: Vectors aimed at in a cell, rows of one side of a tile at most, and vectors of a label that its cells are fitted on.
CELL, BLOCK, SAMPLE = 2048, 2048, 20_000
#: Vectors of the sample to each centroid at least, and bytes of vectors that are assigned in one group.
PER_CENTROID, GROUP_BYTES = 16, 64 << 20


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector scaled to length one in double precision, and the key of its class of equal vectors; null for
    vectors that link with nothing."""
    for batch in batches:
        labels, vectors = batch.column("label"), batch.column("embedding")
        keys, units = [], []
        for label, vector in zip(labels, vectors):
            x = None
            if label.is_valid and vector.is_valid and len(vector) and vector.values.null_count == 0:
                x = np.asarray(vector.values.to_numpy(zero_copy_only=False), dtype=np.float64) + 0.0
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            if x is None:
                keys.append(None)
                units.append(None)
                continue
            name = f"{label.as_py()}:{len(x)}:".encode() + x.tobytes()
            keys.append(hashlib.blake2b(name, digest_size=16).digest())
            units.append((x / np.sqrt(x @ x)).tobytes())
        arrays = [batch.column("vec_id"), labels, pa.array(keys, pa.binary()), pa.array(units, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "key", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` unit centroids of unit vectors: each round sums the vectors of a cell and scales the sum to length one;
    an empty cell starts anew at the vector that is farthest from its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        dots = x @ centroids.T
        cell = dots.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norms = np.sqrt((sums * sums).sum(axis=1))
        worst = iter(np.argsort(dots.max(axis=1)))
        for c in np.flatnonzero(norms < 1e-12):
            sums[c] = x[next(worst)]
            norms[c] = 1.0
        centroids = sums / norms[:, None]
    return centroids


def _padded(raw: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of one matrix; the shorter end in zeros, which change no product."""
    rows = [np.frombuffer(r, dtype=np.float64) for r in raw]
    if all(len(r) == width for r in rows):
        return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : min(len(r), width)] = r[:width]
    return out


def _fit(sample: pa.Table) -> pa.Table:
    """(label, cell, centroid) of one label's cells, from its sample (label, k, unit), which SAMPLE bounds."""
    raw = sample.column("unit").to_pylist()
    points = _padded(raw, max(map(len, raw)) // 8)
    k = min(sample.column("k")[0].as_py(), max(1, len(points) // PER_CENTROID))
    centroids = [c.tobytes() for c in spherical_kmeans(points, k)]
    label = pa.array([sample.column("label")[0].as_py()] * k, sample.schema.field("label").type)
    return pa.table([label, pa.array(range(k), pa.int64()), pa.array(centroids, pa.binary())], ["label", "cell", "centroid"])


def _assign(least: float) -> Callable:
    """The visits (label, key, cell, angle, home) of vectors to cells of their label: each to its home cell, that of the
    nearest centroid, and to every other cell that can be home to a vector linked with it.

    A partner y of x is x*cos(f) + u*sin(f) for a unit vector u across x and cos(f) >= ``least``. If y is at home in c and
    x in h, then 0 <= y*(c - h) <= cos(f) * (x*c - x*h) + sin(f) * w, where w is the length of h - c across x. So no
    partner is at home where ``least`` * (x*h - x*c) > sqrt(1 - least**2) * w: no link is lost at a border.
    """
    across = np.sqrt(1 - least**2)

    def run(vectors: pa.Table, cells: pa.Table) -> pa.Table:
        cells = cells.sort_by("cell")
        raw = cells.column("centroid").to_pylist()
        width = max(len(r) for r in raw) // 8
        centroids = _padded(raw, width)
        cosines = centroids @ centroids.T
        kinds = [vectors.schema.field("label").type, pa.binary(), pa.int64(), pa.float64(), pa.bool_()]
        names = ["label", "key", "cell", "angle", "home"]
        out = [pa.table([pa.array([], k) for k in kinds], names)]
        for s in range(0, vectors.num_rows, 2048):
            part = vectors.slice(s, 2048)
            dots = _padded(part.column("unit").to_pylist(), width) @ centroids.T
            home = dots.argmax(axis=1)
            lag = dots[np.arange(len(dots)), home][:, None] - dots
            aside = np.sqrt(np.maximum(0, 2 - 2 * cosines[home] - lag**2))
            row, cell = np.nonzero(least * lag <= across * aside + 1e-9)
            angle = np.arccos(np.clip(dots[row, cell], -1, 1))
            own = [part.column(c).combine_chunks().take(pa.array(row)) for c in ("label", "key")]
            columns = [*own, pa.array(cell), pa.array(angle), pa.array(home[row] == cell)]
            out.append(pa.table([c.cast(k) for c, k in zip(columns, kinds)], names))
        return pa.concat_tables(out).combine_chunks()

    return run


def _compare(least: float) -> Callable:
    """For each tile: (u, null, n) with the number of vectors that u links with in the tile, classes of equal vectors
    counted in full, and (u, v, null), a spanning forest of the tile's links.

    ``side`` is 1 or 2 for the two blocks of a tile, and 0 where a block meets itself: each row all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "tile"):
            side = t.column("side").to_numpy()
            node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
            raw = t.column("unit").to_pylist()
            size = np.array([len(r) for r in raw])
            matrix = _padded(raw, int(size.max()) // 8)
            ours, theirs = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
            label, counts = np.arange(len(node)), np.zeros(len(node), dtype=np.int64)
            for s in range(0, len(ours), 256):
                rows = ours[s : s + 256]
                near = matrix[rows] @ matrix[theirs].T >= least
                near &= (node[rows][:, None] != node[theirs]) & (size[rows][:, None] == size[theirs])
                counts[rows] += near @ weight[theirs]
                if side.any():
                    counts[theirs] += weight[rows] @ near
                a, b = np.nonzero(near)
                label = forest_on(label, rows[a], theirs[b])
            linked, away = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(node)))
            if not len(linked):
                continue
            u = np.concatenate([node[linked], node[away]])
            is_count = np.arange(len(u)) < len(linked)
            v = np.concatenate([node[linked], node[label[away]]])
            n = np.concatenate([counts[linked], np.zeros(len(away), dtype=np.int64)])
            columns = [pa.array(u), pa.array(v, mask=is_count), pa.array(n, mask=~is_count)]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "n"])

    return run


def forest_on(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest node connected so far) after the links (a, b) too."""
    return forest(len(label), label[a], label[b])[label]


def cells_of(heads: DataFrame, scratch: Scratch, least: float, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """``heads`` (label, key, unit and more; one row to a key) with cell and part, and a row for each block (other_cell, other_part) of
    the same label that may hold a partner; its own block first.

    A label of n vectors has about n / ``cell`` cells, fitted by spherical k-means on its vectors with the smallest
    hashes, about ``sample`` of them, and at most one to PER_CENTROID of those. A cell is dealt over parts of at most
    about BLOCK vectors by a hash, so a cell may grow without bound; a vector that visits a cell visits all its parts.
    A visit is left out if the vector's angle to the cell's centroid is farther than the threshold's angle from those
    of all vectors that are at home there: partners' angles can't differ by more.
    """
    width = F.max(F.length("unit"))
    labels = heads.groupBy("label").agg(F.count("*").alias("of_label"), width.alias("width"))
    labels = labels.select(
        "label",
        (F.lit(float(sample)) / F.col("of_label")).alias("share"),
        F.ceil(F.col("of_label") / cell).alias("k"),
        F.ceil(F.col("of_label") * F.col("width") / GROUP_BYTES).alias("salts"),
    )
    labels = small(scratch.save(labels, "labels"))
    known = heads.join(labels, "label")
    drawn = F.expr("pmod(xxhash64(unit, 3), 1048576) / 1048576D") < F.col("share")
    picked = known.where(drawn).select("label", "k", "unit")
    first = known.groupBy("label", "k").agg(F.min("unit").alias("unit")).select("label", "k", "unit")
    kind = StructType([heads.schema["label"], StructField("cell", LongType()), StructField("centroid", BinaryType())])
    centroids = scratch.save(picked.unionByName(first).groupBy("label").applyInArrow(_fit, kind), "centroids")

    dealt = known.select("label", "key", "unit", F.expr("pmod(xxhash64(key, 4), salts)").alias("salt"))
    sent = centroids.join(labels.select("label", "salts"), "label")
    sent = sent.withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
    kind = StructType([heads.schema["label"], StructField("key", BinaryType()), StructField("cell", LongType()),
                       StructField("angle", DoubleType()), StructField("home", BooleanType())])
    both = dealt.groupBy("label", "salt").cogroup(sent.groupBy("label", "salt"))
    visits = scratch.save(both.applyInArrow(_assign(least), kind), "visits")

    at_home = F.when(F.col("home"), F.col("angle"))
    cells = visits.groupBy("label", "cell").agg(
        F.ceil(F.count(at_home) / BLOCK).alias("parts"), F.min(at_home).alias("low"), F.max(at_home).alias("high")
    )
    cells = small(scratch.save(cells.where("parts > 0"), "cells"))
    reach = float(np.arccos(least)) + 1e-9
    kept = visits.join(cells, ["label", "cell"]).where(f"home or angle between low - {reach!r} and high + {reach!r}")
    visited = F.collect_list(F.struct(F.col("cell").alias("other_cell"), "parts"))
    own = F.max(F.when(F.col("home"), F.struct("cell", "parts"))).alias("own")
    kept = kept.groupBy("key").agg(own, visited.alias("visited"))
    placed = heads.join(kept, "key").select(
        *heads.columns, F.col("own.cell").alias("cell"), F.expr("pmod(xxhash64(key, 5), own.parts)").alias("part"),
        F.explode("visited").alias("visit"),
    )
    other = F.explode(F.expr("sequence(0L, visit.parts - 1)")).alias("other_part")
    return placed.select(*heads.columns, "cell", "part", F.col("visit.other_cell").alias("other_cell"), other)


def near_embeddings(
    vectors: DataFrame, scratch: Scratch, least: float = 0.93, cell: int = CELL, sample: int = SAMPLE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id long, embedding array of float or
    double, label; more columns are ignored).

    Vectors with equal, non-null labels and equal lengths are linked if their cosine in double precision is at least
    ``least``; n_links counts the other vectors linked directly, component_id is the smallest vec_id reachable by
    links, itself included, and kept marks the vectors whose vec_id that is.

    Equal vectors of a label form a class, compared once. Spherical k-means deals a label's vectors over cells; each
    vector also visits the cells that may hold a partner (see ``cells_of``), so the result is exact. Two blocks that
    visit each other form a tile, the product of two matrices in one task, which gives counts and a spanning forest
    instead of pairs; a vector goes to as many tiles as it visits blocks. How many that are depends on the data: where
    vectors form clusters that are narrower than they are apart, few; where they point in all directions, all of the
    label, and its pairs are the cost.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those with a null label link with
    nothing. Rows with a null vec_id link with nothing and are kept, with a null component_id. Rows that repeat a
    vec_id count as separate vectors, each with the links of all. An empty table gives an empty result.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = f"vec_id long, label {given.schema['label'].dataType.simpleString()}, key binary, unit binary"
    units = scratch.save(given.mapInArrow(_unit, kind), "units")
    whole = units.where("key is not null and vec_id is not null")
    classes = whole.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    classes = scratch.save(classes, "classes")
    first = whole.withColumnRenamed("vec_id", "node").join(classes, ["key", "node"]).dropDuplicates(["key"])
    heads = scratch.save(first.select("label", "key", "node", "weight", "unit"), "heads")

    block, other = F.struct("cell", "part"), F.struct(F.col("other_cell").alias("cell"), F.col("other_part").alias("part"))
    tiles = cells_of(heads, scratch, least, cell, sample).select(
        F.xxhash64("label", F.least(block, other), F.greatest(block, other)).alias("tile"),
        F.when(block == other, 0).when(block < other, 1).otherwise(2).alias("side"), "node", "weight", "unit",
    )
    sorted_tiles = tiles.repartition("tile").sortWithinPartitions("tile")
    found = scratch.save(sorted_tiles.mapInArrow(_compare(least), "u long, v long, n long"), "found")
    counts = found.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("v is not null").select("u", "v"), scratch)

    named = classes.join(counts, "node", "left").join(components, "node", "left").select(
        "key",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    named = scratch.save(named, "named")
    linked = whole.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    alone = units.where("key is null or vec_id is null")
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).withColumn("kept", kept)
