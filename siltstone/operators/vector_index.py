"""A written index of vectors in cells of a tree, whose exact bounds let a search leave whole cells unread."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import vector
from siltstone.sources.persisted import read_table, write_table
from siltstone.sources.scratch import broadcast_if_small, numbered, written

#: Vectors aimed at in a cell, children of a node at most, and levels of the tree at most.
CELL, FAN, LEVELS = 2048, 64, 12
#: Vectors that a node's children are fitted on at most, and rows that are assigned in one group.
SAMPLE, TOGETHER = 20_000, 32_768
#: Vectors of a chunk at most, chunks of a block at least, bytes of a block at most, and pairs that a task holds before it sorts them.
CHUNK, CHUNKS, BLOCK, HELD = 512, 8, 16 << 20, 2_000_000
#: What rounding may add to a bound, and to an angle.
SLACK, TURN = 1e-9, 1e-7


def spherical_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centroids of unit vectors. The first lie at equal steps through the rows; each round takes the sum of a
    centroid's vectors, scaled to length one; one without vectors moves to the vector farthest from its own centroid."""
    centers = x[(np.arange(k) * len(x)) // k].copy()
    for _ in range(rounds):
        dots = x @ centers.T
        own = dots.argmax(axis=1)
        totals = np.zeros_like(centers)
        np.add.at(totals, own, x)
        lengths = np.linalg.norm(totals, axis=1)
        lone = np.flatnonzero(lengths < 1e-12)
        totals[lone], lengths[lone] = x[np.argsort(dots.max(axis=1))[: len(lone)]], 1.0
        centers = totals / lengths[:, None]
    return centers


def _rows(units: pd.Series, width: int) -> np.ndarray:
    """Unit vectors as rows of one matrix; shorter ones end in zeros, which change no product."""
    out = np.zeros((len(units), width))
    for i, u in enumerate(units):
        out[i, : len(u)] = u
    return out


def _children(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        node, k = sample["node"].iloc[0], int(sample["k"].iloc[0])
        x = _rows(sample.sort_values("id")["unit"], width)
        centers = spherical_means(x, min(k, len(x)))
        return pd.DataFrame({"node": node, "child": range(len(centers)), "centroid": list(centers)})

    return run


def _assigned(width: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(vectors: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors):
            return vectors[["id", "node", "above", "unit"]]
        centers = centers.sort_values("child")
        best = (_rows(vectors["unit"], width) @ _rows(centers["centroid"], width).T).argmax(axis=1)
        below = [f"{n}{int(c):02x}" for n, c in zip(vectors["node"], best)]
        return pd.DataFrame({"id": vectors["id"], "node": below, "above": vectors["above"], "unit": vectors["unit"]})

    return run


def _units(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``unit``, in doubles at length one; null where an embedding is zero. Those that are null or hold a
    null or a number that isn't finite, and rows without an id, are left out."""
    bad = F.exists("unit", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = vectors.withColumn("unit", vector.doubles(F.col("embedding"))).where("id is not null and unit is not null")
    scaled = lambda n: F.when(n > 0, F.transform("unit", lambda x: x / n))
    return given.where(~bad).withColumn("unit", vector.bound(vector.norm(F.col("unit")), scaled))


def best_cosine(toward: Column, low: Column, high: Column) -> Column:
    """The largest cosine that a vector at angle ``toward`` from a centroid can have with one whose angle from it lies
    between ``low`` and ``high``: angles differ by no more than the angle between two vectors."""
    return F.cos(F.greatest(F.lit(0.0), toward - high, low - toward)) + SLACK


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


class VectorIndex:
    """Vectors (id, embedding and further columns) in a folder: ``vectors``, partitioned by the first level of the tree
    and sorted by cell; ``nodes``, the tree's nodes with their number of vectors, centroid, and the smallest and largest
    angle from it of any vector below.

    The tree grows with the table: a node with more than CELL vectors gets up to FAN children, fitted by spherical k-means
    on SAMPLE of its vectors; all are assigned. Vectors that can't be told apart (copies) stay one cell. Zero vectors are
    a cell of their own, ``zero``, with cosine 0 to all. An empty table gives an index without nodes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.vectors, self.nodes = read_table(spark, f"{path}/vectors"), read_table(spark, f"{path}/nodes")
        self.opened = 0

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cell: int = CELL, fan: int = FAN, sample: int = SAMPLE) -> VectorIndex:
        """Writes the index of ``vectors``; ids are unique."""
        spark = vectors.sparkSession
        given = written(_units(vectors), "index-units")
        width = given.agg(F.max(F.size("unit"))).first()[0] or 1
        id_type = given.schema["id"].dataType.simpleString()
        placed = given.where("unit is not null").select("id", F.lit("").alias("node"), F.lit(None).cast("long").alias("above"), "unit")
        for _ in range(LEVELS):
            # a node whose vectors all went to one child of the one above can't be split
            sizes = placed.groupBy("node").agg(F.count("*").alias("n"), F.first("above").alias("above"))
            wide = sizes.where((F.col("n") > cell) & (F.col("above").isNull() | (F.col("n") < F.col("above")))).select(
                "node", F.col("n").alias("above"), F.least(F.lit(fan), F.ceil(F.col("n") / cell)).cast("int").alias("k"),
                (F.lit(float(sample)) / F.col("n")).alias("share"), F.ceil(F.col("n") / TOGETHER).cast("long").alias("salts"),
            )
            wide = written(wide, "index-wide")
            if wide.isEmpty():
                break
            wide = broadcast_if_small(wide)
            rows = placed.drop("above").join(wide, "node")
            drawn = F.expr("pmod(xxhash64(id, 11), 1048576) / 1048576D") < F.col("share")
            first = rows.groupBy("node", "k").agg(F.min("id").alias("id"), F.min_by("unit", "id").alias("unit"))
            picked = rows.where(drawn).select("node", "k", "id", "unit").unionByName(first).dropDuplicates(["node", "id"])
            centers = picked.groupBy("node").applyInPandas(_children(width), "node string, child int, centroid array<double>")
            centers = written(centers, "index-centers")
            salted = rows.select("id", "node", "above", "unit", F.expr("pmod(xxhash64(id, 13), salts)").alias("salt"))
            sent = centers.join(wide.select("node", "salts"), "node").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
            both = salted.groupBy("node", "salt").cogroup(sent.groupBy("node", "salt"))
            moved = both.applyInPandas(_assigned(width), f"id {id_type}, node string, above long, unit array<double>")
            placed = written(placed.join(wide.select("node"), "node", "left_anti").unionByName(moved), "index-placed")
        at = given.join(placed.select("id", F.col("node").alias("cell")), "id", "left")
        at = at.withColumn("cell", F.when(F.col("unit").isNull(), "zero").otherwise(F.col("cell")))
        at = written(at.withColumn("part", F.when(F.col("cell") == "zero", "zero").otherwise(F.concat(F.lit("p"), F.substring("cell", 1, 2)))), "index-at")
        write_table(cls._nodes(at), f"{path}/nodes")
        out = at.drop("unit").repartition("part", F.expr("substring(cell, 1, 4)")).sortWithinPartitions("part", "cell", "id")
        write_table(out, f"{path}/vectors", "part")
        return cls(spark, path)

    @staticmethod
    def _nodes(at: DataFrame) -> DataFrame:
        """(node, parent, leaf, part, n, centroid, low, high) of every node above a vector, the root excepted if it has
        children: centroids are the means of all vectors below, scaled to length one, and the angles are exact."""
        above = F.expr("transform(sequence(least(2, length(cell)), length(cell), 2), i -> substring(cell, 1, i))")
        below = at.where("unit is not null").select("part", "cell", "unit", F.explode(above).alias("node"))
        sums = below.select("node", "part", F.posexplode("unit").alias("i", "x")).groupBy("node", "part", "i").agg(F.sum("x").alias("x"))
        means = sums.groupBy("node", "part").agg(F.expr("transform(array_sort(collect_list(struct(i, x))), p -> p.x)").alias("mean"))
        length = vector.norm(F.col("mean"))
        first = F.transform("mean", lambda x: F.lit(1.0) / F.sqrt(F.size("mean").cast("double")))
        means = means.withColumn("length", length).withColumn("centroid", F.when(F.col("length") > 1e-9, F.transform("mean", lambda x: x / F.col("length"))).otherwise(first))
        means = written(means.select("node", "centroid"), "index-means")
        near = below.join(broadcast_if_small(means, size=F.size("centroid") * 8), "node")
        near = near.withColumn("toward", _angle(_product(F.col("unit"), F.col("centroid"))))
        found = near.groupBy("node", "part").agg(
            F.count("*").alias("n"), F.min("toward").alias("low"), F.max("toward").alias("high"), F.bool_or(F.col("cell") == F.col("node")).alias("leaf")
        )
        return found.join(broadcast_if_small(means, size=F.size("centroid") * 8), "node").withColumn(
            "parent", F.when(F.length("node") > 2, F.expr("substring(node, 1, length(node) - 2)")).otherwise("")
        )

    def nearest(self, query: list[float], k: int = 10, threshold: float = -1.0, keep: Column | None = None) -> DataFrame:
        """(id, score): the ``k`` vectors of the largest cosine with the query, if it is the threshold, equal ones by id;
        of the rows that satisfy ``keep`` (a condition on further columns). The rows are those of a scan of all vectors.

        Cells are opened by their bounds, the best first, twice as many each time, until no other cell can hold a vector
        as near as the k-th found. ``opened`` tells how many were. Reading cells prunes partitions and row groups.
        """
        k = max(1, min(100, k))
        length = float(np.linalg.norm(np.asarray(query, dtype=float)))
        bound = F.lit(SLACK)
        if length > 0:
            unit = F.array(*(F.lit(float(x) / length) for x in query))
            bound = best_cosine(_angle(_product(F.col("centroid"), unit)), F.col("low"), F.col("high"))
        cells = self.nodes.where("leaf").select("part", F.col("node").alias("cell"), bound.alias("bound"))
        zero = self.spark.createDataFrame([("zero", "zero", SLACK)], "part string, cell string, bound double")
        cells = cells.unionByName(zero)
        best: list[tuple] = []
        after, many, self.opened = None, 4, 0
        while True:
            least = best[k - 1][0] if len(best) >= k else threshold
            more = cells.where(F.col("bound") >= least)
            if after is not None:
                more = more.where((F.col("bound") < after[0]) | ((F.col("bound") == after[0]) & (F.col("cell") > after[1])))
            chosen = more.orderBy(F.desc("bound"), "cell").limit(many).collect()
            if not chosen:
                break
            self.opened += len(chosen)
            rows = self.cells([(c.part, c.cell) for c in chosen])
            rows = rows if keep is None else rows.where(keep)
            scored = rows.select("id", vector.cosine_with(F.col("embedding"), query).alias("score"))
            found = scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k).collect()
            best = sorted([*best, *((r.score, r.id) for r in found)], key=lambda r: (-r[0], r[1]))[:k]
            after, many = (chosen[-1].bound, chosen[-1].cell), min(many * 2, 1024)
        kind = self.vectors.schema["id"].dataType.simpleString()
        return self.spark.createDataFrame([(i, s) for s, i in best], f"id {kind}, score double")

    def cells(self, named: list[tuple[str, str]]) -> DataFrame:
        """The vectors of some cells (part, cell). The parts prune partitions, the cells row groups."""
        parts, cells = sorted({p for p, _ in named}), sorted({c for _, c in named})
        return self.vectors.where(F.col("part").isin(parts) & F.col("cell").isin(cells))

    def visits(self, queries: DataFrame, least: Column) -> DataFrame:
        """(id, cell, bound) of the cells that may hold a vector whose cosine with the query (id, unit, and what ``least``
        needs) is at least ``least``. The tree is gone down level by level; children of a node that can't are not looked
        at. Each level is an equi-join on the node."""
        open_, out = queries.withColumn("at", F.lit("")), None
        deepest = (self.nodes.agg(F.max(F.length("node"))).first()[0] or 0) // 2
        for _ in range(max(1, deepest)):
            below = self.nodes.select(F.col("parent").alias("at"), "node", "leaf", "centroid", "low", "high")
            if deepest == 0:
                below = below.withColumn("at", F.lit(""))
            toward = _angle(_product(F.col("unit"), F.col("centroid")))
            near = open_.join(broadcast_if_small(below, size=F.size("centroid") * 8 + 64), "at").withColumn("bound", best_cosine(toward, F.col("low"), F.col("high")))
            near = near.where(F.col("bound") >= least)
            leaves = near.where("leaf").select("id", F.col("node").alias("cell"), "bound")
            out = leaves if out is None else out.unionByName(leaves)
            open_ = near.where("not leaf").select(*queries.columns, F.col("node").alias("at"))
        return out

    def neighbours(self, least: float, k: int) -> DataFrame:
        """(a, b, score): the up to ``k`` vectors b of the largest cosine with each vector a, itself left out, of those of
        equal length whose cosine, rounded to twelve digits, is at least ``least``; equal ones by id.

        Equal vectors are compared as one, which their smallest id stands for; what it is near to is handed on to the others.
        """
        given = _units(self.vectors.select("id", "embedding", "cell")).where("unit is not null")
        given = written(given.select("id", "cell", "unit"), "index-given")
        heads = given.groupBy("unit").agg(F.min(F.struct("id", "cell")).alias("head"), F.count("*").alias("copies"))
        heads = written(heads.select("head.id", "head.cell", "unit", "copies"), "index-heads")
        near = self._near_heads(heads.select("id", "cell", "unit"), least, k)
        copied = heads.where("copies > 1").select(F.col("id").alias("head"), "unit")
        if copied.isEmpty():
            return near
        ranked = lambda df, by, n, *order: df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")
        members = written(given.join(copied, "unit").select("head", "id"), "index-members")
        own = copied.select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("score")).where(F.col("score") >= least)
        first = ranked(members, "head", k + 1, "id").select(F.col("head").alias("b"), F.col("id").alias("copy"))
        named = near.unionByName(own).join(first, "b", "left").select("a", F.coalesce("copy", "b").alias("b"), "score")
        named = written(ranked(named, "a", k + 1, F.desc("score"), "b"), "index-named")
        heads = copied.select(F.col("head").alias("a"))
        handed = broadcast_if_small(written(named.join(heads, "a", "left_semi"), "index-handed")).withColumnRenamed("a", "head")
        handed = members.join(handed, "head").where("id <> b").select(F.col("id").alias("a"), "b", "score")
        return ranked(named.join(heads, "a", "left_anti").unionByName(handed), "a", k, F.desc("score"), "b")

    def _near_heads(self, heads: DataFrame, least: float, k: int) -> DataFrame:
        """``neighbours`` of different vectors (id, cell, unit).

        In the order of their cells they are packed as matrices, chunks of up to CHUNK vectors, and consecutive chunks are a
        block. A block is compared with itself first; the k-th score that a vector has then is what vectors of other chunks
        must be able to reach, by the angles of a chunk around its centroid. Two blocks meet in one task, with those of their
        chunks alone that ask for one of the other's or are asked for, so that each two are compared once for both sides.
        Where vectors point in all directions these are all products; each block travels once to each other block.
        """
        kind = heads.schema["id"].dataType.simpleString()
        n, width = heads.agg(F.count("*"), F.coalesce(F.max(F.size("unit")), F.lit(1))).first()
        chunk = max(1, min(CHUNK, BLOCK // (16 * width)))
        many = max(1, min(BLOCK // (8 * width * chunk), max(CHUNKS, -(-n // (chunk * 8)))))
        nth = numbered(heads.withColumn("width", F.size("unit")), ["width"], [F.col("cell"), F.col("id")])
        nth = nth.select("id", "unit", "width", "nth", F.expr(f"cast((nth - 1) div {chunk} as int)").alias("chunk"))
        packed = f"width int, block int, chunk int, ids array<{kind}>, rows binary, centroid array<double>, low double, high double"
        chunks = written(nth.groupBy("width", "chunk").applyInPandas(_packed(many), packed), "index-chunks")
        around = written(chunks.select("width", "block", "chunk", "centroid", "low", "high"), "index-around")
        around = around.drop("block").join(F.broadcast(around.select("width", "block").distinct()), "width")
        own = f"width int, block int, chunk int, reach array<double>, asks array<int>, a array<{kind}>, b array<{kind}>, score array<double>"
        both = chunks.groupBy("width", "block").cogroup(around.groupBy("width", "block"))
        near = written(both.applyInPandas(_own_block(least, k, many), own), "index-near")
        asks = near.select("width", F.col("chunk").alias("one"), F.explode("asks").alias("other"))
        ends = [F.expr(f"cast({f}(one, other) div {many} as int)").alias(c) for c, f in (("i", "least"), ("j", "greatest"))]
        met = written(asks.select("width", *ends, F.explode(F.array("one", "other")).alias("chunk")).distinct(), "index-met")
        told = near.select("width", "chunk", "reach", "asks")
        told = broadcast_if_small(told, size=8 * F.size("reach") + 4 * F.size("asks"))
        sides = chunks.select("width", "block", "chunk", "ids", "rows").join(told, ["width", "chunk"])
        across = self._tiles(sides, met, least, k)
        rows = near.select(F.inline(F.arrays_zip("a", "b", "score"))).unionByName(across)
        nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
        return rows.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")

    def _tiles(self, sides: DataFrame, met: DataFrame, least: float, k: int) -> DataFrame:
        """What the blocks i and j of a width find in each other; ``met`` has the chunks that each two need."""
        kind = sides.schema["ids"].dataType.elementType.simpleString()
        sent = sides.join(broadcast_if_small(met), ["width", "chunk"])
        return sent.groupBy("width", "i", "j").applyInPandas(_two_blocks(least, k), f"a {kind}, b {kind}, score double")

    def pairs(self, least: float, k: int = 6) -> DataFrame:
        """(a, b, score), a before b: pairs in either side's ``k`` - 1 nearest vectors, at ``least``."""
        near = self.neighbours(least, k - 1)
        return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def _product(a: Column, b: Column) -> Column:
    """The inner product of the components that both vectors have."""
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def _angles(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centers.T, -1.0, 1.0))


def _packed(many: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A chunk's vectors as one matrix, with their mean direction and the smallest and largest angle from it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        width, chunk = int(rows["width"].iloc[0]), int(rows["chunk"].iloc[0])
        x = np.stack(rows["unit"].to_list())
        mean = x.mean(axis=0)
        length = np.linalg.norm(mean)
        center = mean / length if length > 1e-9 else x[0]
        toward = _angles(x, center[None])
        told = (width, chunk // many, chunk, rows["id"].to_numpy(), x.tobytes(), center, toward.min(), toward.max())
        return pd.DataFrame([told], columns=["width", "block", "chunk", "ids", "rows", "centroid", "low", "high"])

    return run


def _matrix(chunks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """The rows of some chunks, their ids, the ids' ranks, and where each chunk lies."""
    x = np.concatenate([np.frombuffer(r).reshape(-1, w) for r, w in zip(chunks["rows"], chunks["width"])])
    ids = np.concatenate([np.asarray(i) for i in chunks["ids"]])
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    ends = np.cumsum([len(i) for i in chunks["ids"]])
    return x, ids, rank, [slice(int(e) - len(i), int(e)) for e, i in zip(ends, chunks["ids"])]


def _places(marks: np.ndarray) -> np.ndarray:
    """Where the few true marks are, in the flattened array: by bytes of eight first."""
    eights = np.packbits(marks)
    some = np.flatnonzero(eights)
    i, j = np.nonzero(np.unpackbits(eights[some]).reshape(-1, 8))
    return some[i] * 8 + j


def _nearest_rows(x: np.ndarray, rank: np.ndarray, rounds: list[list[tuple[slice, slice]]], reach: np.ndarray, k: int):
    """(a, b, score): the ``k`` nearest rows b of each row a, by score and then rank, of the slices that meet in ``rounds``, each
    two once; ``reach`` is what a score must be at least, and is raised to the k-th after each round.

    Products in single precision choose, with all that their rounding can hide; the chosen are computed in doubles, and
    rounded so that equal ones tie."""
    narrow, hidden = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-24
    low = (reach - hidden).astype(np.float32)
    a, b, score, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), []

    def settle() -> None:
        nonlocal a, b, score, held
        a, b, score = (np.concatenate([own, *more]) for own, more in zip((a, b, score), zip(*held))) if held else (a, b, score)
        order = np.lexsort((rank[b], -score, a))
        a, b, score, held = a[order], b[order], score[order], []
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b, score = a[top], b[top], score[top]
        found = np.bincount(a, minlength=len(x))
        full = found == k
        reach[full] = score[np.cumsum(found)[full] - 1]
        low[full] = reach[full] - hidden

    for meetings in rounds:
        many = 0
        for p, q in meetings:
            near = narrow[p] @ narrow[q].T
            hits = _places(near >= min(low[p].min(), low[q].min()))
            i, j = np.divmod(hits, near.shape[1])
            chosen = (near[i, j] >= low[p][i]) | (near[i, j] >= low[q][j])
            i, j = i[chosen], j[chosen]
            if len(i) > near.size // 16:
                exact = (x[p] @ x[q].T)[i, j]
            else:
                exact = np.einsum("ij,ij->i", x[p][i], x[q][j])
            i, j, exact = i + p.start, j + q.start, np.round(exact, 12)
            ours, theirs = (exact >= reach[i]) & (i != j), (exact >= reach[j]) & (p != q)
            held += [(i[ours], j[ours], exact[ours]), (j[theirs], i[theirs], exact[theirs])]
            many += len(held[-1][0]) + len(held[-2][0])
            if many > HELD:
                settle()
                many = 0
        settle()
    return a, b, score


def _own_block(least: float, k: int, many: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The nearest rows of each row of a block within it, and the chunks of other blocks that can hold nearer ones."""

    def run(chunks: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        chunks, around = chunks.sort_values("chunk"), around.sort_values("chunk")
        x, ids, rank, at = _matrix(chunks)
        reach, n = np.full(len(x), float(least)), len(at)
        steps = [0, *(2**i for i in range(n.bit_length())), n]
        rounds = [[(at[p], at[p + d]) for d in range(s, min(e, n)) for p in range(n - d)] for s, e in zip(steps, steps[1:])]
        for p in at:  # what the own chunk has is a first bound
            near = x[p] @ x[p].T
            np.fill_diagonal(near, -np.inf)
            if len(near) > k:
                reach[p] = np.maximum(reach[p], np.partition(near, -k, axis=1)[:, -k] - 1e-11)
        a, b, score = _nearest_rows(x, rank, rounds, reach, k)
        other = around["chunk"].to_numpy()
        centers, low, high = np.stack(around["centroid"].to_list()), around["low"].to_numpy(), around["high"].to_numpy()
        out = []
        for c, p in zip(chunks.itertuples(), at):
            toward, allowed = _angles(x[p], centers), np.arccos(np.clip(reach[p] - SLACK, -1.0, 1.0))
            open_ = (np.maximum(toward - high, low - toward) <= allowed[:, None] + TURN).any(axis=0) & (other // many != c.block)
            rows = slice(np.searchsorted(a, p.start), np.searchsorted(a, p.stop))
            out.append((c.width, c.block, c.chunk, reach[p], other[open_], ids[a[rows]], ids[b[rows]], score[rows]))
        return pd.DataFrame(out, columns=["width", "block", "chunk", "reach", "asks", "a", "b", "score"])

    return run


def _two_blocks(least: float, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The nearest rows that each row of two blocks has in the other."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("chunk")
        x, ids, rank, at = _matrix(tile)
        reach = np.concatenate(tile["reach"].to_list()).astype(float)
        asked = [set(c) for c in tile["asks"]]
        sides = [(c, s, asks) for c, s, asks in zip(tile["chunk"], at, asked)]
        first = tile["block"] == tile["i"]
        ours, theirs = [s for s, f in zip(sides, first) if f], [s for s, f in zip(sides, first) if not f]
        met = [(p, q) for c, p, asks in ours for d, q, asking in theirs if d in asks or c in asking]
        a, b, score = _nearest_rows(x, rank, [met], reach, k)
        return pd.DataFrame({"a": ids[a], "b": ids[b], "score": score})

    return run
