"""Trees of digests, by which two replicas of a table, or an index and its rows, find where they differ.

Rows lie in leaves by a hash of their key. A leaf's digest is the number of its rows and two sums of hashes of them, and a
node's is the sum of its children's, so digests don't depend on the order of rows and repeated rows count. Two trees are
compared from the root down; only children of nodes that differ are looked at, and only rows of leaves that differ are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.persisted import read_table, write_table
from siltstone.sources.scratch import broadcast_if_small, written

#: Bits of a level, rows of a leaf, levels at most, and leaves whose numbers go into a filter (more are joined).
BITS, ROWS, DEEPEST, LISTED = 4, 4_096, 6, 4_096
#: What a node's digest is made of.
PARTS = ("n", "a", "b")


def depth_of(n: int) -> int:
    """The levels below the root for about so many rows; two trees that are compared must have the same."""
    depth = 1
    while depth < DEEPEST and n > ROWS << (BITS * depth):
        depth += 1
    return depth


class HashTree:
    """A tree written under ``path``: ``rows`` with their leaf, in folders by the first level's node, and ``nodes`` by level."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.nodes, self.rows = read_table(spark, f"{path}/nodes"), read_table(spark, f"{path}/rows")

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, digest: Column, depth: int) -> HashTree:
        """Writes the tree of ``rows``. ``digest`` is a value, or a struct of values, by which rows count as equal; a row where
        it is null is kept but not counted. Null keys share a leaf."""
        leaf = F.shiftrightunsigned(F.xxhash64(key), 64 - BITS * depth)
        placed = rows.withColumns({"leaf": leaf, "top": F.shiftright(leaf, BITS * (depth - 1)).cast("int"), "counted": digest.isNotNull(),
            "a": F.xxhash64(digest).cast("decimal(20,0)"), "b": F.xxhash64(F.lit("b"), digest).cast("decimal(20,0)")})
        sums = [F.sum(c).alias(c) for c in PARTS]
        lowest = placed.where("counted").withColumn("n", F.lit(1)).groupBy("leaf").agg(*sums)
        lowest = written(lowest.withColumnRenamed("leaf", "node"), "leaves")
        levels = lowest.withColumn("level", F.lit(depth))
        for level in range(depth):
            above = lowest.groupBy(F.shiftright("node", BITS * (depth - level)).alias("node")).agg(*sums)
            levels = levels.unionByName(above.withColumn("level", F.lit(level)), allowMissingColumns=False)
        write_table(levels.select("level", "node", F.col("n").cast("long").alias("n"), *(F.col(c).cast("decimal(38,0)").alias(c) for c in "ab")), f"{path}/nodes", "level")
        stored = placed.drop("counted", "a", "b").repartitionByRange("leaf").sortWithinPartitions("leaf")
        write_table(stored, f"{path}/rows", "top")
        return cls(rows.sparkSession, path)

    @property
    def depth(self) -> int:
        return self.nodes.agg(F.max("level")).first()[0] or 0

    def of(self, leaves: DataFrame, depth: int) -> DataFrame:
        """The rows of some leaves (node). Few are named in a filter, which prunes folders and row groups."""
        few = [r[0] for r in leaves.limit(LISTED + 1).collect()]
        if len(few) > LISTED:
            return self.rows.join(broadcast_if_small(leaves.select(F.col("node").alias("leaf"))), "leaf", "left_semi").drop("leaf", "top")
        tops = sorted({n >> BITS * (depth - 1) for n in few})
        return self.rows.where(F.col("top").isin(tops) & F.col("leaf").isin(few)).drop("leaf", "top")


def differing(left: HashTree, right: HashTree) -> list[DataFrame]:
    """(node) for each level from the root: the nodes whose digests differ, those on one side only included. Each level is
    written, and only the children of the one above are compared. Trees of different depths can't be compared, but an empty
    one differs from any."""
    depths = {d for d in (left.depth, right.depth) if d}
    if len(depths) > 1:
        raise ValueError(f"trees of depths {sorted(depths)}")
    found: list[DataFrame] = []
    for level in range(max(depths, default=-1) + 1):
        sides = [t.nodes.where(F.col("level") == level).drop("level") for t in (left, right)]
        if found:
            above = broadcast_if_small(found[-1].select(F.col("node").alias("up")))
            sides = [s.withColumn("up", F.shiftright("node", BITS)).join(above, "up", "left_semi").drop("up") for s in sides]
        # a node is alike if both sides have it with the same sums
        alike = sides[0].unionByName(sides[1]).groupBy("node", *PARTS).agg(F.count("*").alias("sides"))
        found.append(written(alike.where("sides < 2").select("node").distinct(), f"level{level}"))
        if found[-1].isEmpty():
            break
    return found


def differing_rows(left: HashTree, right: HashTree) -> tuple[DataFrame, DataFrame]:
    """The rows of either side that lie in leaves that differ: all rows that differ, and their leaves' others."""
    levels = differing(left, right)
    depth = max(left.depth, right.depth)
    if len(levels) <= depth:
        return left.rows.drop("leaf", "top").limit(0), right.rows.drop("leaf", "top").limit(0)
    return left.of(levels[-1], depth), right.of(levels[-1], depth)


def drift(left: HashTree, right: HashTree, key: str, columns: list[str]) -> DataFrame:
    """(key, what): missing (on the left only), extra (on the right only) or changed; keys are unique and not null. The trees'
    digests must be of all these columns."""
    one, other = differing_rows(left, right)
    pack = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = pack(one, "one").join(pack(other, "other"), key, "full_outer")
    what = F.when(F.col("other").isNull(), "missing").when(F.col("one").isNull(), "extra").when(~F.col("one").eqNullSafe(F.col("other")), "changed")
    return both.select(key, what.alias("what")).where("what is not null")
