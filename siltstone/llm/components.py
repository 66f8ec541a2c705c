"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BROADCAST_ROWS, Scratch

#: Links of a node that are joined in one task; a node with more is a hub.
HUB = 10_000


def _with_low(links: DataFrame, low: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """``links`` with the smallest neighbour ``low`` of their u; ``low`` (u, low, degree) has at most 2 * ``n`` rows.

    Few nodes are broadcast, which moves no link. Of many, the hubs are: at most one to HUB links, so their number is
    bounded too, and no task gets all links of one. The other nodes' links are joined by a shuffle.
    """
    if 2 * n <= BROADCAST_ROWS:
        return links.join(F.broadcast(low.drop("degree")), "u")
    low = scratch.save(low, "low")
    hubs = F.broadcast(low.where(F.col("degree") > HUB).drop("degree"))
    others = links.join(hubs, "u", "left_anti").join(low.where(F.col("degree") <= HUB).drop("degree"), "u")
    return links.join(hubs, "u").unionByName(others)


def _large_star(links: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree"))
    larger = _with_low(both.where("v > u"), low, scratch, n)
    return larger.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(links: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("degree"))
    moved = _with_low(links, low, scratch, n).where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u and v, long); component is its smallest node.

    Nulls and links of a node with itself are passed over; repeated links count once. An empty table gives an empty
    one. Minima are pre-aggregated and hubs' links are not gathered (see ``_with_low``). Every round is written to the scratch folder, so a lost executor costs one round at most.
    """
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = scratch.save(links, "links")
    before = _fingerprint(links)
    while before[0]:
        large = _large_star(links, scratch, before[0])
        after = scratch.save(_small_star(large, scratch, before[0]), "links")
        scratch.drop(links)
        links, now = after, _fingerprint(after)
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
