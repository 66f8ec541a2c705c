"""The link graph: upserts, neighbours, warnings, lineage and induced subgraphs, all by equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scores import clamp
from siltstone.model import RELATIONS


def with_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (source_id, target_id, relation_type, weight) after an upsert: the new weight counts, clamped to 0..1, and
    links of an unknown relation are passed over. Of several new ones with a key the largest weight counts."""
    key = ["source_id", "target_id", "relation_type"]
    known = new.where(F.col("relation_type").isin(*RELATIONS)).groupBy(*key).agg(F.max(clamp(F.col("weight"), 0.0, 1.0)).alias("new_weight"))
    both = links.select(*key, "weight").join(known, key, "full_outer")
    return both.select(*key, F.coalesce("new_weight", "weight").alias("weight"))


def around(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, relation_type, weight, direction): links of each id of ``ids``, outgoing and incoming.

    Two equi-joins instead of one on either end, which would compare every link with every id.
    """
    out = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation_type", "weight", F.lit("out").alias("direction"))
    back = links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation_type", "weight", F.lit("in").alias("direction"))
    return out.join(ids.select("id"), "id", "left_semi").unionByName(back.join(ids.select("id"), "id", "left_semi"))


def related(links: DataFrame, ids: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, other, title, status) of the distinct records linked with each id, in either direction."""
    pairs = around(links, ids).select("id", "other").distinct()
    return pairs.join(memories.select(F.col("id").alias("other"), "title", "status"), "other")


def with_ends(links: DataFrame, memories: DataFrame, how: str = "inner") -> DataFrame:
    """Links with the title, status and feedback of both ends."""
    end = lambda p: memories.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "title", "status", "feedback_score")))
    return links.join(end("source"), "source_id", how).join(end("target"), "target_id", how)


def warnings(links: DataFrame, memories: DataFrame, ids: DataFrame, least: float = 0.4, most: int = 5) -> DataFrame:
    """What speaks against records in a pack: contradictions, supersessions, causes and failures among active records,
    high ones first. At most twice ``most`` links, by weight, are looked at."""
    telling = links.where(F.col("relation_type").isin("contradicts", "supersedes", "causes", "failure_pattern"))
    telling = telling.where(F.col("weight") >= least)
    wanted = ids.select("id")
    touched = telling.join(wanted.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(
        telling.join(wanted.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*telling.columns)
    )
    touched = touched.dropDuplicates(["source_id", "target_id", "relation_type"])
    active = with_ends(touched, memories).where("source_status = 'active' and target_status = 'active'")
    order = (F.desc("weight"), "source_id", "target_id", "relation_type")
    top = active.orderBy(*order).limit(most * 2)
    mild = F.col("relation_type").isin("causes", "failure_pattern")
    high = ~mild & ((F.col("weight") >= 0.7) | (F.col("target_feedback_score") < -0.5))
    graded = top.withColumn("severity", F.when(high, "high").otherwise("medium"))
    return graded.orderBy(F.col("severity") != "high", *order).limit(most)


def induced(links: DataFrame, nodes: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """Links both ends of which are among ``nodes`` (id), without noise relations."""
    kept = links.where(~F.col("relation_type").isin(*noise)) if noise else links
    for end in ("source_id", "target_id"):
        kept = kept.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return kept


def nodes(memories: DataFrame, limit: int = 100) -> DataFrame:
    """The weightiest records as graph nodes."""
    order = (F.desc(F.coalesce("importance", F.lit(0.0))), F.desc("updated_at"), "id")
    top = memories.orderBy(*order).limit(limit)
    return top.select(
        "id", F.substring("title", 1, 80).alias("label"), F.substring("content", 1, 500).alias("text"),
        F.round("importance", 2).alias("importance"), "type", "status",
    )


def lineage_roots(links: DataFrame, scratch: Callable[[DataFrame], DataFrame], most: int = 64) -> DataFrame:
    """(id, root, depth) for every record in a chain of supersessions (source supersedes target), its oldest ancestor.

    Pointer jumping: each round doubles the distance that an entry looks back, so a chain of n takes log2(n) rounds,
    each written out. A record that supersedes several follows the smallest id; a cycle ends after ``most`` rounds.
    ``scratch`` is called with a DataFrame and returns it written and reread.
    """
    up = links.where("relation_type = 'supersedes' and source_id <> target_id").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("root"))
    ends = up.select(F.col("root").alias("id")).join(up.select("id"), "id", "left_anti").distinct()
    ends = ends.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    open_ = scratch(up.withColumn("depth", F.lit(1).cast("long")).unionByName(ends))
    for _ in range(most):
        step = open_.select(F.col("id").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("more"))
        joined = open_.join(step, "root", "left")
        after = scratch(
            joined.select("id", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        )
        moved = after.join(open_.withColumnRenamed("root", "was"), "id").where("root <> was").limit(1).count()
        open_ = after
        if not moved:
            break
    return open_


def ends(links: DataFrame) -> DataFrame:
    """(id) of either end of every link, distinct."""
    return links.select(F.col("source_id").alias("id")).union(links.select("target_id")).distinct()
