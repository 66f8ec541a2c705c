"""Context packs: hits of several searches fused, scored, gated, pruned, capped and cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.functions.scores import clamp, recency, usage_bonus
from siltstone.model import MODES, TASK_WEIGHTS, TASK_WORDS
from siltstone.operators.agents import conflicts
from siltstone.operators.records import overlap
from siltstone.sources.scratch import written


def kind_of_task(task: str) -> str:
    """The first kind of task one of whose words the task has."""
    return next((k for k, words in TASK_WORDS if any(w in task.lower() for w in words)), "general")


def fused(lexical: DataFrame, vectors: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, vector_score, boost, sources): the hits of three searches in one union and one grouping.

    ``lexical`` has id and source (fts or keyword), ``vectors`` id and score, ``entities`` id and boost.
    """
    none = F.lit(None).cast("double")
    hits = (
        lexical.select("id", "source", none.alias("score"), none.alias("boost"))
        .unionByName(vectors.select("id", F.lit("vector").alias("source"), "score", none.alias("boost")))
        .unionByName(entities.select("id", F.lit("entity").alias("source"), none.alias("score"), "boost"))
    )
    return hits.groupBy("id").agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.max("boost"), F.lit(0.0)).alias("boost"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def contradicted(hits: DataFrame, profile: DataFrame) -> DataFrame:
    """``hits`` with conflict: the first attribute of the profile (attribute, value, confidence) that a profile record names
    without its value, else null. Hits are a search's few; they are written once."""
    kept = written(hits, "hits")
    found = conflicts(kept.select("id", "type", "title", "content"), profile)
    return kept.join(found.groupBy("id").agg(F.min("attribute").alias("conflict")), "id", "left")


def scored(
    records: DataFrame, task: str, as_of: str, recency_weight: float = 0.05, atomic: bool = True,
    profile_words: tuple[str, ...] = (), boost_weight: float = 0.15, conflict_penalty: float = 0.6,
) -> DataFrame:
    """Fused records with lexical and score. One projection: evidence adds up, then factors discount it.

    A record whose text holds words of the user's profile is raised by up to ``boost_weight``; one that has a column
    ``conflict`` (see ``contradicted``) that isn't null is discounted by ``conflict_penalty``."""
    lexical = text.lexical_relevance(task, F.col("title"), F.col("content"), F.col("tags"))
    out = records.withColumn("lexical_all", lexical)
    has = lambda s: F.array_contains("sources", s)
    matched = has("fts") | has("keyword")
    lex = F.when(matched, F.col("lexical_all")).otherwise(0.0)
    length = F.length(F.coalesce("content", F.lit("")))
    strong = (lex >= 0.4) | (F.col("vector_score") >= 0.8) | has("entity")
    short = F.when(strong, 1.0).when(length < 50, 0.5).when(length < 80, 0.85).otherwise(1.0)
    fresh = recency(F.coalesce("updated_at", "created_at"), as_of)
    evidence = (
        F.col("vector_score") * 0.35
        + lex * 0.28
        + F.col("boost")
        + F.when(matched, 0.08).otherwise(0.0)
        + F.when(has("entity"), 0.06).otherwise(0.0)
        + F.when(lex >= 0.5, 0.15).otherwise(0.0)
        - (F.when(F.col("kind") == "parent_memory", 0.05).otherwise(0.0) if atomic else F.lit(0.0))
        + F.coalesce("importance", F.lit(0.0)) * 0.05
        + usage_bonus(F.col("injected_count"))
        + F.coalesce("effectiveness_score", F.lit(0.0)) * 0.02
        + clamp(F.coalesce("feedback_score", F.lit(0.0)), -1.0, 1.0) * 0.02
        + fresh * recency_weight
    )
    if profile_words:
        said = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
        evidence = evidence + overlap(said, list(profile_words)) * boost_weight
    factor = F.when(F.col("status") == "candidate", 0.85).otherwise(1.0) * short
    factor = factor * F.when(has("fts") & has("vector"), 1.5).otherwise(1.0)
    if "conflict" in records.columns:
        factor = factor * F.when(F.col("conflict").isNotNull(), conflict_penalty).otherwise(1.0)
    return out.withColumn("fresh", fresh).withColumn("score", F.greatest(F.lit(0.0), evidence * factor))


def gated(records: DataFrame, mode: str = "strict") -> DataFrame:
    """Records that their evidence and score let into a pack."""
    m = MODES[mode]
    weak = F.array_contains("sources", "keyword") & (F.col("lexical_all") < 0.08)
    alone = (F.array_join("sources", ",") == "vector") & (F.col("vector_score") < m.least_vector)
    return records.where(~weak & ~alone & (F.col("score") >= m.least))


def ordered(records: DataFrame, task: str) -> DataFrame:
    """``records`` with their rank from 1: weighed by type for the kind of task, then fresher, then newer."""
    weights = TASK_WEIGHTS[kind_of_task(task)]
    weight: Column = F.lit(1.0)
    for kind, w in weights.items():
        weight = F.when(F.col("type") == kind, w).otherwise(weight)
    final = F.round(F.col("score") * weight, 9)
    out = records.withColumn("final", final)
    newest = F.desc(F.coalesce("updated_at", "created_at"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), F.desc("fresh"), newest, "id")))


def pruned(records: DataFrame, per_parent: int = 3, parents: bool = False) -> DataFrame:
    """At most ``per_parent`` facts of a parent, and no parent one of whose facts is there."""
    nth = F.row_number().over(Window.partitionBy("parent_id").orderBy("rank"))
    kept = records.withColumn("nth", nth).where(f"parent_id is null or nth <= {per_parent}").drop("nth")
    if parents:
        return kept
    present = records.where("kind = 'atomic_fact' and parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return kept.where("parent_id is not null").unionByName(kept.where("parent_id is null").join(present, "id", "left_anti"))


def capped(records: DataFrame, total: int = 12, per_type: int = 3) -> DataFrame:
    """The first ``total`` records with at most ``per_type`` of a type, two of episodic ones; their rank anew."""
    nth = F.row_number().over(Window.partitionBy("type").orderBy("rank"))
    most = F.when(F.col("type") == "episodic_memory", min(2, per_type)).otherwise(per_type)
    some = records.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    return some.orderBy("rank").limit(total).withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def within_budget(records: DataFrame, size: Column, most: int) -> DataFrame:
    """Ranked records up to the first that would overrun the budget. Takes a capped result."""
    running = F.sum(size).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("running", running).where(F.col("running") <= most)


def line(records: DataFrame) -> DataFrame:
    """``records`` with why each was found and the line that a pack shows of it."""
    has = lambda s: F.array_contains("sources", s)
    near = F.format_string("semantic %.2f", F.col("vector_score"))
    by_meaning = (F.col("vector_score") >= 0.7) | (has("vector") & (F.col("vector_score") >= 0.5))
    by_words = has("keyword") | (F.col("lexical_all") > 0.08)
    reason = F.when(by_meaning, near).when(by_words, "lexical").when(has("vector"), near).otherwise("related")
    title = F.replace("title", F.lit("\n"), F.lit(" "))
    shown = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit(" | "), reason, F.lit("] "), title, F.lit(": "), text.snippet(F.col("content")))
    return records.withColumn("reason", reason).withColumn("line", shown)


def pack_quality(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """One row: how many candidates a pack used, and what they were like. Means are rounded twice, so that one that
    ends in a five doesn't depend on the order of its sum."""
    both = candidates.join(used.select("id", F.lit(True).alias("used")), "id", "left")
    n = F.count("*")
    is_used = F.coalesce("used", F.lit(False))
    has = lambda s: F.array_contains("sources", s)
    used_count = F.count_if(is_used)
    return both.agg(
        n.alias("total_candidates"),
        used_count.alias("used_count"),
        F.round(used_count / F.greatest(n, F.lit(1)), 3).alias("hit_rate"),
        F.round(F.count_if(F.col("status") == "active") / F.greatest(n, F.lit(1)), 3).alias("active_ratio"),
        F.round(F.round(F.coalesce(F.avg("importance"), F.lit(0.0)), 9), 3).alias("avg_importance"),
        F.round(F.count_if(F.col("ineffective_count") > 0) / F.greatest(n, F.lit(1)), 3).alias("ineffective_rate"),
        F.round(F.coalesce(F.avg(F.when(is_used & has("vector"), F.col("vector_score"))), F.lit(0.0)), 3).alias("vector_avg_score"),
        F.round(
            F.count_if(is_used & has("vector") & (has("fts") | has("keyword"))) / F.greatest(used_count, F.lit(1)), 3
        ).alias("cross_retrieval_rate"),
    )
