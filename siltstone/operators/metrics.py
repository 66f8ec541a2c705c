"""Statistics of the collection: distributions, recall, quality, health. Each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scores import days_before


def distributions(memories: DataFrame) -> DataFrame:
    """(facet, value, n): counts by type, status and source agent, in one scan and one shuffle."""
    facets = F.array(
        *(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("type", "status", "source_agent"))
    )
    each = memories.select(F.explode(facets).alias("f")).select("f.*")
    return each.groupBy("facet", "value").agg(F.count("*").alias("n"))


def totals(memories: DataFrame) -> DataFrame:
    """One row: number and averages, and what was never accessed."""
    unseen = F.col("last_accessed_at").isNull()
    return memories.agg(
        F.count("*").alias("n"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.round(F.avg("importance"), 6).alias("avg_importance"),
        F.round(F.avg("feedback_score"), 6).alias("avg_feedback"),
        F.count_if(unseen).alias("never_accessed"),
        F.count_if(unseen & (F.col("status") == "active")).alias("active_never_accessed"),
    )


def recall(memories: DataFrame, *by: str) -> DataFrame:
    """How much of the collection was ever put to use, by the given columns."""
    n = F.count("*")
    used = F.count_if(F.col("injected_count") > 0)
    return memories.groupBy(*by).agg(
        n.alias("n"),
        used.alias("used"),
        F.sum("injected_count").alias("injections"),
        F.round(used * 100.0 / n, 1).alias("used_percent"),
        F.round(F.avg("effectiveness_score"), 3).alias("avg_effectiveness"),
    )


def high_recall_types(memories: DataFrame, least: int = 3, most: int = 3) -> DataFrame:
    """The types that are used most, among those with enough live records."""
    n, used = F.count("*"), F.count_if(F.col("injected_count") > 0)
    live = memories.where("status in ('active', 'candidate')").groupBy("type")
    rates = live.agg(n.alias("n"), F.round(used / n, 6).alias("recall_rate")).where(f"n >= {least} and recall_rate > 0")
    return rates.orderBy(F.desc("recall_rate"), F.desc("n"), "type").limit(most)


def seed_feedback(importance: Column, linked: Column, popular: Column, length: Column) -> Column:
    """The feedback that a new fact starts with."""
    first = F.when(importance >= 0.8, 0.3).when(importance >= 0.6, 0.1).otherwise(0.0)
    rest = F.when(linked, 0.2).otherwise(0.0) + F.when(popular, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), first + rest + F.when(length.between(50, 200), 0.1).otherwise(0.0)), 2)


def quality_by_task(events: DataFrame, last: int = 500) -> DataFrame:
    """Mean rates of the last events by kind of task."""
    recent = events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(last)
    means = (F.round(F.avg(c), 3).alias(c) for c in ("hit_rate", "filter_rate", "cross_rate", "used_count"))
    return recent.groupBy("task_type").agg(F.count("*").alias("n"), *means)


def quality_windows(events: DataFrame, as_of: str, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """(days, n, hit_rate, cross_rate): means over several last spans, all in one scan."""
    inside = F.array(*(F.when(F.col("created_at") >= days_before(as_of, d), F.lit(d)) for d in days))
    each = events.select(F.explode(F.array_compact(inside)).alias("days"), "hit_rate", "cross_rate")
    return each.groupBy("days").agg(
        F.count("*").alias("n"), F.round(F.avg("hit_rate"), 4).alias("hit_rate"), F.round(F.avg("cross_rate"), 4).alias("cross_rate")
    )


def feedback_mean(events: DataFrame) -> DataFrame:
    return events.groupBy("memory_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("feedback_score"))


def effectiveness(events: DataFrame, start: float = 0.5, step: float = 0.05) -> DataFrame:
    """(memory_id, effectiveness, ineffective): scores folded in the order of event_id, clamped to 0..1 after each.

    The fold needs the order, so a record's scores meet in one row. They meet as clamped shifts: x -> min(hi, max(lo,
    x + d)) composes, so ``compacted`` folds slices of a long history first and this only folds their compositions.
    """
    parts = compacted(events.withColumn("slice", F.floor(F.col("event_id") / 100_000)), step)
    order = F.array_sort(F.collect_list(F.struct("slice", "shift", "low", "high")))
    apply = lambda x, p: F.least(p["high"], F.greatest(p["low"], x + p["shift"]))
    folded = F.aggregate(order, F.lit(start), apply)
    return parts.groupBy("memory_id").agg(F.round(folded, 4).alias("effectiveness"), F.sum("ineffective").alias("ineffective"))


def compacted(events: DataFrame, step: float = 0.05) -> DataFrame:
    """(memory_id, slice, shift, low, high, ineffective): each slice's scores as one clamped shift."""
    order = F.array_sort(F.collect_list(F.struct("event_id", (F.col("score") * step).alias("d"))))
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))

    def compose(s: Column, e: Column) -> Column:
        d = e["d"]
        bound = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
        return F.struct((s["shift"] + d).alias("shift"), bound(s["low"] + d).alias("low"), bound(s["high"] + d).alias("high"))

    groups = events.groupBy("memory_id", "slice")
    out = groups.agg(F.aggregate(order, start, compose).alias("f"), F.count_if(F.col("score") < 0).alias("ineffective"))
    return out.select("memory_id", "slice", "f.*", "ineffective")


def health(memories: DataFrame, linked: DataFrame, decisions: DataFrame, llm_score: float = 50.0) -> DataFrame:
    """One row: the collection's quality, 0 to 100, and its parts. Inputs are aggregated before they meet."""
    n = lambda s: F.count_if(F.col("status") == s)
    m = memories.agg(
        n("active").alias("active"),
        n("stale").alias("stale"),
        n("superseded").alias("superseded"),
        n("contradicted").alias("contradicted"),
        F.count_if((F.col("status") == "active") & F.col("last_accessed_at").isNull()).alias("never"),
    )
    waiting = F.col("review_status").isin("needs_review", "auto_approved") & (F.col("action") != "keep")
    d = decisions.agg(
        F.count_if(waiting & (F.col("decision_type") == "contradiction")).alias("contra"),
        F.count_if(waiting & (F.col("decision_type") == "semantic_duplicate")).alias("dup"),
    )
    both = m.crossJoin(d).crossJoin(linked.agg(F.count("*").alias("linked")))
    pct = lambda a, b: F.coalesce(F.least(F.lit(100.0), F.bround(F.try_divide(a, b) * 100, 0)), F.lit(0.0))
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(x, 0)))
    pending = F.col("stale") + F.col("superseded") + F.col("contradicted")
    risk = clamp(100.0 - (F.col("contra") + F.col("dup")) * 18 - F.least("dup", F.lit(100)) * 0.28 - F.least("contra", F.lit(20)) * 2)
    parts = both.select(
        "*",
        risk.alias("risk"),
        pct(F.col("active") - F.col("never"), F.col("active")).alias("reuse"),
        pct(F.col("linked"), F.col("active")).alias("coverage"),
        pct(pending, F.col("active") + pending).alias("pending"),
    )
    weighed = (
        F.col("risk") * 0.34 + clamp(100 - F.col("pending")) * 0.16 + clamp(F.col("coverage")) * 0.08
        + clamp(F.col("reuse")) * 0.24 + F.lit(llm_score) * 0.14
    )
    return parts.withColumn("quality", clamp(weighed / 0.96)).select("quality", "risk", "reuse", "coverage", "pending", "linked", "contra", "dup")


def app_of(agent: Column, aliases: dict[str, str]) -> Column:
    """The application behind an agent's name; the name itself where no alias is known."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.element_at(table, F.coalesce(agent, F.lit("manual"))), agent, F.lit("manual"))


def apps(memories: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(app, n, accesses, first_at, last_at) by application."""
    named = memories.withColumn("app", app_of(F.col("source_agent"), aliases))
    return named.groupBy("app").agg(
        F.count("*").alias("n"), F.sum("injected_count").alias("accesses"),
        F.min("last_accessed_at").alias("first_at"), F.max("last_accessed_at").alias("last_at"),
    )


def app_details(memories: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(app, created, accessed, first_at, last_at): an application's active records, and its records that were read."""
    named = memories.withColumn("app", app_of(F.col("source_agent"), aliases))
    return named.groupBy("app").agg(
        F.count_if(F.col("status") == "active").alias("created"), F.count("last_accessed_at").alias("accessed"),
        F.min("last_accessed_at").alias("first_at"), F.max("last_accessed_at").alias("last_at"),
    )


def grouped_stats(memories: DataFrame) -> DataFrame:
    """Records and their mean importance by type, by status, by agent and in all, in one pass over them."""
    sets = [[F.col(c)] for c in ("type", "status", "source_agent")] + [[]]
    grouped = memories.groupingSets(sets, "type", "status", "source_agent")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("importance"), 6).alias("avg_importance"))


def tag_counts(memories: DataFrame) -> DataFrame:
    return memories.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def table_size(rows: DataFrame) -> DataFrame:
    """One row: how many rows a table has, and about how many characters an archive of it takes."""
    length = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in rows.columns), F.lit(0))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("chars"))


def latency(events: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean and approximate percentiles of a duration."""
    quantiles = F.percentile_approx(value, [0.5, 0.95, 0.99], 10_000)
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), quantiles.alias("p50_p95_p99"))
