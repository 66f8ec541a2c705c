"""Maintenance plans: merging by title, cleaning, archiving, retention, and reconciling an index with its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.functions.scores import days_before


def keeper_score(accessed: Column, importance: Column, confidence: Column) -> Column:
    """Accessed, then importance, then confidence in quarters, packed into one number."""
    quarter = lambda x: F.greatest(F.lit(0), F.least(F.lit(7), F.bround(F.coalesce(x, F.lit(0.0)) * 4).cast("int")))
    return F.when(accessed.isNotNull(), 64).otherwise(0) + quarter(importance) * 8 + quarter(confidence)


def merge_winners(memories: DataFrame) -> DataFrame:
    """(title_key, winner_id, n, loser_id): of the ``n`` live records that share a title key the one to keep, a row for
    each of the others."""
    live = memories.where("status in ('active', 'candidate')").withColumn("title_key", text.title_key(F.col("title")))
    live = live.where("length(title_key) >= 2")
    score = keeper_score(F.col("last_accessed_at"), F.col("importance"), F.col("confidence"))
    rank = F.struct(score.alias("s"), "created_at", (-F.col("id")).alias("i"))
    winners = live.groupBy("title_key").agg(F.max_by("id", rank).alias("winner_id"), F.count("*").alias("n")).where("n > 1")
    losers = live.select("title_key", F.col("id").alias("loser_id")).join(winners, "title_key")
    return losers.where("loser_id <> winner_id").select("title_key", "winner_id", "n", "loser_id")


def clean_plan(
    memories: DataFrame, as_of: str, agents: tuple[str, ...], days: int = 30, chars: int = 5, aggressive: bool = True
) -> DataFrame:
    """(id, reason): records to delete for good. Used and important ones are protected."""
    candidate = F.col("status") == "candidate"
    old = candidate & (F.col("created_at") < days_before(as_of, days))
    by_agent = F.col("source_agent").isin(*agents) & ~F.col("status").isin("active", "stale", "contradicted", "superseded")
    fragment = candidate & (F.length(F.trim(F.coalesce("content", F.lit("")))) < chars)
    unused = (F.col("status") == "archived") & F.lit(aggressive)
    reasons = F.concat_ws(
        ",",
        F.when(old, "candidate_ttl"),
        F.when(by_agent, F.concat(F.lit("source_agent:"), F.col("source_agent"))),
        F.when(fragment, "fragment"),
        F.when(unused, "archived_unused"),
    )
    used = (
        F.col("last_accessed_at").isNotNull()
        | (F.coalesce("injected_count", F.lit(0)) > 0)
        | (F.coalesce("feedback_score", F.lit(0.0)) != 0)
        | (F.coalesce("importance", F.lit(0.0)) >= 0.9)
    )
    return memories.where(~used).select("id", reasons.alias("reason")).where("reason <> ''")


def archive_plan(curated: DataFrame, extension: DataFrame, losers: DataFrame, winners: DataFrame) -> DataFrame:
    """(id, reason, target_status) of plans (id, reason), the first of which that has an id counts; a loser's reason
    stands in place of another's, and winners (id) are activated, never archived."""
    every = (
        curated.select("id", "reason", F.lit(1).alias("place"))
        .unionByName(extension.select("id", "reason", F.lit(2).alias("place")))
        .unionByName(losers.select("id", "reason", F.lit(0).alias("place")))
    )
    first = every.groupBy("id").agg(F.min_by("reason", "place").alias("reason"))
    archived = first.join(winners.select("id"), "id", "left_anti").withColumn("target_status", F.lit("archived"))
    active = winners.select("id", F.lit("contradiction_winner").alias("reason"), F.lit("active").alias("target_status"))
    return archived.unionByName(active.distinct())


def untouched(memories: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(id, reason): stale and superseded records that nobody touched for so long."""
    idle = F.coalesce(F.col("last_accessed_at") < days_before(as_of, days), F.lit(True)) & (F.col("updated_at") < days_before(as_of, days))
    found = memories.where(F.col("status").isin("stale", "superseded") & idle)
    return found.select("id", F.concat(F.lit("archive_extension:"), F.col("status")).alias("reason"))


def plan_token(plan: DataFrame) -> DataFrame:
    """(plan_token, n): a digest of a plan (id, target_status), of what it archives and what it activates, which a plan
    that has drifted doesn't share.

    Sorted ids meet as digests of slices by their MD5 first, so that no task holds all of a large plan; so the token is
    not the digest of the plain list of ids that the store makes of a short plan.
    """
    name = F.col("id").cast("string")
    sliced = plan.groupBy("target_status", F.substring(F.md5(name), 1, 3).alias("slice")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(name)), "|"), 256).alias("part"), F.count("*").alias("n")
    )

    def parts(status: str) -> Column:
        mine = F.array_sort(F.collect_list(F.when(F.col("target_status") == status, F.struct("slice", "part"))))
        return F.when(F.size(mine) == 0, "__empty__").otherwise(F.array_join(F.transform(mine, lambda x: x["part"]), "|"))

    whole = F.concat(F.lit("archive|"), parts("archived"), F.lit("|active|"), parts("active"))
    return sliced.agg(F.substring(F.sha2(whole, 256), 1, 24).alias("plan_token"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def reasons(plan: DataFrame, samples: int = 5) -> DataFrame:
    """(reason, n, sample): how many records each reason has, and the smallest ids of some. The sample is pre-aggregated
    by hash slices, so a frequent reason's ids never meet in one task."""
    nth = Window.partitionBy("reason", "slice").orderBy("id")
    sliced = plan.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("nth", F.row_number().over(nth))
    parts = sliced.groupBy("reason", "slice").agg(
        F.count("*").alias("n"), F.collect_list(F.when(F.col("nth") <= samples, F.col("id"))).alias("ids")
    )
    return parts.groupBy("reason").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids")).select(
        "reason", "n", F.slice(F.array_sort("ids"), 1, samples).alias("sample")
    )


def expired(rows: DataFrame, time: str, before: Column, status: str = "", terminal: tuple[str, ...] = ()) -> DataFrame:
    """Rows that retention lets go: older than the instant and, if a status is named, in a terminal one."""
    old = rows.where(F.col(time) < before)
    return old.where(F.col(status).isin(*terminal)) if status else old


def retained(rows: DataFrame, time: str, before: Column, status: str = "", terminal: tuple[str, ...] = ()) -> DataFrame:
    """The rest: the complement of ``expired``, rows without a time or status included."""
    gone = F.col(time) < before
    if status:
        gone = gone & F.col(status).isin(*terminal)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def reconciled(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(id, reason) where rows (id, status) and an index (id) disagree: missing, orphan, or of a row that is gone."""
    both = rows.select("id", "status").join(index.select("id", F.lit(True).alias("indexed")), "id", "full_outer")
    live = F.col("status").isin("active", "candidate")
    reason = (
        F.when(F.col("status").isNull(), "orphan")
        .when(live & F.col("indexed").isNull(), "missing")
        .when(~live & F.col("indexed"), "inactive")
    )
    return both.select("id", reason.alias("reason")).where("reason is not null")
