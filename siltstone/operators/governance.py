"""Governed mutation: gates, policies, decisions, requests, ledgers and their inverses, as pure functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scores import age_days, days_before
from siltstone.functions.text import instruction_like
from siltstone.model import (
    APPROVALS,
    AUTO_CONFIDENCE,
    DELETE_ACTIONS,
    HIGH_RISK,
    LOW_RISK,
    MEDIUM_RISK,
    MUTATING_ACTIONS,
    REVIEW_CONFIDENCE,
    TRANSITIONS,
)


def policy_gate(action: Column, confidence: Column) -> Column:
    """(review_status, reason) of a recommendation: the first objection rejects it."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    said = F.coalesce(action, F.lit(""))
    steps = (
        (instruction_like(said), "rejected", "llm_instruction_injection_in_action"),
        (said.isin(*DELETE_ACTIONS) | F.contains(said, F.lit("delete")), "rejected", "delete_action_not_allowed"),
        (~said.isin(*MUTATING_ACTIONS, "keep"), "rejected", "unsupported_action"),
        (said == "split", "rejected", "split_requires_manual_action"),
        (conf < REVIEW_CONFIDENCE, "rejected", "confidence_below_review_threshold"),
        (said == "keep", "auto_approved", ""),
        (conf < AUTO_CONFIDENCE, "rejected", "confidence_below_auto_threshold"),
        (F.lit(True), "auto_approved", ""),
    )
    out = [F.when(c, F.struct(F.lit(s).alias("review_status"), F.lit(r).alias("reason"))) for c, s, r in steps]
    return F.coalesce(*out)


def configured_gate(action: Column, confidence: Column, risk: Column, auto: float = 0.85, review: float = 0.6) -> Column:
    """The variant that leaves doubtful decisions to a person."""
    low = (
        F.when(instruction_like(action) | action.isin(*DELETE_ACTIONS), "rejected")
        .when(confidence < review, "rejected")
        .when((confidence < auto) | (risk == "high") | (action == "split"), "pending")
    )
    return F.coalesce(low, F.lit("auto_approved"))


def risk_of(action: Column) -> Column:
    low = action.isin("promote", "downgrade", "archive_duplicate", "supersede")
    high = action.isin("archive_and_merge_duplicate", "split", "mark_contradicted")
    return F.when(low, "low").when(high, "high").otherwise("medium")


def mutation_policy(action: Column, risk: Column, confidence: Column, approval: str = "auto_policy") -> Column:
    """allowed, queued, rejected or override_allowed."""
    queued = action.isin(*HIGH_RISK) | (risk == "high") | (action.isin(*MEDIUM_RISK) & (risk != "low"))
    doubtful = (confidence < 0.65) & ~action.isin(*LOW_RISK)
    after = "override_allowed" if approval == "admin_override" else "allowed" if approval in APPROVALS else "queued"
    return F.when(confidence < 0.45, "rejected").when(queued | doubtful, after).otherwise("allowed")


def request_error(action: Column, target: Column, risk: Column, confidence: Column) -> Column:
    """What is wrong with a mutation request, or null."""
    known = (*LOW_RISK, *MEDIUM_RISK, *HIGH_RISK)
    free = ("memory_insert", "memory_link_insert", "no_op", "maintenance_cleanup")
    return (
        F.when(~action.isin(*known), "unsupported action")
        .when(~action.isin(*free) & target.isNull(), "no target")
        .when(~risk.isin("low", "medium", "high"), "unsupported risk")
        .when(~confidence.between(0, 1), "confidence out of range")
    )


def may_follow(now: Column, then: Column) -> Column:
    """Whether an execution may go from one state to another."""
    steps = [f"{a}>{b}" for a, after in TRANSITIONS.items() for b in after]
    return F.coalesce(F.concat(now, F.lit(">"), then).isin(*steps), F.lit(False))


def candidate_hash(kind: Column, action: Column, ids: Column) -> Column:
    """A decision's digest: equal for equal kind, action and set order of ids."""
    named = F.concat_ws("|", kind, action, F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ","))
    return F.sha2(named, 256)


def new_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings whose digest no open or applied decision has; of equal findings the one with the smallest id."""
    known = decisions.where("review_status in ('needs_review', 'auto_approved', 'applied')").select("candidate_hash")
    first = findings.groupBy("candidate_hash").agg(F.min_by(F.struct(*findings.columns), "id").alias("row"))
    return first.select("row.*").join(known.distinct(), "candidate_hash", "left_anti")


def requests(decisions: DataFrame) -> DataFrame:
    """(decision_id, seq, action_type, target_id): the mutations that approved decisions ask for."""

    def request(action: str, target: str) -> Column:
        return F.struct(F.lit(action).alias("action_type"), F.col(target).alias("target_id"))

    a = F.col("action")
    wanted = (
        F.when(a.isin("archive_duplicate", "archive"), F.array(request("memory_archive", "second_id")))
        .when(a == "archive_and_merge_duplicate", F.array(request("memory_update", "first_id"), request("memory_archive", "second_id")))
        .when(a == "mark_contradicted", F.array(request("memory_status_update", "first_id")))
        .when(a == "supersede", F.array(request("memory_supersede", "first_id"), request("memory_link_insert", "second_id")))
        .when(a.isin("promote", "downgrade"), F.array(request("memory_importance_update", "first_id")))
    )
    each = decisions.select(F.col("id").alias("decision_id"), F.posexplode(wanted).alias("seq", "request"))
    return each.select("decision_id", "seq", "request.*")


def executed(rows: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, status) after changes (id, new_status), and the ledger (id, before, after, inverse) of what changed.

    Of several changes of a row the one with the largest seq counts, of equal ones the one with the largest status. A change to what a row already has is no change.
    """
    last = changes.groupBy("id").agg(F.max_by("new_status", F.struct("seq", "new_status")).alias("new_status"))
    both = rows.join(last, "id", "left")
    after = both.select("id", F.coalesce("new_status", "status").alias("status"))
    changed = both.where("new_status is not null and not new_status <=> status")
    show = lambda c: F.to_json(F.struct(F.col(c).alias("status")))
    return after, changed.select("id", show("status").alias("before"), show("new_status").alias("after"), show("status").alias("inverse"))


def rolled_back(ledger: DataFrame) -> DataFrame:
    """(execution_id, entity_id, status): what undoing an execution's applied changes, last first, leaves: the state
    before the first of them."""
    first = ledger.where("status = 'applied'").groupBy("execution_id", "entity_id")
    return first.agg(F.min_by("before_status", F.struct("seq", "before_status")).alias("status"))


def ledger_with_context(ledger: DataFrame, executions: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger rows with their execution and run, kept where these are unknown."""
    return ledger.join(executions, "execution_id", "left").join(runs, "run_id", "left")


def queue(decisions: DataFrame, limit: int = 50) -> DataFrame:
    """Decisions that wait for someone, most pressing first."""
    order = ("mark_contradicted", "archive_and_merge_duplicate", "supersede", "archive_duplicate", "archive", "split", "downgrade", "promote")
    risk = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "low", 2).otherwise(1)
    action = F.coalesce(*(F.when(F.col("action") == a, i) for i, a in enumerate(order)), F.lit(8))
    waiting = decisions.where("review_status in ('needs_review', 'auto_approved') and action <> 'keep'")
    return waiting.orderBy(risk, action, F.desc("confidence"), F.desc("created_at"), "id").limit(limit)


def recalibrated(decisions: DataFrame) -> DataFrame:
    """(id, old, new): what the gate says now of decisions that wait for review."""
    gate = policy_gate(F.col("action"), F.col("confidence"))["review_status"]
    return decisions.where("review_status = 'needs_review'").select("id", F.col("review_status").alias("old"), gate.alias("new"))


def overdue(decisions: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Low-risk decisions whose review has waited too long."""
    low = decisions.where("review_status = 'needs_review'").where(risk_of(F.col("action")) == "low")
    return low.where(F.col("created_at") < days_before(as_of, days))


def health(decisions: DataFrame, as_of: str, auto_supersede: bool = False) -> DataFrame:
    """One row of operational health: counts, rates, the mean age of the queue in hours, and whether it is degraded."""
    n = lambda s: F.count_if(F.col("review_status") == s)
    done, undone = n("applied"), n("rolled_back")
    superseded = F.col("decision_type") == "supersession"
    undone_s = F.count_if(superseded & (F.col("review_status") == "rolled_back"))
    done_s = F.count_if(superseded & F.col("review_status").isin("applied", "rolled_back"))
    age = F.avg(F.when(F.col("review_status") == "needs_review", age_days(F.col("created_at"), as_of) * 24))
    out = decisions.agg(
        done.alias("applied_count"),
        undone.alias("rolled_back_count"),
        n("needs_review").alias("needs_review_count"),
        n("rejected").alias("rejected_count"),
        F.round(F.coalesce(F.try_divide(undone, done + undone), F.lit(0.0)), 4).alias("rollback_rate"),
        F.round(F.coalesce(F.try_divide(undone_s, done_s), F.lit(0.0)), 4).alias("revival_rate"),
        F.round(F.coalesce(age, F.lit(0.0)), 2).alias("queue_age_hours"),
    )
    waits = (F.col("needs_review_count") > 20) if not auto_supersede else F.lit(False)
    degraded = (F.col("revival_rate") > 0.05) | (F.col("rollback_rate") > 0.10) | waits | (F.col("queue_age_hours") > 72.0)
    return out.withColumn("degraded", degraded)


def latest(states: DataFrame, key: str, time: str, *values: str) -> DataFrame:
    """The last state of each key: its values at the largest time."""
    last = F.max_by(F.struct(*values), time).alias("last")
    return states.groupBy(key).agg(last).select(key, "last.*")


def orphaned(jobs: DataFrame, as_of: str, hours: float = 6.0) -> DataFrame:
    """Jobs that still run so long after they began."""
    return jobs.where("status = 'running'").where(F.col("started_at") < days_before(as_of, hours / 24))


def numbered_page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page of rows in a total order, and whether more follow: one row more than the page is looked at."""
    page = rows.orderBy(*order).offset(offset).limit(size + 1)
    nth = F.row_number().over(Window.orderBy(*order))
    counted = page.withColumn("nth", nth).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return counted.withColumn("has_more", F.col("n") > size).where(F.col("nth") <= size).drop("nth", "n")
