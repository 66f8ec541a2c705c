"""Governance over decisions and the mutation ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import AS_OF, TRANSITIONS
from siltstone.operators import commits, governance
from siltstone.plans.registry import query
from siltstone.sources.scratch import shared_folder
from siltstone.sources.versions import VersionedTable
from siltstone.sources.views import view

SQL_WORD = "regexp_matches(action, '\\b(SELECT|UPDATE|INSERT|DELETE|DROP|ALTER|CREATE|TRUNCATE|EXEC|EXECUTE)\\b', 'i')"
MUTATING = "('archive_duplicate', 'archive_and_merge_duplicate', 'mark_contradicted', 'archive', 'promote', 'downgrade', 'split', 'supersede')"
GATE = f"""CASE WHEN {SQL_WORD} THEN 'rejected|llm_instruction_injection_in_action'
  WHEN action NOT IN {MUTATING} AND action <> 'keep' THEN 'rejected|unsupported_action'
  WHEN action = 'split' THEN 'rejected|split_requires_manual_action'
  WHEN confidence < 0.45 THEN 'rejected|confidence_below_review_threshold'
  WHEN action = 'keep' THEN 'auto_approved|' WHEN confidence < 0.75 THEN 'rejected|confidence_below_auto_threshold'
  ELSE 'auto_approved|' END"""
RISK = """CASE WHEN action IN ('promote', 'downgrade', 'archive_duplicate', 'supersede') THEN 'low'
  WHEN action IN ('archive_and_merge_duplicate', 'split', 'mark_contradicted') THEN 'high' ELSE 'medium' END"""


@query(f"SELECT id, split_part({GATE}, '|', 1) AS review_status, split_part({GATE}, '|', 2) AS reason FROM decisions")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions")
    return d.select("id", governance.policy_gate(F.col("action"), F.col("confidence")).alias("g")).select("id", "g.*")


@query(f"""SELECT id, CASE WHEN {SQL_WORD} THEN 'rejected' WHEN confidence < 0.6 THEN 'rejected'
  WHEN confidence < 0.85 OR risk_level = 'high' OR action = 'split' THEN 'pending' ELSE 'auto_approved' END AS review_status FROM decisions""")
def policy_gate_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions")
    return d.select("id", governance.configured_gate(F.col("action"), F.col("confidence"), F.col("risk_level")).alias("review_status"))


@query("""WITH j AS (SELECT execution_id, seq, action_type, risk_level, confidence FROM ledger JOIN decisions ON id = execution_id)
SELECT execution_id, seq, CASE WHEN confidence < 0.45 THEN 'rejected'
  WHEN risk_level = 'high' OR (action_type <> 'memory_importance_update' AND action_type <> 'memory_link_insert' AND risk_level <> 'low')
    OR (confidence < 0.65 AND action_type NOT IN ('memory_importance_update', 'memory_link_insert')) THEN 'queued' ELSE 'allowed' END AS manual,
  CASE WHEN confidence < 0.45 THEN 'rejected' ELSE 'allowed' END AS by_policy FROM j""")
def mutation_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions").select(F.col("id").alias("execution_id"), "risk_level", "confidence")
    j = view(spark, sf_dir, "ledger").join(d, "execution_id")
    args = (F.col("action_type"), F.col("risk_level"), F.col("confidence"))
    return j.select(
        "execution_id", "seq", governance.mutation_policy(*args, approval="none").alias("manual"),
        governance.mutation_policy(*args).alias("by_policy"),
    )


STEPS = ", ".join(f"('{a}', '{b}')" for a, after in TRANSITIONS.items() for b in after)


@query(f"""WITH s AS (SELECT id, CASE id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'applied' ELSE 'planned' END AS now,
  CASE id % 5 WHEN 0 THEN 'applying' WHEN 1 THEN 'rolling_back' WHEN 2 THEN 'policy_evaluated' WHEN 3 THEN 'cancelled' ELSE 'applied' END AS then_
  FROM decisions), t(a, b) AS (VALUES {STEPS})
SELECT now, then_ AS next, EXISTS (SELECT 1 FROM t WHERE a = now AND b = then_) AS allowed, count(*) AS n FROM s GROUP BY now, then_""")
def execution_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions").select(
        F.expr("CASE id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'applied' ELSE 'planned' END").alias("now"),
        F.expr(
            "CASE id % 5 WHEN 0 THEN 'applying' WHEN 1 THEN 'rolling_back' WHEN 2 THEN 'policy_evaluated' "
            "WHEN 3 THEN 'cancelled' ELSE 'applied' END"
        ).alias("next"),
    )
    n = d.groupBy("now", "next").agg(F.count("*").alias("n"))
    return n.withColumn("allowed", governance.may_follow(F.col("now"), F.col("next")))


@query("""WITH q AS (SELECT *, CASE risk_level WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END AS r, CASE action WHEN 'mark_contradicted' THEN 0
  WHEN 'archive_and_merge_duplicate' THEN 1 WHEN 'supersede' THEN 2 WHEN 'archive_duplicate' THEN 3 WHEN 'archive' THEN 4 WHEN 'split' THEN 5
  WHEN 'downgrade' THEN 6 WHEN 'promote' THEN 7 ELSE 8 END AS a FROM decisions
  WHERE review_status IN ('needs_review', 'auto_approved') AND action <> 'keep')
SELECT id, risk_level, action, confidence FROM q ORDER BY r, a, confidence DESC, created_at DESC, id LIMIT 50""")
def queue_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.queue(view(spark, sf_dir, "decisions")).select("id", "risk_level", "action", "confidence")


@query(f"""SELECT *, revival_rate > 0.05 OR rollback_rate > 0.1 OR needs_review_count > 20 OR queue_age_hours > 72 AS degraded FROM (
SELECT count(*) FILTER (review_status = 'applied') AS applied_count, count(*) FILTER (review_status = 'rolled_back') AS rolled_back_count,
  count(*) FILTER (review_status = 'needs_review') AS needs_review_count, count(*) FILTER (review_status = 'rejected') AS rejected_count,
  round(count(*) FILTER (review_status = 'rolled_back') / count(*) FILTER (review_status IN ('applied', 'rolled_back')), 4) AS rollback_rate,
  round(count(*) FILTER (review_status = 'rolled_back' AND decision_type = 'supersession')
    / count(*) FILTER (review_status IN ('applied', 'rolled_back') AND decision_type = 'supersession'), 4) AS revival_rate,
  round(avg((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 3600000000) FILTER (review_status = 'needs_review'), 2) AS queue_age_hours
FROM decisions)""")
def governance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.health(view(spark, sf_dir, "decisions"), AS_OF)


@query("""SELECT decision_type, round(count(*) FILTER (review_status = 'rejected') / count(*), 3) AS rejection_rate,
  count(*) FILTER (review_status = 'applied') AS applied, count(*) FILTER (review_status = 'needs_review') AS needs_review FROM decisions GROUP BY decision_type""")
def rejection_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions").groupBy("decision_type")
    n = lambda s: F.count_if(F.col("review_status") == s)
    return d.agg(F.round(n("rejected") / F.count("*"), 3).alias("rejection_rate"), n("applied").alias("applied"), n("needs_review").alias("needs_review"))


@query("""SELECT review_status, count(*) FILTER (decision_type = 'semantic_duplicate') AS semantic_duplicate,
  count(*) FILTER (decision_type = 'contradiction') AS contradiction, count(*) FILTER (decision_type = 'supersession') AS supersession,
  count(*) FILTER (decision_type = 'importance') AS importance FROM decisions GROUP BY review_status""")
def decision_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["semantic_duplicate", "contradiction", "supersession", "importance"]
    d = view(spark, sf_dir, "decisions").groupBy("review_status").pivot("decision_type", kinds).count()
    return d.fillna(0, kinds)


HASH = "sha256(decision_type || '|' || action || '|' || least(first_id::VARCHAR, second_id::VARCHAR) || ',' || greatest(first_id::VARCHAR, second_id::VARCHAR))"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions")
    digest = governance.candidate_hash(F.col("decision_type"), F.col("action"), F.array("first_id", "second_id"))
    return d.withColumn("candidate_hash", digest)


@query(f"""WITH h AS (SELECT *, {HASH} AS candidate_hash FROM decisions),
known AS (SELECT DISTINCT candidate_hash FROM h WHERE id % 2 = 0 AND review_status IN ('needs_review', 'auto_approved', 'applied'))
SELECT min(id) AS id, candidate_hash FROM h WHERE id % 2 = 1 AND candidate_hash NOT IN (SELECT * FROM known) GROUP BY candidate_hash""")
def new_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd decisions stand for findings, even ones for what was decided before."""
    h = _hashed(spark, sf_dir)
    return governance.new_decisions(h.where("id % 2 = 1"), h.where("id % 2 = 0")).select("id", "candidate_hash")


REQUESTS = """w AS (SELECT id AS decision_id, CASE WHEN action IN ('archive_duplicate', 'archive') THEN [{'t': 'memory_archive', 'i': second_id}]
  WHEN action = 'archive_and_merge_duplicate' THEN [{'t': 'memory_update', 'i': first_id}, {'t': 'memory_archive', 'i': second_id}]
  WHEN action = 'mark_contradicted' THEN [{'t': 'memory_status_update', 'i': first_id}]
  WHEN action = 'supersede' THEN [{'t': 'memory_supersede', 'i': first_id}, {'t': 'memory_link_insert', 'i': second_id}]
  WHEN action IN ('promote', 'downgrade') THEN [{'t': 'memory_importance_update', 'i': first_id}] END AS r FROM decisions
  WHERE review_status = 'auto_approved'),
x AS (SELECT decision_id, unnest(range(0, len(r))) AS seq, r FROM w WHERE r IS NOT NULL),
requests AS (SELECT decision_id, seq, r[seq + 1].t AS action_type, r[seq + 1].i AS target_id FROM x)"""


@query(f"WITH {REQUESTS} SELECT * FROM requests")
def mutation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.requests(view(spark, sf_dir, "decisions").where("review_status = 'auto_approved'"))


@query("""WITH c AS (SELECT entity_id AS id, arg_max(after_status, (execution_id * 10 + seq) * 1000 + ascii(after_status)) AS new_status FROM ledger WHERE status = 'applied' GROUP BY entity_id)
SELECT p_partkey AS id, '{"status":"F"}' AS before, '{"status":"' || new_status || '"}' AS after, '{"status":"F"}' AS inverse
FROM part JOIN c ON id = p_partkey WHERE new_status <> 'F'""")
def mutation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("F").alias("status"))
    changes = view(spark, sf_dir, "ledger").where("status = 'applied'")
    changes = changes.selectExpr("entity_id AS id", "execution_id * 10 + seq AS seq", "after_status AS new_status")
    return governance.executed(rows, changes)[1]


@query("SELECT execution_id, entity_id, arg_min(before_status, seq * 1000 + ascii(before_status)) AS status FROM ledger WHERE status = 'applied' GROUP BY execution_id, entity_id")
def rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.rolled_back(view(spark, sf_dir, "ledger"))


@query("""WITH x AS (SELECT id AS execution_id, first_id AS run_id, review_status AS execution_status FROM decisions WHERE id % 3 > 0),
r AS (SELECT c_custkey AS run_id, c_mktsegment AS origin FROM customer WHERE c_custkey % 2 = 0)
SELECT execution_id, seq, entity_id, execution_status, run_id, origin FROM (SELECT ledger.*, x.run_id, execution_status FROM ledger
  LEFT JOIN x USING (execution_id)) l LEFT JOIN r USING (run_id)""")
def ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions").where("id % 3 > 0")
    executions = d.selectExpr("id AS execution_id", "first_id AS run_id", "review_status AS execution_status")
    runs = view(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS run_id", "c_mktsegment AS origin")
    found = governance.ledger_with_context(view(spark, sf_dir, "ledger"), executions, runs)
    return found.select("execution_id", "seq", "entity_id", "execution_status", "run_id", "origin")


@query(f"""SELECT id, review_status AS old, split_part({GATE}, '|', 1) AS new FROM decisions WHERE review_status = 'needs_review'""")
def recalibrated_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.recalibrated(view(spark, sf_dir, "decisions"))


@query(f"""SELECT id, action FROM decisions WHERE review_status = 'needs_review' AND {RISK} = 'low'
  AND created_at < TIMESTAMP '1996-06-01 00:00:00' - INTERVAL '14' DAY""")
def stale_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.overdue(view(spark, sf_dir, "decisions"), "1996-06-01 00:00:00").select("id", "action")


@query("""SELECT action_type, risk_level, CASE WHEN target_id IS NULL AND action_type <> 'memory_link_insert' THEN 'no target'
  WHEN confidence > 1 THEN 'confidence out of range' END AS error, count(*) AS n FROM (
  SELECT action_type, risk_level, confidence * 1.2::DOUBLE AS confidence, CASE WHEN seq < 6 THEN entity_id END AS target_id
  FROM ledger JOIN decisions ON id = execution_id) GROUP BY ALL""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions").select(F.col("id").alias("execution_id"), "risk_level", "confidence")
    j = view(spark, sf_dir, "ledger").join(d, "execution_id")
    target = F.when(F.col("seq") < 6, F.col("entity_id"))
    error = governance.request_error(F.col("action_type"), target, F.col("risk_level"), F.col("confidence") * 1.2)
    return j.groupBy("action_type", "risk_level", error.alias("error")).agg(F.count("*").alias("n"))


@query("""SELECT execution_id AS id, arg_max(seq, seq) AS seq, arg_max(status, seq) AS status FROM ledger GROUP BY execution_id""")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.latest(view(spark, sf_dir, "ledger"), "execution_id", "seq", "seq", "status").withColumnRenamed("execution_id", "id")


@query("""SELECT id, review_status, true AS has_more FROM decisions ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""")
def decision_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = governance.numbered_page(view(spark, sf_dir, "decisions"), [F.desc("created_at"), F.col("id")], 40, 20)
    return found.select("id", "review_status", "has_more")


def _versioned(spark: SparkSession, rows: DataFrame, name: str) -> VersionedTable:
    return VersionedTable.create(rows, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", buckets=16)


def _of_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.select("id", F.lit(status).alias("status"))


@query("""SELECT id, type, CASE WHEN status = 'stale' AND importance < 0.3 THEN 'archived' ELSE status END AS status FROM memories""")
def versioned_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale records of little weight are archived by a plan. A second plan on the same version is refused."""
    memories = view(spark, sf_dir, "memories").select("id", "type", "status", "importance")
    table = _versioned(spark, memories, "versioned")
    stale = memories.where("status = 'stale'")
    first = commits.plan(table, _of_status(stale.where("importance < 0.3"), "archived"), "clean")
    second = commits.plan(table, _of_status(stale, "contradicted"), "expire")
    commits.execute(table, first)
    commits.execute(table, second)
    return table.read().select("id", "type", "status")


@query("""SELECT id, CASE WHEN type = 'feedback' THEN 'archived' ELSE status END AS status FROM memories""")
def versioned_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two executions, the first of which is undone by its inverses; what the second did stays."""
    memories = view(spark, sf_dir, "memories").select("id", "type", "status")
    table = _versioned(spark, memories, "rollback")
    first = commits.execute(table, commits.plan(table, _of_status(memories.where("type = 'decision' AND status = 'active'"), "stale"), "expire"))
    commits.execute(table, commits.plan(table, _of_status(memories.where("type = 'feedback'"), "archived"), "clean"))
    commits.rollback(table, first["version"])
    return table.read().select("id", "status")


BLOCKED = """confidence < 0.45 AND action IN ('archive_duplicate', 'archive', 'archive_and_merge_duplicate', 'mark_contradicted', 'supersede',
  'promote', 'downgrade')"""


@query(f"""SELECT CASE WHEN review_status = 'applied' THEN 'already_applied' WHEN {BLOCKED} THEN 'skipped' ELSE 'apply' END AS outcome,
  action, count(*) AS n FROM decisions WHERE review_status IN ('applied', 'needs_review', 'auto_approved') GROUP BY ALL""")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions")
    asked = d.where("review_status in ('applied', 'needs_review', 'auto_approved')")
    return commits.batch_outcomes(d, asked).groupBy("outcome", "action").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT CASE WHEN action = 'mark_contradicted' THEN first_id ELSE second_id END AS id, id AS of,
    CASE WHEN action IN ('archive_duplicate', 'archive', 'archive_and_merge_duplicate') THEN 'archived'
      WHEN action = 'mark_contradicted' THEN 'contradicted' WHEN action = 'supersede' THEN 'superseded' END AS status
  FROM decisions WHERE review_status = 'auto_approved' AND NOT ({BLOCKED})),
l AS (SELECT id, arg_max(status, of) AS status FROM w WHERE status IS NOT NULL GROUP BY id)
SELECT m.id, coalesce(l.status, m.status) AS status FROM memories m LEFT JOIN l ON l.id = m.id""")
def batch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All approved decisions as one version of the records."""
    d = view(spark, sf_dir, "decisions")
    memories = _versioned(spark, view(spark, sf_dir, "memories").select("id", "status"), "batch")
    decisions = _versioned(spark, d.select("id", "action", "risk_level", "confidence", "review_status", "first_id", "second_id"), "decisions")
    commits.apply_batch(memories, decisions, d.where("review_status = 'auto_approved'"))
    return memories.read().select("id", "status")
