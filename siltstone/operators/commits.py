"""Governed changes of a versioned table: plans bound to what they saw, executions with a ledger, rollback, batches."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators import governance
from siltstone.sources.versions import Conflict, VersionedTable


def _digest(rows: DataFrame) -> str:
    """Of a table as a set of rows; sums and exclusive ors, so no task holds it whole."""
    hashes = rows.select(F.xxhash64(*sorted(rows.columns)).alias("h"))
    n, x, s = hashes.agg(F.count("*"), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}:{x}:{s}".encode()).hexdigest()


def _targets(table: VersionedTable, changes: DataFrame, version: int) -> DataFrame:
    key = table.entry(version)["key"]
    return table.read(version).join(changes.select(key).distinct(), key, "left_semi")


def plan(table: VersionedTable, changes: DataFrame, action: str) -> str:
    """Keeps a plan, and gives its token: ``changes`` (key, and new values of some columns; unique keys) of the version
    as it is now. The token is the digest of action, version, changes, and the rows that they are for."""
    version, folder = table.version, f"{table.path}/plans/{uuid.uuid4().hex}"
    changes.write.parquet(f"{folder}/changes")
    kept = table.spark.read.schema(changes.schema).parquet(f"{folder}/changes")
    seen = _digest(_targets(table, kept, version))
    token = hashlib.sha256(f"{action}|{version}|{_digest(kept)}|{seen}".encode()).hexdigest()
    meta = {"action": action, "version": version, "seen": seen, "changes": f"{folder}/changes", "schema": changes.schema.json(), "count": kept.count()}
    meta_rows = table.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
    meta_rows.write.mode("overwrite").text(f"{table.path}/plans/{token}")
    return token


def _found(table: VersionedTable, token: str) -> dict | None:
    path = table._at("plans", token)
    return json.loads(table.spark.read.text(path.toString()).first()[0]) if token and table._fs.exists(path) else None


def execute(table: VersionedTable, token: str, strict: bool = True) -> dict:
    """Carries out a plan: {ok, version, ...} or {ok: False, error}.

    A token without a plan is refused (unknown_plan_token). A plan that was carried out already changes nothing more
    (idempotent). If the table has moved on since the plan was made it is refused (plan_drift); with ``strict`` off only
    if one of its rows has changed. The ledger gets each changed row as it was and as it is, beside the new version.
    """
    found = _found(table, token)
    if found is None:
        return {"ok": False, "error": "unknown_plan_token"}
    done = next((n for n in table.history() if n.get("token") == token), None)
    if done:
        return {"ok": True, "idempotent": True, "version": done["version"], "changed": done["changed"]}
    changes = table.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(found["changes"])
    now = table.version
    if strict and now != found["version"] or _digest(_targets(table, changes, now)) != found["seen"]:
        return {"ok": False, "error": "plan_drift", "planned_version": found["version"], "version": now}
    try:
        return _commit(table, now, changes, {"action": found["action"], "token": token})
    except Conflict:
        return {"ok": False, "error": "plan_drift", "planned_version": found["version"], "version": table.version}


def _commit(table: VersionedTable, parent: int, changes: DataFrame, note: dict) -> dict:
    entry = table.entry(parent)
    key, names = entry["key"], StructType.fromJson(json.loads(entry["schema"])).names
    new = changes.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key))
    rows = table.read(parent).join(new, key)
    set_ = [c for c in names if c != key and c in changes.columns]
    differs = F.lit(False)
    for c in set_:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    rows = rows.where(differs)
    after = [F.col(f"_new_{c}").alias(c) if c in set_ else F.col(c) for c in names]
    whole = lambda columns: F.struct(*columns)
    folder = f"ledger/{uuid.uuid4().hex}"
    rows.select(F.col(key).alias("entity"), whole([F.col(c) for c in names]).alias("before"), whole(after).alias("after")).write.parquet(f"{table.path}/{folder}")
    ledger = table.spark.read.parquet(f"{table.path}/{folder}")
    changed = ledger.count()
    version = table.put(parent, ledger.select("after.*"), note=note | {"ledger": folder, "changed": changed})
    return {"ok": True, "idempotent": False, "version": version, "changed": changed}


def ledger(table: VersionedTable, version: int | None = None) -> DataFrame:
    """(version, entity, before, after, inverse, status) of one execution or all: rows as JSON; the inverse is the row
    before. An execution that a later version has undone is rolled_back."""
    history = table.history()
    undone = {n["undoes"] for n in history if "undoes" in n}
    out = None
    for n in history:
        if "ledger" in n and version in (None, n["version"]):
            rows = table.spark.read.parquet(f"{table.path}/{n['ledger']}").select(
                F.lit(n["version"]).alias("version"), "entity", F.to_json("before").alias("before"), F.to_json("after").alias("after"),
                F.to_json("before").alias("inverse"), F.lit("rolled_back" if n["version"] in undone else "applied").alias("status"),
            )
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else table.spark.createDataFrame([], "version int, entity string, before string, after string, inverse string, status string")


def rollback(table: VersionedTable, version: int) -> dict:
    """Undoes one execution by its inverses, in a new version; what other versions changed stays. Refused if it has no
    ledger (no_execution_record) or one of its rows has changed since (plan_drift); once undone it stays so."""
    history = table.history()
    note = history[version] if 0 <= version < len(history) else {}
    if "ledger" not in note:
        return {"ok": False, "error": "no_execution_record"}
    done = next((n for n in history if n.get("undoes") == version), None)
    if done:
        return {"ok": True, "idempotent": True, "version": done["version"], "changed": done["changed"]}
    parent, rows = table.version, table.spark.read.parquet(f"{table.path}/{note['ledger']}")
    left = rows.select("after.*").select(*sorted(rows.select("after.*").columns))
    key = table.entry(parent)["key"]
    now = table.read(parent).join(left.select(key), key, "left_semi").select(*left.columns)
    if _digest(left) != _digest(now):
        return {"ok": False, "error": "plan_drift", "version": parent}
    try:
        return _commit(table, parent, rows.select("before.*"), {"action": "rollback", "undoes": version})
    except Conflict:
        return {"ok": False, "error": "plan_drift", "version": table.version}


#: What an approved decision's action makes of its target's status: fixed values.
STATUS_OF = {"archive_duplicate": "archived", "archive": "archived", "archive_and_merge_duplicate": "archived", "mark_contradicted": "contradicted", "supersede": "superseded"}


def batch_outcomes(decisions: DataFrame, asked: DataFrame, approval: str = "human_accept") -> DataFrame:
    """(id, outcome) of the decisions asked for (id): missing; invalid_state, from which none may be applied;
    already_applied; skipped, where the mutation policy leaves one of its requests queued or rejected; or apply."""
    state = F.col("review_status")
    policy = F.array_distinct(F.transform(_request_kinds(F.col("action")), lambda a: governance.mutation_policy(a, F.col("risk_level"), F.col("confidence"), approval)))
    outcome = (
        F.when(state.isNull(), "missing").when(state == "applied", "already_applied")
        .when(~state.isin("auto_approved", "needs_review"), "invalid_state")
        .when(F.arrays_overlap(policy, F.array(F.lit("queued"), F.lit("rejected"))), "skipped").otherwise("apply")
    )
    return asked.select("id").distinct().join(decisions, "id", "left").withColumn("outcome", outcome)


def _request_kinds(action: Column) -> Column:
    one = lambda *names: F.array(*(F.lit(n) for n in names))
    return (
        F.when(action.isin("archive_duplicate", "archive"), one("memory_archive"))
        .when(action == "archive_and_merge_duplicate", one("memory_update", "memory_archive"))
        .when(action == "mark_contradicted", one("memory_status_update"))
        .when(action == "supersede", one("memory_supersede", "memory_link_insert"))
        .when(action.isin("promote", "downgrade"), one("memory_importance_update"))
        .otherwise(F.array().cast("array<string>"))
    )


def apply_batch(memories: VersionedTable, decisions: VersionedTable, asked: DataFrame, approval: str = "human_accept") -> dict:
    """Applies a batch of decisions (id) as one version of ``memories`` and one of ``decisions``.

    One that is missing or in a state it can't be applied from fails the whole batch before anything is written.
    Those that the policy blocks are skipped, those applied before are left. Targets are the second id of a decision (the
    first for mark_contradicted). If the run dies between the two commits, the same batch finishes it: the token of the
    first is found in the history, and the decisions' states follow.
    """
    judged = batch_outcomes(decisions.read(), asked, approval).persist()
    try:
        counts = {r.outcome: r["count"] for r in judged.groupBy("outcome").count().collect()}
        bad = [k for k in ("missing", "invalid_state") if counts.get(k)]
        if bad:
            return {"ok": False, "error": bad[0], "count": counts[bad[0]]}
        out = {"ok": True, "applied_count": counts.get("apply", 0), "skipped_count": counts.get("skipped", 0), "already_applied": counts.get("already_applied", 0)}
        chosen = judged.where("outcome = 'apply'")
        if not out["applied_count"]:
            return out | {"skipped_run": True}
        token = hashlib.sha256(f"batch|{_digest(chosen.select('id', 'action'))}".encode()).hexdigest()
        if not any(n.get("token") == token for n in memories.history()):
            status = F.coalesce(*(F.when(F.col("action") == a, s) for a, s in STATUS_OF.items()))
            target = F.when(F.col("action") == "mark_contradicted", F.col("first_id")).otherwise(F.col("second_id"))
            wanted = chosen.select(target.alias("id"), status.alias("status"), F.col("id").alias("of")).where("status is not null")
            changes = wanted.groupBy("id").agg(F.max_by("status", "of").alias("status"))
            out |= {"changed": _commit(memories, memories.version, changes, {"action": "batch_apply", "token": token})["changed"]}
        applied = chosen.select("id", F.lit("applied").alias("review_status"))
        return out | {"version": _commit(decisions, decisions.version, applied, {"action": "batch_apply", "token": token})["version"]}
    finally:
        judged.unpersist()
