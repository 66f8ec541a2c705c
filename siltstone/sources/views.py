"""The knowledge store's tables as views of the driver's tables.

Each view is one SELECT in the SQL that Spark and DuckDB share, so both sides of a comparison see the same rows. The
placeholders are the names that differ: {ts} is the type of a timestamp without zone, {list} builds an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.model import AS_OF, RELATIONS, TYPES

#: Roots that the views read.
TABLES = ("documents", "embeddings", "events", "orders", "lineitem", "customer", "supplier", "conversations", "pages", "benchmark", "part")


def _pick(number: str, values: tuple[str, ...]) -> str:
    """The value with the number's place; the last one for all larger numbers."""
    return f"split_part('{'|'.join(values)}', '|', CAST(least({number}, {len(values) - 1}) + 1 AS INT))"


def _ago(days: str, seconds: str = "0") -> str:
    return f"({{ts}} '{AS_OF}' - INTERVAL '1' SECOND * (86400 * ({days}) + {seconds}))"


def _share(number: str) -> str:
    """A number from 0 to 1 in hundredths."""
    return f"(CAST(({number}) % 101 AS DOUBLE) / 100)"


MEMORIES = f"""
SELECT doc_id AS id,
  {_pick("doc_id % 10", TYPES)} AS type,
  {_pick("doc_id % 7", ("active", "active", "active", "candidate", "stale", "archived", "contradicted"))} AS status,
  {_pick("doc_id % 3", ("global", "project", "team-a"))} AS scope,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('/work/', source) END AS project_path,
  substr(text, 1, 40) AS title, text AS content, {{list}}(lang, source) AS tags,
  CASE WHEN doc_id % 11 = 0 THEN 'atomizer' WHEN doc_id % 11 = 1 THEN 'governance_split' ELSE 'ingest' END AS source,
  {_pick("doc_id % 6", ("claude-code", "hermes-cli", "codex", "smoke-test", "frontend", "gemini"))} AS source_agent,
  CASE WHEN doc_id % 4 = 1 THEN 'atomic_fact' WHEN doc_id % 4 = 0 THEN 'parent_memory' ELSE 'plain' END AS kind,
  CASE WHEN doc_id % 4 = 1 THEN doc_id - 1 END AS parent_id,
  {_share("doc_id * 53")} AS confidence, {_share("doc_id * 37")} AS importance,
  CAST(doc_id * 17 % 41 - 20 AS DOUBLE) / 8 AS feedback_score, {_share("doc_id * 29")} AS effectiveness_score,
  {_pick("doc_id % 13", ("freeze", "stable", "review"))} AS decay_policy,
  CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 8 END AS injected_count, doc_id % 5 - doc_id % 5 % 2 AS ineffective_count,
  {_ago("doc_id % 400 + doc_id % 3 * 300", "doc_id * 7919 % 86400")} AS created_at,
  {_ago("doc_id % 400", "doc_id * 7919 % 86400")} AS updated_at,
  CASE WHEN doc_id % 3 > 0 THEN {_ago("doc_id % 120")} END AS last_accessed_at,
  CASE WHEN doc_id % 3 > 0 THEN {_ago("doc_id % 45")} END AS last_injected_at,
  CASE WHEN doc_id % 9 = 0 THEN {_ago("doc_id % 60 - 30")} END AS valid_until
FROM documents"""

LINKS = f"""
SELECT source_id, target_id, {_pick("source_id % 8", RELATIONS)} AS relation_type, {_share("source_id * 31")} AS weight,
  CASE WHEN source_id % 2 = 0 THEN concat('note ', source_id) END AS note
FROM (SELECT doc_id AS source_id, doc_id - doc_id % 2 - (doc_id - doc_id % 2) % 4 AS target_id FROM documents WHERE doc_id % 5 > 1
  UNION ALL SELECT doc_id, doc_id + 7 FROM documents WHERE doc_id % 4 = 0) edges
WHERE source_id <> target_id"""

FEEDBACK = """
SELECT event_id, user_id AS memory_id, CAST(CAST(floor(value) AS BIGINT) % 21 - 10 AS DOUBLE) AS score, ts AS created_at,
  event_type FROM events"""

QUALITY = f"""
SELECT event_id, ts AS created_at,
  {_pick("event_id % 4", ("feedback", "debugging", "implementation", "general"))} AS task_type,
  {_share("event_id * 7")} AS hit_rate, {_share("event_id * 11")} AS filter_rate,
  {_share("event_id * 13")} AS cross_rate, event_id % 12 AS used_count
FROM events"""

DECISIONS = f"""
SELECT o_orderkey AS id,
  {_pick("o_orderkey % 4", ("semantic_duplicate", "contradiction", "supersession", "importance"))} AS decision_type,
  {_pick("o_orderkey % 11", ("keep", "archive_duplicate", "archive_and_merge_duplicate", "mark_contradicted", "archive",
      "promote", "downgrade", "supersede", "split", "delete", "SELECT 1"))} AS action,
  {_pick("o_orderkey % 6", ("applied", "rolled_back", "needs_review", "rejected", "auto_approved", "applied"))} AS review_status,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'high' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'medium'
    ELSE 'low' END AS risk_level,
  {_share("o_orderkey * 13")} AS confidence, o_custkey AS first_id, o_custkey + o_orderkey % 3 AS second_id,
  o_orderdate AS created_at
FROM orders"""

LEDGER = f"""
SELECT l_orderkey AS execution_id, l_linenumber AS seq, l_partkey AS entity_id,
  {_pick("l_linenumber % 4", ("memory_status_update", "memory_importance_update", "memory_archive", "memory_link_insert"))} AS action_type,
  l_linestatus AS before_status, l_returnflag AS after_status, l_shipdate AS created_at,
  CASE WHEN l_linenumber % 5 = 0 THEN 'skipped' ELSE 'applied' END AS status
FROM lineitem"""

AGENTS = f"""
SELECT s_suppkey AS agent_id, s_nationkey AS nation, {_pick("s_suppkey % 4", ("online", "busy", "idle", "offline"))} AS status,
  CASE WHEN s_suppkey % 9 > 0 THEN {_ago("s_suppkey % 12", "s_suppkey * 977 % 86400")} END AS last_seen_at
FROM supplier"""

MESSAGES = """
SELECT event_id AS message_id, user_id % 7 AS sender, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS receiver,
  event_type AS kind, ts AS created_at,
  CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL '1' DAY * (event_id % 40) END AS expires_at
FROM events"""

PROFILE = f"""
SELECT c_custkey % 50 AS user_id, lower(c_mktsegment) AS attribute, lower(c_name) AS value,
  {_share("c_custkey * 19")} AS confidence, c_custkey % 8 = 0 AS immutable, c_custkey AS source_id,
  {_ago("c_custkey % 200")} AS updated_at
FROM customer"""

VIEWS = {
    "memories": MEMORIES,
    "links": LINKS,
    "feedback": FEEDBACK,
    "quality": QUALITY,
    "decisions": DECISIONS,
    "ledger": LEDGER,
    "agents": AGENTS,
    "messages": MESSAGES,
    "profile": PROFILE,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view, or the table itself where no view has the name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    query = VIEWS[name].format(ts="TIMESTAMP_NTZ", list="array")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"FROM {t}" in query}
    bound = {t: df for t, df in used.items()}
    for t in used:
        query = query.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(query, **bound)


def with_views(sql: str) -> str:
    """A DuckDB query that may name the views."""
    used = [n for n in VIEWS if n in sql]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].format(ts='TIMESTAMP', list='list_value')})" for n in used)
    sql = sql.strip()
    recursive = sql.upper().startswith("WITH RECURSIVE")
    rest = sql[len("WITH RECURSIVE") :] if recursive else sql[len("WITH") :] if sql.upper().startswith("WITH ") else None
    head = "WITH RECURSIVE" if recursive else "WITH"
    if not used:
        return sql
    return f"{head} {ctes}" + (f",{rest}" if rest is not None else f"\n{sql}")
