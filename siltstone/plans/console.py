"""Queries of what a console shows and does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scores import instant
from siltstone.model import AS_OF
from siltstone.operators import console, curation, metrics, search
from siltstone.plans.curation import plan_sql
from siltstone.plans.graph import ALIASES, APP
from siltstone.plans.registry import query
from siltstone.plans.search import ENTITIES
from siltstone.sources.views import view


@query("""SELECT id::VARCHAR AS id, title, content, type, tags, substr(CAST(updated_at AS VARCHAR), 1, 10) AS updated_at,
  nullif(project_path, '') AS project_path FROM memories""")
def agent_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.agent_view(view(spark, sf_dir, "memories"))


@query("""WITH h AS (SELECT vec_id * 2 AS id, label / 7.0 AS score FROM embeddings)
SELECT h.id::VARCHAR AS id, round(score, 4) AS score, coalesce(content, '') AS text, coalesce(type, 'episodic_memory') AS type,
  coalesce(tags, []) AS tags, nullif(project_path, '') AS project_path FROM h LEFT JOIN memories m ON m.id = h.id""")
def vector_hit_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector stands for a hit, on the record of twice its number, which some lack."""
    hits = view(spark, sf_dir, "embeddings").selectExpr("vec_id * 2 AS id", "label / 7.0D AS score")
    return console.vector_hits(hits, view(spark, sf_dir, "memories"))


@query(f"""WITH {ENTITIES} SELECT e.id::VARCHAR AS memory_id, entity, normalized_entity, entity_type, weight,
  round(0.12 + least(weight, 1.0) * 0.18, 3) AS boost, title, content_length, seen FROM entity_rows e
  JOIN (SELECT id, title, length(content) AS content_length, substr(CAST(updated_at AS VARCHAR), 1, 10) AS seen FROM memories) USING (id)""")
def entity_hit_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    hits = search.entity_index(memories).withColumn("boost", search.entity_boost(F.col("weight")))
    found = console.entity_hits(hits, memories)
    return found.select(
        "memory_id", "entity", "normalized_entity", "entity_type", "weight", "boost", F.col("memory.title").alias("title"),
        F.length("memory.content").alias("content_length"), F.col("memory.updated_at").alias("seen"),
    )


@query(f"SELECT id, title, status AS state, source_agent AS app_id, {APP} AS app_name, tags AS categories FROM memories")
def ui_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return console.items(view(spark, sf_dir, "memories"), ALIASES)


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN [] ELSE [first_id, second_id] END AS source_ids,
  CASE WHEN id % 5 > 0 THEN confidence END AS confidence FROM decisions""")
def decoded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists and objects of decisions as JSON texts, some of them missing or broken."""
    rows = view(spark, sf_dir, "decisions").select(
        "id",
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.to_json(F.array("first_id", "second_id"))).alias("source_ids_json"),
        F.when(F.col("id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("confidence"))).alias("finding_json"),
    )
    read = console.decoded(rows, {"source_ids": "array<bigint>", "finding": "struct<confidence: double>"})
    return read.select("id", "source_ids", F.col("finding.confidence").alias("confidence"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS trace, [l_orderkey, l_orderkey * 3, l_orderkey + 1, l_orderkey * 2, 5, 6] AS ids FROM lineitem),
e AS (SELECT trace, unnest(range(1, 6)) AS rank, ids FROM l)
SELECT trace, rank::INT AS rank, ids[rank] AS id, title, substr(content, 1, 200) AS snippet, importance FROM e JOIN memories ON memories.id = ids[rank]""")
def context_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order stands for a pack that used six records, of which the trace shows five."""
    packs = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace")).distinct()
    packs = packs.selectExpr("trace", "array(trace, trace * 3, trace + 1, trace * 2, 5L, 6L) AS ids")
    return console.listed(packs, "trace", "ids", view(spark, sf_dir, "memories"), 5, 200).drop("tags")


@query("""WITH p AS (SELECT source_id AS attribute, [source_id, source_id + 9] AS ids FROM profile), e AS (SELECT attribute, unnest([1, 2]) AS rank, ids FROM p)
SELECT attribute, rank, ids[rank] AS id, title, CASE WHEN length(content) > 160 THEN substr(content, 1, 160) || '…' ELSE content END AS snippet
FROM e JOIN memories ON memories.id = ids[rank]""")
def profile_source_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = view(spark, sf_dir, "profile").selectExpr("source_id AS attribute", "array(source_id, source_id + 9) AS ids")
    return console.listed(lists, "attribute", "ids", view(spark, sf_dir, "memories"), 5, 160, "…").drop("importance", "tags")


PRESENCE = """p AS (SELECT CASE agent_id % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'hermes' WHEN 2 THEN 'codex' ELSE 'other' END AS app, min(status) AS status
  FROM agents GROUP BY 1),
a AS (SELECT {app} AS app, count(*) FILTER (status = 'active') AS created, count(last_accessed_at) AS accessed, max(last_accessed_at) AS last_at
  FROM memories GROUP BY 1),
s AS (SELECT a.*, coalesce(p.status, 'unknown') AS status FROM a LEFT JOIN p USING (app))""".format(app=APP)


def _apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = view(spark, sf_dir, "agents").select(
        F.expr("CASE agent_id % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'hermes' WHEN 2 THEN 'codex' ELSE 'other' END").alias("app"), "status"
    )
    return console.app_status(metrics.app_details(view(spark, sf_dir, "memories"), ALIASES), presence)


def _sorted(sort: str, descending: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = console.app_page(_apps(spark, sf_dir), sort, descending, 3)
        return page.select("app", "created", "accessed", "status")

    run.__name__ = f"apps_by_{sort}"
    return run


for _sort, _by, _down in (
    ("name", "lower(app)", False), ("display_name", "lower(app)", True), ("memories", "created", True), ("memories_accessed", "accessed", False),
    ("last_activity", "coalesce(CAST(last_at AS VARCHAR), '')", True), ("status", "status", False),
):
    query(f"WITH {PRESENCE} SELECT app, created, accessed, status FROM s ORDER BY {_by} {'DESC' if _down else 'ASC'}, app LIMIT 3")(_sorted(_sort, _down))


@query(f"""SELECT id, CASE WHEN status = 'active' AND {APP} = 'claude' THEN 'archived' ELSE status END AS status,
  CAST(CASE WHEN status = 'active' AND {APP} = 'claude' THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS VARCHAR) AS updated_at FROM memories""")
def app_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = console.app_archived(view(spark, sf_dir, "memories"), "claude", ALIASES, instant(AS_OF))
    return found.select("id", "status", F.col("updated_at").cast("string").alias("updated_at"))


@query("""WITH c AS (SELECT user_id AS agent_id, arg_max(event_type, (ts, event_id)) AS new_status FROM events GROUP BY user_id)
SELECT coalesce(agents.agent_id, c.agent_id) AS agent_id, coalesce(new_status, status) AS status,
  CASE WHEN c.agent_id IS NULL THEN 'old' ELSE 'new' END AS name, CASE WHEN agents.agent_id IS NULL THEN NULL ELSE nation::VARCHAR END AS nation
FROM agents FULL JOIN c ON c.agent_id = agents.agent_id""")
def app_metadata_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, "agents").select(
        "agent_id", "status", F.col("last_seen_at").alias("seen_at"), F.create_map(F.lit("name"), F.lit("old"), F.lit("nation"), F.col("nation").cast("string")).alias("metadata")
    )
    events = view(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("e"))
    new = last.select(F.col("user_id").alias("agent_id"), F.col("e.event_type").alias("status"), F.col("e.ts").alias("seen_at"), F.create_map(F.lit("name"), F.lit("new")).alias("metadata"))
    found = console.presence_upserted(old, new)
    return found.select("agent_id", "status", F.col("metadata")["name"].alias("name"), F.try_element_at("metadata", F.lit("nation")).alias("nation"))


@query(f"""WITH {plan_sql()} SELECT 'records' AS section, status AS name, count(*) AS n FROM memories GROUP BY status
UNION ALL SELECT 'plan', action, count(*) FROM plan GROUP BY action
UNION ALL SELECT 'open', decision_type, count(*) FROM decisions WHERE review_status IN ('auto_approved', 'needs_review') GROUP BY decision_type
UNION ALL SELECT * FROM (SELECT 'job', review_status, 1 FROM decisions ORDER BY created_at DESC, id DESC LIMIT 1)""")
def curator_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories, decisions = view(spark, sf_dir, "memories"), view(spark, sf_dir, "decisions")
    jobs = decisions.select("id", "created_at", F.col("review_status").alias("status"))
    return console.curator_status(memories, curation.action_plan(memories, AS_OF), decisions, jobs)


@query("""SELECT max(url) AS latest_report, round(arg_max(length(html), url) / 1024, 1) AS latest_report_size_kb, count(*) AS total_reports,
  round(sum(length(html)) / 1024 / 1024, 1) AS total_reports_size_mb, (SELECT count(*) FROM memories WHERE source = 'atomizer') AS memories_produced FROM pages""")
def curator_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for report files."""
    files = view(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.length("html").alias("length"))
    return console.output_metrics(view(spark, sf_dir, "memories"), files, "atomizer")


@query("""SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS expired, count(*) FILTER (value > 489) AS cleaned,
  count(*) FILTER (event_type = 'purchase') > 0 OR count(*) FILTER (value > 489) > 0 AS changed FROM events GROUP BY day""")
def periodic_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("expired"), F.count_if(F.col("value") > 489).alias("cleaned")
    )
    return console.digest(days, "expired", "cleaned")


@query("""SELECT id, decision_type, translate(to_base64(encode('{"offset":75}')), '+/', '-_') AS next_cursor FROM decisions
ORDER BY created_at DESC, id LIMIT 25 OFFSET 50""")
def decision_cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = view(spark, sf_dir, "decisions")
    page = console.cursor_page(decisions, [F.desc("created_at"), F.col("id")], 50, 25)
    return page.select("id", "decision_type", "next_cursor")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'soon'
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+08:00' END AS iso FROM events""")
def systemd_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.expr("""CASE event_id % 4 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") WHEN 1 THEN 'soon'
        WHEN 2 THEN concat('Wed ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' CST') ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END""")
    return view(spark, sf_dir, "events").select("event_id", console.systemd_time(written).alias("iso"))


@query("""WITH p AS (SELECT conv_id * 1000 + turn AS message_id, string_agg(trim(part), chr(10) ORDER BY place) AS text FROM (
    SELECT conv_id, turn, unnest(range(1, len(string_split(text, '. ')) + 1)) AS place, string_split(text, '. ') AS parts, parts[place] AS part FROM conversations)
  WHERE part IS NOT NULL AND trim(part) <> '' GROUP BY 1)
SELECT conv_id AS session, conv_id * 1000 + turn AS message_id, role, coalesce(p.text, '') AS text FROM conversations c
  LEFT JOIN p ON p.message_id = c.conv_id * 1000 + c.turn""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all turns as parts of messages."""
    turns = view(spark, sf_dir, "conversations").withColumn("message_id", F.expr("conv_id * 1000 + turn"))
    parts = turns.select("message_id", F.posexplode(F.split("text", r"\. ")).alias("place", "text"), F.lit("text").alias("type"))
    return console.transcripts(turns.withColumnRenamed("conv_id", "session"), parts)


@query("""SELECT i AS id, CASE WHEN review_status IN ('auto_approved', 'needs_review') THEN 'rejected' ELSE review_status END AS review_status,
  CASE WHEN review_status IS NULL THEN 'decision not found' WHEN review_status NOT IN ('auto_approved', 'needs_review')
    THEN 'decision cannot be rejected from status ' || review_status END AS error
FROM (SELECT DISTINCT l_orderkey + 1 AS i FROM lineitem) LEFT JOIN decisions ON decisions.id = i""")
def rejected_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("id"))
    return console.rejected(view(spark, sf_dir, "decisions"), asked)


@query("""WITH x AS (SELECT id, first_id % 40 AS run, CASE WHEN id % 9 > 0 THEN second_id END AS d,
    CASE WHEN id % 3 = 0 THEN 'manual' ELSE 'auto_policy' END AS kind, CASE WHEN id % 6 = 1 THEN 'applying' ELSE 'planned' END AS status FROM decisions),
e AS (SELECT *, 'k' || (id % 4) AS k FROM x), q AS (SELECT run, d, kind, 'k' || (id % 5) AS k, min(id) AS id FROM x GROUP BY ALL),
known AS (SELECT run, coalesce(d::VARCHAR, '') AS dd, kind, k, min(id) AS same FROM e GROUP BY ALL),
busy AS (SELECT DISTINCT coalesce(d::VARCHAR, '') AS dd, true AS b FROM e WHERE status = 'applying')
SELECT q.run AS run_id, q.d AS decision_id, q.kind AS approval_kind, q.k AS idempotency_key,
  CASE WHEN same IS NOT NULL THEN same WHEN b IS NULL THEN q.id END AS execution_id,
  CASE WHEN same IS NOT NULL THEN 'reused' WHEN b THEN 'refused' ELSE 'planned' END AS outcome
FROM q LEFT JOIN known ON known.run = q.run AND known.dd = coalesce(q.d::VARCHAR, '') AND known.kind = q.kind AND known.k = q.k
  LEFT JOIN busy ON busy.dd = coalesce(q.d::VARCHAR, '')""")
def execution_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = view(spark, sf_dir, "decisions").selectExpr(
        "id", "first_id % 40 AS run_id", "CASE WHEN id % 9 > 0 THEN second_id END AS decision_id",
        "CASE WHEN id % 3 = 0 THEN 'manual' ELSE 'auto_policy' END AS approval_kind", "CASE WHEN id % 6 = 1 THEN 'applying' ELSE 'planned' END AS status",
    )
    there = x.withColumn("idempotency_key", F.expr("concat('k', id % 4)"))
    asked = x.withColumn("idempotency_key", F.expr("concat('k', id % 5)"))
    asked = asked.groupBy("run_id", "decision_id", "approval_kind", "idempotency_key").agg(F.min("id").alias("execution_id"))
    return console.created_executions(asked, there)


@query("""SELECT execution_id, seq, action_type AS mutation_type, entity_id, 'blocked' AS policy_reason, 'skipped' AS status,
  execution_id || ':' || seq || ':' || action_type || ':' || entity_id AS idempotency_key
FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY ledger.seq, action_type, entity_id) AS n FROM (SELECT * FROM ledger) ledger) WHERE status = 'skipped'""".replace(
    "SELECT execution_id, seq,", "SELECT execution_id, n::INT AS seq,").replace("|| seq ||", "|| n ||"))
def blocked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows that were skipped stand for requests that the policy blocked."""
    asked = view(spark, sf_dir, "ledger").select(
        "execution_id", F.col("seq").alias("nth"), "action_type", F.col("entity_id").alias("target_id"),
        F.when(F.col("status") == "skipped", "block").otherwise("allow").alias("policy_decision"), F.lit("blocked").alias("policy_reason"),
    )
    return console.blocked_log(asked)


@query("""SELECT task_type, used_count * 2 + 3 AS total_candidates, used_count, used_count + 3 AS filtered_count,
  round(used_count / (used_count * 2 + 3), 3) AS hit_rate, round((used_count + 3) / (used_count * 2 + 3), 3) AS filter_rate FROM quality WHERE used_count > 0""")
def quality_events_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = view(spark, sf_dir, "quality").selectExpr("task_type", "used_count * 2 + 3 AS total_candidates", "used_count")
    return console.quality_event(packs)
