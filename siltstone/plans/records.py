"""Records as lists, changes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import AS_OF
from siltstone.operators import metrics, records
from siltstone.operators.governance import numbered_page
from siltstone.plans.registry import query
from siltstone.plans.search import ENTITIES
from siltstone.sources.views import view

NOW = f"TIMESTAMP '{AS_OF}'"


@query("""WITH f AS (SELECT * FROM memories WHERE status IN ('active', 'stale') AND source_agent IN ('codex', 'gemini')
  AND list_contains(tags, 'en') AND (contains(lower(title), 'an') OR contains(lower(content), 'an')))
SELECT id, title, status, (SELECT count(*) FROM f) > 30 AS has_more FROM f ORDER BY updated_at DESC, id LIMIT 20 OFFSET 10""")
def record_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.listed(view(spark, sf_dir, "memories"), ("active", "stale"), ("codex", "gemini"), tag="en", text="an")
    page = numbered_page(found.select("id", "title", "status", "updated_at"), [F.desc("updated_at"), "id"], 10, 20)
    return page.drop("updated_at")


@query("SELECT type, source_agent, count(*) AS n FROM memories WHERE status IN ('active', 'candidate') AND type = 'decision' GROUP BY ALL")
def records_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.listed(view(spark, sf_dir, "memories"), ("active", "candidate"), kind="decision")
    return found.groupBy("type", "source_agent").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT * REPLACE (CASE WHEN id % 17 = 0 THEN ' ' ELSE title END AS title) FROM memories)
SELECT 'clean' AS action, id FROM m WHERE (trim(content) = '' OR trim(title) = '') AND status <> 'archived'
UNION ALL SELECT 'expire', id FROM m WHERE status IN ('superseded', 'contradicted') AND updated_at < {NOW} - INTERVAL '90' DAY
UNION ALL SELECT 'archive', id FROM m WHERE status = 'active' AND updated_at < {NOW} - INTERVAL '180' DAY AND importance < 0.45
UNION ALL SELECT 'archive_stale', id FROM m WHERE status = 'stale'
UNION ALL SELECT 'dedup', id FROM m WHERE status = 'active' AND trim(title) <> '' AND lower(trim(title)) IN
  (SELECT lower(trim(title)) FROM m WHERE status = 'active' GROUP BY 1 HAVING count(*) > 1)""")
def maintenance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "memories").withColumn("title", F.when(F.expr("id % 17 = 0"), " ").otherwise(F.col("title")))
    parts = [
        records.maintenance_candidates(m, a, AS_OF).select(F.lit(a).alias("action"), "id")
        for a in ("clean", "expire", "archive", "archive_stale", "dedup")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("""SELECT id, updated_at FROM memories WHERE status IN ('active', 'candidate') AND last_accessed_at IS NOT NULL
ORDER BY updated_at DESC, id LIMIT 50""")
def curation_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.curation_pool(view(spark, sf_dir, "memories"), 50, accessed=True).select("id", "updated_at")


@query(f"""SELECT least(count(*), 8) AS fallback FROM memories WHERE status = 'active' AND (valid_until IS NULL OR valid_until > {NOW})""")
def fallback_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.fallback_count(view(spark, sf_dir, "memories"), AS_OF)


@query("""SELECT id, type, created_at FROM memories WHERE type IN ('timeline_event', 'decision', 'feedback') AND status = 'active'
ORDER BY importance DESC, updated_at DESC, id LIMIT 20""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.timeline(view(spark, sf_dir, "memories")).select("id", "type", "created_at")


SIGNALS, EXPLICIT = ("street", "mail", "the", "license", "system"), ("license",)
PLAN = """p AS (SELECT id, list_filter(['street', 'mail', 'the', 'license', 'system'],
    lambda s: contains(lower(title || chr(10) || content), s)) AS signals
  FROM memories WHERE project_path = '' AND status NOT IN ('archived', 'superseded')),
plan AS (SELECT id, signals, list_contains(signals, 'license') OR len(signals) >= 2 AS sure FROM p WHERE len(signals) > 0)"""


@query(f"WITH {PLAN} SELECT id, array_to_string(signals, ',') AS signals, sure FROM plan")
def subject_backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = records.backfill_plan(view(spark, sf_dir, "memories"), SIGNALS, EXPLICIT)
    return plan.withColumn("signals", F.array_join("signals", ","))


@query(f"""WITH {PLAN}, s AS (SELECT id FROM plan WHERE sure)
SELECT id, CASE WHEN s.id IS NULL THEN project_path ELSE '/work/home' END AS project_path, CASE WHEN s.id IS NULL THEN scope ELSE 'project' END AS scope,
  array_to_string(CASE WHEN s.id IS NULL THEN tags ELSE list_append(tags, 'project:home') END, ',') AS tags
FROM memories LEFT JOIN s USING (id)""")
def subject_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "memories")
    out = records.backfilled(m, records.backfill_plan(m, SIGNALS, EXPLICIT), "/work/home", "project", "project:home")
    return out.select("id", "project_path", "scope", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH c AS (SELECT id, CASE id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'stale' ELSE 'active' END AS s FROM memories WHERE id % 6 < 2)
SELECT m.id, coalesce(own.s, CASE WHEN kind = 'atomic_fact' AND up.s <> 'active' THEN up.s END, status) AS status,
  CASE WHEN own.s IS NOT NULL OR (kind = 'atomic_fact' AND up.s <> 'active' AND up.s <> status) THEN {NOW} ELSE updated_at END AS updated_at
FROM memories m LEFT JOIN c own ON own.id = m.id LEFT JOIN c up ON up.id = m.parent_id""")
def status_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "memories")
    new = F.expr("CASE id % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'stale' ELSE 'active' END")
    out = records.with_status(m, m.where("id % 6 < 2").select("id", new.alias("new_status")), AS_OF)
    return out.select("id", "status", "updated_at")


@query("""WITH m AS (SELECT id, status, CASE WHEN id % 19 = 0 THEN id + 1 END AS by, CASE WHEN id % 7 = 0 THEN id - id % 5 END AS root FROM memories),
p AS (SELECT id AS old_id, id + id % 4 AS new_id FROM m)
SELECT old_id, new_id, error, CASE WHEN error IS NULL THEN coalesce(old_root, old_id) END AS root_id FROM (
  SELECT old_id, new_id, o.root AS old_root, CASE WHEN old_id = new_id THEN 'same record' WHEN n.id IS NULL THEN 'new record not found'
    WHEN o.status = 'archived' THEN 'old record is archived' WHEN o.by IS NOT NULL THEN 'old record already superseded'
    WHEN n.status = 'archived' THEN 'new record is archived' WHEN n.by IS NOT NULL THEN 'new record already superseded'
    WHEN coalesce(n.root, n.id) <> n.id AND n.root <> coalesce(o.root, old_id) THEN 'lineages differ' END AS error
  FROM p JOIN m o ON o.id = old_id LEFT JOIN m n ON n.id = new_id)""")
def supersession_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = view(spark, sf_dir, "memories").selectExpr(
        "id", "status", "CASE WHEN id % 19 = 0 THEN id + 1 END AS superseded_by", "CASE WHEN id % 7 = 0 THEN id - id % 5 END AS fact_lineage_root"
    )
    return records.supersession_errors(m, m.selectExpr("id AS old_id", "id + id % 4 AS new_id"))


def _any(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(title || ' ' || content), '{w}')" for w in words)


@query(f"""SELECT id, CASE WHEN type <> 'episodic_memory' THEN type {" ".join(f"WHEN {_any(w)} THEN '{t}'" for t, w in records.TYPE_WORDS)}
  ELSE 'episodic_memory' END AS type FROM memories""")
def auto_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memories").select("id", records.typed(F.col("type"), F.col("title"), F.col("content")).alias("type"))


@query("""WITH a(alias, project) AS (VALUES ('the', 'one'), ('a-b', 'two'), ('die', 'three'), ('la', 'four')),
t AS (SELECT id, title, list_filter(regexp_split_to_array(regexp_replace(trim(title), '^[\\[(<【〔（]+', ''), '[\\s:：_\\-—/\\])>】〕）]+'), lambda x: x <> '') AS w FROM memories)
SELECT id, title, coalesce(f.project, s.project) AS subject FROM t LEFT JOIN a f ON f.alias = lower(w[1])
LEFT JOIN a s ON s.alias = lower(w[1] || '-' || w[2])""")
def title_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("the", "one"), ("a-b", "two"), ("die", "three"), ("la", "four")], "alias string, project string")
    return records.with_subject(view(spark, sf_dir, "memories").select("id", "title"), aliases)


@query("""SELECT id, round(CASE WHEN length(content) = 0 THEN 0 ELSE length(regexp_replace(content, '[^一-鿿]', '', 'g')) / length(content) END, 6) AS share,
  CASE WHEN title = '' THEN '' WHEN length(title) <= 8 THEN '****' ELSE left(title, 3) || '****' || right(title, 4) END AS masked FROM memories""")
def shares_and_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.round(records.ideograph_share(F.col("content")), 6)
    return view(spark, sf_dir, "memories").select("id", share.alias("share"), records.masked(F.col("title")).alias("masked"))


@query(f"""SELECT id, '[时间: 创建=' || strftime(created_at, '%Y-%m-%d') || ', 更新=' || strftime(updated_at, '%Y-%m-%d') || ', 距今='
  || CAST(greatest(0, floor((epoch_us({NOW}) - epoch_us(updated_at)) / 86400000000))::BIGINT AS VARCHAR) || '天'
  || CASE WHEN last_accessed_at IS NULL THEN '' ELSE ', 最后访问=' || strftime(last_accessed_at, '%Y-%m-%d') END
  || CASE WHEN valid_until IS NULL THEN '' ELSE ', 有效期=未知~' || strftime(valid_until, '%Y-%m-%d') END || ']' AS tag FROM memories""")
def age_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memories").select("id", records.age_tag(AS_OF).alias("tag"))


USES = "user_id AS id, CASE WHEN event_id % 3 = 0 THEN 'injected' ELSE 'last_accessed' END AS kind, ts"


@query(f"""WITH u AS (SELECT {USES} FROM events), t AS (SELECT id, count(*) FILTER (kind = 'injected') AS n,
  max(ts) FILTER (kind = 'injected') AS i, max(ts) AS s FROM u GROUP BY id)
SELECT id, injected_count + coalesce(n, 0) AS injected_count, coalesce(i, last_injected_at) AS last_injected_at,
  coalesce(s, last_accessed_at) AS last_accessed_at FROM memories LEFT JOIN t USING (id)""")
def use_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = view(spark, sf_dir, "events").selectExpr(*USES.replace(", CASE", "|CASE").replace(", ts", "|ts").split("|"))
    out = records.used(view(spark, sf_dir, "memories"), uses)
    return out.select("id", "injected_count", "last_injected_at", "last_accessed_at")


@query("""SELECT id, sha256(title || chr(10) || content) AS hash FROM memories WHERE status IN ('active', 'candidate', 'stale')
  AND id NOT IN (SELECT vec_id FROM embeddings)""")
def vectors_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.lacking_vectors(view(spark, sf_dir, "memories"), view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 6 < 3) AS retryable, count(*) FILTER (event_id % 6 >= 3) AS exhausted FROM events")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.queue_depth(view(spark, sf_dir, "events").selectExpr("event_id % 6 AS retries"))


@query("""SELECT parent_id, array_to_string(list_sort(list(id)), ',') AS children, count(*) FILTER (kind = 'atomic_fact') AS facts
FROM memories WHERE parent_id IS NOT NULL GROUP BY parent_id""")
def parents_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.with_children(view(spark, sf_dir, "memories"))
    return found.withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("""WITH s AS (SELECT id, unnest([first_id, second_id]) AS memory_id, unnest([0, 1]) AS place FROM decisions)
SELECT s.id, array_to_string(list(memory_id || ':' || status ORDER BY place), ',') AS sources FROM s JOIN memories m ON m.id = memory_id GROUP BY s.id""")
def decision_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "decisions").select("id", F.array("first_id", "second_id").alias("source_ids"))
    told = F.transform("sources", lambda s: F.concat_ws(":", s["memory_id"].cast("string"), s["status"]))
    return records.sources_of(d, view(spark, sf_dir, "memories")).select("id", F.array_join(told, ",").alias("sources"))


@query("""SELECT id FROM memories WHERE type = 'user_profile' AND status = 'active'
  AND id NOT IN (SELECT source_id FROM profile WHERE confidence >= 0.5)""")
def unseen_profile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = view(spark, sf_dir, "profile").where("confidence >= 0.5").select(F.array("source_id").alias("sources"))
    return records.unseen_sources(view(spark, sf_dir, "memories"), seen).select("id")


@query("""WITH x AS (SELECT (SELECT max(created_at) FROM memories WHERE type = 'user_profile' AND status = 'active') AS m, (SELECT max(updated_at) FROM profile) AS a)
SELECT round((epoch_us(m) - epoch_us(a)) / 86400000000, 6) AS lag, coalesce((epoch_us(m) - epoch_us(a)) / 86400000000 >= 7, false) AS behind FROM x""")
def profile_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.profile_lag(view(spark, sf_dir, "memories"), view(spark, sf_dir, "profile")).withColumn("lag", F.round("lag", 6))


@query("""SELECT DISTINCT user_id, unnest(list_filter(regexp_extract_all(value, '[a-z0-9_][a-z0-9_.+/-]*'), lambda t: length(t) >= 2)) AS word
FROM profile WHERE attribute IN ('building', 'machinery') AND confidence >= 0.6""")
def profile_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.feature_words(view(spark, sf_dir, "profile"), ("building", "machinery"))


WORDS = ("the", "und", "en", "mail", "que")


@query(f"""SELECT id, round(least(1.0, ({" + ".join(f"contains(lower(content), '{w}')::INT" for w in WORDS)}) / 3.0::DOUBLE), 6) AS overlap FROM memories""")
def profile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memories").select("id", F.round(records.overlap(F.col("content"), list(WORDS)), 6).alias("overlap"))


@query("""WITH p AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN 'help ' || left(text, 5) ELSE left(text, conv_id % 9) END) AS said,
  CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'gemini' END AS agent FROM conversations)
SELECT conv_id, turn, length(said) < 4 OR (agent = 'codex' AND length(said) < 20
  AND regexp_matches(said, '^(现在)?(todo|待办|有什么|还有啥|剩下什么|help|帮助|你好|hi|hello)\\b', 'i')) AS skipped FROM p""")
def generic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE WHEN turn % 3 = 0 THEN concat('help ', left(text, 5)) ELSE left(text, conv_id % 9) END")
    agent = F.expr("CASE WHEN conv_id % 2 = 0 THEN 'codex' ELSE 'gemini' END")
    return view(spark, sf_dir, "conversations").select("conv_id", "turn", records.is_generic(agent, said).alias("skipped"))


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND ts < TIMESTAMP '2024-01-20'")
def handoffs_by_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.by_json(view(spark, sf_dir, "events"), "props", {"k": "7"})
    return found.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("event_id", "user_id")


@query("SELECT event_id, created_at, score FROM feedback WHERE event_type = 'click' ORDER BY created_at DESC, event_id DESC LIMIT 50")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.audit_page(view(spark, sf_dir, "feedback"), event_type="click").select("event_id", "created_at", "score")


@query("""WITH l AS (SELECT action_type, status, CASE WHEN seq > 4 THEN before_status END AS b, CASE after_status WHEN 'A' THEN 'archived' WHEN 'R' THEN 'contradicted' ELSE 'active' END AS a FROM ledger)
SELECT count(*) FILTER (action_type = 'memory_archive' AND b IS DISTINCT FROM 'archived' AND a = 'archived') AS archived,
  count(*) FILTER (action_type = 'memory_status_update' AND a = 'contradicted') AS contradicted,
  count(*) FILTER (action_type = 'memory_importance_update') AS importance_updated, count(*) FILTER (action_type = 'memory_insert') AS children_created,
  count(*) FILTER (action_type = 'memory_link_insert' AND b IS NULL) AS links_created,
  count(*) FILTER (action_type = 'memory_link_insert' AND b IS NOT NULL) AS links_skipped FROM l WHERE status = 'applied'""")
def apply_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = view(spark, sf_dir, "ledger").selectExpr(
        "action_type", "status", "CASE WHEN seq > 4 THEN before_status END AS before_status",
        "CASE after_status WHEN 'A' THEN 'archived' WHEN 'R' THEN 'contradicted' ELSE 'active' END AS after_status",
    )
    return records.apply_counts(ledger)


@query(f"""WITH {ENTITIES.replace("FROM memories", "FROM told")}, own AS (SELECT id, normalized_entity, weight FROM entity_rows),
homes AS (SELECT id, CASE WHEN project_path = '/work/src1' THEN 'src1' WHEN starts_with(project_path, '/work/') THEN 'work rest' END AS normalized_entity
  FROM memories WHERE status = 'active' AND starts_with(project_path, '/work/'))
SELECT * FROM own UNION ALL SELECT id, normalized_entity, 1.0 FROM homes WHERE (id, normalized_entity) NOT IN (SELECT (id, normalized_entity) FROM own)""".replace(
    "WITH ", "WITH told AS (SELECT * REPLACE (title || chr(10) || content || CASE WHEN parent_id IS NULL THEN '' ELSE chr(10) || parent_id END AS content) FROM memories WHERE status = 'active'), ", 1))
def entity_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = spark.createDataFrame([("src1", "/work/src1", 1), ("work rest", "/work", 2)], "name string, root string, place int")
    return records.synced_entities(view(spark, sf_dir, "memories"), projects)


@query("""WITH a AS (SELECT *, CASE source_agent WHEN 'claude-code' THEN 'assistant' WHEN 'hermes-cli' THEN 'assistant' ELSE source_agent END AS app FROM memories)
SELECT app, count(*) FILTER (status = 'active') AS created, count(*) FILTER (last_accessed_at IS NOT NULL) AS accessed,
  min(last_accessed_at) AS first_at, max(last_accessed_at) AS last_at FROM a GROUP BY app""")
def app_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.app_details(view(spark, sf_dir, "memories"), {"claude-code": "assistant", "hermes-cli": "assistant"})


@query("""SELECT type, status, source_agent, count(*) AS n, round(avg(importance), 6) AS avg_importance FROM memories
GROUP BY GROUPING SETS ((type), (status), (source_agent), ())""")
def stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_stats(view(spark, sf_dir, "memories"))
