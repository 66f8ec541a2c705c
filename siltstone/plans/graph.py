"""The link graph, and statistics of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.model import AS_OF
from siltstone.operators import graph, metrics
from siltstone.plans.registry import query
from siltstone.sources.scratch import written
from siltstone.sources.views import view


@query("""SELECT coalesce(n.source_id, l.source_id) AS source_id, coalesce(n.target_id, l.target_id) AS target_id,
  coalesce(n.relation_type, l.relation_type) AS relation_type, coalesce(n.weight, l.weight) AS weight
FROM links l FULL JOIN (SELECT source_id, target_id + 1 - source_id % 2 AS target_id, relation_type, least(1, max(weight) * 2) AS weight
  FROM links GROUP BY ALL) n ON l.source_id = n.source_id AND l.target_id = n.target_id AND l.relation_type = n.relation_type""")
def links_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "links")
    new = links.selectExpr("source_id", "target_id + 1 - source_id % 2 AS target_id", "relation_type", "weight * 2 AS weight")
    return graph.with_links(links, new)


@query("""WITH i AS (SELECT id FROM memories WHERE importance > 0.9)
SELECT source_id AS id, target_id AS other, relation_type, weight, 'out' AS direction FROM links WHERE source_id IN (SELECT id FROM i)
UNION ALL SELECT target_id, source_id, relation_type, weight, 'in' FROM links WHERE target_id IN (SELECT id FROM i)""")
def link_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.around(view(spark, sf_dir, "links"), view(spark, sf_dir, "memories").where("importance > 0.9"))


@query("""WITH i AS (SELECT id FROM memories WHERE importance > 0.9)
SELECT DISTINCT i.id, m.id AS other, title, status FROM i JOIN links l ON l.source_id = i.id OR l.target_id = i.id
JOIN memories m ON m.id = CASE WHEN l.source_id = i.id THEN l.target_id ELSE l.source_id END""")
def related_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    return graph.related(view(spark, sf_dir, "links"), memories.where("importance > 0.9"), memories)


@query("""WITH a AS (SELECT DISTINCT source_id, target_id, relation_type, weight, mt.feedback_score AS fb FROM links
  JOIN memories ms ON ms.id = source_id JOIN memories mt ON mt.id = target_id
  WHERE (ms.importance > 0.5 OR mt.importance > 0.5) AND relation_type IN ('contradicts', 'supersedes', 'causes', 'failure_pattern')
    AND weight >= 0.4 AND ms.status = 'active' AND mt.status = 'active'
  ORDER BY weight DESC, source_id, target_id, relation_type LIMIT 10),
g AS (SELECT *, CASE WHEN relation_type IN ('contradicts', 'supersedes') AND (weight >= 0.7 OR fb < -0.5) THEN 'high' ELSE 'medium' END AS severity FROM a)
SELECT source_id, target_id, relation_type, weight, severity FROM g
ORDER BY severity <> 'high', weight DESC, source_id, target_id, relation_type LIMIT 5""")
def active_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    found = graph.warnings(view(spark, sf_dir, "links"), memories, memories.where("importance > 0.5"))
    return found.select("source_id", "target_id", "relation_type", "weight", "severity")


NODES = "n AS (SELECT id FROM memories ORDER BY importance DESC, updated_at DESC, id LIMIT 500)"


@query(f"""WITH {NODES} SELECT source_id, target_id, relation_type FROM links
WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n) AND relation_type NOT IN ('supports', 'part_of')""")
def induced_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph.nodes(view(spark, sf_dir, "memories"), 500)
    edges = graph.induced(view(spark, sf_dir, "links"), nodes, ("supports", "part_of"))
    return edges.select("source_id", "target_id", "relation_type")


@query("""SELECT id, substr(title, 1, 80) AS label, round(importance, 2) AS importance, type, status FROM memories
ORDER BY memories.importance DESC, updated_at DESC, id LIMIT 100""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(view(spark, sf_dir, "memories")).drop("text")


@query("""SELECT source_id, target_id, relation_type, ms.title AS source_title, mt.status AS target_status FROM links
LEFT JOIN memories ms ON ms.id = source_id LEFT JOIN memories mt ON mt.id = target_id""")
def links_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.with_ends(view(spark, sf_dir, "links"), view(spark, sf_dir, "memories"), "left")
    return found.select("source_id", "target_id", "relation_type", "source_title", "target_status")


@query("""WITH RECURSIVE up AS (SELECT doc_id AS id, doc_id - CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS parent FROM documents WHERE doc_id % 10 > 1),
walk(id, root, depth) AS (SELECT id, parent, 1 FROM up UNION ALL SELECT w.id, u.parent, depth + 1 FROM walk w JOIN up u ON u.id = w.root)
SELECT id, arg_max(root, depth) AS root, max(depth)::BIGINT AS depth FROM walk GROUP BY id
UNION ALL SELECT DISTINCT parent, parent, 0 FROM up WHERE parent NOT IN (SELECT id FROM up)""")
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = view(spark, sf_dir, "documents").where("doc_id % 10 > 1").selectExpr(
        "doc_id AS source_id", "doc_id - CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS target_id", "'supersedes' AS relation_type"
    )
    return graph.lineage_roots(chains, written)


@query("""SELECT 'type' AS facet, type AS value, count(*) AS n FROM memories GROUP BY type UNION ALL
SELECT 'status', status, count(*) FROM memories GROUP BY status UNION ALL SELECT 'source_agent', source_agent, count(*) FROM memories GROUP BY source_agent""")
def stats_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distributions(view(spark, sf_dir, "memories"))


@query("""SELECT count(*) AS n, round(avg(confidence), 6) AS avg_confidence, round(avg(importance), 6) AS avg_importance,
  round(avg(feedback_score), 6) AS avg_feedback, count(*) FILTER (last_accessed_at IS NULL) AS never_accessed,
  count(*) FILTER (last_accessed_at IS NULL AND status = 'active') AS active_never_accessed FROM memories""")
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(view(spark, sf_dir, "memories"))


@query("SELECT count(*) AS linked FROM (SELECT source_id FROM links UNION SELECT target_id FROM links)")
def linked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ends(view(spark, sf_dir, "links")).agg(F.count("*").alias("linked"))


RECALL = """count(*) AS n, count(*) FILTER (injected_count > 0) AS used, sum(injected_count)::BIGINT AS injections,
  round(count(*) FILTER (injected_count > 0) * 100.0::DOUBLE / count(*), 1) AS used_percent, round(avg(effectiveness_score), 3) AS avg_effectiveness"""


@query(f"SELECT {RECALL} FROM memories")
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(view(spark, sf_dir, "memories"))


@query(f"SELECT source_agent, {RECALL} FROM memories GROUP BY source_agent ORDER BY n DESC, source_agent LIMIT 10")
def recall_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(view(spark, sf_dir, "memories"), "source_agent").orderBy(F.desc("n"), "source_agent").limit(10)


POPULAR = """SELECT type, count(*) AS n, round(count(*) FILTER (injected_count > 0) / count(*), 6) AS recall_rate FROM memories
WHERE status IN ('active', 'candidate') GROUP BY type HAVING count(*) >= 3 AND recall_rate > 0 ORDER BY recall_rate DESC, n DESC, type LIMIT 3"""


@query(POPULAR)
def high_recall_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.high_recall_types(view(spark, sf_dir, "memories"))


@query(f"""WITH p AS ({POPULAR}) SELECT id, round(least(1, CASE WHEN importance >= 0.8 THEN 0.3 WHEN importance >= 0.6 THEN 0.1 ELSE 0 END
  + CASE WHEN parent_id IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN type IN (SELECT type FROM p) THEN 0.15 ELSE 0 END
  + CASE WHEN length(content) BETWEEN 50 AND 200 THEN 0.1 ELSE 0 END), 2)::DOUBLE AS seed FROM memories""")
def seed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    popular = metrics.high_recall_types(memories).select("type", F.lit(True).alias("popular"))
    joined = memories.join(F.broadcast(popular), "type", "left")
    args = (F.col("importance"), F.col("parent_id").isNotNull(), F.coalesce("popular", F.lit(False)), F.length("content"))
    return joined.select("id", metrics.seed_feedback(*args).alias("seed"))


@query("""WITH r AS (SELECT * FROM quality ORDER BY created_at DESC, event_id DESC LIMIT 500)
SELECT task_type, count(*) AS n, round(avg(hit_rate), 3) AS hit_rate, round(avg(filter_rate), 3) AS filter_rate,
  round(avg(cross_rate), 3) AS cross_rate, round(avg(used_count), 3) AS used_count FROM r GROUP BY task_type""")
def quality_by_task_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_by_task(view(spark, sf_dir, "quality"))


@query(f"""SELECT days, count(*) AS n, round(avg(hit_rate), 4) AS hit_rate, round(avg(cross_rate), 4) AS cross_rate
FROM quality, (VALUES (1), (7), (30)) d(days) WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL '1' DAY * days GROUP BY days""")
def quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_windows(view(spark, sf_dir, "quality"), AS_OF, (1, 7, 30))


@query("SELECT memory_id, count(*) AS n, round(avg(score), 6) AS feedback_score FROM feedback GROUP BY memory_id")
def feedback_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.feedback_mean(view(spark, sf_dir, "feedback"))


@query("""SELECT memory_id, round(list_reduce(list_prepend(0.5::DOUBLE, list(score * 0.05::DOUBLE ORDER BY event_id)),
  lambda x, d: greatest(0, least(1, x + d))), 4) AS effectiveness, count(*) FILTER (score < 0) AS ineffective FROM feedback GROUP BY memory_id""")
def feedback_effectiveness_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.effectiveness(view(spark, sf_dir, "feedback"))


@query("""WITH m AS (SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status IN ('stale', 'superseded', 'contradicted')) AS pend,
  count(*) FILTER (status = 'active' AND last_accessed_at IS NULL) AS never FROM memories),
d AS (SELECT count(*) FILTER (decision_type = 'contradiction') AS contra, count(*) FILTER (decision_type = 'semantic_duplicate') AS dup FROM decisions
  WHERE review_status IN ('needs_review', 'auto_approved') AND action <> 'keep'),
l AS (SELECT count(*) AS linked FROM (SELECT source_id FROM links UNION SELECT target_id FROM links)),
p AS (SELECT *, greatest(0, least(100, round_even(100 - (contra + dup) * 18 - least(dup, 100) * 0.28 - least(contra, 20) * 2, 0))) AS risk,
  least(100, round_even((active - never) / active * 100, 0)) AS reuse, least(100, round_even(linked / active * 100, 0)) AS coverage,
  least(100, round_even(pend / (active + pend) * 100, 0)) AS pending FROM m, d, l)
SELECT greatest(0, least(100, round_even((risk * 0.34 + (100 - pending) * 0.16 + coverage * 0.08 + reuse * 0.24 + 50 * 0.14) / 0.96, 0)))::DOUBLE AS quality,
  risk::DOUBLE AS risk, reuse, coverage, pending, linked, contra, dup FROM p""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = graph.ends(view(spark, sf_dir, "links"))
    return metrics.health(view(spark, sf_dir, "memories"), links, view(spark, sf_dir, "decisions"))


ALIASES = {"claude-code": "claude", "hermes-cli": "hermes", "frontend": "console"}
APP = "CASE source_agent WHEN 'claude-code' THEN 'claude' WHEN 'hermes-cli' THEN 'hermes' WHEN 'frontend' THEN 'console' ELSE source_agent END"


@query(f"""SELECT {APP} AS app, count(*) AS n, sum(injected_count)::BIGINT AS accesses, CAST(min(last_accessed_at) AS VARCHAR) AS first_at,
  CAST(max(last_accessed_at) AS VARCHAR) AS last_at FROM memories GROUP BY app""")
def apps_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.apps(view(spark, sf_dir, "memories"), ALIASES)
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_at", "last_at")})


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY tag")
def tag_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tag_counts(view(spark, sf_dir, "memories"))


@query("SELECT type, count(*) AS n FROM memories GROUP BY type")
def type_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memories").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, sum(length(l_orderkey::VARCHAR) + length(l_linenumber::VARCHAR) + length(l_returnflag))::BIGINT AS chars FROM lineitem")
def archive_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.table_size(view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query()
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(view(spark, sf_dir, "events"), "value", "event_type")
