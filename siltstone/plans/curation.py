"""Curation and maintenance plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scores import days_before
from siltstone.model import AS_OF
from siltstone.operators import curation, hash_tree, maintenance
from siltstone.plans.registry import query, query_like
from siltstone.plans.search import vector_index
from siltstone.sources.persisted import persisted
from siltstone.sources.views import view

KEY = "substr(array_to_string(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), ' '), 1, 120)"


def ago(days: int) -> str:
    return f"TIMESTAMP '{AS_OF}' - INTERVAL '{days}' DAY"


PRECIOUS = "type IN ('user_profile', 'environment_fact', 'decision', 'project_memory', 'skill_candidate')"

#: Each rule over the memories view, in the order of the plan.
RULES = {
    "revival": f"status = 'stale' AND type <> 'episodic_memory' AND last_injected_at >= {ago(7)} AND effectiveness_score >= 0.5 AND feedback_score >= 0",
    "promote": "status = 'candidate' AND ((importance >= 0.75 AND feedback_score >= 0) OR injected_count >= 3)",
    "low_feedback": f"status IN ('active', 'candidate') AND feedback_score < -1 AND NOT {PRECIOUS}",
    "precious_stale": f"status = 'active' AND {PRECIOUS} AND feedback_score < -2 AND importance < 0.3 AND decay_policy <> 'stable'",
    "episodic_stale": f"type = 'episodic_memory' AND status = 'active' AND updated_at < {ago(14)} AND importance < 0.65",
    "stale": f"status = 'active' AND NOT {PRECIOUS} AND type <> 'episodic_memory' AND updated_at < {ago(365)} AND importance < 0.45 AND feedback_score <= -0.5 AND decay_policy <> 'stable'",
    "episodic_archive": f"type = 'episodic_memory' AND status = 'stale' AND updated_at < {ago(30)}",
    "archive": f"status = 'stale' AND type <> 'episodic_memory' AND updated_at < {ago(730)}",
    "dead": f"""status = 'candidate' AND ((type = 'episodic_memory' AND updated_at < {ago(7)} AND importance < 0.65)
      OR ({PRECIOUS} AND updated_at < {ago(30)} AND importance < 0.4 AND feedback_score < 0)
      OR (NOT {PRECIOUS} AND type <> 'episodic_memory' AND updated_at < {ago(7)} AND importance < 0.5))""",
    "never_accessed": f"status = 'candidate' AND last_accessed_at IS NULL AND injected_count = 0 AND updated_at < {ago(14)} AND NOT {PRECIOUS}",
    "unused": f"status = 'active' AND injected_count = 0 AND NOT {PRECIOUS} AND importance < 0.9 AND updated_at < {ago(30)} AND decay_policy <> 'stable'",
    "unused_fragment": f"status = 'active' AND injected_count = 0 AND source IN ('atomizer', 'governance_split') AND created_at < {ago(7)} AND decay_policy <> 'stable'",
    "contradicted": f"status = 'contradicted' AND (last_accessed_at IS NULL OR last_accessed_at < {ago(90)})",
    "auto_decay": f"status = 'active' AND decay_policy = 'review' AND (last_accessed_at IS NULL OR last_accessed_at < {ago(30)}) AND effectiveness_score < 0.3 AND importance < 0.5 AND injected_count > 0 AND confidence > 0.15",
    "skill_promotion": "type = 'skill_candidate' AND status IN ('active', 'candidate') AND importance >= 0.65 AND feedback_score >= 0",
    "evolution": "status IN ('active', 'candidate') AND (length(content) < 50 OR feedback_score < -1.5)",
}
FLAGS = ", ".join(f"coalesce(decay_policy <> 'freeze' AND ({v}), false) AS \"{k}\"" for k, v in RULES.items())


def plan_sql(allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> str:
    steps = [s for s in curation.PLAN if (not allow or s[1] in allow) and s[1] not in deny]
    whens = " ".join(f"WHEN {RULES[r]} THEN '{a}|{reason}|{s}'" for r, a, reason, s in steps)
    return f"""p AS (SELECT id, status AS old_status, parent_id, confidence, CASE WHEN decay_policy = 'freeze' THEN NULL {whens} END AS p FROM memories),
plan AS (SELECT id, split_part(p, '|', 1) AS action, split_part(p, '|', 2) AS reason, split_part(p, '|', 3) AS target_status, old_status
  FROM p WHERE p IS NOT NULL)"""


@query(f"SELECT id, {FLAGS} FROM memories")
def curator_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.candidates(view(spark, sf_dir, "memories"), AS_OF)


@query(f"WITH f AS (SELECT id, {FLAGS} FROM memories) SELECT count(*) AS scanned, "
       + ", ".join(f'count(*) FILTER ("{k}") AS "{k}"' for k in RULES) + " FROM f")
def curator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.summary(view(spark, sf_dir, "memories"), AS_OF)


@query(f"WITH {plan_sql()} SELECT * FROM plan")
def curator_action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.action_plan(view(spark, sf_dir, "memories"), AS_OF)


@query(f"WITH {plan_sql(('mark_stale', 'archive', 'promote'), ('promote',))} SELECT * FROM plan")
def curator_allow_deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    return curation.action_plan(memories, AS_OF, allow=("mark_stale", "archive", "promote"), deny=("promote",))


@query(f"""WITH {plan_sql()}, d AS (SELECT id, coalesce({RULES["auto_decay"]}, false) AND decay_policy <> 'freeze' AS decays FROM memories)
SELECT m.id, coalesce(CASE WHEN pp.target_status <> 'active' THEN pp.target_status END, mine.target_status, m.status) AS status,
  CASE WHEN decays THEN greatest(0.15, round(confidence - 0.05, 4)) ELSE confidence END AS confidence
FROM memories m JOIN d USING (id) LEFT JOIN plan mine ON mine.id = m.id LEFT JOIN plan pp ON pp.id = m.parent_id""")
def curator_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    return curation.applied(memories, curation.action_plan(memories, AS_OF), AS_OF)


@query(f"""SELECT {KEY} AS title_key, count(*) AS n, min(id) AS first_id FROM memories WHERE {KEY} <> ''
GROUP BY title_key HAVING count(*) > 1""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.duplicate_titles(view(spark, sf_dir, "memories"))


@query(f"""SELECT id AS old_id, new_id, review_required FROM (SELECT id,
  first_value(id) OVER (PARTITION BY {KEY}, type, scope, project_path ORDER BY updated_at DESC, id) AS new_id,
  {PRECIOUS} OR importance >= 0.7 AS review_required FROM memories WHERE status = 'active' AND {KEY} <> '') WHERE id <> new_id""")
def supersession_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.supersessions(view(spark, sf_dir, "memories"))


@query(f"""SELECT {KEY} AS title_key, count(*) FILTER (status = 'active') AS n_active,
  count(*) FILTER (status = 'contradicted') AS n_contradicted FROM memories WHERE {KEY} <> '' GROUP BY title_key
HAVING n_active > 0 AND n_contradicted > 0""")
def contradiction_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.contradictions(view(spark, sf_dir, "memories"))


@query(f"""WITH k AS (SELECT *, {KEY} AS title_key,
  CASE WHEN last_accessed_at IS NOT NULL THEN 64 ELSE 0 END + greatest(0, least(7, round_even(importance * 4, 0))) * 8
    + greatest(0, least(7, round_even(confidence * 4, 0))) AS s FROM memories WHERE status IN ('active', 'candidate')),
r AS (SELECT *, first_value(id) OVER (PARTITION BY title_key ORDER BY s DESC, created_at DESC, id) AS winner_id,
  count(*) OVER (PARTITION BY title_key) AS n FROM k WHERE length(title_key) >= 2)
SELECT title_key, winner_id, n, id AS loser_id FROM r WHERE id <> winner_id""")
def merge_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.merge_winners(view(spark, sf_dir, "memories"))


CLEAN = f"""SELECT id, reason FROM (SELECT id, concat_ws(',', CASE WHEN status = 'candidate' AND created_at < {ago(30)} THEN 'candidate_ttl' END,
  CASE WHEN source_agent = 'smoke-test' AND status NOT IN ('active', 'stale', 'contradicted', 'superseded') THEN 'source_agent:smoke-test' END,
  CASE WHEN status = 'candidate' AND length(trim(content)) < 5 THEN 'fragment' END,
  CASE WHEN status = 'archived' THEN 'archived_unused' END) AS reason FROM memories
  WHERE last_accessed_at IS NULL AND injected_count = 0 AND feedback_score = 0 AND importance < 0.9) WHERE reason <> ''"""


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.clean_plan(view(spark, sf_dir, "memories"), AS_OF, ("smoke-test",))


@query(CLEAN)
def clean_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)


UNTOUCHED = f"""SELECT id, 'archive_extension:' || status AS reason FROM memories WHERE status IN ('stale', 'superseded')
  AND (last_accessed_at IS NULL OR last_accessed_at < {ago(30)}) AND updated_at < {ago(30)}"""

ARCHIVE = f"""{plan_sql()}, k AS (SELECT id, status, {KEY} AS title_key FROM memories),
shared AS (SELECT title_key FROM k WHERE title_key <> '' GROUP BY title_key
  HAVING count(*) FILTER (status = 'active') > 0 AND count(*) FILTER (status = 'contradicted') > 0),
losers AS (SELECT id, 'archive_extension:contradiction_loser' AS reason FROM k WHERE status = 'contradicted' AND title_key IN (SELECT title_key FROM shared)),
winners AS (SELECT id FROM k WHERE status = 'active' AND title_key IN (SELECT title_key FROM shared)),
every AS (SELECT id, reason, 1 AS place FROM plan WHERE action = 'archive' UNION ALL SELECT id, reason, 2 FROM ({UNTOUCHED})
  UNION ALL SELECT id, reason, 0 FROM losers),
archive AS (SELECT id, arg_min(reason, place) AS reason, 'archived' AS target_status FROM every WHERE id NOT IN (SELECT id FROM winners) GROUP BY id
  UNION ALL SELECT id, 'contradiction_winner', 'active' FROM winners)"""


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    curated = curation.action_plan(memories, AS_OF).where("action = 'archive'")
    keys = curation.contradictions(memories).select("title_key")
    of_key = curation.keyed(memories.where("status in ('active', 'contradicted')")).join(keys, "title_key", "left_semi")
    losers = of_key.where("status = 'contradicted'").select("id", F.lit("archive_extension:contradiction_loser").alias("reason"))
    winners = of_key.where("status = 'active'").select("id")
    return maintenance.archive_plan(curated, maintenance.untouched(memories, AS_OF), losers, winners)


@query(f"WITH {ARCHIVE} SELECT * FROM archive")
def archive_extension_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(spark, sf_dir)


@query(f"""WITH {ARCHIVE}, n AS (SELECT reason, id, row_number() OVER (PARTITION BY reason ORDER BY id) AS nth FROM archive)
SELECT reason, count(*) AS n, list_sort(list(id) FILTER (nth <= 5)) AS sample FROM n GROUP BY reason""")
def plan_reason_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.reasons(_archived(spark, sf_dir))


@query(f"""WITH {ARCHIVE}, cut AS (SELECT target_status, substr(md5(id::VARCHAR), 1, 3) AS slice, count(*) AS n,
  sha256(string_agg(id::VARCHAR, '|' ORDER BY id::VARCHAR)) AS part FROM archive GROUP BY ALL),
told AS (SELECT string_agg(part, '|' ORDER BY slice) FILTER (target_status = 'archived') AS a,
  string_agg(part, '|' ORDER BY slice) FILTER (target_status = 'active') AS b, sum(n)::BIGINT AS n FROM cut)
SELECT substr(sha256('archive|' || coalesce(a, '__empty__') || '|active|' || coalesce(b, '__empty__')), 1, 24) AS plan_token, coalesce(n, 0) AS n FROM told""")
def plan_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.plan_token(_archived(spark, sf_dir))


@query(f"""WITH o AS (SELECT * FROM links), e AS (SELECT source_id AS id FROM links UNION SELECT target_id FROM links)
SELECT id FROM memories WHERE status IN ('active', 'candidate') AND id NOT IN (SELECT id FROM e)""")
def orphan_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "links")
    ends = links.select(F.col("source_id").alias("id")).unionByName(links.select(F.col("target_id").alias("id")))
    live = view(spark, sf_dir, "memories").where(F.col("status").isin("active", "candidate"))
    return live.select("id").join(ends.distinct(), "id", "left_anti")


PAIRS = """e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.label = b.label AND a.id <> b.id),
top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS nth FROM near WHERE score >= 0.25),
pairs AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(score), 6) AS score FROM top WHERE nth < 6 GROUP BY ALL)"""


#: The same over the whole table, as the store searches.
PAIRS_WHOLE = PAIRS.replace("a.label = b.label AND ", "")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), "embedding")
    return curation.similar_pairs(curation.units(vectors), 0.25)


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def similarity_pairs_in_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS_WHOLE} SELECT * FROM pairs")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the written index: a vector visits the cells that can hold one of its nearest."""
    return vector_index(spark, sf_dir).pairs(0.25).withColumn("score", F.round("score", 6))


CANDIDATES = """r AS (SELECT DISTINCT memory_id AS id FROM feedback WHERE created_at >= TIMESTAMP '2024-01-29 00:00:00'),
l AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM links)
SELECT a, b, score FROM pairs WHERE score BETWEEN 0.25 AND 0.75 AND a NOT IN (SELECT id FROM r) AND b NOT IN (SELECT id FROM r)
  AND NOT EXISTS (SELECT 1 FROM l WHERE l.a = pairs.a AND l.b = pairs.b)"""


@query(f"WITH {PAIRS}, {CANDIDATES}")
def link_candidates_in_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, _pairs(spark, sf_dir))


@query(f"WITH {PAIRS_WHOLE}, {CANDIDATES}")
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, vector_index(spark, sf_dir).pairs(0.25))


def _candidates(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    reviews = view(spark, sf_dir, "feedback").select(F.col("memory_id").alias("id"), "created_at")
    pairs = curation.cooled_down(pairs, reviews, days_before(AS_OF, 3))
    links = view(spark, sf_dir, "links").select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    )
    some = pairs.where(F.round("score", 6).between(0.25, 0.75)).join(links, ["a", "b"], "left_anti")
    return some.withColumn("score", F.round("score", 6))


@query(f"""SELECT scope, source_agent, project_path, count(*) AS n, CAST(min(created_at) AS VARCHAR) AS oldest,
  CASE WHEN count(*) >= 30 THEN 'count' ELSE 'age' END AS trigger FROM memories
WHERE type = 'episodic_memory' AND status IN ('active', 'candidate') GROUP BY scope, source_agent, project_path
HAVING count(*) >= 30 OR (count(*) >= 3 AND min(created_at) <= {ago(1)})""")
def rollup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = curation.rollup_groups(view(spark, sf_dir, "memories"), AS_OF, aged=3)
    return groups.withColumn("oldest", F.col("oldest").cast("string"))


@query("""WITH r AS (SELECT id, status FROM memories WHERE id % 10 <> 9), i AS (SELECT vec_id AS id FROM embeddings)
SELECT coalesce(r.id, i.id) AS id, CASE WHEN r.status IS NULL THEN 'orphan' WHEN status IN ('active', 'candidate') THEN 'missing'
  ELSE 'inactive' END AS reason FROM r FULL JOIN i ON r.id = i.id
WHERE r.status IS NULL OR (status IN ('active', 'candidate') AND i.id IS NULL)
  OR (status NOT IN ('active', 'candidate') AND i.id IS NOT NULL)""")
def reconcile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows lack every tenth record, so that the index has orphans."""
    rows = view(spark, sf_dir, "memories").where("id % 10 <> 9")
    return maintenance.reconciled(rows, view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query_like("reconcile_index")
def reconcile_by_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by two trees of digests, of the live rows and of the index: only leaves that differ are read."""
    rows = view(spark, sf_dir, "memories").where("id % 10 <> 9").select("id", "status")
    index, depth = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), tree_depth(spark, sf_dir)
    live = F.when(F.col("status").isin("active", "candidate"), F.col("id"))
    left = tree_of(spark, "tree-live", f"{sf_dir}/documents.parquet", rows, live, depth)
    right = tree_of(spark, "tree-index", f"{sf_dir}/embeddings.parquet", index, F.col("id"), depth)
    return maintenance.reconciled(*hash_tree.differing_rows(left, right))


def tree_depth(spark: SparkSession, sf_dir: str) -> int:
    return hash_tree.depth_of(view(spark, sf_dir, "documents").count())


def tree_of(spark: SparkSession, name: str, path: str, rows: DataFrame, digest: Column, depth: int) -> hash_tree.HashTree:
    """A tree that is built once for a source file."""
    build = lambda p: hash_tree.HashTree.build(rows, p, "id", digest, depth)
    return hash_tree.HashTree(spark, persisted(spark, f"{name}-{depth}", [path], build))


@query("""WITH s AS (SELECT id, content, CASE WHEN id % 97 = 0 THEN 'gone' ELSE status END AS status FROM memories WHERE id % 89 <> 0
  UNION ALL SELECT -1 - id, content, status FROM memories WHERE id % 83 = 0)
SELECT coalesce(r.id, s.id) AS id, CASE WHEN s.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'extra' ELSE 'changed' END AS what
FROM memories r FULL JOIN s ON r.id = s.id
WHERE r.id IS NULL OR s.id IS NULL OR r.status IS DISTINCT FROM s.status OR r.content IS DISTINCT FROM s.content""")
def replica_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records and a replica that has lost, gained and changed some, compared by their trees."""
    rows = view(spark, sf_dir, "memories").select("id", "content", "status")
    moved = F.when(F.col("id") % 97 == 0, "gone").otherwise(F.col("status")).alias("status")
    replica = rows.where("id % 89 <> 0").select("id", "content", moved)
    replica = replica.unionByName(rows.where("id % 83 = 0").withColumn("id", -1 - F.col("id")))
    path, depth, whole = f"{sf_dir}/documents.parquet", tree_depth(spark, sf_dir), F.struct("id", "content", "status")
    trees = [tree_of(spark, n, path, df, whole, depth) for n, df in (("tree-records", rows), ("tree-replica", replica))]
    return hash_tree.drift(*trees, "id", ["content", "status"])


@query("""SELECT status, count(*) AS n, count(*) FILTER (created_at < TIMESTAMP '1996-01-01 00:00:00' AND status = 'applied') AS gone
FROM ledger GROUP BY status""")
def retention_archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, before = view(spark, sf_dir, "ledger"), F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")
    gone = maintenance.expired(ledger, "created_at", before, "status", ("applied",))
    kept = maintenance.retained(ledger, "created_at", before, "status", ("applied",))
    both = gone.select("status", F.lit(1).alias("gone")).unionByName(kept.select("status", F.lit(0).alias("gone")))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.sum("gone").cast("long").alias("gone"))
