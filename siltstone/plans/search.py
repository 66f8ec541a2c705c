"""Search and context packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.model import AS_OF
from siltstone.operators import retrieval, search
from siltstone.operators.entity_table import EntityTable
from siltstone.operators.trigram_index import TrigramIndex
from siltstone.operators.vector_index import VectorIndex
from siltstone.plans.registry import query, query_like
from siltstone.sources.persisted import persisted
from siltstone.sources.views import view

QUERY = "leaux enaux"
TASK = "implement leaux enaux the entand src3"
#: The vector that queries by vector start from.
SEED = 3

#: DuckDB macros of one expression each, as text to paste: the trigrams of a text, and their likeness.
TRIGRAMS = (
    "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), "
    "lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), "
    "lambda i: substring('  ' || w || ' ', i, 3)))))"
)


def similar(a: str, b: str) -> str:
    x, y = TRIGRAMS.format(a), TRIGRAMS.format(b)
    return f"coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0)"


COSINE = f"list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {SEED}))"


def seed_vector(spark: SparkSession, sf_dir: str, vec_id: int = SEED) -> list[float]:
    """A point lookup: the one vector that stands for the query's embedding."""
    found = view(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in found[0]]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(f"""SELECT id, title, round(rank_score, 6) AS rank_score FROM (
  SELECT *, {similar("title", f"'{QUERY}'")} * 0.4 + importance * 0.3 + effectiveness_score * 0.2 + feedback_score * 0.1
    AS rank_score FROM memories
  WHERE title ILIKE '%leaux%' OR content ILIKE '%leaux%' OR {similar("title", "'leaux'")} > 0.15
    OR title ILIKE '%enaux%' OR content ILIKE '%enaux%' OR {similar("title", "'enaux'")} > 0.15)
ORDER BY round(rank_score, 9) DESC, updated_at DESC, id LIMIT 20""")
def lexical_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked(view(spark, sf_dir, "memories"), QUERY)
    return found.select("id", "title", F.round("rank_score", 6).alias("rank_score"))


@query("""SELECT id, importance, CAST(updated_at AS VARCHAR) AS updated_at FROM memories
ORDER BY importance DESC, effectiveness_score DESC, feedback_score DESC, memories.updated_at DESC, id LIMIT 15""")
def search_without_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked(view(spark, sf_dir, "memories"), "", 15)
    return found.select("id", "importance", F.col("updated_at").cast("string").alias("updated_at"))


@query(f"""SELECT id, type, scope, project_path, status FROM memories
WHERE (valid_until IS NULL OR valid_until > TIMESTAMP '{AS_OF}')
  AND (scope = 'global' OR (scope = 'project' AND project_path IN ('/work/src3', '')))
  AND type IN ('decision', 'feedback', 'project_memory', 'episodic_memory')
  AND len(list_filter(tags, lambda t: lower(t) IN ('en', 'src3'))) > 0 AND status = 'active'
  AND created_at BETWEEN TIMESTAMP '2022-01-01 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")
def search_filters_scope_tags_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.filtered(
        view(spark, sf_dir, "memories"),
        AS_OF,
        types=["decision", "feedback", "project_memory", "episodic_memory"],
        tags=["EN", "src3"],
        status="active",
        scope="global",
        project="/work/src3",
        created=("2022-01-01 00:00:00", "2024-01-15 00:00:00"),
    )
    return found.select("id", "type", "scope", "project_path", "status")


#: The lexical relevance of a record to TASK, whose terms are implement, leaux, enaux, entand, src3, src and 3 (too short).
TERMS = text.query_terms(TASK)


def lexical_sql(task: str) -> str:
    terms = text.query_terms(task)
    hay = "(lower(title) || ' ' || lower(content) || ' ' || lower(array_to_string(tags, ' ')))"
    count = lambda parts, where: " + ".join(f"contains({where}, '{p}')::INT" for p in parts)
    matched = f"({count(terms, hay)})"
    pairs = [f"{a} {b}" for a, b in zip(terms, terms[1:])]
    return (
        f"least(1.0::DOUBLE, {matched}::DOUBLE / {len(terms)} * 0.55::DOUBLE + ({count(terms, 'lower(title)')})::DOUBLE / {len(terms)} * 0.2::DOUBLE"
        f" + CASE WHEN contains({hay}, '{task}') THEN 0.15::DOUBLE ELSE 0 END"
        f" + CASE WHEN contains({hay}, 'src 3') OR contains({hay}, 'src3') THEN 0.25::DOUBLE ELSE 0 END"
        f" + CASE WHEN {matched} >= 2 THEN ({count(pairs, hay)}) * 0.1::DOUBLE ELSE 0 END)"
    )


@query(f"""SELECT id, round(lexical, 6) AS lexical FROM (SELECT *, {lexical_sql(TASK)} AS lexical FROM memories)
WHERE lexical >= 0.08 AND ({" OR ".join(f"contains(lower(title) || ' ' || lower(content) || ' ' || lower(array_to_string(tags, ' ')), '{t}')" for t in search.search_terms(TASK))})
ORDER BY round(lexical, 9) DESC, id LIMIT 30""")
def keyword_relaxed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.relaxed(view(spark, sf_dir, "memories"), TASK)
    return found.select("id", F.round("lexical", 6).alias("lexical"))


@query(f"""SELECT vec_id AS id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.nearest(vectors(spark, sf_dir), seed_vector(spark, sf_dir), 10)
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id AS id, round({COSINE}, 6) AS score FROM embeddings WHERE label IN (1, 3, 5) AND {COSINE} >= 0.05
ORDER BY {COSINE} DESC, vec_id LIMIT 25""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = vectors(spark, sf_dir).where(F.col("label").isin(1, 3, 5))
    found = search.nearest(some, seed_vector(spark, sf_dir), 25, 0.05)
    return found.select("id", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (3, 4, 5))
SELECT vec_id AS id, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS score FROM embeddings, q
GROUP BY vec_id ORDER BY max(list_cosine_similarity(embedding::DOUBLE[], q)) DESC, vec_id LIMIT 10""")
def vector_segment_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = [seed_vector(spark, sf_dir, i) for i in (3, 4, 5)]
    found = search.best_by_segment(vectors(spark, sf_dir), segments)
    return found.select("id", F.round("score", 6).alias("score"))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The written index of the vectors; its bounds hold for all of them."""
    path = persisted(spark, "vector-index", [f"{sf_dir}/embeddings.parquet"], lambda p: VectorIndex.build(vectors(spark, sf_dir), p))
    return VectorIndex(spark, path)


def trigram_index(spark: SparkSession, sf_dir: str) -> TrigramIndex:
    path = persisted(spark, "trigram-index", [f"{sf_dir}/documents.parquet"], lambda p: TrigramIndex.build(view(spark, sf_dir, "memories"), p))
    return TrigramIndex(spark, path)


def entity_table(spark: SparkSession, sf_dir: str) -> EntityTable:
    path = persisted(spark, "entity-table", [f"{sf_dir}/documents.parquet"], lambda p: EntityTable.build(view(spark, sf_dir, "memories"), p))
    return EntityTable(spark, path)


@query_like("vector_topk")
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_index(spark, sf_dir).nearest(seed_vector(spark, sf_dir), 10)
    return found.select("id", F.round("score", 6).alias("score"))


@query_like("vector_topk_filtered")
def vector_topk_filtered_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_index(spark, sf_dir).nearest(seed_vector(spark, sf_dir), 25, 0.05, F.col("label").isin(1, 3, 5))
    return found.select("id", F.round("score", 6).alias("score"))


@query_like("lexical_search_ranked")
def lexical_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trigram_index(spark, sf_dir).ranked(QUERY)
    return found.select("id", "title", F.round("rank_score", 6).alias("rank_score"))


@query_like("keyword_relaxed_scan")
def keyword_relaxed_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trigram_index(spark, sf_dir).relaxed(TASK)
    return found.select("id", F.round("lexical", 6).alias("lexical"))


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "memories").join(vectors(spark, sf_dir).drop("label"), "id", "left")


@query(f"""SELECT id, title, round(txt, 6) AS txt, round(vec, 6) AS vec, round(score, 6) AS score FROM (
  SELECT *, greatest(vec, txt) * 0.70 + txt * 0.15 + importance * 0.15 AS score FROM (
    SELECT m.*, coalesce({COSINE}, 0) AS vec,
      greatest({similar("title", f"'{QUERY}'")}, CASE WHEN content ILIKE '%{QUERY}%' THEN 0.5 ELSE 0 END) AS txt
    FROM memories m LEFT JOIN embeddings ON vec_id = id) WHERE vec > 0.4 OR txt > 0.03)
ORDER BY round(score, 9) DESC, id LIMIT 10""")
def hybrid_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid(_with_vectors(spark, sf_dir), QUERY, seed_vector(spark, sf_dir))
    return found.select("id", "title", *(F.round(c, 6).alias(c) for c in ("txt", "vec", "score")))


@query(f"""SELECT id, round(txt * 0.85 + importance * 0.15, 6) AS score FROM (SELECT *,
  greatest({similar("title", f"'{QUERY}'")}, CASE WHEN content ILIKE '%{QUERY}%' THEN 0.5 ELSE 0 END) AS txt FROM memories)
WHERE txt > 0.03 ORDER BY round(txt * 0.85 + importance * 0.15, 9) DESC, id LIMIT 10""")
def text_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hybrid(view(spark, sf_dir, "memories"), QUERY, None)
    return found.select("id", F.round("score", 6).alias("score"))


@query_like("text_only_search")
def text_only_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trigram_index(spark, sf_dir).hybrid(QUERY)
    return found.select("id", F.round("score", 6).alias("score"))


ENTITIES = """raw AS (SELECT id, unnest(list_concat(
    regexp_extract_all(content, 'https?://[^\\s\\p{Z})''"<>]+'),
    regexp_extract_all(content, '(?:^|[^\\p{L}\\p{N}_])(/(?:[\\p{L}\\p{N}_.@+-]+/)*[\\p{L}\\p{N}_.@+-]+)', 1),
    list_filter(list_transform(regexp_extract_all(content, '[\\p{L}\\p{N}_.-]+'),
      lambda w: regexp_extract(w, '(?i)^[.-]*([\\p{L}\\p{N}_][\\p{L}\\p{N}_.-]*\\.(?:sqlite3?|ya?ml|toml|json|db|py|md))(?:[.-]|$)', 1)), lambda w: w <> ''),
    list_filter(regexp_extract_all(content, '(?i)(?::|port[\\s\\p{Z}]+|端口[\\s\\p{Z}]*)([\\p{L}\\p{N}_]+)', 1), lambda w: regexp_full_match(w, '\\p{Nd}{2,5}')),
    list_filter(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'), lambda w: lower(w) IN ('qdrant', 'ollama', 'openmemory', 'mem0', 'mcp', 'fts5')),
    regexp_extract_all(content, '(?i)(?:^|[^\\p{L}\\p{N}_])(memory\\.sqlite3|nomic-embed-text)(?:[^\\p{L}\\p{N}_]|$)', 1),
    list_filter(tags, lambda t: NOT regexp_matches(trim(t), '(?i)^(extracted|rollup|atomic_fact|agent:.+|project:.+|windows|claude|hermes|codex|gemini|opencode)$')))) AS e
  FROM memories),
cut AS (SELECT id, regexp_replace(trim(e), '^[.,;:)]+|[.,;:)]+$', '', 'g') AS entity FROM raw),
named AS (SELECT id, entity, CASE array_to_string(regexp_extract_all(lower(entity), '[a-z0-9]+|[一-鿿]+'), ' ')
    WHEN 'vector store' THEN 'qdrant' WHEN 'sqlite3' THEN 'sqlite' WHEN 'memory sqlite3' THEN 'sqlite' WHEN 'fts5' THEN 'sqlite'
    WHEN 'nomic embed text' THEN 'ollama' WHEN 'model context protocol' THEN 'mcp' WHEN 'open memory' THEN 'openmemory' WHEN 'mem0' THEN 'openmemory'
    ELSE array_to_string(regexp_extract_all(lower(entity), '[a-z0-9]+|[一-鿿]+'), ' ') END AS normalized_entity,
  CASE WHEN starts_with(entity, 'http://') OR starts_with(entity, 'https://') THEN 'url' WHEN starts_with(entity, '/') THEN 'path'
    WHEN regexp_full_match(entity, '\\p{Nd}{2,5}') THEN 'port'
    WHEN regexp_matches(entity, '\\.(sqlite3?|ya?ml|toml|json|db|py|md)$') THEN 'file' ELSE 'concept' END AS entity_type
  FROM cut WHERE entity <> ''),
weighed AS (SELECT *, CASE entity_type WHEN 'path' THEN 1.0 WHEN 'url' THEN 0.95 WHEN 'port' THEN 0.9 WHEN 'file' THEN 0.9
  ELSE 0.75 END::DOUBLE AS weight FROM named WHERE normalized_entity <> ''),
entity_rows AS (SELECT id, entity, normalized_entity, entity_type, weight FROM (SELECT *, row_number() OVER (
  PARTITION BY id, normalized_entity ORDER BY weight DESC, entity, entity_type) AS n FROM weighed) WHERE n = 1)"""


@query(f"WITH {ENTITIES} SELECT * FROM entity_rows")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.entity_index(view(spark, sf_dir, "memories"))


@query(f"""WITH {ENTITIES} SELECT id, entity, weight, round(0.12 + least(weight, 1.0) * 0.18, 3) AS boost
FROM entity_rows JOIN memories USING (id) WHERE normalized_entity IN ('src3', 'en')
ORDER BY weight DESC, importance DESC, updated_at DESC, id, normalized_entity LIMIT 30""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = view(spark, sf_dir, "memories")
    found = search.entity_search(search.entity_index(memories), memories, ["src3", "en"])
    return found.select("id", "entity", "weight", "boost")


@query_like("entity_search")
def entity_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["src3", "en"]
    found = search.entity_search(entity_table(spark, sf_dir).named(*names), view(spark, sf_dir, "memories"), names)
    return found.select("id", "entity", "weight", "boost")


def context_candidates(spark: SparkSession, sf_dir: str, task: str = TASK, profile: DataFrame | None = None, words: tuple[str, ...] = ()) -> DataFrame:
    """Visible records found by words, vector or entity, fused and scored; with a profile (attribute, value, confidence) and
    its words, by how well they fit it, too."""
    memories = view(spark, sf_dir, "memories")
    live = memories.where(F.col("status").isin("active", "candidate")).where(search.valid_at(AS_OF))
    live = live.where(search.visible("global", "/work/src3"))
    said = search.ranked(live, task, 30).select("id", F.lit("fts").alias("source"))
    near = search.nearest(vectors(spark, sf_dir), seed_vector(spark, sf_dir), 30, 0.1)
    named = entity_table(spark, sf_dir).named("src3").join(live.select("id", "importance", "updated_at"), "id")
    named = named.withColumn("boost", search.entity_boost(F.col("weight")))
    named = named.orderBy(F.desc("weight"), F.desc("importance"), F.desc("updated_at"), "id").limit(30)
    hits = live.join(F.broadcast(retrieval.fused(said, near, named)), "id")
    hits = hits if profile is None else retrieval.contradicted(hits, profile)
    return retrieval.scored(hits, task, AS_OF, profile_words=words)


FTS = " OR ".join(
    f"title ILIKE '%{t}%' OR content ILIKE '%{t}%' OR {similar('title', f"'{t}'")} > 0.15" for t in search.search_terms(TASK)
)

def candidates_sql(boost: str = "0", factor: str = "1") -> str:
    """The scored candidates, with what a profile adds to their evidence and the factor by which it discounts them."""
    return f"""live AS MATERIALIZED (SELECT * FROM memories WHERE status IN ('active', 'candidate')
  AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AS_OF}')
  AND (scope = 'global' OR (scope = 'project' AND project_path IN ('/work/src3', '')))),
w AS (SELECT id FROM live WHERE {FTS}
  ORDER BY {similar("title", f"'{TASK}'")} * 0.4 + importance * 0.3 + effectiveness_score * 0.2 + feedback_score * 0.1 DESC,
    updated_at DESC, id LIMIT 30),
v AS (SELECT vec_id AS id, {COSINE} AS score FROM embeddings WHERE {COSINE} >= 0.1 ORDER BY {COSINE} DESC, vec_id LIMIT 30),
e AS (SELECT id, round(0.12 + least(0.75, 1.0) * 0.18, 3) AS boost FROM live WHERE list_contains(tags, 'src3')
  ORDER BY importance DESC, updated_at DESC, id LIMIT 30),
hits AS (SELECT id, 'fts' AS source, NULL AS score, NULL AS boost FROM w UNION ALL SELECT id, 'vector', score, NULL FROM v
  UNION ALL SELECT id, 'entity', NULL, boost FROM e),
f AS (SELECT id, coalesce(max(score), 0) AS vector_score, coalesce(max(boost), 0)::DOUBLE AS boost,
  list_sort(list_distinct(list(source))) AS sources FROM hits GROUP BY id),
g AS (SELECT *, {lexical_sql(TASK)} AS lexical_all, list_contains(sources, 'fts') AS m,
  greatest(0, least(1, 1 - greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000) / 365)) AS fresh
  FROM live JOIN f USING (id)),
h AS (SELECT *, CASE WHEN m THEN lexical_all ELSE 0 END AS lex FROM g),
scored AS (SELECT *, greatest(0, (vector_score * 0.35 + lex * 0.28 + boost + CASE WHEN m THEN 0.08 ELSE 0 END
    + CASE WHEN list_contains(sources, 'entity') THEN 0.06 ELSE 0 END + CASE WHEN lex >= 0.5 THEN 0.15 ELSE 0 END
    - CASE WHEN kind = 'parent_memory' THEN 0.05 ELSE 0 END + importance * 0.05
    + least(0.02, ln(1 + injected_count) * 0.005) + effectiveness_score * 0.02
    + greatest(-1, least(1, feedback_score)) * 0.02 + fresh * 0.05 + {boost}) * {factor}
  * CASE WHEN status = 'candidate' THEN 0.85 ELSE 1 END
  * CASE WHEN lex >= 0.4 OR vector_score >= 0.8 OR list_contains(sources, 'entity') THEN 1
      WHEN length(content) < 50 THEN 0.5 WHEN length(content) < 80 THEN 0.85 ELSE 1 END
  * CASE WHEN m AND list_contains(sources, 'vector') THEN 1.5 ELSE 1 END) AS score FROM h)"""


CANDIDATES = candidates_sql()


@query(f"""WITH {CANDIDATES} SELECT id, array_to_string(sources, ',') AS sources, round(lexical_all, 6) AS lexical,
  round(score, 6) AS score FROM scored""")
def fused_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = context_candidates(spark, sf_dir)
    return found.select(
        "id", F.array_join("sources", ",").alias("sources"), F.round("lexical_all", 6).alias("lexical"),
        F.round("score", 6).alias("score"),
    )


PACKED = """ok AS (SELECT *, score * CASE type WHEN 'project_memory' THEN 1.4 WHEN 'decision' THEN 1.2 ELSE 1 END AS final FROM scored
  WHERE NOT (array_to_string(sources, ',') = 'vector' AND vector_score < 0.35) AND score >= 0.15),
r AS (SELECT *, row_number() OVER (ORDER BY round(final, 9) DESC, fresh DESC, updated_at DESC, id) AS rnk FROM ok),
p AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY rnk) AS nth FROM r),
k AS (SELECT * FROM p WHERE (parent_id IS NOT NULL AND nth <= 3)
  OR (parent_id IS NULL AND id NOT IN (SELECT parent_id FROM r WHERE parent_id IS NOT NULL))),
t AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rnk) AS of_type FROM k),
pack AS (SELECT *, row_number() OVER (ORDER BY rnk) AS rank FROM t
  WHERE of_type <= CASE WHEN type = 'episodic_memory' THEN 2 ELSE 3 END ORDER BY rnk LIMIT 12)"""

PACK = f"{CANDIDATES},\n{PACKED}"


def context_pack(spark: SparkSession, sf_dir: str, task: str = TASK, **profile) -> DataFrame:
    """The capped, ranked records of a pack."""
    found = retrieval.gated(context_candidates(spark, sf_dir, task, **profile))
    return retrieval.capped(retrieval.pruned(retrieval.ordered(found, task)))


@query(f"WITH {PACK} SELECT rank, id, type, round(final, 6) AS final FROM pack")
def context_pack_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_pack(spark, sf_dir).select("rank", "id", "type", F.round("final", 6).alias("final"))


@query(f"""WITH {PACK}, s AS (SELECT *, sum(least(length(content), 420) + length(title)) OVER (ORDER BY rank) AS running FROM pack)
SELECT rank, id, running::BIGINT AS running FROM s WHERE running <= 3000""")
def context_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(text.snippet(F.col("content"))) + F.length("title")
    return retrieval.within_budget(context_pack(spark, sf_dir), size, 3000).select("rank", "id", "running")


@query(f"""WITH {PACK}, s AS (SELECT *, sum(ceil(length(content) / 2.5)) OVER (ORDER BY rank) AS running FROM pack)
SELECT rank, id, running::BIGINT AS running FROM s WHERE running <= 12000""")
def context_budget_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.ceil(F.length("content") / F.lit(2.5)).cast("long")
    return retrieval.within_budget(context_pack(spark, sf_dir), size, 12000).select("rank", "id", "running")


@query(f"""WITH {PACK} SELECT rank, id, CASE WHEN vector_score >= 0.7 OR (list_contains(sources, 'vector') AND vector_score >= 0.5)
    THEN printf('semantic %.2f', vector_score) WHEN lexical_all > 0.08 THEN 'lexical'
    WHEN list_contains(sources, 'vector') THEN printf('semantic %.2f', vector_score) ELSE 'related' END AS reason,
  sha256(CASE WHEN length(content) > 420 THEN replace(substr(content, 1, 417), chr(10), ' ') || '...'
    ELSE replace(content, chr(10), ' ') END) AS snippet_sha256 FROM pack""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = retrieval.line(context_pack(spark, sf_dir))
    return lines.select("rank", "id", "reason", F.sha2(text.snippet(F.col("content")), 256).alias("snippet_sha256"))


@query(f"""WITH {PACK}, b AS (SELECT r.*, pack.id IS NOT NULL AS used FROM r LEFT JOIN pack USING (id))
SELECT count(*) AS total_candidates, count(*) FILTER (used) AS used_count,
  round(count(*) FILTER (used) / greatest(count(*), 1), 3) AS hit_rate,
  round(count(*) FILTER (status = 'active') / greatest(count(*), 1), 3) AS active_ratio,
  round(coalesce(avg(importance), 0), 3) AS avg_importance,
  round(count(*) FILTER (ineffective_count > 0) / greatest(count(*), 1), 3) AS ineffective_rate,
  round(coalesce(avg(vector_score) FILTER (used AND list_contains(sources, 'vector')), 0), 3) AS vector_avg_score,
  round(count(*) FILTER (used AND list_contains(sources, 'vector') AND list_contains(sources, 'fts'))
    / greatest(count(*) FILTER (used), 1), 3) AS cross_retrieval_rate FROM b""")
def pack_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.ordered(retrieval.gated(context_candidates(spark, sf_dir)), TASK)
    return retrieval.pack_quality(found, retrieval.capped(retrieval.pruned(found)))


#: A user's profile: words, and attributes whose records must have one of the value's words.
LIKED = ("leaux", "ache", "the")
KNOWN = (("en", "zebra stripes", 0.9), ("a", "enaux leaux", 0.85), ("und", "xx", 0.95), ("e", "quagga", 0.3))
SAID = "lower(coalesce(title, '') || ' ' || coalesce(content, ''))"
BOOST = f"least(1.0::DOUBLE, ({' + '.join(f"contains({SAID}, '{w}')::INT" for w in LIKED)}) / 3.0::DOUBLE) * 0.15"
TOLD = "lower(title || chr(10) || content)"
CONFLICT = "CASE WHEN type <> 'user_profile' THEN NULL " + " ".join(
    f"WHEN contains({TOLD}, '{name}')" + "".join(f" AND NOT contains({TOLD}, '{word}')" for word in value.split()) + f" THEN '{name}'"
    for name, value, confidence in sorted(KNOWN) if confidence >= 0.8
) + " END"
PROFILED = candidates_sql(BOOST, f"CASE WHEN {CONFLICT} IS NULL THEN 1 ELSE 0.6 END")


def user_profile(spark: SparkSession) -> dict:
    return {"profile": spark.createDataFrame(list(KNOWN), "attribute string, value string, confidence double"), "words": LIKED}


@query(f"WITH {PROFILED} SELECT id, {CONFLICT} AS conflict, round(score, 6) AS score FROM scored")
def profile_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a pack as a user's profile raises or discounts them."""
    found = context_candidates(spark, sf_dir, **user_profile(spark))
    return found.select("id", "conflict", F.round("score", 6).alias("score"))


@query(f"WITH {PROFILED},\n{PACKED} SELECT rank, id, type, round(final, 6) AS final, {CONFLICT} IS NOT NULL AS withheld FROM pack")
def profile_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for a user: what contradicts the profile is withheld from its text and shown as a warning."""
    found = context_pack(spark, sf_dir, **user_profile(spark))
    return found.select("rank", "id", "type", F.round("final", 6).alias("final"), F.col("conflict").isNotNull().alias("withheld"))
