"""Record search: lexical, by filters, by entity, and by vector. Filters reach the scan; only sorts and limits shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text, vector
from siltstone.functions.scores import instant
from siltstone.model import GREETINGS


def search_terms(query: str, most: int = 8) -> list[str]:
    """The terms that a lexical search looks for."""
    light = lambda t: len(t) <= 2 and text.FUNCTION_CHARACTERS.issuperset(t)
    return [t for t in text.query_terms(query) if not light(t)][:most]


def is_greeting(task: str) -> bool:
    return task.strip().lower() in GREETINGS


def any_term(terms: list[str], least: float = 0.15) -> Column:
    """Whether title or content holds a term, or the title is alike to one. Without terms nothing matches."""

    def one(t: str) -> Column:
        like = f"%{t.replace(chr(92), chr(92) * 2).replace('%', chr(92) + '%').replace('_', chr(92) + '_')}%"
        near = text.similarity(F.col("title"), F.lit(t)) > least
        return F.col("title").ilike(like) | F.col("content").ilike(like) | near

    return reduce(lambda a, b: a | b, (one(t) for t in terms), F.lit(False))


def visible(scope: str = "", project: str = "") -> Column:
    """Which records a caller sees: global ones, and those of the scope and project, or of the scope and no project."""
    shared = F.col("scope") == "global"
    if project:
        wanted = "project" if scope in ("", "global") else scope
        return shared | ((F.col("scope") == wanted) & F.col("project_path").isin(project, ""))
    return shared | (F.col("scope") == scope) if scope else F.lit(True)


def valid_at(as_of: str) -> Column:
    """Records that have not run out at the instant."""
    return F.col("valid_until").isNull() | (F.col("valid_until") > instant(as_of))


def has_any_tag(tags: list[str]) -> Column:
    wanted = [t.lower() for t in tags]
    return F.exists("tags", lambda t: F.lower(t).isin(wanted))


def filtered(
    memories: DataFrame,
    as_of: str,
    types: list[str] | None = None,
    tags: list[str] | None = None,
    status: str = "",
    scope: str = "",
    project: str = "",
    created: tuple[str, str] | None = None,
) -> DataFrame:
    """Records by every given criterion; one that is empty filters nothing."""
    out = memories.where(valid_at(as_of)).where(visible(scope, project))
    if types:
        out = out.where(F.col("type").isin(types))
    if tags:
        out = out.where(has_any_tag(tags))
    if status:
        out = out.where(F.col("status") == status)
    if created:
        out = out.where(F.col("created_at").between(instant(created[0]), instant(created[1])))
    return out


def ranked(memories: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Records that match the query, best first; without a query, the weightiest and newest. 1 to 100 rows."""
    limit = max(1, min(100, limit))
    if query:
        near = text.similarity(F.col("title"), F.lit(query))
        rank = near * 0.4 + F.col("importance") * 0.3 + F.col("effectiveness_score") * 0.2 + F.col("feedback_score") * 0.1
        found = memories.where(any_term(search_terms(query))).withColumn("rank_score", rank)
        return found.orderBy(F.desc("rank_score"), F.desc("updated_at"), "id").limit(limit)
    order = ("importance", "effectiveness_score", "feedback_score", "updated_at")
    return memories.orderBy(*(F.desc(c) for c in order), "id").limit(limit)


def relaxed(memories: DataFrame, task: str, least: float = 0.08, limit: int = 30) -> DataFrame:
    """Records by lexical relevance of at least ``least``; those that share a term are looked at."""
    terms = search_terms(task)
    holds = F.array_join(F.array(F.lower("title"), F.lower("content"), F.lower(F.array_join("tags", " "))), " ")
    some = reduce(lambda a, b: a | b, (F.contains(holds, F.lit(t)) for t in terms), F.lit(False))
    score = text.lexical_relevance(task, F.col("title"), F.col("content"), F.col("tags"))
    scored = memories.where(some).withColumn("lexical", score).where(F.col("lexical") >= least)
    return scored.orderBy(F.desc("lexical"), "id").limit(limit)


def entity_index(memories: DataFrame) -> DataFrame:
    """(id, entity, normalized_entity, entity_type, weight): a record's entities, one for each normalised name, the one
    with the largest weight, else the smallest text."""
    raw = memories.select("id", F.explode(text.entities(F.col("content"), F.col("tags"))).alias("entity"))
    named = raw.withColumn("normalized_entity", text.canonical_entity(F.col("entity"))).where("normalized_entity <> ''")
    typed = named.withColumn("entity_type", text.entity_type(F.col("entity")))
    typed = typed.withColumn("weight", text.entity_weight(F.col("entity_type")))
    best = F.min(F.struct((-F.col("weight")).alias("w"), "entity", "entity_type"))
    out = typed.groupBy("id", "normalized_entity").agg(best.alias("best"))
    return out.select(
        "id", F.col("best.entity").alias("entity"), "normalized_entity", F.col("best.entity_type").alias("entity_type"),
        (-F.col("best.w")).alias("weight"),
    )


def entity_boost(weight: Column) -> Column:
    return F.round(0.12 + F.least(weight, F.lit(1.0)) * 0.18, 3)


def entity_search(index: DataFrame, memories: DataFrame, names: list[str], limit: int = 30) -> DataFrame:
    """Records that have one of the normalised entities, by weight, importance and age."""
    hits = index.where(F.col("normalized_entity").isin(names)).join(memories, "id")
    order = (F.desc("weight"), F.desc("importance"), F.desc("updated_at"), "id", "normalized_entity")
    return hits.withColumn("boost", entity_boost(F.col("weight"))).orderBy(*order).limit(limit)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = -1.0) -> DataFrame:
    """(id, score): the ``k`` vectors (id, embedding) of the largest cosine with the query, if it is the threshold."""
    scored = vectors.select("id", vector.cosine_with(F.col("embedding"), query).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(max(1, min(100, k)))


def best_by_segment(vectors: DataFrame, queries: list[list[float]], k: int = 10) -> DataFrame:
    """(id, score): the largest cosine with any segment of a long query; all segments in one scan."""
    each = F.array(*(vector.cosine_with(F.col("embedding"), q) for q in queries))
    scored = vectors.select("id", F.array_max(each).alias("score"))
    return scored.orderBy(F.desc_nulls_last("score"), "id").limit(k)


def hybrid(records: DataFrame, query: str, vector_query: list[float] | None, limit: int = 10) -> DataFrame:
    """One pass over records (id, title, content, importance, embedding): the better of vector and text likeness counts
    .70, text .15, importance .15; without a vector, text counts .85. Records that neither likens to are left out."""
    by_text = F.greatest(
        text.similarity(F.col("title"), F.lit(query)),
        F.when(F.col("content").ilike(f"%{query}%"), 0.5).otherwise(0.0),
    )
    scored = records.withColumn("txt", by_text)
    if vector_query is None:
        scored = scored.where("txt > 0.03").withColumn("score", F.col("txt") * 0.85 + F.col("importance") * 0.15)
    else:
        near = F.coalesce(vector.cosine_with(F.col("embedding"), vector_query), F.lit(0.0))
        scored = scored.withColumn("vec", near).where("vec > 0.4 or txt > 0.03")
        best = F.greatest("vec", "txt") * 0.70 + F.col("txt") * 0.15 + F.col("importance") * 0.15
        scored = scored.withColumn("score", best)
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def numbered(records: DataFrame, *order: Column | str) -> DataFrame:
    """``records`` with their rank from 1. Meant for a result that a limit or cap has bounded."""
    return records.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
