"""Records as lists, changes and reports: pages, maintenance candidates, cascades, supersession, typing, counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scores import age_days, days_before, instant
from siltstone.functions.text import entities, normalize_entity
from siltstone.operators.agents import resolved_project, value_tokens
from siltstone.operators.search import entity_index, valid_at, visible

#: Words that tell the type of a record that came without one, in the order in which they are tried: fixed values.
TYPE_WORDS = (
    ("decision", ("决定", "规范", "重构", "必须", "禁止", "原则", "方案", "约定", "规定", "决策")),
    ("environment_fact", ("端口", "路径", "环境变量", "安装", "service", "配置", "ip", "host", "port", "url")),
    ("user_profile", ("偏好", "习惯", "喜欢", "风格", "要求我", "我的角色", "技术栈")),
)
#: Openings of prompts for which nothing is recalled: fixed values.
GENERIC_OPENINGS = ("todo", "待办", "有什么", "还有啥", "剩下什么", "help", "帮助", "你好", "hi", "hello")


def listed(memories: DataFrame, statuses: tuple[str, ...] = (), agents: tuple[str, ...] = (), kind: str = "", tag: str = "", text: str = "") -> DataFrame:
    """Records of a list view. ``kind`` and ``tag`` are the two readings of its category; empty criteria filter nothing."""
    tests = []
    if statuses:
        tests.append(F.col("status").isin(*statuses))
    if agents:
        tests.append(F.col("source_agent").isin(*agents))
    if kind:
        tests.append(F.col("type") == kind)
    if tag:
        tests.append(F.array_contains("tags", tag))
    if text:
        tests.append(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.lower("content"), F.lit(text.lower())))
    return reduce(lambda df, t: df.where(t), tests, memories)


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def maintenance_candidates(memories: DataFrame, action: str, as_of: str, days: int | None = None, importance: float = 0.45) -> DataFrame:
    """Records that an action would touch: ``clean`` (no title or no content), ``expire`` (replaced and old), ``archive``
    (active, old and of little importance), ``archive_stale`` and ``dedup`` (active records that share a title)."""
    if action == "clean":
        return memories.where((_blank("content") | _blank("title")) & (F.col("status") != "archived"))
    if action == "expire":
        old = F.col("updated_at") < days_before(as_of, 90 if days is None else days)
        return memories.where(F.col("status").isin("superseded", "contradicted") & old)
    if action == "archive":
        old = F.col("updated_at") < days_before(as_of, 180 if days is None else days)
        return memories.where((F.col("status") == "active") & old & (F.coalesce("importance", F.lit(0.0)) < importance))
    if action == "archive_stale":
        return memories.where("status = 'stale'")
    if action == "dedup":
        key = F.lower(F.trim("title"))
        named = memories.where((F.col("status") == "active") & ~_blank("title")).withColumn("_title", key)
        shared = named.groupBy("_title").count().where("count > 1")
        return named.join(shared, "_title", "left_semi").drop("_title")
    raise ValueError(f"unknown action: {action}")


def curation_pool(memories: DataFrame, newest: int, accessed: bool = False) -> DataFrame:
    """The newest active or candidate records, of all or of those that were ever accessed."""
    pool = memories.where("status in ('active', 'candidate')")
    return (pool.where("last_accessed_at is not null") if accessed else pool).orderBy(F.desc("updated_at"), "id").limit(newest)


def fallback_count(memories: DataFrame, as_of: str, scope: str = "", project: str = "", limit: int = 8) -> DataFrame:
    """One row: how many active and valid records in sight there are, counted up to ``limit``."""
    seen = memories.where("status = 'active'").where(valid_at(as_of)).where(visible(scope, project))
    return seen.limit(max(1, min(100, limit))).agg(F.count("*").alias("fallback"))


def timeline(found: DataFrame, limit: int = 20) -> DataFrame:
    """The newest events, decisions and feedback that are active, to be read from the oldest."""
    told = found.where(F.col("type").isin("timeline_event", "decision", "feedback") & (F.col("status") == "active"))
    return told.orderBy(F.desc("importance"), F.desc("updated_at"), "id").limit(limit).orderBy("created_at", "id")


def backfill_plan(memories: DataFrame, signals: tuple[str, ...], explicit: tuple[str, ...]) -> DataFrame:
    """(id, signals, sure) of records without a project that hold signals of one. A record is surely the project's if it
    names it (``explicit``) or holds two signals; others are for review."""
    said = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))))
    open_ones = memories.where((F.coalesce("project_path", F.lit("")) == "") & ~F.col("status").isin("archived", "superseded"))
    held = open_ones.withColumn("_said", said).select("id", F.filter(F.array(*map(F.lit, signals)), lambda s: F.contains(F.col("_said"), s)).alias("signals"))
    named = F.arrays_overlap("signals", F.array(*map(F.lit, explicit))) if explicit else F.lit(False)
    return held.where("size(signals) > 0").withColumn("sure", named | (F.size("signals") >= 2))


def backfilled(memories: DataFrame, plan: DataFrame, project: str, scope: str, tag: str) -> DataFrame:
    """Records after a plan: the sure ones get the project, its scope and its tag."""
    sure = plan.where("sure").select("id", F.lit(True).alias("_sure"))
    both = memories.join(sure, "id", "left")
    hit = F.coalesce("_sure", F.lit(False))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    out = both.withColumns({
        "project_path": F.when(hit, project).otherwise(F.col("project_path")),
        "scope": F.when(hit, scope).otherwise(F.col("scope")),
        "tags": F.when(hit, F.array_union(tags, F.array(F.lit(tag)))).otherwise(F.col("tags")),
    })
    return out.select(memories.columns)


def with_status(memories: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Records after status changes (id, new_status). A status other than active goes on to a record's atomic facts,
    unless they have a change of their own. Changed records are updated at ``as_of``."""
    own = changes.select("id", "new_status")
    down = changes.where("new_status <> 'active'").select(F.col("id").alias("parent_id"), F.col("new_status").alias("_passed"))
    both = memories.join(own, "id", "left").join(down, "parent_id", "left")
    passed = F.when((F.col("kind") == "atomic_fact") & (F.col("_passed") != F.col("status")), F.col("_passed"))
    new = F.coalesce("new_status", passed)
    return both.withColumns({
        "status": F.coalesce(new, "status"), "updated_at": F.when(new.isNotNull(), instant(as_of)).otherwise(F.col("updated_at")),
    }).select(memories.columns)


def supersession_errors(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (old_id, new_id) with the first guard that each breaks in ``error``, and its lineage root otherwise.

    ``memories`` has id, status, superseded_by and fact_lineage_root.
    """
    def side(name: str) -> DataFrame:
        return memories.select(
            F.col("id").alias(f"{name}_id"), F.col("status").alias(f"{name}_status"),
            F.col("superseded_by").alias(f"{name}_by"), F.col("fact_lineage_root").alias(f"{name}_root"),
        )

    both = pairs.select("old_id", "new_id").join(side("old"), "old_id", "left").join(side("new"), "new_id", "left")
    old_root = F.coalesce("old_root", "old_id")
    error = (
        F.when(F.col("old_id") == F.col("new_id"), "same record")
        .when(F.col("old_status").isNull(), "old record not found")
        .when(F.col("new_status").isNull(), "new record not found")
        .when(F.col("old_status") == "archived", "old record is archived")
        .when(F.col("old_by").isNotNull(), "old record already superseded")
        .when(F.col("new_status") == "archived", "new record is archived")
        .when(F.col("new_by").isNotNull(), "new record already superseded")
        .when((F.coalesce("new_root", "new_id") != F.col("new_id")) & (F.col("new_root") != old_root), "lineages differ")
    )
    return both.select("old_id", "new_id", error.alias("error"), F.when(error.isNull(), old_root).alias("root_id"))


def typed(kind: Column, title: Column, content: Column) -> Column:
    """A record's type; if it has none or a general one, the type that its words tell, else an episode."""
    said = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))
    given = F.coalesce(kind, F.lit(""))
    told = F.when(~given.isin("", "episodic_memory", "general"), given)
    for name, words in TYPE_WORDS:
        told = told.when(reduce(lambda a, b: a | b, (F.contains(said, F.lit(w)) for w in words)), name)
    return told.when(given == "", "episodic_memory").otherwise(given)


def title_subject(title: Column) -> Column:
    """The names that a title's beginning may give a subject by: its first token, and its first two with a dash."""
    bare = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^[\[(<【〔（]+", "")
    tokens = F.filter(F.split(bare, r"[\s:：_\-—/\])>】〕）]+"), lambda t: t != "")
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    names = F.array(F.lower(first), F.lower(F.concat(first, F.lit("-"), second)))
    return F.filter(names, lambda n: n.isNotNull())


def with_subject(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """``records`` (id, title) with the project (alias, project; a short list) that the title names, the first token first."""
    asked = records.select("id", F.posexplode(title_subject(F.col("title"))).alias("place", "alias"))
    found = asked.join(F.broadcast(aliases.select(F.lower("alias").alias("alias"), "project")), "alias")
    best = found.groupBy("id").agg(F.min(F.struct("place", "project")).alias("b")).select("id", F.col("b.project").alias("subject"))
    return records.join(best, "id", "left")


def ideograph_share(text: Column) -> Column:
    """The share of ideographs in a text; above .15 it is taken for Chinese."""
    length = F.length(text)
    return F.coalesce(F.try_divide(length - F.length(F.regexp_replace(text, "[一-鿿]", "")), length), F.lit(0.0))


def masked(secret: Column) -> Column:
    """A secret as it may be shown: its first three and last four characters, or nothing of a short one."""
    value = F.coalesce(secret, F.lit(""))
    shown = F.concat(F.left(value, F.lit(3)), F.lit("****"), F.right(value, F.lit(4)))
    return F.when(value == "", "").when(F.length(value) <= 8, "****").otherwise(shown)


def age_tag(as_of: str) -> Column:
    """A line for judges: when a record was made, changed and last read, its age in days, and how long it holds."""
    def day(c: str) -> Column:
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("未知"))

    changed = F.coalesce("updated_at", "created_at")
    age = F.coalesce(F.greatest(F.lit(0), F.floor(age_days(changed, as_of))).cast("string"), F.lit("?"))
    read = F.when(F.col("last_accessed_at").isNotNull(), F.concat(F.lit(", 最后访问="), day("last_accessed_at"))).otherwise("")
    holds = F.when(F.col("valid_until").isNotNull(), F.concat(F.lit(", 有效期=未知~"), day("valid_until"))).otherwise("")
    return F.concat(F.lit("[时间: 创建="), day("created_at"), F.lit(", 更新="), day("updated_at"), F.lit(", 距今="), age, F.lit("天"), read, holds, F.lit("]"))


def used(memories: DataFrame, uses: DataFrame) -> DataFrame:
    """Records after uses (id, kind, ts): an injection counts and sets both times, an access sets its own. Uses are
    counted before they meet the records, so a hot record is one row of the join."""
    tally = uses.groupBy("id").agg(
        F.count_if(F.col("kind") == "injected").alias("_n"), F.max(F.when(F.col("kind") == "injected", F.col("ts"))).alias("_injected"),
        F.max("ts").alias("_seen"),
    )
    both = memories.join(tally, "id", "left")
    return both.withColumns({
        "injected_count": F.col("injected_count") + F.coalesce("_n", F.lit(0)),
        "last_injected_at": F.coalesce("_injected", "last_injected_at"), "last_accessed_at": F.coalesce("_seen", "last_accessed_at"),
    }).select(memories.columns)


def lacking_vectors(memories: DataFrame, vectors: DataFrame, statuses: tuple[str, ...] = ("active", "candidate", "stale")) -> DataFrame:
    """(id, hash) of retained records without a vector; the hash of title and content tells copies apart from new texts."""
    kept = memories.where(F.col("status").isin(*statuses)).join(vectors.select("id"), "id", "left_anti")
    return kept.select("id", F.sha2(F.concat_ws("\n", "title", "content"), 256).alias("hash"))


def queue_depth(queue: DataFrame, most: int = 3) -> DataFrame:
    """One row: entries of a retry queue (retries), those that may be tried again, and those that may not."""
    can = F.col("retries") < most
    return queue.agg(F.count("*").alias("total"), F.count_if(can).alias("retryable"), F.count_if(~can).alias("exhausted"))


def with_children(memories: DataFrame) -> DataFrame:
    """(parent_id, children, facts): for each parent its children's ids in order, and how many are atomic facts. A parent
    has few children; their texts are not gathered."""
    children = memories.where("parent_id is not null")
    ids = F.array_sort(F.collect_list("id")).alias("children")
    return children.groupBy("parent_id").agg(ids, F.count_if(F.col("kind") == "atomic_fact").alias("facts"))


def sources_of(decisions: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, sources): a decision (id, source_ids) with title and status of its records, in the order in which it names them."""
    named = decisions.select("id", F.posexplode("source_ids").alias("place", "memory_id"))
    told = named.join(memories.select(F.col("id").alias("memory_id"), "title", "status"), "memory_id")
    listed_ = F.array_sort(F.collect_list(F.struct("place", "memory_id", "title", "status")))
    return told.groupBy("id").agg(listed_.alias("sources"))


def unseen_sources(memories: DataFrame, profile: DataFrame) -> DataFrame:
    """Active profile records that no profile attribute names among its ``sources`` yet."""
    seen = profile.select(F.explode("sources").alias("id")).distinct()
    return memories.where("type = 'user_profile' and status = 'active'").join(seen, "id", "left_anti")


def profile_lag(memories: DataFrame, profile: DataFrame, most: float = 7.0) -> DataFrame:
    """One row: days by which the newest profile record is ahead of the newest attribute, and whether that is too many."""
    newest = memories.where("type = 'user_profile' and status = 'active'").agg(F.max("created_at").alias("m"))
    stored = profile.agg(F.max("updated_at").alias("a"))
    micros = F.unix_micros(F.col("m").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    both = newest.join(F.broadcast(stored)).select((micros / 86_400_000_000).alias("lag"))
    return both.select("lag", F.coalesce(F.col("lag") >= most, F.lit(False)).alias("behind"))


def feature_words(profile: DataFrame, signals: tuple[str, ...], least: float = 0.6) -> DataFrame:
    """(user_id, word): the distinct Latin tokens of the values of a user's surer signal attributes, without links."""
    sure = profile.where(F.col("attribute").isin(*signals) & (F.col("confidence") >= least))
    return sure.select("user_id", F.explode(value_tokens(F.col("value"))).alias("word")).where("word not like 'http%'").distinct()


def overlap(text: Column, words: list[str]) -> Column:
    """How many of a profile's words a text holds, 1 from three on."""
    said = F.lower(F.coalesce(text, F.lit("")))
    hits = reduce(lambda a, b: a + b, (F.contains(said, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(1.0), hits / 3.0)


def is_generic(agent: Column, prompt: Column) -> Column:
    """Whether a prompt asks for no recall: a very short one or, from the agent that opens so, a short generic one."""
    said = F.trim(F.coalesce(prompt, F.lit("")))
    opening = F.rlike(said, F.lit(rf"(?i)^(现在)?({'|'.join(GENERIC_OPENINGS)})\b"))
    return (F.length(said) < 4) | ((agent == "codex") & (F.length(said) < 20) & opening)


def by_json(rows: DataFrame, column: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose JSON text has the wanted values at dotted paths."""
    return reduce(lambda df, kv: df.where(F.get_json_object(column, f"$.{kv[0]}") == kv[1]), wanted.items(), rows)


def audit_page(events: DataFrame, limit: int = 50, **wanted) -> DataFrame:
    """The newest audit events with the wanted values; 1 to 500."""
    hit = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), wanted.items(), events)
    return hit.orderBy(F.desc("created_at"), F.desc("event_id")).limit(max(1, min(500, limit)))


def apply_counts(ledger: DataFrame) -> DataFrame:
    """One row: what an execution's applied changes (action_type, before_status, after_status, status) came to."""
    done, kind = F.col("status") == "applied", F.col("action_type")
    archived = (kind == "memory_archive") & ~F.col("before_status").eqNullSafe("archived") & (F.col("after_status") == "archived")
    return ledger.where(done).agg(
        F.count_if(archived).alias("archived"),
        F.count_if((kind == "memory_status_update") & (F.col("after_status") == "contradicted")).alias("contradicted"),
        F.count_if(kind == "memory_importance_update").alias("importance_updated"),
        F.count_if(kind == "memory_insert").alias("children_created"),
        F.count_if((kind == "memory_link_insert") & F.col("before_status").isNull()).alias("links_created"),
        F.count_if((kind == "memory_link_insert") & F.col("before_status").isNotNull()).alias("links_skipped"),
    )


def synced_entities(memories: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, normalized_entity, weight) of active records, and their project's name where the text doesn't name it. Other
    records keep no entities."""
    active = memories.where("status = 'active'")
    told = F.concat_ws("\n", "title", "content", F.col("parent_id").cast("string"))
    own = entity_index(active.select("id", told.alias("content"), "tags")).select("id", "normalized_entity", "weight")
    homes = resolved_project(active.select("id", F.col("project_path").alias("path")), projects).where("project is not null")
    named = homes.select("id", normalize_entity(F.col("project")).alias("normalized_entity"), F.lit(1.0).alias("weight"))
    return own.unionByName(named.join(own, ["id", "normalized_entity"], "left_anti"))


def entity_freshness(memories: DataFrame) -> DataFrame:
    """One row: how many entities active records name, with repeats, and when the newest such record was made."""
    active = memories.where("status = 'active'").select("created_at", F.size(entities(F.col("content"), F.col("tags"))).alias("n"))
    return active.where("n > 0").agg(F.sum("n").alias("entities"), F.max("created_at").alias("newest_at"))
