"""What a console shows and does: views of records and hits, pages, digests, and the life of runs and applications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.metrics import app_of

#: Sort keys of the page of applications, by name: fixed values.
APP_SORTS = {
    "name": "lower(app)", "display_name": "lower(app)", "memories": "created", "memories_accessed": "accessed",
    "last_activity": "coalesce(cast(last_at AS string), '')", "status": "coalesce(status, '')",
}
#: States in which a decision can still be rejected, and those that end an execution: fixed values.
ACTIONABLE = ("auto_approved", "needs_review")
#: Rows that name a record, about, for which it has one copy, and the share of all rows by which they are counted.
HOT, SHARE = 131_072, 64


def agent_view(records: DataFrame) -> DataFrame:
    """(id, title, content, type, tags, updated_at, project_path): what an agent sees of a record. Missing texts are
    empty, a missing type is project_memory, the date has ten characters, and an empty project is null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return records.select(
        text("id"), text("title"), text("content"), F.coalesce("type", F.lit("project_memory")).alias("type"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.substring(F.coalesce(F.coalesce("updated_at", "created_at").cast("string"), F.lit("")), 1, 10).alias("updated_at"),
        F.nullif(F.col("project_path"), F.lit("")).alias("project_path"),
    )


def vector_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """(id, score, text, type, tags, project_path) of hits (id, score), the score with four digits; a hit without a
    record has an empty text and counts as episodic."""
    both = hits.select("id", "score").join(records.select("id", "content", "type", "tags", "project_path"), "id", "left")
    return both.select(
        F.col("id").cast("string").alias("id"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
        F.coalesce("content", F.lit("")).alias("text"), F.coalesce("type", F.lit("episodic_memory")).alias("type"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.nullif(F.col("project_path"), F.lit("")).alias("project_path"),
    )


def entity_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits (id, entity, normalized_entity, entity_type, weight, boost) with memory, the agent's view of the record; null
    where there is none."""
    shown = agent_view(records)
    nested = shown.select(F.col("id").alias("memory_id"), F.struct(*shown.columns).alias("memory"))
    named = hits.select(
        F.col("id").cast("string").alias("memory_id"), "entity", "normalized_entity", "entity_type", "weight", F.round("boost", 3).alias("boost")
    )
    return named.join(nested, "memory_id", "left")


def items(records: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(id, title, state, app_id, app_name, categories) of a page: a missing status is active, a missing agent manual."""
    agent = F.coalesce(F.nullif(F.col("source_agent"), F.lit("")), F.lit("manual"))
    return records.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("status", F.lit("active")).alias("state"),
        agent.alias("app_id"), app_of(agent, aliases).alias("app_name"), F.coalesce("tags", F.array().cast("array<string>")).alias("categories"),
    )


def decoded(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``rows`` with each column of ``kinds`` (name: type), a JSON text named with _json at the end, read as its type. A
    missing or broken text is an empty list, or null for other types."""
    out = rows
    for name, kind in kinds.items():
        read = F.from_json(F.col(f"{name}_json"), kind)
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
        out = out.withColumn(name, F.coalesce(read, empty)).drop(f"{name}_json")
    return out


def listed(lists: DataFrame, key: str, ids: str, records: DataFrame, most: int, chars: int, more: str = "") -> DataFrame:
    """(key, rank, id, title, snippet, importance, tags) of the first ``most`` ids of each row's list, in its order, with
    the beginnings of their contents; ids without a record are left out and leave a gap in the ranks.

    Contents are cut before they travel. Records that more than about HOT lists name, as a SHARE-th of the rows tells, are copied
    and their rows dealt to the copies, so that no task gets all of them; what is found doesn't depend on it."""
    each = lists.select(key, F.posexplode(F.slice(ids, 1, most)).alias("rank", "id"))
    content = F.coalesce("content", F.lit(""))
    snippet = F.concat(F.substring(content, 1, chars), F.when(F.length(content) > chars, F.lit(more)).otherwise(""))
    shown = records.select("id", F.coalesce("title", F.lit("")).alias("title"), snippet.alias("snippet"), "importance", "tags")
    often = each.where(F.pmod(F.xxhash64(key, "rank"), F.lit(SHARE)) == 0).groupBy("id").agg((F.count("*") * SHARE).alias("n"))
    hot = F.broadcast(often.where(F.col("n") > HOT).select("id", F.ceil(F.col("n") / HOT).cast("int").alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    dealt = each.join(hot, "id", "left").select(key, "rank", "id", F.pmod(F.hash(key, "rank"), copies).alias("copy"))
    copied = shown.join(hot, "id", "left").select(*shown.columns, F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    found = dealt.hint("merge").join(copied, ["id", "copy"])
    return found.select(key, (F.col("rank") + 1).alias("rank"), "id", "title", "snippet", "importance", "tags")


def app_page(apps: DataFrame, sort: str = "name", descending: bool = False, limit: int = 50) -> DataFrame:
    """The first ``limit`` applications (app, created, accessed, last_at, status) by one of six keys; an unknown key is
    the name, and ties are in the order of names."""
    by = F.expr(APP_SORTS.get(sort, APP_SORTS["name"]))
    return apps.orderBy(by.desc() if descending else by.asc(), "app").limit(limit)


def app_status(apps: DataFrame, presence: DataFrame) -> DataFrame:
    """``apps`` (app and more) with the status of presence (app, status); an application without one is unknown."""
    seen = presence.groupBy("app").agg(F.min("status").alias("status"))
    return apps.join(seen, "app", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))


def app_archived(records: DataFrame, app: str, aliases: dict[str, str], as_of: Column) -> DataFrame:
    """``records`` after an application was deleted: the active ones of all its names are archived at the instant."""
    gone = (F.col("status") == "active") & (app_of(F.col("source_agent"), aliases) == app)
    gone = F.coalesce(gone, F.lit(False))
    return records.withColumns({
        "status": F.when(gone, "archived").otherwise(F.col("status")),
        "updated_at": F.when(gone, as_of).otherwise(F.col("updated_at")),
    })


def presence_upserted(presence: DataFrame, changes: DataFrame) -> DataFrame:
    """(agent_id, status, seen_at, metadata) after changes of the same columns: the latest change of an agent sets what
    it names, keys of its metadata (a map) replace those of the same name, and an agent that is new is added."""
    last = changes.groupBy("agent_id").agg(F.max(F.struct("seen_at", "status", F.map_entries("metadata").alias("entries"))).alias("c"))
    both = presence.join(last, "agent_id", "full_outer")
    new = F.coalesce(F.map_from_entries("c.entries"), F.create_map().cast("map<string,string>"))
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return both.select(
        "agent_id", F.coalesce("c.status", "status").alias("status"), F.coalesce("c.seen_at", "seen_at").alias("seen_at"),
        F.map_concat(kept, new).alias("metadata"),
    )


def curator_status(records: DataFrame, plan: DataFrame, decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """(section, name, n): records by status, planned actions, open decisions by type, and the latest job's state, each
    grouped on its own and put together."""
    part = lambda df, section, name: df.groupBy(F.lit(section).alias("section"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    newest = jobs.agg(F.max_by("status", F.struct("created_at", "id")).alias("name")).where("name is not null")
    return (
        part(records, "records", "status")
        .unionByName(part(plan, "plan", "action"))
        .unionByName(part(decisions.where(F.col("review_status").isin(*ACTIONABLE)), "open", "decision_type"))
        .unionByName(newest.select(F.lit("job").alias("section"), "name", F.lit(1).cast("long").alias("n")))
    )


def output_metrics(records: DataFrame, files: DataFrame, source: str) -> DataFrame:
    """One row: what a curator left: its report files (name, length), the one with the last name first, and the records of
    its source. ``files`` may come from Spark's binaryFile reader, without the contents."""
    newest = F.max(F.struct("name", "length"))
    reports = files.agg(
        newest["name"].alias("latest_report"), F.round(F.coalesce(newest["length"], F.lit(0)) / 1024, 1).alias("latest_report_size_kb"),
        F.count("*").alias("total_reports"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1024 / 1024, 1).alias("total_reports_size_mb"),
    )
    produced = records.where(F.col("source") == source).agg(F.count("*").alias("memories_produced"))
    return reports.join(produced)


def digest(counters: DataFrame, *names: str) -> DataFrame:
    """``counters`` with ``changed``: whether any of the named ones is above zero; nulls are zero."""
    return counters.withColumn("changed", reduce(lambda a, b: a | b, (F.coalesce(F.col(n) > 0, F.lit(False)) for n in names)))


def cursor(offset: Column) -> Column:
    """The opaque cursor of an offset: its JSON in URL-safe base64; what is negative or null is zero."""
    plain = F.concat(F.lit('{"offset":'), F.greatest(F.lit(0), F.coalesce(offset, F.lit(0))).cast("string"), F.lit("}"))
    return F.translate(F.base64(F.encode(plain, "utf-8")), "+/", "-_")


def offset_of(cursor: Column) -> Column:
    """The offset that a cursor holds; zero for an empty or broken one."""
    plain = F.decode(F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64")), "utf-8")
    return F.greatest(F.lit(0).cast("long"), F.coalesce(F.get_json_object(plain, "$.offset").try_cast("long"), F.lit(0)))


def cursor_page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """``size`` rows from an offset on, with next_cursor, null on the last page. One row more is looked for, no count."""
    page = rows.orderBy(*order).offset(offset).limit(size + 1)
    nth = page.withColumn("nth", F.row_number().over(Window.orderBy(*order)))
    more = F.max("nth").over(Window.partitionBy()) > size
    following = F.when(more, cursor(F.lit(offset + size)))
    return nth.withColumn("next_cursor", following).where(F.col("nth") <= size).drop("nth")


def systemd_time(value: Column) -> Column:
    """A wall-clock time such as ``Wed 2026-08-26 15:16:17 CST``, printed by a host at +08:00, as ISO with that offset; ISO
    times and what can't be read stay as they are."""
    clock = r"^(?:[A-Za-z]+\s+)?(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})(?:\s+[A-Za-z]+)?$"
    iso = F.concat(F.regexp_extract(value, clock, 1), F.lit("T"), F.regexp_extract(value, clock, 2), F.lit("+08:00"))
    return F.when(F.trim(value).rlike(clock), iso).otherwise(value)


def transcripts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session, message_id, role, text) of messages (session, message_id, role) and their parts (message_id, place, type,
    text): the text parts in order, a line each. A message without any has an empty text. A message's parts must fit in
    a row."""
    texts = parts.where("type = 'text' and text is not null and trim(text) <> ''")
    joined = texts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.trim(p["text"])), "\n")
    both = messages.select("session", "message_id", "role").join(joined, "message_id", "left")
    return both.select("session", "message_id", "role", F.coalesce(text, F.lit("")).alias("text"))


def rejected(decisions: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, review_status, error) of the decisions asked for (id): rejected if they are still open, else as they are with
    the reason; one that is unknown has no status."""
    both = asked.select("id").distinct().join(decisions.select("id", "review_status"), "id", "left")
    open_ = F.col("review_status").isin(*ACTIONABLE)
    error = F.when(F.col("review_status").isNull(), "decision not found").when(
        ~open_, F.concat(F.lit("decision cannot be rejected from status "), F.col("review_status"))
    )
    return both.select("id", F.when(open_, "rejected").otherwise(F.col("review_status")).alias("review_status"), error.alias("error"))


def created_executions(asked: DataFrame, executions: DataFrame) -> DataFrame:
    """(run_id, decision_id, approval_kind, idempotency_key, execution_id, outcome) of requests to execute (run_id,
    decision_id, approval_kind, idempotency_key, execution_id; one row to a key).

    An execution with the same run, decision, approval and key is reused; a decision that another execution is applying
    is refused; else a new one is planned. A null decision is a batch; batches count as one decision.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = ["run_id", "_decision", "approval_kind", "idempotency_key"]
    known = executions.withColumn("_decision", name("decision_id"))
    same = known.groupBy(*key).agg(F.min("id").alias("_same"))
    busy = known.where("status = 'applying'").select("_decision", F.lit(True).alias("_busy")).distinct()
    both = asked.withColumn("_decision", name("decision_id")).join(same, key, "left").join(busy, "_decision", "left")
    outcome = F.when(F.col("_same").isNotNull(), "reused").when(F.col("_busy"), "refused").otherwise("planned")
    given = F.when(F.col("_same").isNotNull(), F.col("_same")).when(F.col("_busy").isNull(), F.col("execution_id"))
    return both.select("run_id", "decision_id", "approval_kind", "idempotency_key", given.alias("execution_id"), outcome.alias("outcome"))


def blocked_log(requests: DataFrame) -> DataFrame:
    """Ledger rows (execution_id, seq, mutation_type, entity_id, policy_reason, status, idempotency_key) of the requests
    (execution_id, nth, action_type, target_id, policy_decision, policy_reason) of executions that the policy blocked:
    numbered from 1 by nth, action and target, skipped, without a state before or after."""
    seq = F.row_number().over(Window.partitionBy("execution_id").orderBy("nth", "action_type", "target_id"))
    numbered = requests.withColumn("seq", seq).where("policy_decision <> 'allow'")
    key = F.concat_ws(":", "execution_id", "seq", "action_type", F.coalesce(F.col("target_id").cast("string"), F.lit("")))
    return numbered.select(
        "execution_id", "seq", F.col("action_type").alias("mutation_type"), F.col("target_id").alias("entity_id"), "policy_reason",
        F.lit("skipped").alias("status"), key.alias("idempotency_key"),
    )


def quality_event(packs: DataFrame) -> DataFrame:
    """(task_type, total_candidates, used_count, filtered_count, hit_rate, filter_rate) of packs (task_type,
    total_candidates, used_count) that used a record; the others leave no event."""
    n = F.greatest("total_candidates", F.lit(1))
    filtered = F.col("total_candidates") - F.col("used_count")
    return packs.where("used_count > 0").select(
        "task_type", "total_candidates", "used_count", filtered.alias("filtered_count"),
        F.round(F.col("used_count") / n, 3).alias("hit_rate"), F.round(filtered / n, 3).alias("filter_rate"),
    )
