"""Transfer files, archives and transcripts, all read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table. A table's folder appears whole or not at all."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


#: The tables of each kind of export, in order: fixed values.
TABLE_SETS = {
    "full": [
        "memories", "feedback_events", "memory_links", "memory_entities", "governance_decisions", "governance_executions",
        "governance_mutation_log", "governance_runs", "curator_review_log", "llm_curator_batches", "llm_curator_jobs",
        "context_quality_events", "agent_messages", "agent_presence", "agent_capabilities",
    ],
    "transfer": ["memories", "feedback_events", "memory_links", "agent_messages", "agent_presence"],
    "sync": ["memories", "feedback_events", "memory_links", "memory_entities"],
}


def export_set(tables: dict[str, DataFrame], path: str, kind: str = "transfer", audit: bool = False) -> DataFrame:
    """Exports the tables of one kind and returns (table, rows) in its order; a table that is not there has 0 rows.

    ``audit`` adds the audit's events, though never to the kind ``sync``. The rows counted are those written.
    """
    names = TABLE_SETS[kind] + (["audit_events"] if audit and kind != "sync" else [])
    there = {n: tables[n] for n in names if n in tables}
    if not there:
        raise ValueError(f"no table of the kind {kind!r} is given")
    export_json(there, path)
    spark = next(iter(there.values())).sparkSession
    listed = spark.createDataFrame(list(enumerate(names)), "place int, table string")
    counts = listed.limit(0).select("table", F.lit(0).cast("long").alias("rows"))
    for name in there:
        lines = spark.read.schema("value string").text(f"{path}/{name}")
        counts = counts.unionByName(lines.agg(F.lit(name).alias("table"), F.count("*").alias("rows")))
    return listed.join(counts, "table", "left").orderBy("place").select("table", F.coalesce("rows", F.lit(0)).alias("rows"))


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A backup: each table as Parquet under its name. A folder that is there already is an error and stays."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of an export, read by their schemas; nothing is inferred."""
    return {name: spark.read.schema(kind).json(f"{path}/{name}") for name, kind in schemas.items()}


def exported_at(tables: dict[str, DataFrame], time: str = "updated_at") -> DataFrame:
    """One row: the latest change in any table."""
    each = [df.agg(F.max(time).alias("at")) for df in tables.values() if time in df.columns]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out.agg(F.max("at").alias("exported_at"))


def write_archive(rows: DataFrame, path: str, table: str, batch: str) -> DataFrame:
    """Archives rows as gzipped JSON lines under table and batch, with a manifest beside them, and returns the manifest.

    The digest is that of the rows' number and of four sums over pieces of their digests: it doesn't depend on the order,
    gathers no list, and shows damage, though it is no proof against forgery.
    """
    to = f"{path}/{table}/{batch}"
    rows.write.option("compression", "gzip").json(f"{to}/data")
    read = rows.sparkSession.read.schema("value string").text(f"{to}/data")
    line = F.sha2("value", 256)
    piece = lambda k: F.conv(F.substring(line, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(piece(k)), F.lit(0)).cast("string") for k in range(4)]
    manifest = read.agg(
        F.lit(table).alias("table"), F.lit(batch).alias("batch"), F.count("*").alias("rows"),
        F.coalesce(F.sum(F.length("value").cast("long")), F.lit(0)).alias("chars"),
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("sha256"),
    )
    manifest.coalesce(1).write.json(f"{to}/manifest")
    return rows.sparkSession.read.schema(MANIFEST).json(f"{to}/manifest")


MANIFEST = "table string, batch string, rows long, chars long, sha256 string"


def archive_stats(spark: SparkSession, path: str) -> DataFrame:
    """(table, batches, rows, chars) over all manifests."""
    found = spark.read.schema(MANIFEST).json(f"{path}/*/*/manifest")
    return found.groupBy("table").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("chars").alias("chars"))


#: The fields of a transcript's line that some layout reads. What may be a string, an object or an array stays JSON text.
LINE = (
    "type string, role string, author string, speaker string, displayContent string, content string, text string, "
    "message string, payload struct<type: string, role: string, message: string, content: string>"
)
BLOCKS = "array<struct<type: string, text: string, input_text: string, output_text: string>>"
LAYOUTS = ("messages", "events", "turns")


def _joined(value: Column, said: Column) -> Column:
    """The texts of an array's blocks, joined by blanks; null where ``value`` is no array of objects."""
    blocks = F.when(F.ltrim(value).startswith("["), F.from_json(value, BLOCKS))
    return F.when(blocks.isNotNull(), F.array_join(F.filter(said, lambda t: t != ""), " "))


def _text(value: Column) -> Column:
    """A string as it is, or the text blocks of an array."""
    blocks = F.filter(F.from_json(value, BLOCKS), lambda b: F.coalesce(b["type"], F.lit("text")) == "text")
    return F.coalesce(_joined(value, F.transform(blocks, lambda b: b["text"])), value)


def transcripts(spark: SparkSession, path: str, layout: str = "messages", chars: int | None = None) -> DataFrame:
    """(file, line, role, text) of transcripts as JSON lines, ``line`` rising within a file; texts are whole, or cut to ``chars``.

    ``messages``: a role and a content, at the top or under ``message``. ``events``: user and agent messages as events;
    the response items of a file count only where it has no such event. ``turns``: the role under any of four names,
    ``model`` and ``gemini`` being the assistant. Contents are strings or arrays of blocks. Lines that can't be read, have
    another role or lack a text are passed over.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout {layout!r} is none of {LAYOUTS}")
    raw = spark.read.schema(LINE).json(path).withColumns(
        {"file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()}
    )
    inner = F.from_json("message", "role string, content string")
    is_object = F.ltrim("message").startswith("{")
    if layout == "messages":
        role = F.when(is_object, inner["role"]).otherwise(F.col("role"))
        found = raw.select("file", "line", role.alias("role"), _text(F.when(is_object, inner["content"]).otherwise(F.col("content"))).alias("text"))
    elif layout == "turns":
        named = [F.when(F.col(c) != "", F.col(c)) for c in ("role", "author", "speaker", "type")]
        role = F.coalesce(*named)
        role = F.when(role.isin("model", "gemini"), "assistant").otherwise(role)
        text = F.coalesce(F.when(F.col("displayContent") != "", F.col("displayContent")), "content", "text", "message")
        found = raw.select("file", "line", role.alias("role"), _text(text).alias("text"))
    else:
        kind, items = F.col("payload.type"), F.from_json("payload.content", BLOCKS)
        filled = lambda t: F.when(t != "", t)
        said = F.transform(items, lambda b: F.coalesce(filled(b["text"]), filled(b["input_text"]), filled(b["output_text"])))
        speaker = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant")
        events = raw.where("type = 'event_msg'").select("file", "line", speaker.alias("role"), F.col("payload.message").alias("text"))
        replies = raw.where("type = 'response_item' and payload.type = 'message'").select(
            "file", "line", F.col("payload.role").alias("role"), _joined(F.col("payload.content"), said).alias("text")
        )
        events = _spoken(events)
        found = events.unionByName(replies.join(events.select("file").distinct(), "file", "left_anti"))
    found = _spoken(found)
    return found if chars is None else found.withColumn("text", F.substring("text", 1, chars))


def _spoken(rows: DataFrame) -> DataFrame:
    """The rows of a user or assistant that have a text, with it trimmed."""
    trimmed = rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    return trimmed.where("role in ('user', 'assistant') and text <> ''")
