"""Chat formatting from event logs: fold streamed deltas, edits and regenerations into messages, then render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Text without control strings: no ``<|`` is left, and every backslash is followed by e, n or p."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(
        F.replace(F.replace(role, F.lit("<\\p"), F.lit("<|")), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\")
    )


#: Code points of a streamed delta at least, and deltas of a message at most; a longer text has longer deltas.
DELTA, DELTAS = 256, 64
#: The share of messages, one in so many, that are edited or generated again.
CHANGED = 3


def streamed_log(turns: DataFrame) -> DataFrame:
    """The event log (conv_id, turn, part, seq, kind, role, text) of a chat service that ends in the given turns.

    Assistants' texts arrive as deltas after an empty message; of one in CHANGED, chosen by a hash, a first attempt is
    broken off and generated again. Other texts arrive whole, one in CHANGED of them as a draft that an edit replaces.
    seq runs through a conversation. Rows that share a turn, repeated rows too, are separate messages, in the order of
    role and text.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    body = F.coalesce("text", F.lit(""))
    size = F.greatest(F.lit(DELTA), F.ceil(F.length(body) / DELTAS).cast("int"))
    numbered = turns.select("conv_id", "turn", "role", body.alias("text"), place.alias("part"), size.alias("size"))
    last = F.expr("cast(greatest(ceil(length(text) / size), 1) - 1 AS int)")
    numbered = numbered.select(
        "conv_id", "turn", "part", "role", "text",
        F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * F.col("size") + 1, F.col("size"))).alias("pieces"),
        (F.expr(f"pmod(xxhash64(conv_id, part), {CHANGED})") == 0).alias("changed"),
    )

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    empty, first = F.lit(""), F.get("pieces", F.lit(0))
    again = F.array(event("delta", first), event("regenerate", empty))
    deltas = F.transform("pieces", lambda t: event("delta", t))
    streamed = F.concat(F.array(event("message", empty)), F.when(F.col("changed"), again).otherwise(F.slice(again, 1, 0)), deltas)
    edited = F.array(event("message", first), event("edit", F.col("text")))
    written = F.when(F.col("changed"), edited).otherwise(F.array(event("message", F.col("text"))))
    events = F.when(F.col("role") == "assistant", streamed).otherwise(written)
    log = numbered.select("conv_id", "turn", "part", "role", F.posexplode(events).alias("nth", "event"))
    seq = F.col("part").cast("long") * (DELTAS + 8) + F.col("nth")
    role = F.when(F.col("nth") == 0, F.col("role"))
    return log.select("conv_id", "turn", "part", seq.alias("seq"), "event.kind", role.alias("role"), "event.text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, part, role, text) of a log (conv_id, turn, part, seq, kind, role, text).

    (turn, part) is a message's place in its conversation; seq orders the events of a conversation. ``message`` and
    ``edit`` set a message's text, ``delta`` appends to it, ``regenerate`` sets it anew and withdraws the messages of
    later turns that were last set, or if never set began, before it. Logs may be delivered more than once: events of a
    message with equal seq and text count once; those with equal seq alone follow in the order of their texts. A null
    seq comes before all others. A null text is empty, an unknown or null kind counts as ``delta``; the role is the last
    that is not null, else empty.
    """
    message = ["conv_id", "turn", "part"]
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63)))
    sets = F.coalesce(F.col("kind").isin("message", "edit", "regenerate"), F.lit(False))
    folded = events.groupBy(*message).agg(
        F.collect_set(F.struct(seq.alias("seq"), F.coalesce("text", F.lit("")).alias("text"))).alias("pieces"),
        F.max(F.when(sets, seq)).alias("set"),
        F.min(seq).alias("first"),
        F.max(F.when(F.col("role").isNotNull(), F.struct(seq.alias("seq"), "role")))["role"].alias("role"),
        F.max(F.when(F.col("kind") == "regenerate", seq)).alias("again"),
    )
    since = F.coalesce("set", "first")
    live = F.filter(F.array_sort("pieces"), lambda x: x["seq"] >= since)
    before = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    kept = folded.select(
        *message,
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
        F.coalesce(F.max("again").over(before) > since, F.lit(False)).alias("withdrawn"),
    )
    return kept.where("not withdrawn").drop("withdrawn")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of messages (conv_id, turn, part, role, text).

    A message is rendered as its marks around the escaped role, a line feed and the escaped text. ``loss`` lists where
    the assistants' texts are: the number of the message in ``formatted`` and start and length, in code points, within
    what stands between its start mark and the next. One conversation is one string and so must fit in a row.
    """
    body, head = escape(F.col("text")), escape_role(F.col("role"))
    piece = F.concat(F.lit(START), head, F.lit("\n"), body, F.lit(f"{END}\n"))
    place = Window.partitionBy("conv_id").orderBy("turn", "part")
    rows = messages.select(
        "conv_id",
        (F.row_number().over(place) - 1).alias("number"),
        piece.alias("piece"),
        (F.length(head) + 1).alias("start"),
        F.length(body).alias("length"),
        (F.col("role") == "assistant").alias("assistant"),
    )
    spans = F.collect_list(F.when(F.col("assistant"), F.struct("number", "start", "length")))
    return rows.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("number", "piece"))), lambda x: x["piece"]), ""
        ).alias("formatted"),
        F.array_sort(spans).alias("loss"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learned): the turns (role, text) and the unescaped texts under the loss mask."""
    marked = rendered.withColumn("pieces", F.expr("slice(split(formatted, '<\\\\|im_start\\\\|>'), 2, 2147483647)"))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = piece.substr(F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    def under(span: Column) -> Column:
        return unescape(F.get(F.col("pieces"), span["number"]).substr(span["start"] + 1, span["length"]))

    return marked.select(
        "conv_id",
        "formatted",
        F.transform("pieces", turn).alias("turns"),
        F.transform("loss", under).alias("learned"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of plain turns (conv_id, turn, role, text; more columns are ignored): their log is
    folded into messages, which are rendered.

    Null texts and roles are empty; a null turn comes first; rows with a null conv_id are one conversation. An empty
    table gives an empty result.
    """
    return render(fold_events(streamed_log(turns.select("conv_id", "turn", "role", "text"))))
