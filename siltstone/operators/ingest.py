"""Ingest of new facts: likeness within a batch, title matches, decisions by nearest neighbours, and transfer merges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.functions import text
from siltstone.model import DEDUP, DEDUP_OTHER
from siltstone.operators.first_wins import first_wins
from siltstone.sources.scratch import broadcast_if_small, numbered, written

#: Facts of a block of a batch that are compared at once, and pairs that a task passes on at once.
ALIKE, PAIRS = 1024, 10_000
WORDS = re.compile(r"[\w一-鿿]+")


def alike_in_batch(facts: DataFrame, least: float = 0.55, block: int = ALIKE) -> DataFrame:
    """(batch, a, b, likeness) of facts (batch, id, text) of one batch whose character bigrams overlap so far.

    Bigrams of letters are so common that nearly all facts of a batch share even the rarer ones, so all of its pairs are
    looked at. A batch is dealt to blocks of about ``block`` facts by a hash of the id, and each two blocks are a tile; tiles come one
    after the other in a task, which holds one of them. In a tile, a fact's shared bigrams with all others are counted at
    once from the postings of its own.
    """
    told = facts.where("batch is not null and id is not null and text is not null").select("batch", "id", F.trim(F.lower("text")).alias("text"))
    blocks = told.groupBy("batch").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = told.join(blocks, "batch", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiles = dealt.select("batch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "text")
    tiles = tiles.repartition("batch", "i", "j").sortWithinPartitions("batch", "i", "j")
    kinds = [facts.schema[c].dataType for c in ("batch", "id")]
    schema = StructType([StructField(n, k) for n, k in zip(("batch", "a", "b", "likeness"), (kinds[0], kinds[1], kinds[1], DoubleType()))])
    return tiles.mapInArrow(_alike_in_tiles(least, *map(to_arrow_type, kinds)), schema)


def _alike_in_tiles(least: float, batch_type: pa.DataType, id_type: pa.DataType):
    """(batch, a, b, likeness) by rows (batch, i, j, own, id, text) that come tile by tile: pairs within block i where i is
    j, else those between the two blocks."""

    def compare(batch, within: bool, rows: list[tuple]) -> Iterator[tuple]:
        sets = [{t[k : k + 2] for k in range(len(t) - 1)} if len(t) > 1 else {t} for _, _, t in rows]
        own, sizes = np.array([r[0] for r in rows]), np.array([len(s) for s in sets])
        holders: dict[str, list[int]] = {}
        for r, grams in enumerate(sets):
            for g in grams:
                holders.setdefault(g, []).append(r)
        held = {g: np.array(r) for g, r in holders.items() if len(r) > 1}
        for r, grams in enumerate(sets):
            postings = [held[g] for g in grams if g in held]
            if not postings:
                continue
            shared = np.bincount(np.concatenate(postings), minlength=len(rows))
            ratio = shared / (sizes[r] + sizes - shared)
            near = (ratio >= least) & (shared > 0)
            for o in np.flatnonzero(near if within else near & (own != own[r])):
                if rows[r][1] < rows[o][1]:
                    yield batch, rows[r][1], rows[o][1], float(ratio[o])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tile, rows = None, []
        for some in batches:
            for *key, own, id_, t in zip(*(some.column(c).to_pylist() for c in ("batch", "i", "j", "own", "id", "text"))):
                if key != tile:
                    if len(rows) > 1:
                        yield from compare(tile[0], tile[1] == tile[2], rows)
                    tile, rows = key, []
                rows.append((own, id_, t))
        if len(rows) > 1:
            yield from compare(tile[0], tile[1] == tile[2], rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tiles(batches)
        while some := list(islice(found, PAIRS)):
            kinds = (batch_type, id_type, id_type, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["batch", "a", "b", "likeness"])

    return run


def first_of_batch(facts: DataFrame, least: float = 0.55) -> DataFrame:
    """Facts (batch, id, text) none of whose earlier facts in the batch, kept or not, is alike: one in each run of
    rewordings, without a sequential pass."""
    later = alike_in_batch(facts, least).select("batch", F.col("b").alias("id")).distinct()
    return facts.join(later, ["batch", "id"], "left_anti")


def greedy_of_batch(facts: DataFrame, least: float = 0.55) -> DataFrame:
    """(batch, id) of facts that no kept earlier fact of the batch is like, as one pass in order would keep them; by
    parallel rounds over the pairs (``first_wins``), so a batch may be of any size. Of repeated rows one counts."""
    key = ["batch", "id"]
    end = lambda c: F.struct("batch", F.col(c).alias("id")).alias(c)
    pairs = alike_in_batch(facts, least).select(end("a"), end("b"))
    rows = facts.select(*key).dropna().distinct()
    return first_wins(rows, pairs, key, [F.col("batch"), F.col("id")]).where("kept").select(*key)


def title_matches(facts: DataFrame, memories: DataFrame) -> DataFrame:
    """(fact_id, memory_id): the most effective active record of a fact's (id, type, title) type and title, in any case."""
    active = memories.where("status = 'active'").select(
        F.col("id").alias("memory_id"), "type", F.lower(F.trim("title")).alias("key"), "effectiveness_score", "updated_at"
    )
    best = F.max_by("memory_id", F.struct("effectiveness_score", "updated_at", (-F.col("memory_id")).alias("i")))
    heads = active.groupBy("type", "key").agg(best.alias("memory_id"))
    keyed = facts.select(F.col("id").alias("fact_id"), "type", F.lower(F.trim("title")).alias("key"))
    return keyed.join(heads, ["type", "key"]).select("fact_id", "memory_id")


def redacted(rows: DataFrame, column: str = "text") -> DataFrame:
    """``rows`` with ``column`` redacted, and redacted_count and labels: how many secrets went, and of which kinds.

    Kinds are applied one after the other, each to what the one before left, and tokens of high entropy last. A text is
    searched for a kind only if it holds one of its signs. A null text is empty.
    """
    out = rows.withColumn(column, F.coalesce(column, F.lit(""))).withColumn("_count", F.lit(0)).withColumn("_labels", F.array().cast("array<string>"))
    for label, pattern, new in text.SECRETS:
        low = F.lower(column)
        sign = reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in text.SECRET_SIGNS[label]))
        out = out.withColumn("_n", F.when(sign, F.regexp_count(column, F.lit(pattern))).otherwise(0))
        out = out.withColumns({
            column: F.when(F.col("_n") > 0, F.regexp_replace(column, pattern, new)).otherwise(F.col(column)),
            "_count": F.col("_count") + F.col("_n"),
            "_labels": F.when(F.col("_n") > 0, F.array_append("_labels", F.lit(label))).otherwise(F.col("_labels")),
        })
    out = out.withColumn("_n", F.size(text.entropic_tokens(F.col(column))))
    out = out.withColumn(column, F.when(F.col("_n") > 0, text.redact_entropic(F.col(column))).otherwise(F.col(column)))
    labels = F.when(F.col("_n") > 0, F.array_append("_labels", F.lit("high_entropy"))).otherwise(F.col("_labels"))
    return out.withColumns({"redacted_count": (F.col("_count") + F.col("_n")).cast("long"), "labels": labels}).drop("_n", "_count", "_labels")


def matches(facts: DataFrame, rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(fact_id, memory_id, score) of the rows (memory_id, unit) whose product with a fact (fact_id, unit) is at least
    ``least``, and of each fact's nearest row, itself left out.

    Facts and rows are cut into blocks by a hash; each pair of blocks is a product of two matrices in one task, which
    passes on a fact's best row of the block and those that are near enough.
    """
    of_facts, of_rows = (max(1, -(-df.count() // block)) for df in (facts, rows))
    ours = facts.select(F.col("fact_id").alias("id"), "unit", F.lit(True).alias("is_fact"))
    theirs = rows.select(F.col("memory_id").alias("id"), "unit", F.lit(False).alias("is_fact"))
    ours = ours.withColumn("i", F.expr(f"pmod(xxhash64(id), {of_facts})")).withColumn("j", F.explode(F.expr(f"sequence(0L, {of_rows - 1}L)")))
    theirs = theirs.withColumn("j", F.expr(f"pmod(xxhash64(id), {of_rows})")).withColumn("i", F.explode(F.expr(f"sequence(0L, {of_facts - 1}L)")))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        a, b = tile[tile["is_fact"]], tile[~tile["is_fact"]].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"fact_id": [], "memory_id": [], "score": []})
        score = np.stack(a["unit"].to_list()) @ np.stack(b["unit"].to_list()).T
        score[a["id"].to_numpy()[:, None] == b["id"].to_numpy()] = -np.inf
        kept = score >= least
        kept[np.arange(len(a)), score.argmax(axis=1)] = True
        kept &= score > -np.inf
        i, j = np.nonzero(kept)
        return pd.DataFrame({"fact_id": a["id"].to_numpy()[i], "memory_id": b["id"].to_numpy()[j], "score": score[i, j]})

    return ours.unionByName(theirs).groupBy("i", "j").applyInPandas(compare, "fact_id long, memory_id long, score double")


def thresholds(kind: Column) -> Column:
    """(skip, update, link) of a type."""

    def triple(t: tuple[float, float, float]) -> Column:
        return F.struct(*(F.lit(x).alias(n) for n, x in zip(("skip", "update", "link"), t)))

    out = triple(DEDUP_OTHER)
    for name, t in DEDUP.items():
        out = F.when(kind == name, triple(t)).otherwise(out)
    return out


def decisions(facts: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(id, action, existing_id, similarity, linked): what becomes of facts (id, type), given neighbours (fact_id,
    memory_id, score). The nearest decides; a new fact is linked with those that are near enough."""
    t = thresholds(F.col("type"))
    both = facts.select("id", "type").join(neighbours, F.col("id") == F.col("fact_id"), "left").withColumn("t", t)
    top = F.max(F.when(F.col("memory_id").isNotNull(), F.struct("score", (-F.col("memory_id")).alias("m"))))
    near = F.when((F.col("score") >= F.col("t.link")) & (F.col("score") < F.col("t.update")), F.col("memory_id"))
    out = both.groupBy("id", "type").agg(top.alias("top"), F.array_sort(F.collect_set(near)).alias("near"))
    out = out.withColumn("t", t)
    score = F.col("top.score")
    action = F.when(score >= F.col("t.skip"), "skip").when(score >= F.col("t.update"), "update").otherwise("add")
    out = out.withColumn("action", action)
    known = F.col("action") != "add"
    none = F.array().cast("array<long>")
    return out.select(
        "id", "action", F.when(known, -F.col("top.m")).alias("existing_id"), F.coalesce(score, F.lit(0.0)).alias("similarity"),
        F.when(known, none).otherwise(F.col("near")).alias("linked"),
    )


def merged(existing: DataFrame, incoming: DataFrame, policy: str, key: str = "id", time: str = "updated_at") -> DataFrame:
    """``existing`` after an import: skip keeps what is there, replace takes what comes, newer the later of both, and
    full_replace drops what does not come. Both have the same columns and unique keys."""
    columns = existing.columns
    if policy == "full_replace":
        return incoming.select(*columns)
    old = existing.select(F.struct(*columns).alias("old"), F.col(key).alias("_k"))
    new = incoming.select(F.struct(*columns).alias("new"), F.col(key).alias("_k"))
    both = old.join(new, "_k", "full_outer")
    taken = {"skip": F.lit(False), "replace": F.lit(True), "newer": F.col(f"new.{time}") > F.col(f"old.{time}")}[policy]
    row = F.when(F.col("old").isNull() | (F.col("new").isNotNull() & taken), F.col("new")).otherwise(F.col("old"))
    return both.select(row.alias("row")).select("row.*")


def import_counts(existing: DataFrame, incoming: DataFrame, key: str = "id", time: str = "updated_at") -> DataFrame:
    """One row: how many incoming rows are new, in conflict, and newer: a dry run of every policy."""
    both = incoming.select(key, F.col(time).alias("new")).join(existing.select(key, F.col(time).alias("old"), F.lit(True).alias("there")), key, "left")
    return both.agg(
        F.count_if(F.col("there").isNull()).alias("inserted"), F.count_if(F.col("there")).alias("conflicts"),
        F.count_if(F.col("new") > F.col("old")).alias("newer"),
    )


#: Characters of the strings that bound what two texts have in common, and the length from which difflib passes over
#: frequent characters: a fixed value of its.
GRAM, LONG = 8, 200
#: Bits that a text's strings fall on.
BITS = 1 << 16


class Told:
    """A text, and what bounds the characters that difflib can match of it: its strings of GRAM characters, repeats
    numbered, as hashes; how many of these fell together; and how many of its characters are rare (None below LONG)."""

    def __init__(self, text: str):
        self.text, self.words = text, frozenset(WORDS.findall(text))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        self.size, self.rare, self.merged, self.grams, self.bits, self.shared = len(codes), None, 0, frozenset(), 0, 0
        if self.size >= LONG:
            counts = np.unique(codes, return_counts=True)[1]
            self.rare = int(counts[counts <= self.size // 100 + 1].sum())
        if self.size >= GRAM:
            odd, n = np.uint64(0x9E3779B97F4A7C15), self.size - GRAM + 1
            h = np.zeros(n, dtype=np.uint64)
            for j in range(GRAM):
                h = (h ^ (h >> np.uint64(29))) * odd + codes[j : n + j]
            h = np.sort(h)
            first = np.concatenate([[True], h[1:] != h[:-1]])
            nth = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
            h = (h + nth.astype(np.uint64)) * odd
            self.grams = frozenset(h.tolist())
            self.merged = n - len(self.grams)
            marks = np.zeros(BITS, dtype=np.uint8)
            marks[h >> np.uint64(48)] = 1
            self.bits, self.shared = int.from_bytes(np.packbits(marks).tobytes()), len(self.grams) - int(marks.sum())

    def ratio_with(self, old: Told, rough: bool = False) -> float:
        """The most that difflib's ratio of this text and an older one can be; ``rough`` takes the bits that the strings
        fall on for the strings, which is quick and never less.

        It matches blocks in order. From LONG characters on, a block must hold a character that is rare in the older
        text, but for one at the very start, so there are at most rare + 1. Each block of n characters has n - GRAM + 1
        strings of GRAM characters, which both texts hold; so all blocks have at most as many characters as the
        texts have such strings in common, and GRAM - 1 more for each block.
        """
        most = min(self.size, old.size)
        if old.rare is not None and most:
            common = (self.bits & old.bits).bit_count() + self.shared if rough else len(self.grams & old.grams)
            most = min(most, common + self.merged + (old.rare + 1) * (GRAM - 1))
        return 2 * most / (self.size + old.size) if self.size + old.size else 1.0


def _likeness(new: Told, old: Told, cosine: float | None, least: float) -> float | None:
    """.65 of the matching-blocks ratio of two texts and .35 of their words' Jaccard; where there is a cosine, .4 of that
    and .6 of the cosine; None below ``least``. The ratio is computed only where its upper bounds, by lengths, by common
    strings and by letters, leave a chance."""
    both = len(new.words & old.words) if new.words and old.words else 0
    words = both / (len(new.words) + len(old.words) - both) if new.words and old.words else None

    def blended(ratio: float) -> float:
        out = ratio if words is None else round(ratio * 0.65 + words * 0.35, 4)
        return out if cosine is None else round(cosine * 0.6 + out * 0.4, 4)

    shortest = 2 * min(new.size, old.size) / (new.size + old.size) if new.size + old.size else 1.0
    if blended(shortest) < least or blended(new.ratio_with(old, rough=True)) < least or blended(new.ratio_with(old)) < least:
        return None
    matcher = SequenceMatcher(None, new.text, old.text)
    out = blended(matcher.quick_ratio())
    out = out if out < least else blended(matcher.ratio())
    return None if out < least else out


def auto_supersessions(
    memories: DataFrame, vectors: DataFrame | None = None, auto: float = 0.88, review: float = 0.72, newest: int = 50
) -> DataFrame:
    """(old_id, new_id, likeness, action): active records of one type, scope and project whose lower-cased titles and
    contents, as a whole, are alike, and whose ``vectors`` (id, unit) are where both have one; if either is precious
    they are left to review. Each record is compared with the ``newest`` records before it at most; one without a type,
    scope or project is compared with none. Ids are unique.

    Records are numbered by ranges and meet by blocks of ``newest`` numbers: a record joins its own block and the next,
    whatever the size of its group, so a task compares at most ``newest`` records with twice as many. Texts travel once for
    each of these; what is computed of them doesn't. Exact bounds decide whether difflib runs for a pair.
    """
    least, group = min(auto, review), ["type", "scope", "project_path"]
    whole = F.lower(F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))))
    active = memories.where("status = 'active'").dropna(subset=group)
    places = numbered(active.select("id", *group, "updated_at"), group, [F.desc("updated_at"), F.asc("id")]).select("id", "nth")
    precious = F.col("type").isin("user_profile", "decision", "environment_fact") | (F.coalesce("importance", F.lit(0.0)) >= 0.85)
    precious = precious | (F.coalesce("feedback_score", F.lit(0.0)) > 0)
    active = active.select("id", *group, precious.alias("precious"), whole.alias("text"))
    if vectors is None:
        active = active.withColumn("unit", F.lit(None).cast("array<double>"))
    else:
        active = active.join(vectors.select("id", "unit"), "id", "left")
    active = active.join(places, "id").withColumn("block", F.floor(F.col("nth") / newest))
    own_or_next = F.explode(F.array(F.col("block"), F.col("block") + 1))
    later = active.select(*(F.col(c).alias(c) for c in active.columns if c != "block"), own_or_next.alias("block"))

    def compare(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = [[(r.id, r.nth, r.precious, r.unit, Told(r.text)) for r in side.itertuples()] for side in (old, new)]
        for old_id, old_nth, old_precious, old_unit, old_told in known[0]:
            for new_id, new_nth, new_precious, new_unit, new_told in known[1]:
                if new_nth < old_nth <= new_nth + newest:
                    both = old_unit is not None and new_unit is not None
                    cosine = float(sum(x * y for x, y in zip(old_unit, new_unit))) if both else None
                    likeness = _likeness(new_told, old_told, cosine, least)
                    if likeness is not None:
                        out.append((old_id, new_id, likeness, "review" if likeness < auto or old_precious or new_precious else "supersede"))
        return pd.DataFrame(out, columns=["old_id", "new_id", "likeness", "action"])

    kind = memories.schema["id"].dataType.simpleString()
    both = active.groupBy(*group, "block").cogroup(later.groupBy(*group, "block"))
    return both.applyInPandas(compare, f"old_id {kind}, new_id {kind}, likeness double, action string")


def clustered(records: DataFrame, least: float = 0.85, tile: int = 1024) -> DataFrame:
    """(id, leader): ranked records (rank, id, unit), each under the first leader so near; those without a unit lead
    themselves alone.

    Near records are found by products of blocks (``near_pairs``); who leads, by parallel rounds (``first_wins``), so a
    whole table may be clustered.
    """
    rows = written(records.select("rank", "id", "unit"), "ranked")
    pairs = near_pairs(rows.where("unit is not null").select("id", "unit"), least, tile)
    pairs = pairs.select(F.struct(F.col("a").alias("id")).alias("a"), F.struct(F.col("b").alias("id")).alias("b"))
    out = first_wins(rows.select("id", "rank"), pairs, ["id"], [F.col("rank"), F.col("id")])
    return out.select("id", F.col("leader.id").alias("leader"))


def near_pairs(units: DataFrame, least: float, tile: int = 1024) -> DataFrame:
    """(a, b) of all rows (id, unit) of equal length whose product is at least ``least``, a before b: rows are dealt to
    blocks of about ``tile`` by a hash, and each pair of blocks is a product of two matrices in one task."""
    given = units.withColumn("width", F.size("unit"))
    blocks = given.groupBy("width").agg(F.ceil(F.count("*") / tile).cast("long").alias("blocks"))
    dealt = given.join(broadcast_if_small(blocks), "width").withColumn("own", F.expr("pmod(xxhash64(id, 23), blocks)"))
    every = F.explode(F.expr("sequence(0L, blocks - 1)"))
    met = dealt.withColumn("other", every).select("id", "unit", "width", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = units.schema["id"].dataType.simpleString()

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        ours, theirs = part[part["own"] == i], part[part["own"] == j]
        if not len(ours) or not len(theirs):
            return pd.DataFrame({"a": [], "b": []})
        x, y = ours["id"].to_numpy(), theirs["id"].to_numpy()
        near = np.stack(ours["unit"].to_list()) @ np.stack(theirs["unit"].to_list()).T >= least
        r, c = np.nonzero(near & (x[:, None] < y) if i == j else near)
        return pd.DataFrame({"a": np.minimum(x[r], y[c]), "b": np.maximum(x[r], y[c])})

    return met.groupBy("width", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")
