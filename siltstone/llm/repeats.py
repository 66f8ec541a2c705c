"""Repeated passages: every byte covered by a string of 200 bytes that also starts elsewhere, found by suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, inner_name, small, texts
from siltstone.llm.shingles import constants, mix
from siltstone.llm.suffixes import Shard, merged

#: Bytes of a window.
LENGTH = 200
#: Bytes of a text that are hashed together, bytes of a shard, and different texts of one key that may share a task.
PIECE, SHARD, GROUP = 4 << 20, 1 << 20, 400

_PLACE = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _sums(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and what makes a difference of two independent of its place."""
    n = 1 << max(16, int(len(data)).bit_length())
    power, inverse = _powers(_BASES[which], n)
    value = constants(31 + which, 256)[data]
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(value * power[: len(data)], dtype=np.uint64)]), inverse


def stretches(parts: list[bytes], length: int) -> list[np.ndarray]:
    """The windows of ``length`` bytes of each text, in stretches that share their least inner string: arrays of text,
    start, number of windows, places of that string from the start, its hash, and the hash of the whole stretch.

    The inner strings have about a sixth of a window's bytes; of those in a window the one with the least hash is
    taken, the first of equal ones. So equal windows, wherever they stand, have equal inner strings at equal places.
    """
    core = max(1, length * 4 // 25)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    n = len(data)
    if n < length:
        return [np.empty(0, dtype=np.int64)] * 6
    begins = np.cumsum(sizes) - sizes
    sums, inverse = _sums(data, 0)
    inner = mix((sums[core:] - sums[:-core]) * inverse[: n - core + 1])
    least = (inner & ~_PLACE) | np.arange(len(inner), dtype=np.uint64)
    wide, reach = length - core + 1, 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    windows = n - length + 1
    least = np.minimum(least[:windows], least[wide - reach : wide - reach + windows])
    at = (least & _PLACE).astype(np.int64)
    place = np.arange(windows)
    whole = place + length <= np.repeat(begins + sizes, sizes)[:windows]
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | fresh[1:]
    first, last = np.flatnonzero(fresh), np.flatnonzero(last)
    text = np.searchsorted(begins, first, side="right") - 1
    ahead, count = at[first] - first, last - first + 1
    sums, inverse = _sums(data, 1)
    digest = (sums[last + length] - sums[first]) * inverse[first]
    shape = mix((count * 4096 + ahead).astype(np.uint64) * constants(33, 1))
    return [text, first - begins[text], count, ahead, inner[at[first]].view(np.int64), mix(digest + shape).view(np.int64)]


def _stretches(length: int) -> Callable:
    names = ["id", "hash", "start", "windows", "ahead", "key", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
            for row, part in texts(batch.column("text"), 1 << 19):
                for offset in range(0, max(len(p) for p in part), PIECE):
                    cut = [p[offset : offset + PIECE + length - 1] for p in part]
                    text, start, count, ahead, key, digest = stretches(cut, length)
                    columns = [ids[row + text], hashes[row + text], start + offset, count, ahead, key, digest]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _searched(length: int) -> Callable:
    """(id, hash, start, end): the places in a document from which windows also start elsewhere.

    Rows come sorted by key, and are dealt to shards of about SHARD bytes. Within a shard its suffix array tells. The
    windows of a key whose rows go on in the next shard are kept as a sorted run and merged with that shard's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[dict, np.ndarray]] = []
        key, kept, owner = None, np.empty(0, dtype=f"S{length}"), np.empty((0, 2), dtype=np.int64)
        for rows in _shards(batches):
            shard = Shard([r["text"] for r in rows], length)
            marks = [shard.found[b : b + s].copy() for b, s in zip(shard.begins, shard.sizes)]
            keys = [r["key"] for r in rows]
            if keys[0] != key:
                yield from _places(waiting)
                waiting, key, kept, owner = [], keys[0], kept[:0], owner[:0]
            ends = [i + 1 for i in range(len(keys)) if i + 1 == len(keys) or keys[i + 1] != keys[i]]
            goes_on = ends[0]
            if waiting or len(ends) == 1:
                own, at = shard.run(0, goes_on)
                row = np.searchsorted(shard.begins, at, side="right") - 1
                to, hit_kept, hit = merged(kept, own)
                for i, r in owner[hit_kept]:
                    waiting[i][1][r] = True
                for i, r in zip(row[hit], (at - shard.begins[row])[hit]):
                    marks[i][r] = True
                new = ~hit
                kept = np.insert(kept, to[new], own[new])
                mine = np.stack([row + len(waiting), at - shard.begins[row]], axis=1)
                owner = np.insert(owner, to[new], mine[new], axis=0)
            waiting += zip(rows[:goes_on], marks[:goes_on])
            if len(ends) > 1:
                yield from _places(waiting)
                begin = ends[-2]
                yield from _places(list(zip(rows[goes_on:begin], marks[goes_on:begin])))
                kept, at = shard.run(begin, len(rows))
                row = np.searchsorted(shard.begins, at, side="right") - 1
                owner = np.stack([row - begin, at - shard.begins[row]], axis=1)
                waiting, key = list(zip(rows[begin:], marks[begin:])), keys[-1]
        yield from _places(waiting)

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append(row)
            size += len(row["text"])
            if size >= SHARD:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _places(rows: list[tuple[dict, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    out = []
    for row, marks in rows:
        if row["open"] and marks.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
            out += [(row["id"], row["hash"], row["start"] + s, row["start"] + e - 1) for s, e in edges.reshape(-1, 2).tolist()]
    if out:
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "first", "last"])


def _halves(length: int) -> Column:
    """Each row's windows in two rows: those whose inner string lies at most as far from their start as the middle of the
    range allowed so far (``low`` to ``high``), and the others. All windows of such a half share a longer string, which
    is the half's key."""
    middle = F.expr("(low + high) div 2")

    def half(low: Column, high: Column) -> Column:
        skip = F.greatest(F.col("ahead") - high, F.lit(0))
        count = F.least(F.col("windows") - 1, F.col("ahead") - low) - skip + 1
        ahead = F.col("ahead") - skip
        text = F.substring("text", skip + 1, F.greatest(count, F.lit(0)) + (length - 1))
        core = F.substring(text, ahead - low + 1, F.lit(length) - high + low)
        return F.struct(
            (F.col("start") + skip).alias("start"), count.alias("windows"), ahead.alias("ahead"), low.alias("low"),
            high.alias("high"), F.xxhash64(core, low, high).alias("key"), F.xxhash64(text, ahead, F.lit(5)).alias("digest"),
            text.alias("text"),
        )

    return F.explode(F.filter(F.array(half(F.col("low"), middle), half(middle + 1, F.col("high"))), lambda h: h["windows"] > 0))


def _split(hot: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of ``hot`` (keys with many different texts) by the keys of their halves, and the windows settled there.

    A half whose key is nowhere else has no repeated window and goes; one whose whole text is elsewhere has nothing else;
    of the texts that are, one goes on, for others to be held against. Counts alone decide, so no group is gathered.
    """
    halves = hot.select("id", "hash", "n", "open", _halves(length).alias("half")).select("id", "hash", "n", "open", "half.*")
    halves = scratch.save(halves, "halves")
    least = F.min(F.struct("id", "hash", "start")).alias("of")
    kinds = scratch.save(halves.groupBy("key", "digest").agg(F.sum("n").alias("in_all"), least), "kinds")
    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("in_all").alias("of_key"))
    known = halves.join(kinds, ["key", "digest"])
    done = known.where("open and in_all > 1").selectExpr("id", "hash", "start AS first", "start + windows - 1 AS last")
    more = known.where("struct(id, hash, start) = of").join(keys.where("kinds > 1"), "key")
    more = more.withColumn("open", F.expr("open and in_all = 1")).drop("n", "of", "of_key").withColumnRenamed("in_all", "n")
    return scratch.save(more, "more"), scratch.save(done, "done")


_ITEM = ["id", "hash", "start", "windows", "ahead", "low", "high", "key", "digest", "n", "open", "kinds", "text"]


def repeated_windows(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(id, hash, first, last): windows of ``docs`` (id, hash, text; written or cheap to read) that start at the bytes
    ``first`` to ``last`` and also start elsewhere. A document whose id and hash are those of another is the same text.

    1. Stretches of windows that share their least inner string (``stretches``) are counted by it; equal windows have
       equal ones, so a stretch whose string is nowhere else has no repeated window.
    2. A stretch that is elsewhere as a whole is settled. The others, and one of each of their whole copies, are texts of
       a few hundred bytes, of which each shares its key with at least one different text.
    3. They meet in shards by key. A suffix array of the shard and its common prefixes tell which windows are repeated;
       where a key's texts lie in two shards, the sorted windows of both are merged by binary search.
    Joins with what grows with the corpus shuffle at every size; only the places of step 3's texts are broadcast while they
    are few.

    4. A key with more than GROUP different texts is split by longer strings first, as often as needed (``_split``), so
       that no task gathers a hot key.
    """
    given = docs.select("id", "hash", "text").mapInArrow(
        _stretches(length), "id long, hash long, start long, windows long, ahead long, key long, digest long"
    )
    found = scratch.save(given, "stretches")
    again = scratch.save(found.groupBy("key").count().where("count > 1").select("key"), "again")
    shared = scratch.save(found.join(again, "key", "left_semi"), "shared")
    scratch.drop(found)
    at = F.min(F.struct("id", "hash", "start", "windows", "ahead")).alias("at")
    kinds = scratch.save(shared.groupBy("key", "digest").agg(F.count("*").alias("n"), at), "kinds")

    once = kinds.where("n = 1").select("at.id", "at.hash", "at.start")
    settled = shared.join(once, ["id", "hash", "start"], "left_anti")
    parts = [scratch.save(settled.selectExpr("id", "hash", "start AS first", "start + windows - 1 AS last"), "settled")]

    keys = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    keys = keys.where("kinds > 1 and least = 1").drop("least")
    wanted = kinds.join(keys, "key").select("at.*", "key", "digest", "n", (F.col("n") == 1).alias("open"), "kinds")
    entry = F.struct("start", "windows", "ahead", "key", "digest", "n", "open", "kinds")
    by_text = scratch.save(wanted.groupBy("id", "hash").agg(F.collect_list(entry).alias("wanted")), "wanted")
    cut = F.transform(
        "wanted",
        lambda w: F.struct(w.alias("w"), F.substring(F.col("bytes"), (w["start"] + 1).cast("int"), (w["windows"] + (length - 1)).cast("int")).alias("text")),
    )
    whole = docs.select("id", "hash", F.col("text").cast("binary").alias("bytes"))
    items = whole.join(small(by_text, size=F.size("wanted") * 64 + 32), ["id", "hash"])
    items = items.select("id", "hash", F.explode(cut).alias("c")).select("id", "hash", "c.w.*", "c.text")
    core = max(1, length * 4 // 25)
    items = items.withColumns({"low": F.lit(0).cast("long"), "high": F.lit(length - core).cast("long")}).select(*_ITEM)
    items = scratch.save(items.dropDuplicates(["key", "digest"]), "items")

    calm, hot = [items.where(F.col("kinds") <= GROUP)], items.where(F.col("kinds") > GROUP)
    while not hot.isEmpty():
        more, done = _split(hot, length, scratch)
        parts.append(done)
        calm.append(more.where(F.col("kinds") <= GROUP).select(*_ITEM))
        hot = more.where(F.col("kinds") > GROUP)
    for table in calm[1:]:
        calm[0] = calm[0].unionByName(table)
    dealt = calm[0].select("id", "hash", "start", "key", "digest", "open", "text").repartition("key").sortWithinPartitions("key", "digest")
    searched = dealt.mapInArrow(_searched(length), "id long, hash long, first long, last long")
    parts.append(scratch.save(searched, "searched"))
    out = parts[0]
    for table in parts[1:]:
        out = out.unionByName(table)
    return out


def _spans(found: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(found):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last + length)
        else:
            out.append((first, last + length))
    return out


def _with_spans(docs: DataFrame, scratch: Scratch, length: int) -> tuple[DataFrame, str]:
    """``docs`` (doc_id, text and more) with the windows repeated in each text, and the name of their column."""
    key, digest, found = (inner_name(docs, name) for name in ("repeat_id", "repeat_hash", "repeat_found"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), digest: F.xxhash64(text)})
    places = repeated_windows(keyed.select(F.col(key).alias("id"), F.col(digest).alias("hash"), text.alias("text")), scratch, length)
    by_text = places.groupBy(F.col("id").alias(key), F.col("hash").alias(digest)).agg(F.collect_list(F.struct("first", "last")).alias(found))
    by_text = scratch.save(by_text, "by_text")
    return keyed.join(by_text, [key, digest], "left").drop(key, digest), found


def repeated_bytes(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id long, text; more columns are
    ignored): its bytes in UTF-8, those covered by a string of ``length`` bytes that also starts anywhere else, in the
    same document or another, the maximal runs of those, and the digest of the others.

    Whole texts are read; a null one is empty. Rows that repeat a text are copies of each other, with or without equal
    ids, so all their windows are repeated. An empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, found in zip(batch.column("text").cast(pa.binary()), batch.column("found")):
                raw, spans = raw.as_py() or b"", _spans([(f["first"], f["last"]) for f in found.as_py() or ()], length)
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked, found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, length)
    marked = marked.withColumnRenamed(found, "found")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """``docs`` with the bytes that ``repeated_bytes`` counts taken out of ``text``; what a cut leaves of a character that
    it tears goes too. Null texts stay null; other columns stay as they are."""
    marked, found = _with_spans(docs, scratch, length)

    def kept(raw, found):
        out, at = [], 0
        for s, e in _spans([(f["first"], f["last"]) for f in found or ()], length):
            out.append(raw[at:s])
            at = e
        return None if raw is None else b"".join([*out, raw[at:]]).decode("utf-8", "ignore")

    cut = F.udf(kept, "string")(F.col("text").cast("binary"), F.col(found))
    return marked.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
