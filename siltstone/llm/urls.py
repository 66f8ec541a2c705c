"""URL filters: host and path rules, and exact membership in a host list by a cascade of Bloom filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, inner_name
from siltstone.llm.shingles import U, constants, mix, word_hashes

#: Keys that share a cascade; the universe is dealt over as many cascades as this asks for.
SHARD_KEYS = 100_000
#: Bytes of cascades that are broadcast; larger lists go to the keys by a shuffle on the shard.
BROADCAST_BYTES = 64 << 20

#: (verdict, host suffix, path prefix): fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, and the path
    that follows up to ``?``, ``#`` or the end; both empty without ``://`` or with a null url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The name (host and path) and verdict of the longest rule that fits, else null. A rule fits its host and all
    subdomains, if the path starts with the rule's; of equally long rules the first in the list wins."""

    def fits(rule: tuple[str, str, str]) -> Column:
        return ((host == rule[1]) | F.endswith(host, F.lit(f".{rule[1]}"))) & F.startswith(path, F.lit(rule[2]))

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = F.coalesce(*(F.when(fits(r), F.lit(r[1] + r[2])) for r in ordered), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(fits(r), F.lit(r[0])) for r in ordered), F.lit(None).cast("string"))
    return name, verdict


def _hash(keys: list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each whole key, white space included; the seed is put before the key."""
    raw = [k.encode("utf-8", "surrogatepass").translate(HIDE) for k in keys]
    words, edge = word_hashes([b"\xff" * (seed + 1) + r for r in raw])
    return words[edge[:-1]]


#: White space bytes and the bytes that UTF-8 never has, so that a key hashes as one word.
HIDE = bytes.maketrans(b" \t\n\x0b\x0c\r", b"\xf8\xf9\xfa\xfb\xfc\xfd")


def _bits(hashes: np.ndarray, level: int, size: int, k: int) -> np.ndarray:
    """The ``k`` bit positions of each key in the filter of a level; every level hashes anew."""
    one, two = constants(40 + level, 2)
    a, b = mix(hashes * one), mix(hashes * two) | U(1)
    return ((a[:, None] + b[:, None] * np.arange(k, dtype=U)) % U(size)).astype(np.int64)


def _inside(filters: list[tuple[int, int, np.ndarray]], hashes: np.ndarray) -> np.ndarray:
    """Membership by the cascade: the parity of the first level that lacks the key, or of the number of levels."""
    depth = np.full(len(hashes), len(filters))
    left = np.arange(len(hashes))
    for level, (size, k, packed) in enumerate(filters):
        at = _bits(hashes[left], level, size, k)
        there = ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        depth[left[~there]] = level
        left = left[there]
    return depth % 2 == 1


def build_cascade(listed: np.ndarray, other: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Bloom filters (bits, hashes, packed bits) that tell ``listed`` from ``other`` without error.

    Level 0 encodes the listed keys, each further level those of the opposite side that the level before it let
    through, until none is left. The first level admits about a listed key's number of others, the next ones half.
    """
    filters: list[tuple[int, int, np.ndarray]] = []
    inside, outside = listed, other
    while len(inside):
        level = len(filters)
        rate = 0.5 if level else min(0.5, max(1e-6, len(inside) / max(1, len(outside))))
        k = max(1, round(-np.log2(rate)))
        size = max(8, int(np.ceil(len(inside) * k / np.log(2))))
        bits = np.zeros(-(-size // 8) * 8, dtype=np.uint8)
        bits[_bits(inside, level, size, k).ravel()] = 1
        packed = np.packbits(bits, bitorder="little")
        filters.append((size, k, packed))
        at = _bits(outside, level, size, k)
        through = ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        inside, outside = outside[through], inside
    return filters


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    seed, hashes = 0, _hash(keys["key"].tolist())
    while len(np.unique(hashes)) != len(hashes):
        seed, hashes = seed + 1, _hash(keys["key"].tolist(), seed + 1)
    is_listed = keys["listed"].to_numpy(dtype=bool)
    filters = build_cascade(hashes[is_listed], hashes[~is_listed])
    shard = int(keys["shard"].iloc[0])
    rows = [(shard, i, size, k, seed, bits.tobytes()) for i, (size, k, bits) in enumerate(filters)]
    return pd.DataFrame(rows, columns=["shard", "level", "size", "hashes", "seed", "bits"])


def cascades(universe: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(shard, level, size, hashes, seed, bits) of cascades over ``universe`` (key string, listed boolean), and their number.

    Keys are distinct and not null. They are dealt over shards by a hash, about SHARD_KEYS to each, so every shard is
    built in one bounded task, whatever the number of keys. A shard two of whose keys share a hash is hashed again with
    the next seed.
    """
    shards = max(1, -(-universe.count() // SHARD_KEYS))
    dealt = universe.withColumn("shard", F.expr(f"pmod(xxhash64(key), {shards})"))
    kind = "shard long, level int, size long, hashes int, seed int, bits binary"
    return scratch.save(dealt.groupBy("shard").applyInPandas(_build, kind), "cascades"), shards


def _by_shard(table: pd.DataFrame) -> dict[int, tuple[int, list[tuple[int, int, np.ndarray]]]]:
    """The seed and the filters of each shard."""
    out: dict[int, tuple[int, list[tuple[int, int, np.ndarray]]]] = {}
    for r in table.sort_values(["shard", "level"]).itertuples():
        levels = out.setdefault(int(r.shard), (int(r.seed), []))[1]
        levels.append((int(r.size), int(r.hashes), np.frombuffer(r.bits, dtype=np.uint8)))
    return out


def listed_by_cascade(rows: DataFrame, key: str, filters: DataFrame, shards: int, out: str) -> DataFrame:
    """``rows`` with the boolean column ``out``: whether the cascades list their key. Null keys are not listed.

    Exact for every key of the universe that the cascades were built over. Cascades of up to BROADCAST_BYTES are
    broadcast and no row moves; larger ones meet the distinct keys of their shard in a shuffle.
    """
    shard = F.expr(f"pmod(xxhash64(`{key}`), {shards})")
    size = filters.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        shared = rows.sparkSession.sparkContext.broadcast(_by_shard(filters.toPandas()))

        @F.pandas_udf("boolean")
        def is_listed(keys: pd.Series, shard_of: pd.Series) -> pd.Series:
            got = pd.Series(False, index=keys.index)
            uniques, codes = np.unique(keys.fillna("").to_numpy(dtype=object).astype(str), return_inverse=True)
            first = pd.Series(shard_of.to_numpy()).groupby(codes).first().to_numpy()
            answer = np.zeros(len(uniques), dtype=bool)
            for s in np.unique(first):
                if s in shared.value:
                    seed, levels = shared.value[s]
                    answer[first == s] = _inside(levels, _hash(uniques[first == s].tolist(), seed))
            got[:] = answer[codes] & keys.notna().to_numpy()
            return got

        return rows.withColumn(out, is_listed(F.col(key), shard))
    name = inner_name(rows, "key")

    def judge(keys: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        seed, levels = next(iter(_by_shard(parts).values()), (0, []))
        return pd.DataFrame({name: keys[name], out: _inside(levels, _hash(keys[name].tolist(), seed))})

    keys = rows.select(F.col(key).alias(name)).where(F.col(name).isNotNull()).distinct()
    keys = keys.withColumn("shard", F.expr(f"pmod(xxhash64(`{name}`), {shards})"))
    both = keys.groupBy("shard").cogroup(filters.groupBy("shard"))
    answers = both.applyInPandas(judge, f"`{name}` string, `{out}` boolean")
    joined = rows.join(answers, F.col(key) == F.col(name), "left").drop(name)
    return joined.withColumn(out, F.coalesce(out, F.lit(False)))


def judge_pages(
    pages: DataFrame,
    listed_hosts: DataFrame,
    scratch: Scratch,
    rules: list[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed, in place of columns of those names.

    The verdict is that of the longest rule that fits (see ``rule_for``), else block if ``listed_hosts`` (host) has
    the page's host, else allow. Membership is exact: the cascades' universe is every host of ``pages`` and of the list,
    collected by one grouping.

    A null url, or one without ``://``, has an empty host and path. Repeated rows are judged alike; nulls and
    repetitions in ``listed_hosts`` are passed over. An empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "listed")]
    parsed = pages.select(*rest, host.alias("host"), path.alias("path"))
    hosts = pages.select(host.alias("key"), F.lit(False).alias("listed"))
    named = listed_hosts.select(F.col("host").alias("key"), F.lit(True).alias("listed")).where("key is not null")
    universe = hosts.unionByName(named).groupBy("key").agg(F.max("listed").alias("listed"))
    universe = scratch.save(universe, "universe")
    filters, shards = cascades(universe, scratch)
    judged = listed_by_cascade(parsed, "host", filters, shards, "listed")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, method))
