"""Atomic facts: long records are split into facts of one sentence or line each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text


def facts(memories: DataFrame, chars: int = 600, most: int = 12) -> DataFrame:
    """(id, place, fact, fact_hash): the facts of records (id, kind, content) that should be split.

    Lines are facts; of a text of one line, sentences are. Facts of 50 to 520 characters with a word count; of equal
    ones the first does, and the first ``most`` of a record do.
    """
    long_ones = memories.where(text.should_split(F.col("content"), F.col("kind"), chars))
    lines = F.filter(F.transform(F.split("content", "\n"), _tidy), lambda x: x != "")
    parts = F.when(F.size(lines) > 1, lines).otherwise(
        F.transform(F.regexp_extract_all("content", F.lit("[^。.!?\n]+[。.!?]?"), F.lit(0)), _tidy)
    )
    each = long_ones.select("id", F.posexplode(parts).alias("place", "fact"))
    good = each.where(F.length("fact").between(50, 520) & F.col("fact").rlike(r"[\p{L}\p{N}_]{4,}"))
    hashed = good.withColumn("fact_hash", text.fact_hash(F.col("id"), F.col("fact")))
    once = hashed.groupBy("id", "fact_hash").agg(F.min(F.struct("place", "fact")).alias("f")).select("id", "f.*", "fact_hash")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("place"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def _tidy(part):
    """A line without its bullet and with single blanks."""
    bare = F.regexp_replace(part, r"^\s*(?:[-*]|[0-9]+[.)])?\s*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ -]+|[ -]+$", "")


def title(fact):
    """The start of a fact as its title."""
    return F.when(F.length(fact) > 88, F.concat(F.rtrim(F.substring(fact, 1, 88)), F.lit("..."))).otherwise(fact)


def child_links(found: DataFrame) -> DataFrame:
    """(source, target, relation_type): each fact is part of its record, and supports it."""
    relations = F.explode(F.array(F.lit("part_of"), F.lit("supports")))
    return found.select(F.col("fact_hash").alias("source"), F.col("id").alias("target"), relations.alias("relation_type"))


def duplicate_facts(found: DataFrame) -> DataFrame:
    """(fact, n, first_id) of facts that several records share."""
    return found.groupBy("fact").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first_id")).where("n > 1")
