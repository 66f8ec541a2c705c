"""Bounded samples of labelled documents, and which rows are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


#: Characters of a sample at most, whatever the number of its documents.
CHARS = 256 << 20


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(-1))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int, scratch: Scratch
) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents: those whose ids have the smallest hashes among the rows of
    ``labels`` (doc_id, ``label`` 0 or 1) that satisfy ``keep``, up to CHARS characters in all, by that order. Null
    labels are passed over; if ids repeat, the largest label and the smallest text count. The table is written, because
    training reads it several times."""
    known = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = scratch.save(once.select("text", "label", F.xxhash64("doc_id").alias("place"), F.length("text").alias("chars")), "sample")
    if (sample.agg(F.sum(F.col("chars").cast("long"))).first()[0] or 0) > CHARS:
        total = 0
        for r in sample.select("place", "chars").orderBy("place").collect():
            total += r["chars"]
            if total > CHARS:
                sample = sample.where(F.col("place") < r["place"])
                break
    return sample.select("text", "label")
