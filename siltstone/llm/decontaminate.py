"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, drop_rows, small


def _words(text: Column) -> Column:
    """Lower-cased words between white space; none for a null or blank text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def _runs(words: str, values: str, width: int, join: str) -> Column:
    """``join`` over each run of ``width`` entries of ``values``; over all of them if ``words`` has fewer, but some."""
    run = join.format(", ".join(f"{values}[i + {j}]" for j in range(width)))
    return F.expr(
        f"CASE WHEN size({words}) >= {width} THEN transform(sequence(0, size({words}) - {width}), i -> {run}) "
        f"WHEN size({words}) > 0 THEN array({join.format(f'array_join({words}, chr(32))')}) END"
    )


def _hashes(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (…, words) with the hash of each shingle in place of the words; shorter texts as one shingle."""
    rest = [c for c in docs.columns if c != "words"]
    hashed = docs.select(*rest, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("of_words"))
    return hashed.select(*rest, _runs("words", "of_words", width, "xxhash64({})").alias("hashes"))


def _shingles(width: int) -> Column:
    return F.array_distinct(F.coalesce(_runs("words", "words", width, "concat_ws(chr(32), {})"), F.array().cast("array<string>")))


def _each(hashed: DataFrame) -> DataFrame:
    """A row for each of the ``hashes``. A plain explode would have Spark filter on the array's size first, and so
    compute the array a second time, with the words anew for each shingle."""
    rest = [c for c in hashed.columns if c != "hashes"]
    return hashed.select(*rest, F.explode_outer("hashes").alias("hash")).where("hash is not null")


def item_sketches(items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(item_id, hash) of the MinHash sketches of benchmark items (item_id, words).

    Items are partitioned by size: those with 2**c to 2**(c+1) - 1 shingles share a sketch length k, the most shingles
    that any of them may lack at ``percent`` containment, plus one. The sketch holds the k smallest hashes. A text
    that contains the item lacks fewer than k of its shingles, so it has at least one of any k: the search over
    sketches loses nothing.
    """
    hashed = _hashes(items, width).withColumn("hashes", F.array_sort(F.array_distinct("hashes")))
    top = F.expr("cast(pow(2, floor(log2(size(hashes))) + 1) as int) - 1")
    length = F.expr(f"cast(floor(top * {100 - percent} / 100) as int) + 1")
    sketch = F.slice("hashes", F.lit(1), length)
    return _each(hashed.withColumn("top", top).select("item_id", sketch.alias("hashes")))


def contaminated(
    docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the benchmark items that documents contain.

    ``docs`` has doc_id and text, ``items`` item_id and text; more columns are ignored. A document contains an item if
    100 * shared >= ``percent`` * the item's distinct ``width``-word shingles, over the document's whole text. Words
    are lower-cased and end at white space; of a text with fewer words, the whole sequence is its one shingle.

    Every shingle of every document is looked up among the items' sketches (see ``item_sketches``). The pairs found
    are written; the texts of their documents alone are read again and compared shingle by shingle. Sketches, pairs
    and items are broadcast if they are few, items also by their bytes, and else joined by a shuffle.

    Rows with a null id or no words contain nothing and are contained in nothing. Rows that repeat an id count as
    separate texts, and equal pairs come once, with the largest n_shared. Empty tables give an empty result.
    """
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    words = texts.select("doc_id", _words(F.col("text")).alias("words"))
    known = items.select("item_id", _words(F.col("text")).alias("words")).where("item_id is not null")
    sketches = scratch.save(item_sketches(known, width, percent), "sketches")
    looked_up = _each(_hashes(words, width))
    pairs = scratch.save(looked_up.join(small(sketches), "hash").select("doc_id", "item_id").distinct(), "pairs")

    item_sets = known.select("item_id", _shingles(width).alias("item_shingles"))
    item_sets = scratch.save(item_sets, "items").where("size(item_shingles) > 0")
    suspects = texts.join(small(pairs), "doc_id").select("doc_id", "item_id", _words(F.col("text")).alias("words"))
    suspects = suspects.select("doc_id", "item_id", _shingles(width).alias("shingles"))
    bytes_of = F.aggregate("item_shingles", F.lit(0), lambda n, x: n + F.length(x) + 16)
    both = suspects.join(small(item_sets, size=bytes_of), "item_id")
    shared = F.size(F.array_intersect("item_shingles", "shingles")).cast("long")
    compared = both.select("doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_item"), shared.alias("n_shared"))
    found = compared.where(f"100 * n_shared >= {percent} * n_item")
    return found.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def decontaminate(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; rows with a null doc_id or text stay."""
    ids = contaminated(docs, items, scratch, width, percent).select("doc_id").distinct()
    return drop_rows(docs, scratch.save(ids, "contaminated"))
